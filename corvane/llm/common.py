"""Helpers that the operators share: tables in the shared folder, Arrow batches and fixed-size sketches."""

from __future__ import annotations

import ctypes
import gc
import os
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import forget, shared_folder, stored

__all__ = ["forget", "shared_folder", "stored"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Nodes up to which labels (two numbers each) are broadcast.
BROADCAST_LABELS = 500_000


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is: the join then shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame, folder: str) -> DataFrame:
    """The connected components of edges (a, b: long): a row (node, label) for each node of an edge, label its smallest reachable node.

    Every round takes the least label of the neighbours and then the label of that label, by joins and
    partial minima, and ends as a table in the shared folder; it stops when no label changes. Labels are
    broadcast up to BROADCAST_LABELS nodes; beyond, the joins shuffle, and a hub's rows are dealt anew as a skewed join.
    """
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), folder, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), folder, "labels")
    side = F.broadcast if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else lambda df: df
    while True:
        near = both.join(side(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hop = near.join(side(labels), "node").select("node", F.col("label").alias("before"), F.least("label", "m").alias("at"))
        up = side(labels.select(F.col("node").alias("at"), F.col("label").alias("up")))
        after = stored(hop.join(up, "at", "left").select("node", "before", F.least("at", "up").alias("label")), folder, "labels")
        done = after.where("before <> label").limit(1).count() == 0
        forget(labels)
        labels = after
        if done:
            forget(both)
            return after.select("node", "label")


def joined_components(labels: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """labels (node, label) after more edges (a, b): only components that the new edges join are looked at again."""
    known = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    ends = edges.join(known("a"), "a", "left").join(known("b"), "b", "left")
    ends = stored(ends.select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y")).where("x <> y"), folder, "ends")
    if ends.limit(1).count() == 0:
        return labels
    after = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), folder).select(F.col("node").alias("label"), F.col("label").alias("now"))
    new = ends.select(F.col("a").alias("node"), F.col("x").alias("label")).union(ends.select("b", "y")).where("node = label").distinct()
    every = labels.unionByName(new.join(labels.select("node"), "node", "left_anti"))
    return stored(every.join(after, "label", "left").select("node", F.coalesce("now", "label").alias("label")), folder, "labels")


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n: the folds of labelled rows."""
    return F.crc32(column.cast("string").cast("binary")) % n


def bounded_sample(ids: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, the first by a hash of the key: the same ones on every run."""
    return ids.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch's texts and their n + 1 offsets; a null text is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19, rows: int = 2048):
    """A batch cut into runs of at most so many rows with about so many bytes of text, so that working arrays stay small."""
    offsets = text_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def tidied(run):
    """An Arrow function that gives freed memory back when its task ends: workers are reused by later stages."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_BASE = 0x9E6D62D06F6A9A9B
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        tables = []
        for base in (_BASE, _INVERSE):
            p = np.ones(size, dtype=np.uint64)
            filled, factor = 1, base
            while filled < size:  # doubling: p[filled:2*filled] = p[:filled] * base^filled
                more = min(filled, size - filled)
                p[filled : filled + more] = p[:more] * U(factor)
                factor = factor * factor % (1 << 64)
                filled += more
            tables.append(p)
        _powers[:] = tables
    return _powers[0], _powers[1]


#: White space of the word rule [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: What separates words of letters and digits: every other ASCII character.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts of a batch, and each text's first word (n + 1 entries). No word crosses two texts."""
    inside = ~separators[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z read as a-z: a polynomial of its bytes, by prefix sums over the batch."""
    return span_hashes(data, [(starts, ends)])[0]


def span_hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], fold: np.ndarray = LOWER) -> list[np.ndarray]:
    """word_hashes of several lists of spans (starts, ends) of the same bytes, each read as fold has it."""
    if not len(data):
        return [np.zeros(len(s), dtype=np.uint64) for s, _ in spans]
    powers, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[fold[data]] * powers[: len(data)], out=sums[1:])
    return [mix64((sums[ends] - sums[starts]) * inverse[starts]) for starts, ends in spans]


def small_fold(column, n: int, out: int):
    """True for the rows held out of training: the remainder of the id's crc32 is out."""
    return F.coalesce(crc_mod(column, n) == out, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int, out: int, most: int) -> DataFrame:
    """doc_id, text and label (int) of the documents of at most so many labelled ids outside the held-out fold, the first by a hash of the id.

    Of several labels of an id the largest counts. The number of ids is bounded, so they are broadcast; texts stay
    where they are read. Ids may repeat: what is made of the rows goes through ``first_rows``.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = bounded_sample(ids.where(~small_fold(F.col("doc_id"), n, out)), "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def first_rows(rows: DataFrame, most: int, *tie: str) -> DataFrame:
    """At most so many rows, the first by a hash of doc_id: what reaches the driver is bounded however often an id repeats.

    The repartition keeps the merge of the tasks' first rows off the driver.
    """
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", *tie).limit(most).repartition(1)


def shipped(spark: SparkSession, path: str):
    """Sends a file of the driver to all executors; a function that gives its place in a task."""
    context, sent = spark.sparkContext, path
    if path not in getattr(context, "_corvane_files", set()):
        context.addFile(path)
        context._corvane_files = {*getattr(context, "_corvane_files", set()), path}

    def place() -> str:
        from pyspark import SparkFiles

        own = SparkFiles.get(os.path.basename(sent))
        return own if os.path.exists(own) else sent

    return place
