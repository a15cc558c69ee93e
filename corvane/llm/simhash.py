"""Document fingerprints: SimHash over weighted terms, and a radius search by permuted block tables.

The terms of a text are its distinct words (weight 1) and distinct adjacent
pairs of words (weight 2), A-Z read as a-z. Each term's 128-bit hash votes on
every bit; a bit is set where the votes for it win. Votes are counted by the
bytes of the hashes, one histogram a byte, so no term-by-bit matrix is made.

``within_radius`` cuts fingerprints into radius + 1 blocks: two within the
radius agree on one block at least, so every table joins on one block, and the
exact distance decides. Where a block's value is common, the rest of the
fingerprint is cut and joined in the same way, so that such rows meet only where
two blocks agree.

Defined results: null and empty texts have the fingerprint of no terms (all
zero); equal texts have equal fingerprints; likeness is 1 - distance / 128. Rows
of one id, or without an id (last), follow each other by a hash of their text;
repeated rows each have a result. Columns beyond doc_id and text are not read;
an empty table gives no rows, and a single row is followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U, mix64, shared_folder, slices, small, stored, text_bytes, tidied, word_hashes, words

BITS = 128
#: Fingerprints that share a block's value beyond which it is common, and common values up to which they are broadcast.
COMMON, BROADCAST_VALUES = 1_000, 200_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((of.astype(np.uint64) << U(44)) | (h >> U(20)))
    return mix64(keys & U((1 << 44) - 1)), (keys >> U(44)).astype(np.int64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """BITS / 8 bytes for each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    one, by_one = _distinct(h, of)
    pair = of[1:] == of[:-1]
    two, by_two = _distinct(mix64(h[:-1] * U(3) + h[1:])[pair], of[1:][pair])
    out = np.zeros((n, BITS // 8), dtype=np.uint8)
    half = (np.bincount(by_one, minlength=n) + 2 * np.bincount(by_two, minlength=n)) / 2
    wide = [(np.concatenate([x.view(np.uint8).reshape(-1, 8), mix64(x + U(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8)], axis=1), d * 256) for x, d in ((one, by_one), (two, by_two))]
    for j in range(BITS // 8):
        a, b = (np.bincount(d + x[:, j], minlength=n * 256).reshape(n, 256) for x, d in wide)
        out[:, j] = np.packbits((a + 2 * b) @ _BYTE_BITS > half[:, None], axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([x.tobytes().hex() for x in fingerprints(some.column("text"))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, fingerprint string")


def _cut(text: Column, length: int, parts: int) -> Column:
    """A string of that length cut into so many parts."""
    cuts = [(2 * i * length + parts) // (2 * parts) for i in range(parts + 1)]
    return F.array(*(F.substring(text, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)))


def within_radius(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints (column fingerprint) whose distance is at most radius.

    Equal fingerprints are one row first; rows of a fingerprint are found by joining it.
    """
    nibbles, parts = BITS // 4, radius + 1
    every = prints.select("fingerprint").where("fingerprint is not null").distinct()
    tables = every.select("fingerprint", F.posexplode(_cut(F.col("fingerprint"), nibbles, parts)).alias("block", "value"))
    common = tables.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("block", "value", F.lit(True).alias("common"))
    tables = tables.join(small(common, BROADCAST_VALUES), ["block", "value"], "left")
    width = F.length("value")
    before = F.expr(f"cast((2 * block * {nibbles} + {parts}) div {2 * parts} as int)")
    rest = F.concat(F.substring(F.col("fingerprint"), F.lit(1), before), F.substring(F.col("fingerprint"), before + width + 1, F.lit(nibbles)))
    least = nibbles - -(-nibbles // parts)
    again = tables.where("common").withColumn("rest", rest).select("fingerprint", "block", "value", F.posexplode(_cut(F.col("rest"), least, parts)).alias("block2", "value2"))
    rows = tables.where("common is null").select("fingerprint", "block", "value", F.lit(-1).alias("block2"), F.lit("").alias("value2")).unionByName(again)
    distance = sum(
        F.bit_count(F.conv(F.substring("a", i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", i, 8), 16, 10).cast("long")))
        for i in range(1, nibbles, 8)
    )
    pairs = rows.withColumnRenamed("fingerprint", "a").join(rows.withColumnRenamed("fingerprint", "b"), ["block", "value", "block2", "value2"])
    pairs = pairs.where("a < b").withColumn("distance", distance).where(F.col("distance") <= radius)
    return pairs.select("a", "b", "distance").distinct()


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGE = [("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string())]


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Result rows of all texts but the last, each with the next one."""
    prints = fingerprints(pa.array(texts, pa.large_string()))
    edited = []
    for t, follow in zip(texts[:-1], texts[1:], strict=True):
        m = len(t) // 3
        edited.append(t[: len(t) - m] + follow[:m] if m else t)
    also = fingerprints(pa.array(edited, pa.large_string()))
    hexed = lambda x: pa.array([r.tobytes().hex() for r in x], pa.string())
    columns = [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64())]
    columns += [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), hexed(prints[:-1]), hexed(also)]
    columns += [pa.array(likeness(prints[:-1], also)), pa.array(likeness(prints[:-1], prints[1:]))]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(edited), k) for _, k in _EDGE], names=[n for n, _ in _RESULT + _EDGE])


def _edge(doc_id, part: int, last: bool, text: str) -> pa.RecordBatch:
    values = {"doc_id": doc_id, "part": part, "last": last, "text": text}
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in _RESULT + _EDGE], names=[n for n, _ in _RESULT + _EDGE])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: every row with the next one; its first and last row go out whole, for the seams."""
    from pyspark import TaskContext

    part, ids, texts = TaskContext.get().partitionId(), [], []
    for batch in batches:
        for some in slices(batch, "text"):
            if not texts:
                ids, texts = [some.column("doc_id")[0].as_py()], [some.column("text")[0].as_py() or ""]
                yield _edge(ids[0], part, False, texts[0])
                some = some.slice(1)
            ids += some.column("doc_id").to_pylist()
            texts += [t or "" for t in some.column("text").to_pylist()]
            if len(texts) > 1:
                yield _compared(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
    if texts:
        yield _edge(ids[0], part, True, texts[0])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of the last row of a partition, from the first row of the next one."""
    for batch in batches:
        for i in range(batch.num_rows):
            one, two, text, follow = (batch.column(c)[i].as_py() for c in ("doc_id", "doc_id2", "text", "text2"))
            yield _compared([one, two], [text, follow]).select([n for n, _ in _RESULT])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, and that of its text with the last third replaced from the next row by descending doc_id.

    Rows are range-partitioned and sorted; only the first and last row of each partition meet again, by the
    partitions' numbers, each pair on its own. The first row follows the last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("row")]
    parts = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = stored(ordered.mapInArrow(tidied(_neighbours), f"{schema}, part int, last boolean, text string"), shared_folder(spark), "prints")
    ends = found.where("part is not null").select("doc_id", "part", "last", "text")
    # One number for each partition: bounded by the number of partitions.
    numbers = sorted(r["part"] for r in ends.where("last").select("part").collect())
    follows = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "part int, next int")
    first = ends.where("not last").select(F.col("part").alias("next"), F.col("doc_id").alias("doc_id2"), F.col("text").alias("text2"))
    seams = ends.where("last").join(F.broadcast(follows), "part").join(first.hint("merge"), "next").select("doc_id", "text", "doc_id2", "text2")
    return found.where("part is null").select([n for n, _ in _RESULT]).unionByName(seams.mapInArrow(tidied(_seams), schema))
