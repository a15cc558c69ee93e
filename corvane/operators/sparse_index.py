"""A sparse index on disk: postings in small blocks, in segments that follow their collection.

A chunk's terms are counted where its text is read. Some chunks of alike roles and lengths
make a block; a block's postings of one term are one row, with the greatest count and the
least length among them, from which a bound of any score follows without a look at the
postings. Rows go to folders by a hash of their term, so that a query reads its terms'
folders only, and a search reads the bounds first.

Chunks are rows (chunk: long, text, allowed_roles, source_path, section_path). An index is a
folder of segments, tombstones and numbered versions; a version names the segments and
tombstones that count. Changes write a new segment of new and changed chunks and tombstones
of changed and vanished ones; compaction writes one segment of what lives. A version is
written once, so readers of an older one are not disturbed and the later of two writers fails.

Row of an index: segment, bucket, block, term (null: the row that lists all chunks of the
block), roles (bits of all roles that may see one of them), masks (chunks and lengths by
mask), max_tf, min_dl, docs (chunk, mask, dl, tf).
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.access import ROLES, role_bit, role_mask
from corvane.functions.text import runs
from corvane.storage import latest, published, shared_folder, stored

K1, B = 1.5, 0.75
#: Chunks of a block; folders of terms; chunks that a task writes, where whole files allow it; bytes that it gathers for a folder before it writes them.
BLOCK, BUCKETS, PART, GATHERED = 8, 64, 50_000, 4 << 20
#: Rows up to which a side is broadcast: query terms, pairs of a query and a block, runs of ids; blocks with tombstones, of at most as many ids as a block has.
SIDE, HIT = 200_000, 500_000
#: The share of a query's postings, its rarest terms, that is scored before chunks are left out; leading chunks for each result that are then scored in full, for a threshold.
CUT, LEAD = 0.15, 4
#: Query terms of a batch up to which parts of the index are scored for all its queries at once; postings of such a part (of the role that sees most), and scores or summands that a task holds at a time.
ASKED, HELD, CELLS = 1_000_000, 2_000_000, 2_000_000
_SLACK = 1e-5  # scores are rounded to six digits
_WORD = re.compile(rb"[a-z0-9_]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROW = "block long, term string, roles int, masks array<struct<mask:int,n:long,dl:long>>, max_tf int, min_dl int, docs array<struct<chunk:long,mask:int,dl:int,tf:int>>"
SCHEMA = f"segment string, bucket int, {_ROW}"


def bounded(df: DataFrame, most: int = SIDE) -> DataFrame:
    """For broadcast, if it has at most so many rows; else Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def among(rows: DataFrame, ids: DataFrame, how: str, *keys: str) -> DataFrame:
    """A left semi or anti join of rows with ids (chunk, keys), where 64 neighbouring ids are one row of the side: ids that lie close are broadcast, up to 64 * SIDE of them."""
    run, bit = "shiftright(bigint(chunk), 6)", "shiftleft(1L, int(bigint(chunk) & 63))"
    side = ids.groupBy(F.expr(run).alias("_run"), *(F.col(c).alias(f"_{c}") for c in keys)).agg(F.expr(f"bit_or({bit})").alias("_bits"))
    return rows.join(bounded(side, SIDE), F.expr(" and ".join([f"{run} = _run", f"_bits & {bit} != 0", *(f"{c} = _{c}" for c in keys)])), how)


def ascii_words(text: str | None, pattern: re.Pattern = re.compile(rb"[a-z0-9]+")) -> Counter:
    """Runs of ASCII letters and digits of a text, lower-cased, with their numbers."""
    return Counter(pattern.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)))


def _lists(starts: np.ndarray, end: int, **columns: np.ndarray) -> pa.Array:
    """Runs of rows as lists of structs."""
    values = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(np.append(starts, end).astype(np.int32)), values)


def _packed(chunk: np.ndarray, mask: np.ndarray, dl: np.ndarray, of: np.ndarray, tf: np.ndarray, code: np.ndarray, terms: pa.Array, first: int, size: int) -> pa.RecordBatch:
    """Blocks of some chunks and their postings: the place of a posting's chunk (of), its count (tf) and the place of its term (code)."""
    place = np.empty(len(chunk), dtype=np.int64)
    place[np.lexsort((chunk, dl, mask))] = np.arange(len(chunk))
    # Postings, and for each chunk one without a term.
    of = np.concatenate([np.arange(len(chunk)), of])
    tf, code = np.concatenate([np.zeros(len(chunk), np.int64), tf]), np.concatenate([np.full(len(chunk), -1), code])
    order = np.lexsort((place[of], code, place[of] // size))
    of, tf, code, block = of[order], tf[order], code[order], place[of][order] // size
    row = np.flatnonzero(np.diff(code, prepend=-2) | np.diff(block, prepend=-1))
    n, masks, lengths = len(of), mask[of], dl[of]
    run = np.flatnonzero(np.isin(np.arange(n), row) | (np.diff(masks, prepend=-1) != 0))
    counts = _lists(np.searchsorted(run, row), len(run), mask=masks[run].astype(np.int32), n=np.diff(np.append(run, n)), dl=np.add.reduceat(lengths, run))
    docs = _lists(row, n, chunk=chunk[of], mask=masks.astype(np.int32), dl=lengths.astype(np.int32), tf=tf.astype(np.int32))
    words = terms.take(pa.array(code[row], pa.int64(), mask=code[row] < 0))
    columns = [first + block[row] * size, words, np.bitwise_or.reduceat(masks, row).astype(np.int32), counts, np.maximum.reduceat(tf, row).astype(np.int32), np.minimum.reduceat(lengths, row).astype(np.int32), docs]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["block", "term", "roles", "masks", "max_tf", "min_dl", "docs"])


def _blocks(texts: list[str | None], chunk: np.ndarray, mask: np.ndarray, first: int, size: int) -> pa.RecordBatch:
    found = [ascii_words(t, _WORD) for t in texts]
    dl = np.array([sum(c.values()) for c in found], dtype=np.int64)
    of, tf = np.repeat(np.arange(len(texts)), [len(c) for c in found]), np.array([n for c in found for n in c.values()], dtype=np.int64)
    terms = pa.array([t for c in found for t in c], pa.binary()).dictionary_encode()
    return _packed(chunk, mask, dl, of, tf, terms.indices.to_numpy().astype(np.int64), terms.dictionary.cast(pa.string()), first, size)


def _merged(rows: pa.Table, size: int) -> pa.RecordBatch | None:
    """Blocks of what lives in whole blocks (part, segment, block, term, chunk, tf): listings have mask and dl too, tombstones have no tf."""

    def flat(rows: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
        n = pc.list_value_length(rows["chunk"]).to_numpy()
        values = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("chunk", *names))
        return np.repeat(rows["segment"].to_numpy(), n), *values, np.repeat(np.arange(len(n)), n)

    segment, chunk, mask, dl, _ = flat(rows.filter(rows["mask"].is_valid()), "mask", "dl")
    order = np.lexsort((chunk, segment))
    segment, chunk, mask, dl = (x[order] for x in (segment, chunk, mask, dl))

    def at(of: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of chunks in the listing."""
        out = np.empty(len(ids), np.int64)
        for s in np.unique(of):
            low, high = np.searchsorted(segment, [s, s + 1])
            out[of == s] = low + np.searchsorted(chunk[low:high], ids[of == s])
        return out

    live = np.ones(len(chunk), dtype=bool)
    live[at(*flat(rows.filter(rows["tf"].is_null()))[:2])] = False
    if not live.any():
        return None
    held = rows.filter(rows["term"].is_valid())
    of, ids, tf, row = flat(held, "tf")
    terms, place = held["term"].combine_chunks().dictionary_encode(), at(of, ids)
    some = live[place]
    place, code = (np.cumsum(live) - 1)[place[some]], terms.indices.to_numpy().astype(np.int64)[row[some]]
    return _packed(chunk[live], mask[live], dl[live], place, tf[some], code, terms.dictionary, rows["part"][0].as_py() << 33, size)


def block_rows(chunks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of an index (without segment) of chunks: no shuffle, each text is looked at once, equal terms of a chunk are one posting.

    A block's number is that of its first row in the table, so it is the same when a task is run again.
    """
    rows = chunks.select(F.col("chunk").cast("long").alias("chunk"), role_mask(lambda r: F.array_contains("allowed_roles", r)).alias("mask"), "text", F.monotonically_increasing_id().alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chunk, mask = (batch.column(c).to_numpy() for c in ("chunk", "mask"))
                yield _blocks(batch.column("text").to_pylist(), chunk, mask.astype(np.int64), batch.column("first")[0].as_py(), size)

    out = rows.where("chunk is not null").mapInArrow(run, _ROW)
    return out.withColumn("bucket", bucket(F.col("term")))


def bucket(term: Column) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def postings(rows: DataFrame) -> DataFrame:
    """(chunk, mask, dl, term, tf) of an index; a chunk without terms has no row."""
    return rows.where("term is not null").select("term", F.inline("docs")).select("chunk", "mask", "dl", "term", "tf")


# Segments and versions


@dataclass(frozen=True)
class SparseIndex:
    """A version of an index."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[str, ...]
    dead: tuple[str, ...]

    def _read(self, kind: str, names: tuple[str, ...], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/segment={n}" for n in names))

    def listing(self) -> DataFrame:
        """(segment, chunk, block, checksum) of the chunks that live."""
        every = self._read("listing", self.segments, "segment string, chunk long, block long, checksum string")
        return among(every, self.tombstones(), "left_anti", "segment") if self.dead else every

    def tombstones(self) -> DataFrame:
        """(segment, block, chunk) of the chunks that changed or vanished after their segment was written."""
        rows = self._read("dead", self.dead, "segment string, of string, block long, chunk long")
        return rows.select(F.col("of").alias("segment"), "block", "chunk")

    def rows(self) -> DataFrame:
        """The rows that live: blocks without a tombstone as they are written, the others without the chunks that are dead (of a row, none may be left), with masks of a chunk each."""
        every = self._read("postings", self.segments, SCHEMA)
        if not self.dead:
            return every
        gone = self.tombstones().groupBy("segment", "block").agg(F.collect_list("chunk").alias("gone"))
        whole = F.col("gone").isNull()
        # No filter after the join: query terms, joined to what this returns, then come before it.
        hit = every.join(bounded(gone, HIT), ["segment", "block"], "left")
        hit = hit.withColumn("docs", F.when(whole, F.col("docs")).otherwise(F.filter("docs", lambda x: ~F.array_contains("gone", x["chunk"]))))
        again = {
            "roles": F.aggregate("docs", F.lit(0), lambda a, x: a.bitwiseOR(x["mask"])),
            "masks": F.transform("docs", lambda x: F.struct(x["mask"].alias("mask"), F.lit(1).cast("long").alias("n"), x["dl"].cast("long").alias("dl"))),
            "max_tf": F.array_max("docs.tf"),
            "min_dl": F.array_min("docs.dl"),
        }
        return hit.select(*(F.when(whole, F.col(c)).otherwise(again[c]).alias(c) if c in again else c for c in every.columns))


def checksum(chunks: DataFrame) -> Column:
    """Of all that an index holds of a chunk; it is found where the text is read."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source_path", "section_path", "text")]
    return F.sha2(F.concat_ws("\x1f", *parts, F.array_join(F.array_sort("allowed_roles"), ",")).cast("binary"), 256)


@contextmanager
def _open_folders(spark: SparkSession) -> Iterator[None]:
    """Lets a task write to all folders of terms at once, where Spark would sort its rows by folder first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BUCKETS + 2))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _writers(index: SparseIndex, n: int) -> int:
    """Tasks that write n chunks: each writes a file a folder."""
    return max(2 * index.spark.sparkContext.defaultParallelism, -(-n // PART))


def _segment(index: SparseIndex, rows: DataFrame, sums: DataFrame) -> str:
    """Writes rows and (chunk, checksum) as a segment. Rows go to their folders as they come: a task holds GATHERED bytes a folder, however many rows it writes."""
    name = uuid.uuid4().hex
    with _open_folders(index.spark):
        rows.write.option("parquet.block.size", GATHERED).partitionBy("bucket").parquet(f"{index.path}/postings/segment={name}")
    written = index._read("postings", (name,), SCHEMA).where("bucket = -1").select("block", F.inline("docs")).select("chunk", "block")
    written.join(sums, "chunk").write.parquet(f"{index.path}/listing/segment={name}")
    return name


def _publish(index: SparseIndex, segments: tuple[str, ...], dead: tuple[str, ...]) -> SparseIndex:
    out = SparseIndex(index.spark, index.path, index.version + 1, segments, dead)
    published(index.spark, index.path, out.version, json.dumps({"segments": segments, "dead": dead}))
    return out


def opened(spark: SparkSession, path: str) -> SparseIndex:
    """The latest version of the index at path, from any session; an empty index where nothing was written."""
    version, text = latest(spark, path)
    held = json.loads(text) if text else {"segments": [], "dead": []}
    return SparseIndex(spark, path.rstrip("/"), version, tuple(held["segments"]), tuple(held["dead"]))


def followed(index: SparseIndex, chunks: DataFrame, size: int = BLOCK) -> SparseIndex:
    """The index made equal to a collection: new and changed chunks get a segment, changed and vanished ones a tombstone.

    Of rows with one id the one with the least checksum counts. Only ids and checksums are shuffled; texts of chunks that did not change are read for their checksum and no further.
    """
    named = chunks.where("chunk is not null")
    now = named.select(F.col("chunk").cast("long").alias("chunk"), checksum(chunks).alias("now")).groupBy("chunk").agg(F.min("now").alias("now"))
    if index.segments:
        both = now.join(index.listing(), "chunk", "full").where("not now <=> checksum")
    else:
        both = now.selectExpr("chunk", "now", "string(null) as segment", "bigint(null) as block", "string(null) as checksum")
    both = stored(both, f"{index.path}/changes", "changes")
    dead, fresh = both.where("checksum is not null"), both.where("now is not null").select("chunk", F.col("now").alias("checksum"))
    segments, tombs = index.segments, index.dead
    if dead.limit(1).count():
        tombs += (uuid.uuid4().hex,)
        dead.select(F.col("segment").alias("of"), "block", "chunk").write.parquet(f"{index.path}/dead/segment={tombs[-1]}")
    if fresh.limit(1).count():
        rows, n = among(named, fresh, "left_semi") if segments else named, fresh.count()
        if rows.select("chunk").count() > n:  # repeated ids: the row whose checksum counts, in an order that a task run again finds too
            rows = rows.withColumn("checksum", checksum(rows)).join(bounded(fresh), ["chunk", "checksum"], "left_semi").dropDuplicates(["chunk"]).sortWithinPartitions("chunk")
        segments += (_segment(index, block_rows(rows.coalesce(_writers(index, n)), size), fresh),)
    return index if (segments, tombs) == (index.segments, index.dead) else _publish(index, segments, tombs)


def created(path: str, chunks: DataFrame, size: int = BLOCK) -> SparseIndex:
    """An index of chunks at a new path."""
    return followed(opened(chunks.sparkSession, path), chunks, size)


def compacted(index: SparseIndex, size: int = BLOCK) -> SparseIndex:
    """One segment of all that lives, without tombstones; blocks are filled again, texts are not needed.

    Rows are shuffled once, as they are: whole blocks, with their tombstones, go to parts of about HELD words, and a task
    makes new blocks of the chunks of a part that live.
    """
    every, sums = index._read("postings", index.segments, SCHEMA), index.listing().select("chunk", "checksum")
    number = F.array_position(F.array(*map(F.lit, index.segments)), F.col("segment")).cast("int").alias("segment")
    # A posting's mask and length are those that its block lists.
    listed = F.when(F.col("term").isNull(), F.col("docs"))
    held = every.select(number, "block", "term", F.col("docs.chunk").alias("chunk"), F.col("docs.tf").alias("tf"), listed["mask"].alias("mask"), listed["dl"].alias("dl"))
    none = (F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("tf", "mask", "dl"))
    dead = index.tombstones().select(number, "block", F.lit(None).cast("string").alias("term"), F.array("chunk").alias("chunk"), *none)
    words = every.where("bucket = -1").select(F.inline("masks")).agg(F.sum("dl")).first()[0] or 0
    dealt = held.union(dead).repartition(max(1, -(-words // HELD)), "segment", "block").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        out = _merged(pa.Table.from_batches(found), size) if sum(x.num_rows for x in found) else None
        for at in range(0, out.num_rows if out else 0, 100_000):
            yield out.slice(at, 100_000)

    rows = dealt.mapInArrow(run, _ROW).withColumn("bucket", bucket(F.col("term"))).coalesce(_writers(index, sums.count()))
    return _publish(index, (_segment(index, rows, sums),), ())


# Scores


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, role, term, times): repeated terms count repeatedly."""
    return queries.select("query_id", "role", F.explode(runs("query")).alias("term")).groupBy("query_id", "role", F.lower("term").alias("term")).agg(F.count("*").alias("times"))


def _sees(mask: str = "mask") -> Column:
    return F.col(mask).bitwiseAND(F.col("bit")) != 0


def _of_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of some terms (term), from their folders only."""
    places = [r["b"] for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
    return rows.where(F.col("bucket").isin(places)).join(bounded(terms), "term", "left_semi")


def weights(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, role, bit, term, weight, avgdl, df, late): what a term is worth to a query, by the chunks that its role may see.

    Numbers come from the counts by mask; no posting is read. late: terms beyond the CUT rarest share of the query's postings.
    """
    terms = query_terms(queries).withColumn("bit", role_bit(F.col("role"))).where("bit > 0")
    terms = stored(terms, shared_folder(rows.sparkSession), "terms")  # found once, read by three steps
    roles = F.broadcast(rows.sparkSession.createDataFrame([(r, 1 << i) for i, r in enumerate(ROLES)], "role string, bit int"))
    sizes = rows.where("bucket = -1").select(F.inline("masks")).groupBy("mask").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    stats = sizes.join(roles, _sees()).groupBy("role").agg(F.sum("n").alias("n"), (F.sum("dl") / F.greatest(F.lit(1), F.sum("n"))).alias("avgdl"))
    counts = _of_terms(rows, terms.select("term").distinct()).select("term", F.inline("masks")).groupBy("mask", "term").agg(F.sum("n").alias("df"))
    df = counts.join(roles, _sees()).groupBy("role", "term").agg(F.sum("df").alias("df"))
    found = terms.join(df, ["role", "term"]).join(F.broadcast(stats), "role")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    order = Window.partitionBy("query_id").orderBy("df", "term")  # a row a term of the query
    share = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("df").over(Window.partitionBy("query_id"))
    late = (F.row_number().over(order) > 1) & (share > CUT)
    return found.select("query_id", "role", "bit", "term", (F.col("times") * idf).alias("weight"), "avgdl", "df", late.alias("late"))


def _part(tf: str, dl: str, k1: float, b: float) -> Column:
    return F.col("weight") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.greatest(F.lit(1e-9), F.col("avgdl"))))


def _parts(rows: DataFrame, worth: DataFrame, k1: float, b: float, seen: list[Observation] | None) -> DataFrame:
    """(query_id, role, chunk, part) of postings of some queries' terms."""
    hits = rows.join(bounded(worth), "term").where(_sees("roles"))
    each = hits.select("query_id", "role", "bit", "weight", "avgdl", F.inline("docs")).where(_sees())
    if seen is not None:
        seen.append(Observation())
        each = each.observe(seen[-1], F.count(F.lit(1)).alias("n"))
    return each.select("query_id", "role", "chunk", _part("tf", "dl", k1, b).alias("part"))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "role", "chunk").agg(F.round(F.sum("part"), 6).alias("score"))


def worths(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """weights(), stored: a few rows that all steps of a search read."""
    return stored(weights(rows, queries), shared_folder(rows.sparkSession), "weights")


def scores(rows: DataFrame, worth: DataFrame, k1: float = K1, b: float = B, seen: list[Observation] | None = None) -> DataFrame:
    """(query_id, role, chunk, score) of every visible chunk with a query term."""
    return _summed(_parts(_of_terms(rows, worth.select("term").distinct()), worth, k1, b, seen))


def search(rows: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, role, chunk, score) of chunks among which are the k best of each query."""
    return _leading(rows, worths(rows, queries), k, k1, b, False, None)


def best(rows: DataFrame, worth: DataFrame, k: int, k1: float = K1, b: float = B, seen: list[Observation] | None = None) -> DataFrame:
    """(query_id, role, chunk, score) of chunks among which are the k best of each query, ties by chunk: scores as scores() has them.

    In each part of the index a query's rare terms are scored everywhere. The chunks that lead then are scored in full, which
    gives a score that k chunks reach. A block's bound of the other, common terms comes from its greatest counts; chunks that
    it cannot lift to that score are left out. seen: observations of the number of postings scored.
    """
    return _leading(rows, worth, k, k1, b, True, seen)


def _frame(spark: SparkSession, df, schema: str) -> DataFrame:
    return spark.createDataFrame(list(df.itertuples(index=False, name=None)), schema)


def coded(worth: DataFrame, side) -> tuple[dict[str, np.ndarray], object, DataFrame]:
    """Query terms as arrays with numbers for queries (q) and terms (code), ordered by role and term; (code, term); (q, query_id, role).

    side: the rows of worth (query_id, role, bit, term, weight, avgdl, late) as pandas.
    """
    side = side.assign(q=side.groupby(["query_id", "role"]).ngroup(), code=side.groupby("term").ngroup()).sort_values(["role", "code", "q"])
    kind = worth.schema["query_id"].dataType.simpleString()
    queries = _frame(worth.sparkSession, side.drop_duplicates("q")[["q", "query_id", "role"]], f"q int, query_id {kind}, role string")
    return {c: side[c].to_numpy() for c in ("bit", "code", "q", "weight", "avgdl", "late")}, side.drop_duplicates("code")[["code", "term"]], queries


def _leading(rows: DataFrame, worth: DataFrame, k: int, k1: float, b: float, bounds: bool, seen: list[Observation] | None) -> DataFrame:
    """The k best of each query in each part of the index; scores() of batches beyond ASKED query terms.

    A posting of a term that is asked for is shuffled once, to the part of its block, however many queries ask for it.
    """
    side = worth.limit(ASKED + 1).toPandas()
    if len(side) > ASKED:
        return scores(rows, worth, k1, b, seen)
    asked, codes, queries = coded(worth, side)
    terms = _frame(rows.sparkSession, codes, "code int, term string")
    parts = -(-int(max(side.groupby("term")["df"].max().sum(), 1)) // HELD)
    bits = int(np.bitwise_or.reduce(asked["bit"])) if len(side) else 0
    each = _of_terms(rows, terms.select("term")).join(F.broadcast(terms), "term").select("segment", "block", "code", F.inline("docs")).where(F.col("mask").bitwiseAND(bits) != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches))
        if found.num_rows:
            q, chunk, score, n = best_of_part({c: found.column(c).to_numpy() for c in found.column_names}, asked, k, k1, b, bounds)
            columns = [pa.array(np.append(q, -1).astype(np.int32)), pa.array(np.append(chunk, 0)), pa.array(np.append(score, 0.0)), pa.array(np.append(np.zeros(len(q), np.int64), n))]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "chunk", "score", "n"])

    dealt = each.repartition(parts, "segment", "block").select("block", "code", "chunk", "mask", "dl", "tf")
    out = dealt.mapInArrow(run, "q int, chunk long, score double, n long")
    if seen is not None:
        seen.append(Observation())
        out = out.observe(seen[-1], F.sum("n").alias("n"))
    return out.join(F.broadcast(queries), "q").select("query_id", "role", "chunk", F.round("score", 6).alias("score"))


def best_of_part(held: dict[str, np.ndarray], asked: dict[str, np.ndarray], k: int, k1: float | None = K1, b: float = B, bounds: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Queries, chunks and scores of the k best of each query among all postings (block, code, chunk, mask, dl, tf) of some blocks, and the number of postings scored.

    Without k1 a posting counts its tf.
    """
    order = np.lexsort((held["code"], held["chunk"], held["block"]))
    held = {c: x[order] for c, x in held.items()}
    found, n = [], 0
    for bit in np.unique(asked["bit"]):
        mine = {c: x[asked["bit"] == bit] for c, x in asked.items()}
        seen = np.flatnonzero(held["mask"] & bit)
        if len(seen):
            got, scored = _best_of_role({c: x[seen] for c, x in held.items()}, mine, k, k1, b, bounds)
            found.append(got)
            n += scored
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return (*(np.concatenate(x) for x in zip(empty, *found, strict=True)), n)


def _best_of_role(held: dict[str, np.ndarray], asked: dict[str, np.ndarray], k: int, k1: float | None, b: float, bounds: bool) -> tuple[tuple, int]:
    """best_of_part() for the queries of one role, over the postings that it sees, ordered by block and chunk."""
    queries, q = np.unique(asked["q"], return_inverse=True)
    avgdl, most, late = max(1e-9, asked["avgdl"][0]), len(queries), asked["late"].astype(bool)
    change = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    first = np.append(change(held["chunk"]), len(held["chunk"]))
    ids, blocks = held["chunk"][first[:-1]], held["block"][first[:-1]]
    place = np.repeat(np.arange(len(ids)), np.diff(first))
    worth = held["tf"] * 1.0 if k1 is None else held["tf"] * (k1 + 1) / (held["tf"] + k1 * (1 - b + b * held["dl"] / avgdl))
    entries = {None: np.arange(len(q)), False: np.flatnonzero(~late), True: np.flatnonzero(late)}
    # Entries are ordered by term: the queries of a term are a run.
    size = int(max(held["code"].max(), asked["code"].max())) + 2
    runs_of = {f: np.searchsorted(asked["code"][e], np.arange(size)) for f, e in entries.items()}

    def pairs(start: int, end: int, code: np.ndarray, flag: bool | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of rows start to end of code and the entries of their terms."""
        runs, code = runs_of[flag], code[start:end]
        n = runs[code + 1] - runs[code]
        row = np.repeat(np.arange(start, end), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + runs[code][row - start]
        return row, entries[flag][at]

    def summed(of: np.ndarray, at: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of * most + q[at], part * asked["weight"][at], n * most).reshape(n, most)

    # Slices of whole blocks; a block's chunks and postings, times the queries, are few.
    n = np.diff(runs_of[None])[held["code"]]
    heads = np.append(change(blocks), len(blocks))
    cost = np.add.reduceat(n, first[heads[:-1]]) + most * np.diff(heads)
    slices = heads[np.append(change((np.cumsum(cost) - cost) // CELLS), len(heads) - 1)]

    def kept(found: list[tuple], most_of: int) -> tuple:
        who, chunk, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids[chunk], -np.round(score, 6), who))
        who, chunk, score = who[order], chunk[order], score[order]
        some = np.arange(len(who)) - np.searchsorted(who, who) < most_of
        return who[some], chunk[some], score[some]

    def leaders(score: np.ndarray, start: int, most_of: int) -> tuple:
        from corvane.operators.retrieval import best_of

        shown = np.where(score > 0, np.round(score, 6), -np.inf).T
        who, at = best_of(shown, ids[start : start + score.shape[0]], most_of)
        return who, at + start, score[at, who]

    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    scored, out, lead, reach = 0, none, none, np.full(most, -np.inf)

    def early(start: int, end: int) -> np.ndarray:
        row, at = pairs(first[start], first[end], held["code"], False)
        return summed(place[row] - start, at, worth[row], end - start)

    def whole(score: np.ndarray, start: int, end: int, wanted: np.ndarray) -> tuple[np.ndarray, int]:
        """Scores of the wanted (chunk, query) pairs, 0 for the others."""
        row, at = pairs(first[start], first[end], held["code"], True)
        some = wanted[place[row] - start, q[at]]
        row, at = row[some], at[some]
        return np.where(wanted, score + summed(place[row] - start, at, worth[row], end - start), 0), len(row)

    every = list(zip(slices[:-1], slices[1:], strict=True))
    if not bounds:
        for start, end in every:
            row, at = pairs(first[start], first[end], held["code"], None)
            scored += len(row)
            out = kept([out, leaders(summed(place[row] - start, at, worth[row], end - start), start, k)], k)
    else:
        for start, end in every:
            lead = kept([lead, leaders(early(start, end), start, LEAD * k)], LEAD * k)
        for start, end in every:
            some = (lead[1] >= start) & (lead[1] < end)
            wanted = np.zeros((end - start, most), dtype=bool)
            wanted[lead[1][some] - start, lead[0][some]] = True
            out = kept([out, leaders(whole(early(start, end), start, end, wanted)[0], start, k)], k)
        who, n = np.unique(out[0], return_counts=True)
        last = np.cumsum(n) - 1
        reach[who[n >= k]] = np.round(out[2][last[n >= k]], 6) - _SLACK
        # A block's terms as rows, with the greatest count and the least length of those that have it.
        order = np.lexsort((held["code"], held["block"]))
        code, of = held["code"][order], held["block"][order]
        tops = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])))
        tf, dl = np.maximum.reduceat(held["tf"][order], tops), np.minimum.reduceat(held["dl"][order], tops)
        code, of = code[tops], np.searchsorted(blocks[heads[:-1]], of[tops])
        bound = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        out = none
        for start, end in every:
            low, high = np.searchsorted(heads, [start, end])
            row, at = pairs(*np.searchsorted(of, [low, high]), code, True)
            rest = summed(of[row] - low, at, bound[row], high - low)
            rest = np.repeat(rest, np.diff(heads[low : high + 1]), axis=0)
            score = early(start, end)
            wanted = ((score > 0) & (score + rest >= reach)) | (rest > 0) & (rest >= reach)
            scored += int(np.diff(runs_of[False])[held["code"][first[start] : first[end]]].sum())
            score, n = whole(score, start, end, wanted)
            scored += n
            out = kept([out, leaders(score, start, k)], k)
    return (queries[out[0]], ids[out[1]], out[2]), scored
