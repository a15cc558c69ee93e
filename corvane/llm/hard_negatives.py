"""Hard negatives by block matrix multiplication in two dimensions.

Vectors become whole numbers and are packed, where they are read, into blocks of rows,
each cut into ``depth`` chunks of dimensions. Blocks of anchors and blocks of rows are
dealt over a grid; a cell multiplies its chunks to partial int64 tiles of scores, tiles of
one pair of blocks meet by a shuffle and are added up one after the other, and what is
left of a sum are the best rows of each anchor. That is done twice: entries of equal
labels give each anchor's positives, entries of different labels then give the negatives
of each window below a positive. Each entry of the score matrix is shuffled in one of the
two only, and no more than one tile, or one Arrow batch, is held at a time.

Anchors are a stated set of queries that meets all rows in blocks: the work is anchors
times rows, and no group of rows, labels or ids meets in one task.

Defined results: rows with a null id, label or vector, or a null or non-finite component,
take no part; a shorter vector counts as padded with zeros. Rows with an anchor's own id
are none of its others; repeated rows count each, as anchors, positives and negatives, and
equal rows stand next to each other. Components are whole numbers up to 2**25 either way
(beyond, they saturate there), so that sums over 1,024 dimensions stay exact. Empty tables
give no rows. Columns beyond vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import shared_folder, stored, tidied

EVERY, POSITIVES, NEGATIVES, LABELS, MOVED = 100, 5, 5, 10, 7
#: The share of a positive's score, as a / b, from which on a row is a hard negative.
NEAR = (4, 5)
#: Chunks of dimensions; rows of a block of anchors, and of others: a tile of sums is 2 MB.
DEPTH, ANCHORS, ROWS = 2, 256, 1024
SCALE, MOST = 256.0, 1 << 25


def relabelled(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, a seventh of them with the next label in place of their own."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    label = F.when(F.pmod("vec_id", F.lit(MOVED)) == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").alias("vector"))


def blocks(rows: DataFrame, most: int, width: int) -> DataFrame:
    """(block, chunk, ids, labels, part) of rows (block: start of a number, vec_id, label, vector): at most so many rows a block, a row for each chunk of so many dimensions.

    part: int32, a row of the matrix for each id. Chunks are as wide as the longest vector of the block needs, and
    the first one is always there.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                n, vectors = some.num_rows, some.column("vector")
                size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = np.asarray(vectors.flatten(), dtype=np.float64)
                x = np.zeros((n, max(int(size.max()), 1)), dtype=np.int32)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                x[np.repeat(np.arange(n), size), place] = np.clip(np.floor(SCALE * flat), -MOST, MOST)
                ids, labels = (some.column(c).to_numpy().tobytes() for c in ("vec_id", "label"))
                cuts = range(0, x.shape[1], width)
                parts = [np.ascontiguousarray(x[:, c : c + width]).tobytes() for c in cuts]
                of = pa.array([some.column("block")[0].as_py()] * len(parts))
                yield pa.RecordBatch.from_arrays([of, pa.array(range(len(parts)), pa.int32()), pa.array([ids] * len(parts), pa.binary()), pa.array([labels] * len(parts), pa.binary()), pa.array(parts, pa.binary())], names=["block", "chunk", "ids", "labels", "part"])

    # A row's number is unique over all tasks, so the number of a block's first row names the block.
    return rows.withColumn("block", F.monotonically_increasing_id()).mapInArrow(run, "block long, chunk int, ids binary, labels binary, part binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact int64 product of a and b transposed: in doubles where every partial sum is whole below 2**53."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    kind = np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _same(labels: bytes, others: bytes, equal: bool) -> np.ndarray:
    return (np.frombuffer(labels, np.int64)[:, None] == np.frombuffer(others, np.int64)[None, :]) == equal


def partial_tiles(anchors: DataFrame, rows: DataFrame, equal: bool, cells: int) -> DataFrame:
    """(i, j, chunk, tile, ids, labels, ids2, labels2, windows): the part of one chunk of dimensions in the scores of one pair of blocks.

    A tile holds the entries of equal labels, or the others, row by row. anchors and rows are dealt over so many cells
    as tall and wide as the ratio of their sizes asks for; names of a pair's rows go with the first chunk only.
    """
    n, m = (df.where("chunk = 0").count() for df in (anchors, rows))
    tall = max(1, min(n, round((cells * n / max(m, 1)) ** 0.5)))
    wide = max(1, -(-cells // tall))
    spread = lambda c, k, salt: F.pmod(F.xxhash64(F.col(c), F.lit(salt)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = anchors.withColumnRenamed("block", "i").withColumn("at", spread("i", tall, 1)).withColumn("cell", every(wide))
    b = rows.select(F.col("block").alias("j"), "chunk", F.col("ids").alias("ids2"), F.col("labels").alias("labels2"), F.col("part").alias("part2"))
    b = b.withColumn("cell", spread("j", wide, 2)).withColumn("at", every(tall))
    names = ["i", "j", "chunk", "ids", "labels", "ids2", "labels2", "part", "part2", "windows"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, chunk, ids, labels, ids2, labels2, part, part2, windows in _pairs(batches, names):
            left, right = (np.frombuffer(p, np.int32).reshape(len(k) // 8, -1) for p, k in ((part, ids), (part2, ids2)))
            tile = _product(left, right)[_same(labels, labels2, equal)].tobytes()
            named = [ids, labels, ids2, labels2, windows] if chunk == 0 else [None] * 5
            values = [pa.array([i]), pa.array([j]), pa.array([chunk], pa.int32()), *(pa.array([v], pa.binary()) for v in (tile, *named))]
            yield pa.RecordBatch.from_arrays(values, names=["i", "j", "chunk", "tile", "ids", "labels", "ids2", "labels2", "windows"])

    pairs = a.join(b, ["at", "cell", "chunk"]).select(*names)
    return pairs.mapInArrow(run, "i long, j long, chunk int, tile binary, ids binary, labels binary, ids2 binary, labels2 binary, windows binary")


def added(tiles: DataFrame, equal: bool, best, schema: str) -> DataFrame:
    """best of each pair of blocks after its partial tiles are added up.

    Tiles of a pair come one after the other, the first chunk in front, so that one sum is held, whatever the number of chunks.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = total = key = None
        for i, j, _, tile, *named in _pairs(batches, ["i", "j", "chunk", "tile", "ids", "labels", "ids2", "labels2", "windows"]):
            if (i, j) != key:
                if key is not None:
                    yield from best(key[0], total, *names)
                key, names, total = (i, j), named, np.frombuffer(tile, np.int64).copy()
            else:
                total += np.frombuffer(tile, np.int64)
        if key is not None:
            yield from best(key[0], total, *names)

    return tiles.repartition("i", "j").sortWithinPartitions("i", "j", "chunk").mapInArrow(run, schema)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the best so many of each group, ties by id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < most]


def _top(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def positives(anchors: DataFrame, rows: DataFrame, cells: int, most: int = POSITIVES) -> DataFrame:
    """(i, row, rank, id, score): the first so many others of its label for each row of each block of anchors."""

    def best(i, total, ids, labels, ids2, labels2, windows) -> Iterator[pa.RecordBatch]:
        row, at = np.nonzero(_same(labels, labels2, True))
        own, other = np.frombuffer(ids, np.int64), np.frombuffer(ids2, np.int64)
        some = own[row] != other[at]
        row, at, total = row[some], at[some], total[some]
        first = _first(row, total, other[at], most)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), i)), pa.array(row[first].astype(np.int32)), pa.array(other[at[first]]), pa.array(total[first])], names=["i", "row", "id", "score"])

    found = added(partial_tiles(anchors, rows, True, cells), True, best, "i long, row int, id long, score long")
    return _top(found, ["i", "row"], most)


_WINDOW = np.dtype([("row", np.int64), ("rank", np.int64), ("id", np.int64), ("score", np.int64)])


def windowed(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """anchors with the windows of each block's positives in one value: a few for each of its rows."""
    packed = F.struct(F.col("row").cast("long").alias("row"), F.col("rank").cast("long").alias("rank"), "id", "score")
    lists = found.groupBy("i").agg(F.collect_list(packed).alias("w")).select(F.col("i").alias("block"), "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array([tuple(w[c] for c in _WINDOW.names) for w in ws], dtype=_WINDOW).tobytes() for ws in batch.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(rows, pa.binary())], names=["block", "windows"])

    return anchors.drop("windows").join(lists.mapInArrow(run, "block long, windows binary"), "block")


def negatives(anchors: DataFrame, rows: DataFrame, cells: int, most: int = NEGATIVES, near: tuple[int, int] = NEAR) -> DataFrame:
    """(i, row, of, anchor_id, positive_id, positive_score, rank, id, score): for each window of windowed anchors, the first so many rows of other labels within it."""
    a, b = near

    def best(i, total, ids, labels, ids2, labels2, windows) -> Iterator[pa.RecordBatch]:
        tile = np.full((len(ids) // 8, len(ids2) // 8), np.iinfo(np.int64).min)
        tile[_same(labels, labels2, False)] = total
        own, other, window = np.frombuffer(ids, np.int64), np.frombuffer(ids2, np.int64), np.frombuffer(windows, _WINDOW)
        window = window[window["score"] >= 0]  # a window below a negative score is empty
        n = -(-a * window["score"] // b)  # the least whole score within
        top, low = np.full(len(tile), -1), np.full(len(tile), np.iinfo(np.int64).max)
        np.maximum.at(top, window["row"], window["score"])
        np.minimum.at(low, window["row"], n)
        row, at = np.nonzero((tile <= top[:, None]) & (tile >= low[:, None]))
        score = tile[row, at]
        order = np.lexsort((other[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        start, end = np.searchsorted(row, window["row"]), np.searchsorted(row, window["row"], side="right")
        out = []
        for w, low, s, e in zip(window, n, start, end, strict=True):
            s += np.searchsorted(-score[s:e], -w["score"])
            e = min(e, s + most)
            e = s + np.searchsorted(-score[s:e], -low, side="right")
            out += [(w, at[k], score[k]) for k in range(s, e)]
        columns = [[w["row"] for w, _, _ in out], [w["rank"] for w, _, _ in out], [own[w["row"]] for w, _, _ in out], [w["id"] for w, _, _ in out], [w["score"] for w, _, _ in out], [other[k] for _, k, _ in out], [v for _, _, v in out]]
        yield pa.RecordBatch.from_arrays([pa.array([i] * len(out), pa.int64()), *(pa.array(np.array(c, dtype=np.int64)) for c in columns)], names=["i", "row", "of", "anchor_id", "positive_id", "positive_score", "id", "score"])

    found = added(partial_tiles(anchors, rows, False, cells), False, best, "i long, row long, of long, anchor_id long, positive_id long, positive_score long, id long, score long")
    return _top(found, ["i", "row", "of"], most)


def mined(vectors: DataFrame, every: int = EVERY, most_positives: int = POSITIVES, most_negatives: int = NEGATIVES, near: tuple[int, int] = NEAR, depth: int = DEPTH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding): see the module."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    part = relabelled(vectors)
    longest = part.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    width = -(-max(longest or 1, 1) // depth)
    rows = stored(blocks(part, ROWS, width), folder, "rows")
    anchors = stored(blocks(part.where(F.pmod("vec_id", F.lit(every)) == 0), ANCHORS, width), folder, "anchors").withColumn("windows", F.lit(None).cast("binary"))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(positives(anchors, rows, cells, most_positives), folder, "positives")
    asked = stored(windowed(anchors, found), folder, "windows")
    out = negatives(asked, rows, cells, most_negatives, near)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = f"""
with part as (
  select row_number() over () as n, vec_id, case when vec_id % {MOVED} = 0 then (label + 1) % {LABELS} else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (select a.n as a, a.vec_id as anchor_id, a.label = b.label as same, b.n as b, b.vec_id as id, list_dot_product(a.v, b.v)::bigint as score from part a join part b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id),
positive as (select a, anchor_id, b, id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by a order by score desc, id, b) <= {POSITIVES})
select p.anchor_id, positive_id, (row_number() over (partition by p.a, p.b order by s.score desc, s.id, s.b))::int as rank, s.id as negative_id, positive_score, s.score as negative_score
from positive p join scored s on s.a = p.a and not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score
qualify rank <= {NEGATIVES}
"""
