"""A vector collection on disk, searched by cells.

Centres are fitted on a bounded sample; every vector goes to the folder of its nearest
centre, with its angle to it. A query reads the folders of its nearest centres only, and
rescores what it finds by exact cosine. How many folders that takes is measured when vectors
are added: a sample of them is searched exactly, and the places of what is found tell the
number of cells that holds RECALL of it. A search can also be exact: the angle to a centre, less the
widest angle in the centre's cell, bounds what a cell can hold, and cells that cannot hold a
better vector than those found are not read.

Vectors are rows (id: long, vector, and for roles mask: int). A collection has numbered
versions; a version names its parts, and the model and the number of dimensions, which a
search must share. A part holds its own cells, so adding vectors writes a part and touches no
other. Null and zero vectors are in no cell: a search by cosine gives them no place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import latest, published, shared_folder, stored

#: Sampled vectors for each centre, centres at most, and rows of a file at most.
SAMPLE, CENTRES, FILE_ROWS = 64, 4096, 500_000
#: The share of nearest vectors that a search aims at, and the vectors and nearest ones of each by which the number of cells is set.
RECALL, TRIED, NEAREST = 0.97, 100, 10
#: Pairs of a query and a cell up to which they are broadcast.
PAIRS = 100_000
_SLACK = 1e-5


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of length 1; a zero vector stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fitted(vectors: DataFrame, centres: int, dim: int, seed: int = 17) -> np.ndarray:
    """Centres of length 1 by spherical k-means on a sample: at most SAMPLE vectors a centre, the first by a hash of the id."""
    some = vectors.select("vector").where(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(centres * SAMPLE)
    some = some.where(F.exists("vector", lambda v: v != 0)).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=centres, seed=seed, maxIter=10, distanceMeasure="cosine", initMode="random").fit(some)
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.sqrt((found * found).sum(axis=1))[:, None], 1e-300)


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with cell and angle: the nearest centre by cosine, the first of equal ones, and the angle to it."""
    names, dim = vectors.columns, centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column("vector")).reshape(-1, dim) @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*names, "cell", "angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    whole = F.col("vector").isNotNull() & (F.size("vector") == dim) & F.forall("vector", lambda v: v.isNotNull()) & F.exists("vector", lambda v: v != 0)
    return vectors.where(whole).mapInArrow(run, f"{schema}, cell int, angle double")


@dataclass(frozen=True)
class VectorIndex:
    """A version of a collection."""

    spark: SparkSession
    path: str
    version: int
    parts: tuple[str, ...]
    model: str
    dim: int
    probes: int

    def vectors(self) -> DataFrame:
        """(id, mask, vector, angle, part, cell) of all vectors."""
        schema = "id long, mask int, vector array<float>, angle double, part string, cell int"
        if not self.parts:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/cells"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/part={p}" for p in self.parts))

    def cells(self) -> DataFrame:
        """(part, cell, n, roles: bits of all roles that see one of its vectors, widest, centre): a row for each folder."""
        return self.spark.read.schema("part string, cell int, n long, roles int, widest double, centre array<double>").parquet(*(f"{self.path}/centres/{p}" for p in self.parts))


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The latest version of the collection at path, from any session; an empty one where nothing was written."""
    version, text = latest(spark, path)
    held = json.loads(text) if text else {"parts": [], "model": "", "dim": 0, "probes": 1}
    return VectorIndex(spark, path.rstrip("/"), version, tuple(held["parts"]), held["model"], held["dim"], held["probes"])


def added(index: VectorIndex, vectors: DataFrame, model: str, centres: int | None = None) -> VectorIndex:
    """The collection with more vectors as a part of their own. Their number of centres is the root of their number, CENTRES at most.

    Vectors of another model or length than those held are refused. Rows of a large cell go to several files.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), (F.col("mask") if "mask" in vectors.columns else F.lit(-1)).cast("int").alias("mask"), F.col("vector").cast("array<float>").alias("vector"))
    kinds = rows.where("id is not null and size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().limit(2).collect()
    if not kinds:
        return index
    dim, n = kinds[0]["dim"], kinds[0]["count"]
    if len(kinds) > 1 or index.parts and (index.model, index.dim) != (model, dim):
        raise ValueError(f"embeddings of different models: {index.model} of {index.dim}, {model} of {[k['dim'] for k in kinds]}")
    k = max(1, min(centres or round(n**0.5), CENTRES, n))
    found = fitted(rows.where("id is not null"), k, dim) if k > 1 else np.ones((1, dim)) / dim**0.5
    name = uuid.uuid4().hex
    out = placed(rows.where("id is not null"), found).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(-(-n // (k * FILE_ROWS)))))
    out.sortWithinPartitions("cell").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{index.path}/cells/part={name}")
    middle = index.spark.createDataFrame([(i, c) for i, c in enumerate(found.tolist())], "cell int, centre array<double>")  # CENTRES rows at most
    after = VectorIndex(index.spark, index.path, index.version + 1, (*index.parts, name), model, dim, 1)
    sizes = after.vectors().where(F.col("part") == name).groupBy("part", "cell").agg(F.count("*").alias("n"), F.bit_or("mask").alias("roles"), F.max("angle").alias("widest"))
    sizes.join(F.broadcast(middle), "cell").select("part", "cell", "n", "roles", "widest", "centre").write.parquet(f"{index.path}/centres/{name}")
    after = replace(after, probes=_probes(after))
    published(index.spark, index.path, after.version, json.dumps({"parts": after.parts, "model": model, "dim": dim, "probes": after.probes}))
    return after


def _probes(index: VectorIndex) -> int:
    """The number of cells that hold RECALL of the NEAREST vectors of each of TRIED vectors, by an exact search of those, each for one of the roles that occur."""
    roles = index.cells().agg(F.bit_or("roles")).first()[0]
    bits = [1 << i for i in range(31) if roles >> i & 1] if roles >= 0 else [-1]
    bit = F.element_at(F.array(*map(F.lit, bits)), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(len(bits))) + 1).cast("int"))
    some = stored(index.vectors().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIED).select(F.col("id").alias("query_id"), "vector", bit.alias("bit")), shared_folder(index.spark), "tried")
    found = search(index, some, NEAREST + 1, 4, exact=True).where("id <> query_id")
    placed = F.broadcast(found).join(index.vectors().select("id", "part", "cell"), "id").join(near_cells(index, some), ["query_id", "part", "cell"])
    places = sorted(r["place"] for r in placed.select("place").collect())  # TRIED times NEAREST numbers
    return places[min(int(len(places) * RECALL), len(places) - 1)] + 1 if places else 1


def created(path: str, vectors: DataFrame, model: str, centres: int | None = None) -> VectorIndex:
    """A collection of vectors at a new path."""
    return added(opened(vectors.sparkSession, path), vectors, model, centres)


def _bit(queries: DataFrame):
    return (F.col("bit") if "bit" in queries.columns else F.lit(-1)).cast("int").alias("bit")


def near_cells(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(query_id, part, cell, most, place) of each query (query_id, vector, bit) and each cell with a vector that it may see.

    most: the greatest cosine that the cell can hold; place: the cell's place among these by its centre.
    """
    rows = sorted(index.cells().collect(), key=lambda r: (r["part"], r["cell"]))  # a row a folder: CENTRES for each part at most
    centres = np.array([r["centre"] for r in rows])
    parts, cells, widest = [r["part"] for r in rows], np.array([r["cell"] for r in rows], dtype=np.int32), np.array([r["widest"] for r in rows])
    roles = np.array([r["roles"] for r in rows], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                angle = np.arccos(np.clip(_matrix(some.column("vector")).reshape(-1, centres.shape[1]) @ centres.T, -1, 1))
                most = np.cos(np.maximum(angle - widest, 0))
                seen = (some.column("bit").to_numpy()[:, None] & roles[None, :]) != 0
                place = np.where(seen, angle, np.inf).argsort(axis=1, kind="stable").argsort(axis=1)
                row, at = np.nonzero(seen)
                ids = pa.array(some.column("query_id").to_numpy()[row])
                yield pa.RecordBatch.from_arrays([ids, pa.array(parts).take(pa.array(at)), pa.array(cells[at]), pa.array(most[row, at]), pa.array(place[row, at].astype(np.int32))], names=["query_id", "part", "cell", "most", "place"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), _bit(queries), "vector").where(F.col("vector").isNotNull())
    return asked.mapInArrow(run, "query_id long, part string, cell int, most double, place int")


def read(index: VectorIndex, pairs: DataFrame) -> DataFrame:
    """The vectors of the cells of pairs (part, cell), from their folders only: each is read once, whatever the number of its queries."""
    folders = [(r["part"], r["cell"]) for r in pairs.select("part", "cell").distinct().collect()]  # a row a folder
    by: dict[str, list[int]] = {}
    for part, cell in folders:
        by.setdefault(part, []).append(cell)
    wanted = F.lit(False)
    for part, cells in by.items():
        wanted = wanted | ((F.col("part") == part) & F.col("cell").isin(cells))
    return index.vectors().where(wanted)


def _packed(rows: DataFrame, most: int = 1024) -> DataFrame:
    """Rows of vectors, cell by cell as they are read, as blocks (part, cell, ids, masks, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell, prepend=-1) | (batch.column("part").dictionary_encode().indices.to_numpy() != np.roll(batch.column("part").dictionary_encode().indices.to_numpy(), 1)))
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                for at in range(start, end, most):
                    some = batch.slice(at, min(most, end - at))
                    packed = [some.column("id").to_numpy().tobytes(), some.column("mask").to_numpy().tobytes(), _matrix(some.column("vector")).tobytes()]
                    yield pa.RecordBatch.from_arrays([some.column("part").slice(0, 1), some.column("cell").slice(0, 1), *(pa.array([p], pa.binary()) for p in packed)], names=["part", "cell", "ids", "masks", "rows"])

    return rows.select("id", "mask", "vector", "part", "cell").mapInArrow(run, "part string, cell int, ids binary, masks binary, rows binary")


def _scored(index: VectorIndex, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query in the cells of pairs (query_id, part, cell)."""
    from corvane.operators.retrieval import best_of, top

    # The queries of a cell go to each of its blocks, some hundreds at a time.
    asked = pairs.join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), _bit(queries)), "query_id")
    groups = asked.groupBy("part", "cell", F.pmod(F.xxhash64("query_id"), F.lit(16)).alias("g")).agg(F.collect_list(F.struct("query_id", "bit", "vector")).alias("asked"))
    side = F.broadcast(groups) if pairs.limit(PAIRS + 1).count() <= PAIRS else groups
    met = _packed(read(index, pairs)).join(side, ["part", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, masks = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("ids", np.int64), ("masks", np.int32)))
                x = np.frombuffer(batch.column("rows")[i].as_py()).reshape(len(ids), -1)
                asked = batch.column("asked")[i].values
                qids, bits = asked.field("query_id").to_numpy(), asked.field("bit").to_numpy()
                score = np.round(_matrix(asked.field("vector")) @ x.T, 6) + 0.0
                score[(bits[:, None] & masks[None, :]) == 0] = -np.inf
                row, at = best_of(score, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[at]), pa.array(score[row, at])], names=["query_id", "id", "score"])

    return top(met.mapInArrow(run, "query_id long, id long, score double"), k, tie="id")


def search(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, model: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors by cosine of each query (query_id, vector and, for roles, bit).

    The nearest ``probes`` cells are read, as many as the collection's measure says where none are named. exact: cells that can still hold one of the k best are read after them, so
    that nothing is missed. model: what made the queries; another one than the collection's is refused, and so is another length.
    """
    spark = index.spark
    if not index.parts:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    asked = queries.where("query_id is not null and vector is not null")
    lengths = [r["n"] for r in asked.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
    if model not in (None, index.model) or lengths not in ([], [index.dim]):
        raise ValueError(f"queries of {model} of lengths {lengths}, vectors of {index.model} of {index.dim}")
    folder, probes = shared_folder(spark), probes or index.probes
    cells = near_cells(index, asked)
    cells = stored(cells if exact else cells.where(F.col("place") < probes), folder, "cells")
    first = _scored(index, cells.where(F.col("place") < probes), asked, k)
    if not exact:
        return first
    from corvane.operators.retrieval import top

    first = stored(first, folder, "first")
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = cells.where(F.col("place") >= probes).join(least, "query_id", "left").where(F.col("most") + _SLACK >= F.coalesce("least", F.lit(-2.0)))
    rest = stored(rest.select("query_id", "part", "cell"), folder, "rest")
    if rest.limit(1).count() == 0:
        return first
    return top(first.drop("rank").unionByName(_scored(index, rest, asked, k).drop("rank")), k, tie="id")
