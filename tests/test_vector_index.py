"""The stored vector collection: recall, pruned folders, exact search, versions, roles, refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.operators import vector_index as V
from corvane.plans import registry

MID = "/root/testdata/sf0.01"
SCHEMA = "id long, mask int, vector array<double>"


def clustered(n=1500, dim=24, groups=30, seed=3):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((groups, dim))
    return [(i, 1 + i % 3, (middle[i % groups] + 0.25 * r.standard_normal(dim)).tolist()) for i in range(n)]


def answers(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def opened_files(df):
    return {r.f for r in df.select("id", F.col("_metadata.file_path").alias("f")).select("f").distinct().collect()}


def test_collection(spark, tmp_path):
    rows = clustered()
    rows += [(5000, 1, None), (5001, 1, [0.0] * 24), (5002, 1, rows[0][2]), (None, 1, rows[0][2])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = vectors.where("id % 50 = 0 and id < 1500").select(F.col("id").alias("query_id"), "vector", F.lit(2).alias("bit"))
    V.created(str(tmp_path / "c"), vectors, "m")
    index = V.opened(spark.newSession(), str(tmp_path / "c"))  # another session opens what this one wrote
    assert (index.version, index.model, index.dim) == (1, "m", 24) and index.vectors().count() == 1501
    session = lambda df: index.spark.createDataFrame(df.collect(), df.schema)
    asked = session(queries)
    want = answers(retrieval.dense_search(vectors.where("id is not null and id not in (5000, 5001)"), queries, 5))
    assert answers(V.search(index, asked, 5, exact=True)) == want and len(want) == 150
    found = answers(V.search(index, asked, 5))
    assert len({x[::2] for x in found} & {x[::2] for x in want}) >= 0.9 * len(want)
    # A query's files grow with the number of its cells, and are few of all.
    one = asked.limit(1)
    files = [opened_files(V.read(index, V.near_cells(index, one).where(F.col("place") < p))) for p in (1, 4, 16)]
    every = opened_files(index.vectors())
    assert len(files[0]) < len(files[1]) < len(files[2]) < len(every) and index.probes < 20
    plan = V.read(index, V.near_cells(index, one).where("place < 2"))._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_vectors_are_added_in_parts(spark, tmp_path):
    rows = clustered(600)
    vectors = spark.createDataFrame(rows, SCHEMA)
    one = V.created(str(tmp_path / "c"), vectors.where("id < 400"), "m")
    two = V.added(one, vectors.where("id >= 400"), "m")
    assert two.version == 2 and len(two.parts) == 2 and one.vectors().count() == 400
    queries = vectors.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    assert answers(V.search(two, queries, 4, exact=True)) == answers(retrieval.dense_search(vectors.select("id", "vector"), queries, 4))
    with pytest.raises(ValueError, match="different models"):
        V.added(two, vectors, "another")
    with pytest.raises(ValueError, match="different models"):
        V.added(two, spark.createDataFrame([(1, 1, [1.0])], SCHEMA), "m")
    with pytest.raises(ValueError, match="lengths"):
        V.search(two, queries.withColumn("vector", F.array(F.lit(1.0))))
    with pytest.raises(ValueError, match="queries of"):
        V.search(two, queries, model="another")


def test_small_and_odd_collections(spark, tmp_path):
    none = V.created(str(tmp_path / "none"), spark.createDataFrame([], SCHEMA), "m")
    one = spark.createDataFrame([(1, 1, [0.5, 0.5])], SCHEMA)
    queries = one.select(F.col("id").alias("query_id"), "vector")
    assert none.version == 0 and V.search(none, queries).count() == 0
    assert answers(V.search(V.created(str(tmp_path / "one"), one, "m"), queries)) == [(1, 1, 1, 1.0)]
    same = spark.createDataFrame([(i, 1, [0.5, 0.5]) for i in range(200)], SCHEMA)  # one cell holds them all
    index = V.created(str(tmp_path / "same"), same, "m")
    assert [x[2] for x in answers(V.search(index, queries, 3))] == [0, 1, 2]
    assert V.search(index, queries.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    pairs = lambda name: {(r.query_id, r.id) for r in registry.queries()[name](spark, MID).collect()}
    want = pairs("cosine_topk")
    assert len(pairs("cells_topk") & want) >= 0.9 * len(want) and pairs("cells_exact_topk") == want
