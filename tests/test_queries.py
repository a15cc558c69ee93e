"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import duckdb
import pytest

from corvane.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:  # whole numbers with nulls
        if str(df[c].dtype) in ("Int64", "Int32"):
            df[c] = df[c].astype("float64")
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
    clean = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(map(clean, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


def test_policy_counts(spark):
    got = registry.policy_rows(spark).withColumn("x", registry.policy_of_grid()).select("x.*")
    assert got.count() == 37_800 and got.where("effect = 'permit'").count() == 8_205


def test_lsh_recall(spark):
    exact = {(r.query_id, r.id) for r in registry.queries()["cosine_topk"](spark, DATA).collect()}
    found = {(r.query_id, r.id) for r in registry.queries()["lsh_topk"](spark, DATA).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_hashed_search_makes_no_row_for_a_candidate(spark):
    """The candidates are those that share a bucket, and buckets are compared within blocks: nothing is shuffled but what was found."""
    import numpy as np

    from corvane.operators import retrieval

    rows = np.random.default_rng(3).standard_normal((300, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>")
    found = retrieval.lsh_search(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 4, tables=3, bits=4)
    bits = np.einsum("nd,tbd->ntb", rows, np.random.default_rng(17).standard_normal((3, 4, 8))) > 0
    alike = (bits[:, None] == bits[None]).all(axis=3).any(axis=2)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    best = [(q, i) for q in range(0, 300, 20) for i in sorted(np.flatnonzero(alike[q]), key=lambda i: (-round(unit[q] @ unit[i], 6), i))[:4]]
    assert sorted((r.query_id, r.id) for r in found.collect()) == sorted(best) and not alike.all()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in plan and "SortMergeJoin" not in plan


def test_texts_are_not_shuffled_to_hits(spark):
    """Hits go to the texts, also where Spark would not broadcast them by itself."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry._candidates(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning(chunk" not in plan and "BroadcastHashJoin [chunk" in plan


def test_keyword_search_shuffles_no_words(spark, monkeypatch):
    """All queries are scored where a text is read; joins, for batches beyond a size, give the same."""
    from corvane.operators import retrieval, sparse_index
    from corvane.plans import corpus

    c, q = corpus.chunks(spark, DATA), corpus.asked(spark, DATA)
    found = retrieval.keyword_search(c, q, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(chunk" not in plan
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(sparse_index, "ASKED", 5)
    assert sorted(map(tuple, retrieval.keyword_search(c, q, 3).collect())) == whole and len(whole) > 50
    assert retrieval.keyword_search(c, q.limit(0), 3).count() == 0
