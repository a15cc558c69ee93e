"""The stored sparse index: blocks, bounds, segments, tombstones, versions."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import sparse_index as S
from corvane.plans import corpus, registry

MID = "/root/testdata/sf0.1"
CHUNKS = "chunk long, text string, allowed_roles array<string>, source_path string, section_path string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, r, f"s{i}", "") for i, t, r in rows], CHUNKS)


def some(n, seed=1, start=0):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(4000)]
    roles = [["hr", "c_level"], ["c_level"], ["finance", "c_level"], [], ["hr"]]
    return [(start + i, " ".join(r.choices(words, k=r.randrange(60))), r.choice(roles)) for i in range(n)]


def asked(spark, n=12, seed=5):
    r = random.Random(seed)
    rows = [(i, " ".join(f"W{int(r.paretovariate(0.5)) % 300}" for _ in range(8)), r.choice(["hr", "c_level", "finance", "nobody"])) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, query string, role string")


def all_scores(rows, queries):
    return sorted(tuple(x) for x in S.scores(rows, S.worths(rows, queries)).collect())


def brute(chunks, queries):
    """BM25 with the statistics of what each role may see, in plain Python."""
    import math
    import re
    from collections import Counter

    out = []
    for q in queries:
        seen = {i: Counter(t.lower() for t in re.findall("[A-Za-z0-9_]+", text or "")) for i, text, roles in chunks if q.role in roles}
        avg = sum(sum(c.values()) for c in seen.values()) / max(1, len(seen))
        asked = Counter(t.lower() for t in re.findall("[A-Za-z0-9_]+", q.query or ""))
        df = {t: sum(t in c for c in seen.values()) for t in asked}
        for i, c in seen.items():
            if any(t in c for t in asked):
                dl = sum(c.values())
                out.append((q.query_id, q.role, i, round(sum(n * math.log(1 + (len(seen) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / max(1e-9, avg))) for t, n in asked.items() if t in c), 6)))
    return sorted(out)


def near(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 2e-6 for x, y in zip(a, b, strict=True))


def test_odd_texts_and_scores_by_hand(spark, tmp_path):
    rows = [*some(150), (900, None, ["hr"]), (901, "", ["hr"]), (902, "ÀÉ K.. w1_2 W1 w1", ["hr"]), (902, "again", ["hr"]), (None, "w1", ["hr"]), (903, "w1 " * 5000, ["hr", "c_level"])]
    rows = [x for x in rows if x != (902, "again", ["hr"])]
    chunks, queries = made(spark, rows), asked(spark)
    index = S.created(str(tmp_path / "one"), chunks)
    assert near(all_scores(index.rows(), queries), brute([x for x in rows if x[0] is not None], queries.collect()))
    assert index.listing().count() == 154 and S.postings(index.rows()).where("chunk in (900, 901)").count() == 0
    found = {(x.term, x.tf) for x in S.postings(index.rows()).where("chunk = 902").collect()}
    assert found == {("w1_2", 1), ("w1", 2)} or found == {("k", 1), ("w1_2", 1), ("w1", 2)}
    assert S.created(str(tmp_path / "none"), chunks.limit(0)).rows().count() == 0
    none = S.opened(spark, str(tmp_path / "none"))
    assert none.version == 0 and all_scores(none.rows(), queries) == []


def test_repeated_ids_are_one_chunk(spark, tmp_path):
    index = S.created(str(tmp_path / "i"), made(spark, [(1, "a b", ["hr"]), (1, "a b", ["hr"]), (2, "c", ["hr"])]))
    assert sorted(x.chunk for x in index.listing().collect()) == [1, 2] and S.postings(index.rows()).count() == 3
    both = made(spark, [(1, "one text", ["hr"]), (1, "another", ["hr"]), (2, "c", ["hr"])])
    again = S.followed(index, both)
    assert again.version == 2 and S.postings(again.rows()).where("chunk = 1").count() in (1, 2) and S.followed(again, both).version == 2


@pytest.mark.parametrize("k", [2, 40])
def test_best_has_the_best_of_all(spark, tmp_path, k):
    index = S.created(str(tmp_path / "i"), made(spark, some(400, 7)))
    rows, queries = index.rows(), asked(spark, 20, 9)
    ranked = lambda rows: {q: sorted((-s, c) for i, _, c, s in rows if i == q)[:k] for q in range(20)}
    every = ranked(all_scores(rows, queries))
    assert ranked([tuple(x) for x in S.best(rows, S.worths(rows, queries), k).collect()]) == every and sum(map(len, every.values())) > 10


def test_index_follows_its_collection(spark, tmp_path):
    """After adds, changes, deletes and compaction every score equals a full rebuild, and older versions stay readable."""
    path, queries = str(tmp_path / "i"), asked(spark)
    first = some(120)
    one = S.created(path, made(spark, first))
    assert S.followed(one, made(spark, first)).version == one.version == 1  # nothing changed
    second = [x for x in first if x[0] % 4] + some(30, 3, 500)
    second = [(i, t + " w5 w5", r) if i % 5 == 0 else (i, t, ["hr"]) if i % 7 == 0 else (i, t, r) for i, t, r in second]
    two = S.followed(one, made(spark, second))
    assert two.version == 2 and len(two.segments) == 2 and len(two.dead) == 1
    rebuilt = all_scores(S.created(str(tmp_path / "again"), made(spark, second)).rows(), queries)
    assert near(all_scores(two.rows(), queries), rebuilt) and len(rebuilt) > 100
    whole = S.compacted(two)
    assert len(whole.segments) == 1 and not whole.dead and near(all_scores(whole.rows(), queries), rebuilt)
    assert whole.rows().where("term is null and size(docs) > 8").count() == 0
    third = [x for x in second if x[0] != 501]
    last = S.followed(whole, made(spark, third))
    assert near(all_scores(last.rows(), queries), brute(third, queries.collect()))
    assert near(all_scores(S.opened(spark.newSession(), path).rows(), queries), brute(third, queries.collect()))
    assert near(all_scores(one.rows(), queries), brute(first, queries.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        S.followed(whole, made(spark, second[:10]))  # version 4 is taken


def test_a_fifth_of_the_postings_is_scored(spark, tmp_path):
    chunks, queries = corpus.chunks(spark, MID), corpus.asked(spark, MID)
    rows = S.created(str(tmp_path / "i"), chunks).rows()
    worth, few, every = S.worths(rows, queries), [], []
    top = lambda df: sorted(tuple(x) for x in df.withColumn("n", F.expr("row_number() over (partition by query_id order by score desc, chunk)")).where("n <= 5").collect())
    assert top(S.best(rows, worth, 5, seen=few)) == top(S.scores(rows, worth, seen=every))
    assert sum(o.get["n"] for o in few) <= 0.2 * every[0].get["n"]


def test_parts_are_scored_for_all_queries(spark, tmp_path, monkeypatch):
    """Small parts and slices of them give the best of all scores, copies included; nothing is shuffled by query and chunk but what leads."""
    monkeypatch.setattr(S, "HELD", 1000)
    monkeypatch.setattr(S, "CELLS", 300)
    rows = S.block_rows(made(spark, [*some(100, 7), *((900 - i, "w1 w2 w3 w1", ["hr", "c_level"]) for i in range(20))])).withColumn("segment", F.lit("s"))
    rows = spark.createDataFrame(rows.collect(), rows.schema).coalesce(1)
    worth = S.worths(rows, asked(spark, 20, 9))
    ranked = lambda df: {q: sorted((-x.score, x.chunk) for x in df if x.query_id == q)[:4] for q in range(20)}
    every = ranked(S.scores(rows, worth).collect())
    for bounds in (False, True):
        found = S._leading(rows, worth, 4, S.K1, S.B, bounds, None)
        assert ranked(found.collect()) == every and sum(map(len, every.values())) > 10
        assert "keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_queries_read_the_folders_of_their_terms(spark, tmp_path):
    index = S.created(str(tmp_path / "i"), made(spark, some(200)))
    one = spark.createDataFrame([("w3",)], "term string")
    files = lambda df: {x.f for x in df.select(F.input_file_name().alias("f")).distinct().collect()}
    rows = S._of_terms(index.rows(), one)
    assert rows.count() > 0 and len(files(index.rows())) > 20
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert any("bucket#" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert len(files(rows)) < len(files(index.rows())) / 2


def stages(spark):
    """(rows shuffled, most memory of a task's sorts and tables, bytes written) of all stages of this application by number."""
    store, out = spark.sparkContext._jsc.sc().statusStore(), {}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = store.store().view(spark._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")).iterator()
    while every.hasNext():
        s = every.next().info()
        out[s.stageId()] = (s.shuffleWriteRecords(), s.peakExecutionMemory(), s.outputBytes())
    return out


def test_postings_are_neither_shuffled_nor_sorted(spark, tmp_path):
    """A build shuffles a row a chunk, and the tasks that write postings hold nothing that grows with them."""
    chunks, queries = made(spark, some(600)).repartition(4).localCheckpoint(), asked(spark)
    before = set(stages(spark))
    index = S.created(str(tmp_path / "i"), chunks)
    done = {k: x for k, x in stages(spark).items() if k not in before}
    assert max(x[0] for x in done.values()) <= 600
    assert max(done.values(), key=lambda x: x[2])[1] == 0 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert index.rows().where("bucket >= 0").count() > 4 * 600
    assert near(all_scores(index.rows(), queries), brute(some(600), queries.collect()))


BUILDERS = ["bm25_topk", "chat_contexts", "dedup_counts", "extractive_answer", "rerank_prompt"]


@pytest.mark.parametrize("name", BUILDERS)
def test_the_first_query_writes_postings_unsorted(spark, tmp_path, name):
    """The query that builds the index: the stage that writes most, that of the postings, holds no memory for a sort."""
    (tmp_path / "d").symlink_to("/root/testdata/sf0.001")  # another path, so an index of its own
    before = set(stages(spark))
    assert registry.queries()[name](spark, str(tmp_path / "d")).count() > 0
    done = [x for k, x in stages(spark).items() if k not in before]
    assert max(done, key=lambda x: x[2])[1] == 0


def shuffled(spark, run):
    """What run() gives, and the rows shuffled by all stages that it started."""
    before = set(stages(spark))
    out = run()
    return out, sum(x[0] for k, x in stages(spark).items() if k not in before)


def test_compaction_shuffles_whole_rows_once(spark, tmp_path, monkeypatch):
    """Rows go to parts of whole blocks as they are, not a posting at a time, and no row more than once; several parts, and tombstones too many to broadcast, give the same."""
    first, queries = some(300), asked(spark)
    second = [(i, t + " w5" if i % 5 == 0 else t, r) for i, t, r in first if i % 4] + [(-1 - i, t, r) for i, t, r in some(40, 3)]
    two = S.followed(S.created(str(tmp_path / "i"), made(spark, first).repartition(4)), made(spark, second))
    found, n = shuffled(spark, lambda: all_scores(two.rows(), queries))
    assert near(found, brute(second, queries.collect())) and len(found) > 100
    every, ids = two._read("postings", two.segments, S.SCHEMA).count(), len(first) + len(second)
    whole, n = shuffled(spark, lambda: S.compacted(two))
    assert n <= every + 4 * ids and near(all_scores(whole.rows(), queries), found)
    assert sorted((x.chunk, x.checksum) for x in whole.listing().collect()) == sorted((x.chunk, x.checksum) for x in two.listing().collect())
    _, n = shuffled(spark, lambda: two.rows().write.format("noop").mode("overwrite").save())
    assert n <= ids  # the tombstones, no row of the index
    monkeypatch.setattr(S, "HELD", 1000)
    monkeypatch.setattr(S, "HIT", 3)
    again = S.compacted(S.SparseIndex(spark, str(tmp_path / "i"), 9, two.segments, two.dead))
    rows = again.rows()
    assert near(all_scores(rows, queries), found) and near(all_scores(two.rows(), queries), found)
    assert rows.select((F.col("block") / (1 << 33)).cast("int")).distinct().count() > 3 and rows.where("term is null and size(docs) > 8").count() == 0
    listed = rows.where("term is null").select("block", F.size("docs").alias("n"))
    assert listed.count() == listed.select("block").distinct().count() and listed.agg(F.sum("n")).first()[0] == len(second)
    all_dead = S.compacted(S.followed(S.created(str(tmp_path / "none"), made(spark, first)), made(spark, first).limit(0)))
    assert all_dead.rows().count() == 0 and all_dead.listing().count() == 0


@pytest.mark.parametrize("side", [200, 0])
def test_ids_that_lie_close_are_few_rows(spark, monkeypatch, side):
    """Thousands of ids are broadcast as runs of 64; beyond the bound, the same by a shuffle."""
    monkeypatch.setattr(S, "SIDE", side)
    rows = spark.range(-5000, 5000).selectExpr("int(id) as chunk", "string(id % 2) as kind")
    ids = [(i, "0") for i in (-(2**63), 2**63 - 1, *range(-5001, 5000, 3))]
    ids = spark.createDataFrame(ids, "chunk long, kind string")
    wanted = [i for i in range(-5000, 5000) if i % 3 == 0]
    semi, anti = S.among(rows, ids, "left_semi"), S.among(rows, ids, "left_anti", "kind")
    assert sorted(x.chunk for x in semi.collect()) == wanted and semi.columns == rows.columns
    assert sorted(x.chunk for x in anti.collect()) == [i for i in range(-5000, 5000) if i % 3 or i % 2]
    assert ("strategy=broadcast" in semi._jdf.queryExecution().optimizedPlan().toString()) == (side > 0)


def test_the_query_over_segments_shuffles_rows_not_postings(spark, tmp_path):
    (tmp_path / "d").symlink_to("/root/testdata/sf0.001")
    found, n = shuffled(spark, lambda: registry.queries()["bm25_segments"](spark, str(tmp_path / "d")).collect())
    postings = corpus.chunks(spark, str(tmp_path / "d")).transform(S.block_rows).transform(S.postings).count()
    print(len(found), n, postings)
    assert len(found) == 200 and n <= 3 * postings
