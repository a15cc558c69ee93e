import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking, policy, providers, retrieval, store, tabular
from corvane.sources import files
from corvane.streaming import events


def test_sections_and_fences(spark):
    text = "intro\n# A\none\n```\n# not\n```\n### C\nthree\n## B\n\n#x\n# D\n"
    got = chunking.sections(spark.createDataFrame([("f", text)], "source_path string, text string")).orderBy("ordinal").collect()
    assert [(r.section_path, r.text) for r in got] == [("", "intro"), ("A", "one\n```\n# not\n```"), ("A > C", "three"), ("A > B", "#x")]


def test_split_text():
    assert chunking.split_text("short") == ["short"] and chunking.split_text("  ") == []
    assert [len(p) for p in chunking.split_text("x" * 5000)] == [2048, 2048, 904]
    parts = ["a" * 400, "b" * 3000, "c" * 400]
    plain, compat = (chunking.split_text("\n\n".join(parts), overlap_tokens=0, compat=c) for c in (False, True))
    assert plain == ["a" * 400, "b" * 2048, "b" * 952, "c" * 400]
    assert compat == ["a" * 400, "b" * 2048, "b" * 952, "a" * 400 + "\n\n" + "c" * 400]


def test_collection(spark, tmp_path):
    for name, text in {"general/gen.md": "# Hello\nWorld of all", "finance/fin.MD": "# Money\nOnly some", "other/x.md": "no", "hr/hr_data.csv": "a,b\n1,2\n"}.items():
        (tmp_path / "base" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "base" / name).write_text(text)
    base = str(tmp_path / "base")
    assert [(r.owner_dept, r.doc_type, r.sensitivity) for r in files.discover(spark, base).collect()] == [("finance", "md", "internal"), ("general", "md", "general"), ("hr", "csv", "restricted")]
    index = {r.owner_dept: r for r in files.build_index(spark, base).collect()}
    assert index["general"].section_path == "Hello" and index["general"].role_marketing and not index["finance"].role_marketing and index["finance"].role_finance
    assert files.discover(spark, str(tmp_path / "none")).count() == 0


def test_malformed_conditions(spark):
    row = spark.range(1)
    for bad in ("x", {}, {"eq": ["a"]}, {"like": ["a", "b"]}, {"eq": ["a", "b"], "ne": ["a", "b"]}):
        assert not row.select(policy.condition(bad, {}).alias("x")).first().x
    everything = policy.compiled({"rules": [{"name": "skipped"}, {"name": "all", "when": {"all": []}, "effect": "permit"}]}, {})
    assert row.select(everything.alias("x")).first().x.rule == "all"


def test_batches_close_at_limits():
    assert [len(b) for b in providers.batches(["x"] * 250)] == [100, 100, 50]
    assert [len(b) for b in providers.batches(["x" * 40_000, "y" * 30_000, "z"])] == [1, 2]


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, text string")
    new = spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", "5", 3)], "id string, text string, ord int")
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [("a", "1"), ("b", "4"), ("c", "5")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windows(events.stream_files(spark, str(tmp_path / "in"), rows), late="40 days")
    q = stream.writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("limits").count() == events.windows(rows).count() > 0


def test_replies(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("x")).first().x
    assert one(T.llm_order(F.lit("[2,0,9]"), F.lit(3))) == [2, 0] and one(T.llm_order(F.lit("oops"), F.lit(2))) == [0, 1]
    assert one(T.subqueries(F.lit('```json\n["a","b"]\n```'), F.lit("q"))) == ["a", "b"] and one(T.subqueries(F.lit("no"), F.lit("q"))) == ["q"]


def test_split_text_by_worked_examples():
    """Pieces are stripped, cuts lose their separator, overlaps come from stripped pieces; compat repeats what was held before a long part."""
    one = lambda text, compat, over=0, most=4: chunking.split_text(text, most, over, compat=compat)
    assert one("  short \n", False) == ["short"]
    text = "aaaa bbbb\n\ncccc dddd\n\neeee"
    assert one(text, False) == one(text, True) == ["aaaa bbbb", "cccc dddd\n\neeee"]
    text = "head\n\n" + "x" * 20 + "\n\ntail\n\nlast part of it"
    assert one(text, False) == ["head", "x" * 16, "xxxx", "tail", "last part of it"]
    assert one(text, True) == ["head", "x" * 16, "xxxx", "head\n\ntail", "last part of it"]
    assert one("one two. three four five. six", False) == ["one two", "three four five", "six"]
    assert one("aaaa bbbb\n\ncccc dddd\n\neeee", False, over=1) == ["aaaa bbbb", "bbbb cccc dddd\n\neeee"]
    assert one("\n\n\n\nabcdefghij\n\n   \n\nklmnopqrst", False) == ["abcdefghij", "klmnopqrst"]


def test_embedder_places_texts_that_share_words_near():
    a, b, c, none = providers.hashed_embedder()(["the annual leave policy of staff", "annual leave of our staff", "quarterly revenue grew again", "  "])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert len(a) == 256 and abs(dot(a, a) - 1) < 1e-9 and dot(a, b) > 0.5 > dot(a, c) and not any(none)


def test_embedder_finds_the_features_of_a_word_once():
    """Each vector is what word by word sums give, whatever else is in the batch; a word that was seen is not hashed again."""
    import zlib
    from unittest import mock

    import numpy as np

    texts = ["the leave policy the THE", "", "a", " ".join(f"word{i} w{i % 7}" for i in range(3000)), "the policy of leave"]
    embed = providers.hashed_embedder(64)
    whole = np.array(embed(texts))
    for text, got in zip(texts, whole, strict=True):
        want = np.zeros(64)
        words = text.lower().split()
        for w in dict.fromkeys(words):
            for t in (w, *(f"<{w}>"[i : i + 3] for i in range(len(w)))):
                h = zlib.crc32(t.encode())
                want[h % 64] += (1.0 if h >> 31 else -1.0) * (1 + np.log(words.count(w)))
        assert np.abs(got - want / (np.linalg.norm(want) or 1)).max() < 1e-12
    with mock.patch.object(providers.zlib, "crc32", side_effect=AssertionError):
        assert (np.array(embed(texts[::-1])) == whole[::-1]).all()


def test_upsert_does_not_embed_for_ids(spark):
    """The rows of an index that stay are found by the ids of the chunks: each chunk is embedded once."""
    from corvane.sources import files

    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(8)], "id string, text string")
    out = files.dense_index(rows.where("id > 5"), files.dense_index(rows, None))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert sorted(r.id for r in out.collect()) == [str(i) for i in range(8)]


def test_failing_providers_keep_order_and_question(spark):
    def fails(prompts):
        raise RuntimeError("no answer")

    rows = spark.createDataFrame([(1, "q one", r, r, f"text {r}") for r in (1, 2, 3)], "query_id long, query string, rank long, chunk long, text string")
    assert [(x.chunk, x.rank) for x in retrieval.rerank_replied(rows, fails).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert [x.chunk for x in retrieval.rerank_replied(rows, providers.backwards(), 2).orderBy("rank").collect()] == [3, 2]
    asked = spark.createDataFrame([(1, "compare leave and pay", "hr"), (2, "leave rules", "hr")], "query_id long, query string, role string")
    hops = lambda g: sorted((x.query_id, x.sub, x.subquery, x.hops) for x in retrieval.decomposed(asked, g).collect())
    assert hops(fails) == [(1, 0, "compare leave and pay", False), (2, 0, "leave rules", False)]
    assert hops(None) == [(1, 0, "compare leave", True), (1, 1, "pay", True), (2, 0, "leave rules", False)]
    try:
        providers.generated(rows.withColumnRenamed("text", "prompt"), fails, tolerant=False).collect()
    except Exception as e:
        assert "no answer" in str(e)
    else:
        raise AssertionError


def test_dense_index_of_a_folder(spark, tmp_path):
    base = tmp_path / "base"
    (base / "hr").mkdir(parents=True)
    (base / "hr" / "a.md").write_text("# Leave\nStaff have leave.\n# Pay\nPay comes monthly.")
    assert files.build_dense_index(spark, str(base), str(tmp_path / "v1")) == 2
    (base / "hr" / "b.md").write_text("New text.")
    old = spark.read.parquet(str(tmp_path / "v1"))
    assert files.build_dense_index(spark, str(base), str(tmp_path / "v2"), old) == 3
    assert files.build_dense_index(spark, str(tmp_path / "none"), str(tmp_path / "v3")) == 0
    assert {r.dim for r in spark.read.parquet(str(tmp_path / "v2")).collect()} == {256}


def test_index_of_a_stream_takes_a_batch_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # the second run replays the first batch
        stream = events.stream_files(spark, str(tmp_path / "in"), rows)
        events.indexed(stream, str(tmp_path / "index"), str(tmp_path / checkpoint)).awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "index")).collect()) == ["a", "b"]
    spark.createDataFrame([("b", "2"), ("c", "3")], "id string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.stream_files(spark, str(tmp_path / "in"), rows)
    events.indexed(stream, str(tmp_path / "index"), str(tmp_path / "two")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "index")).collect()) == ["a", "b", "c"]


def test_settings_and_policy_files(spark, tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nPORT='9000'\nHOST=\"example\"\nnonsense\n")
    monkeypatch.setenv("HOST", "kept")
    assert files.env_file(str(tmp_path / ".env")) == {"PORT": "9000", "HOST": "kept"} and files.env_file(str(tmp_path / "none")) == {}
    assert files.settings(PORT="1")["PORT"] == "1" and len(files.settings()) == 9
    (tmp_path / "policy.json").write_text('{"default": "deny", "rules": [{"name": "x", "effect": "permit", "when": {"all": [{"in": ["subject.role", "hr and more"]}]}}]}')
    rules = policy.load(str(tmp_path / "policy.json"))
    got = spark.createDataFrame([("hr",), ("it",), (None,)], "role string").select(policy.compiled(rules, {"subject.role": F.col("role")}).alias("x")).collect()
    assert [r.x.effect for r in got] == ["permit", "deny", "deny"]


def test_cache_versions(spark, tmp_path):
    cache = spark.createDataFrame([("a", 1, 5), ("b", 2, 7)], "key string, at int, size long")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 3, 3)], "key string, at int, size long")
    both = store.put(cache, new)
    assert sorted(map(tuple, both.collect())) == [("a", 1, 5), ("b", 4, 2), ("c", 3, 3)]
    assert tuple(store.stats(both).first()) == (3, 10)
    empty = store.clear(both, str(tmp_path / "v2"))
    assert empty.columns == cache.columns and tuple(store.stats(empty).first()) == (0, 0)


def test_audit_sink_writes_a_folder_a_day(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.audit_sink(rows, str(tmp_path / "audit"))
    days = rows.select(T.utc_day("ts", T.zoned(rows)).alias("d")).distinct().count()
    back = spark.read.text(str(tmp_path / "audit"))
    assert back.count() == rows.count() and back.select("day").distinct().count() == days


def test_days_are_those_of_utc_in_any_session(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.createDataFrame([("2024-01-02T02:00:00.25Z",), ("1969-12-31T23:59:59Z",), ("2024-03-10T02:30:00Z",)], "t string")
    want = [("1969-12-31", "-1.0"), ("2024-01-02", "1704160800.25"), ("2024-03-10", "1710037800.0")]
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for local in (False, True):  # instants, and times without a zone
                ts = F.substring("t", 1, 22) if local else F.col("t")
                ts = F.regexp_replace(ts, "Z$", "").cast("timestamp_ntz") if local else ts.cast("timestamp")
                found = events.audit_rows(rows.select(ts.alias("ts"), F.lit(1).alias("event_id"), F.lit("x").alias("event_type"), F.lit(1).alias("user_id"), F.lit(0.0).alias("value"))).collect()
                seconds = lambda line: str(json.loads(line)["ts"])
                assert sorted((r.day, seconds(r.line)) for r in found) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_searches_refuse_vectors_of_another_model(spark):
    rows = lambda model, name: spark.createDataFrame([(1, [1.0, 0.0], model, 2)], f"{name} long, vector array<double>, model string, dim int")
    assert retrieval.dense_search(rows("a", "id"), rows("a", "query_id")).count() == 1
    with pytest.raises(ValueError, match="different models"):
        retrieval.dense_search(rows("a", "id"), rows("b", "query_id"))


def test_first_rows_without_one_sort(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").cast("double").alias("v")).repartition(7)
    for n in (0, 1, 500, 999, 1000, 2000):
        assert sorted(r.k for r in tabular.first_rows(rows, "k", n).collect()) == list(range(min(n, 1000)))
    assert tabular.first_rows(rows.limit(0), "k", 3).count() == 0


def test_denied_requests_fail(spark):
    rows = spark.createDataFrame([("hr", "hr", "csv", "restricted", "view_row"), ("finance", "hr", "csv", "restricted", "view_row")], "role string, owner_dept string, doc_type string, sensitivity string, action string")
    gate = lambda df: policy.authorized(df, F.col("role"), F.col("action")).collect()
    assert gate(rows.where("role = 'hr'"))[0].rule == "hr_rows_hr_and_c_level_only"
    with pytest.raises(Exception, match="403 non_hr_hr_rows_deny"):
        gate(rows)
