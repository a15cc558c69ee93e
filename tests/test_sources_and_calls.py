"""The folder source, the chunker as a table function, calls that resume, aliases, the answer cache."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import aliases, tables
from corvane.operators import chunking, generation, providers
from corvane.sources import files, folder
from corvane.storage import complete_folders


def made(tmp_path):
    texts = {"general/gen.md": "# Hello\nWorld of all", "finance/fin.MD": "# Money\r\nOnly some é", "finance/deep/er/x.md": "y" * 3000, "other/x.md": "no", "hr/hr_data.csv": "a,b\n1,2\n", "hr/notes.txt": "no", "hr/md": "no"}
    for name, text in texts.items():
        (tmp_path / "base" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "base" / name).write_bytes(text.encode())
    (tmp_path / "base/general/odd.md").write_bytes(b"bad \xff byte")
    return str(tmp_path / "base")


def test_folder_source_equals_discovery(spark, tmp_path):
    base = made(tmp_path)
    folder.register(spark)
    rows = spark.read.format("collection").load(base)
    plain = lambda df: sorted((r.source_path.replace("file:///", "/").replace("file:/", "/"), *r[1:]) for r in df.collect())
    names = ["source_path", "owner_dept", "doc_type", "sensitivity"]
    assert plain(rows.select(names)) == plain(files.discover(spark, base).select(names))
    assert plain(rows.where("doc_type = 'md'").select("source_path", "text")) == plain(files.markdown(spark, base).select("source_path", "text"))
    assert rows.where("owner_dept = 'finance' and doc_type = 'md' and size > 100").count() == 1
    assert spark.read.format("collection").load(str(tmp_path / "none")).count() == 0


def test_filters_reach_the_listing(tmp_path):
    reader = folder.CollectionReader(made(tmp_path), 100)
    assert len(reader.found()) == 5 and len(reader.partitions()) == 2
    rest = list(reader.pushFilters([folder.EqualTo(("owner_dept",), "finance"), folder.In(("doc_type",), ("md", "csv")), folder.EqualTo(("size",), 3)]))
    assert [f.attribute for f in rest] == [("size",)] and {f[1] for f in reader.found()} == {"finance"}
    batch = next(reader.read(folder.Files([f for f in reader.found() if f[3] < 100])))
    assert batch.column("text").to_pylist() == ["# Money\r\nOnly some é"]


def test_filters_open_fewer_files(spark, tmp_path):
    """A file that a filter rules out may even be unreadable."""
    base = made(tmp_path)
    folder.register(spark)
    os.remove(f"{base}/general/gen.md")
    os.symlink("/proc/self/mem", f"{base}/general/gen.md")
    rows = spark.read.format("collection").load(base)
    assert rows.where("owner_dept = 'finance'").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        rows.where("owner_dept = 'general'").select("text").collect()


def test_table_function_equals_the_chunker(spark):
    r = random.Random(4)
    lines = ["# A", "## B ", "#### D", "#no", "```", "text of it", "", "  ", "x" * 900, "word " * 600, "\x85", "# é", " # x"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(25))) for _ in range(60)] + ["", None, "one\r\n# two\r\nthree"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_path string, text string")
    tables.register(spark)
    docs.createOrReplaceTempView("texts_of_files")
    names = ["source_path", "section_path", "ordinal", "chunk_index", "text"]
    got = spark.sql("select source_path, c.* from texts_of_files d, lateral chunk_markdown(d.text, 100, 10) c").select(names)
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = plain(chunking.chunk_markdown(docs, 100, 10).select(names))
    assert plain(got) == want and len(want) > 300


def test_each_text_is_paid_for_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.mkdir(log)

    def fails(texts):
        if random.random() < 0.4:
            raise OSError("busy")
        with open(f"{log}/{os.getpid()}-{random.random()}", "w") as f:
            f.write("\n".join(texts) + "\n")
        return [[float(len(t)), 1.0] for t in texts]

    texts = [f"text {i % 700}" for i in range(1000)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, said string").repartition(6)
    path = str(tmp_path / "ledger")
    out = providers.paid_once(rows, fails, "m", path, text="said", tries=2, wait=0.01, rounds=20).collect()
    assert sorted((r.id, r.value) for r in out) == [(i, [float(len(t or "")), 1.0]) for i, t in enumerate(texts)]
    calls = [line for name in os.listdir(log) for line in open(f"{log}/{name}").read().split("\n")[:-1]]
    assert sorted(calls) == sorted({t or "" for t in texts})  # each once, repeated texts and failures or not
    rounds = len(complete_folders(spark, path))

    def never(texts):
        raise AssertionError

    again = providers.paid_once(rows, never, "m", path, text="said")
    assert again.count() == 1002 and len(complete_folders(spark, path)) == rounds
    with pytest.raises(RuntimeError, match="not answered"):
        providers.paid_once(rows.limit(3), never, "other model", path, text="said", tries=2, wait=0.001, rounds=2)


def test_waits_grow(monkeypatch):
    waits, n = [], iter(range(10))
    monkeypatch.setattr(providers.time, "sleep", waits.append)
    call = lambda texts: [1] if next(n) > 2 else 1 / 0
    assert providers._called(["x"], call, 5, 0.5) == [1] and waits == [0.5, 1.0, 2.0]
    assert providers._called(["x", "y"], lambda t: [1], 2, 0.5) is None


def brute_aliases(text, names, words):
    out, at = "", 0
    while at < len(text):
        hits = [n for n in names if n and text.startswith(n, at)]
        if words:
            hits = [n for n in hits if not (at and text[at - 1].isalnum()) and not text[at + len(n) : at + len(n) + 1].isalnum()]
        if hits:
            best = max(hits, key=len)
            out, at = out + names[best], at + len(best)
        else:
            out, at = out + text[at], at + 1
    return out


@pytest.mark.parametrize("words", [False, True])
def test_aliases_by_hand(spark, words):
    r = random.Random(7)
    names = {"ab": "1", "abc": "22", "bcd": "", "é": "e", "c": "ab", "a b": "~", "": "never"}
    texts = ["".join(r.choice("abcdé .") for _ in range(30)) for _ in range(300)] + ["", None]
    got = aliases.normalized(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, query string, query_original string"), names, words=words)
    assert {r.id: (r.query, r.query_original) for r in got.collect()} == {i: (t if t is None else brute_aliases(t, names, words), t) for i, t in enumerate(texts)}
    assert aliases.replaced("as it is", aliases.automaton({})) == "as it is"


def test_answers_are_kept_and_end(spark):
    rows = [(i, f"q{i % 3}", [(1, "s", "", f"text {i % 2}")]) for i in range(6)] + [(6, "q0", [(1, "s", "", "text 0")])]
    asked = spark.createDataFrame(rows, "query_id long, query string, snippets array<struct<place:int,source_path:string,section_path:string,text:string>>")
    empty = spark.createDataFrame([], "key string, value string, at timestamp, expires_at timestamp")
    noon = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    answer = lambda rows: rows.withColumn("answer", F.when(F.col("query") != "q2", F.concat(F.lit("a "), F.col("prompt"))))
    given, cache = generation.answered(asked, empty, answer, "m", noon)
    found = {r.query_id: (r.answer, r.cached) for r in given.collect()}
    assert found[0] == found[6] and found[0][1] is False and re.match("a Query:\nq0", found[0][0]) and found[2] == (None, False)
    assert cache.count() == 4  # two questions, two contexts; failures are not kept
    never = lambda rows: rows.withColumn("answer", F.lit("new"))
    again, cache2 = generation.answered(asked, cache, never, "m", noon + F.expr("interval 59 minutes"))
    assert {r.query_id: r.cached for r in again.collect()} == {i: i % 3 != 2 for i in range(7)} and cache2.count() == 6
    over, _ = generation.answered(asked, cache, never, "m", noon + F.expr("interval 1 hour"))
    assert {r.answer for r in over.collect()} == {"new"}
    other, _ = generation.answered(asked, cache, never, "another", noon)
    assert not any(r.cached for r in other.collect())
