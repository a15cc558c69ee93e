"""Operators 11 to 13 against plain versions, on odd tables and beside their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import hard_negatives, importance, queries, rule_ledger

DATA = "/root/testdata/sf0.001"
ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (3, "one two"), (3, "other words"), (None, "one two " * 20), (4, "12 !? é ÉCOLE"), (5, "word " * 30_000), (6, "a" * 100_000 + " Übermaß\x00x\x1f" + "b" * 70)]
EXTRA = "rank long, score string, weight string, n long, buckets string, times string, kept string, fail_bits string, label2 string, text2 string, block string, chunk string"


def documents(spark, rows=None, names="doc_id long, text string"):
    from pyspark.sql import functions as F

    out = spark.createDataFrame(ODD if rows is None else rows, names)
    for c in EXTRA.split(", "):
        name, kind = c.split(" ")
        out = out.withColumn(name, F.lit("1").cast(kind))
    return out


def plain(rows):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op11_importance", "op12_rules", "op13_negatives"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA).select(want.columns)
    assert got.count() > 20 and plain(got.collect()) == plain(want.fetchall())


# ---- 11


def test_crc_of_words_and_of_runs():
    r = random.Random(3)
    some = ["", "a", "é", "word", "x" * 63, "y" * 64, "z" * 65, "ü" * 3000] + ["".join(r.choice("abcé9ß") for _ in range(r.randrange(1, 40))) for _ in range(300)]
    data = np.frombuffer("".join(some).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in some])
    ends = np.cumsum(size)
    crc = importance.word_crcs(data, ends - size, ends)
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in some]
    of = np.sort(np.array([r.randrange(40) for _ in some]))
    runs = list(importance.run_crcs(crc, size, of, 4))
    assert len(runs) == 4
    for n, (got, text) in enumerate(runs, 1):
        want = [(zlib.crc32(" ".join(some[i : i + n]).encode()), of[i]) for i in range(len(some) - n + 1) if of[i] == of[i + n - 1]]
        assert [(c, t) for c, t in zip(got.tolist(), text, strict=True) if t >= 0] == want
    assert importance.word_crcs(data, ends[:0], ends[:0]).tolist() == []


def brute_resampling(docs, target, longest, buckets, least, percent, seed):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def found(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    each = [(i, len(words(t)), found(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in found(x))
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in s}
    rows = []
    for i, w, f in each:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return rows


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    r = random.Random(8)
    docs = ODD + [(10 + i % 150, " ".join([r.choice(["Red", "green", "blue", "ÉTÉ", "x9", "über-groß", "end"]) for _ in range(r.randrange(60))])) for i in range(300)]
    target = ["red green", None, "end of it all x9 x9", ""]
    got = importance.resampled(documents(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), longest, 500, 5, 40, 7)
    want = brute_resampling(docs, target, longest, 500, 5, 40, 7)
    assert plain(got.collect()) == plain(want) and sum(x[4] is not None for x in want) > 80


def test_resampling_of_nothing(spark):
    none = documents(spark, [])
    some = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(none, some).count() == 0
    assert {(x.weight, x.n_features) for x in importance.resampled(documents(spark), some.limit(0), least=1, percent=100).where("doc_id < 3").collect()} == {(0, 0)}


def test_copies_of_one_row_are_drawn_next_to_each_other(spark):
    docs = [(1, "b b b b")] * 400 + [(i, "a c") for i in range(2, 402)]
    got = importance.resampled(documents(spark, docs), spark.createDataFrame([("b",)], "text string"), least=1, percent=60)
    ranks = sorted(x["rank"] for x in got.where("rank is not null").collect())
    own = sorted(x["rank"] for x in got.where("doc_id = 1 and rank is not null").collect())
    assert ranks == list(range(1, 481)) and own == list(range(own[0], own[0] + len(own)))


# ---- 12


def brute_measures(text):
    text = text or ""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    w = split(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(runs)
    again = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if split(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    letter = lambda x: re.search("[A-Za-z\x80-\U0010ffff]", x)
    return [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), len(lines), sum(1 for x in w if letter(x)), sum(split(x)[-1].endswith(("...", "…")) for x in lines), sum(split(x)[0].startswith(("-", "*", "•")) for x in lines)]


def test_measures_equal_brute_force():
    r = random.Random(5)
    parts = ["a", "A", "é", "#1", "…", "...", "..", "- x", "•", "* y", "\n", "\n", "\n", " ", "\t", "\r", "\x0b", "\xa0", "one two three four five six", "12", "&|<>", "end...", "a b c d e"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(80))) for _ in range(400)]
    texts += [t or "" for _, t in ODD[:8]] + ["x y z v w " * 9, "\n\n\n", "same\nsame\n same\nsame ", "…", "..", "•\n-\n*", "one two three four one two three four one two three four one"]
    got = rule_ledger.measures(pa.array(texts))
    assert got.tolist() == [brute_measures(t) for t in texts]
    assert rule_ledger.measures(pa.array([None], pa.string())).tolist() == [[0] * 9] and len(rule_ledger.measures(pa.array([], pa.string()))) == 0


def test_ledger_on_odd_tables(spark):
    rows = rule_ledger.judged(documents(spark)).collect()
    assert len(rows) == len(ODD)
    assert plain((x.doc_id, x.n_words, x.n_repeat_words) for x in rows) == plain((i, brute_measures(t)[0], brute_measures(t)[4]) for i, t in ODD)
    assert all(x.base_failed and not x.kept for x in rows if x.doc_id in (0, 1, 2, 3, 5)) and rule_ledger.judged(documents(spark, [])).count() == 0


def test_policies_and_ablations_come_from_bits(spark):
    r = random.Random(2)
    bits = [sum(1 << b for b in range(9) if r.random() < 0.15) for _ in range(500)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id long, fail_bits long")
    policies = {1: ("few_words",), 7: ("symbols", "few_words", "equal_lines")}
    masks = {v: rule_ledger.mask(p) for v, p in policies.items()}
    kept = {(x.doc_id, x.version): (x.kept, x.reasons) for x in rule_ledger.verdicts(rows, policies).collect()}
    assert kept == {(i, v): (b & m == 0, b & m) for i, b in enumerate(bits) for v, m in masks.items()}
    found = rule_ledger.ablation(rows, policies).collect()
    assert len(found) == 4
    for x in found:
        m, own = masks[x.version], rule_ledger.bit(x.rule)
        others = 0
        for b in bits:
            others |= (b & m ^ own) if b & own else 0
        assert x.n_failed == sum(b & own > 0 for b in bits) and x.fails_with == others
        assert x.n_kept == sum(b & m == 0 for b in bits) and x.n_kept_without == sum(b & (m ^ own) == 0 for b in bits) and x.n_alone == x.n_kept_without - x.n_kept


# ---- 13


def brute_negatives(rows, every, most, near):
    part = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [min(max(math.floor(256 * x), -(1 << 25)), 1 << 25) for x in v]))
    out = []
    for i, label, v in part:
        if i % every:
            continue
        score = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, k) for j, k, w in part if j != i)
        for s, j, _ in [x for x in score if x[2] == label][:most]:
            within = [x for x in score if x[2] != label and near[0] * -s <= near[1] * -x[0] and -x[0] <= -s]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(within[:most], 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as id", "'x' as block", "'y' as rank", "'z' as part", "'v' as vector")


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_negatives_equal_brute_force(spark, depth):
    r = np.random.default_rng(6)
    center = r.standard_normal((4, 7)) / 3
    rows = [(int(i), int(r.integers(3)), (center[i % 4] + 0.1 * r.standard_normal(7)).tolist()) for i in range(600)]
    rows += [(600 + i, 1, rows[40][2]) for i in range(80)] + [rows[40]] * 3 + [(40, 2, rows[41][2]), (80, 1, rows[80][2])]  # equal scores, repeated ids
    rows += [(None, 1, rows[0][2]), (700, None, rows[0][2]), (720, 1, None), (740, 1, [math.nan] * 7), (760, 1, [None] * 7), (780, 1, [math.inf] * 7), (800, 1, []), (820, 2, [3.0]), (840, 2, [1e12, -1e12]), (-20, -1, rows[0][2])]
    got = hard_negatives.mined(vectors(spark, rows), 20, 4, 3, (4, 5), depth)
    want = brute_negatives(rows, 20, 4, (4, 5))
    assert len(want) > 100
    got = [tuple(x) for x in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    # Windows of equal positives of one anchor: most is 4 positives and 3 negatives.
    assert plain(got) == plain([x for x in want if x[2] <= 3])


def test_negatives_of_nothing(spark):
    assert hard_negatives.mined(vectors(spark, [])).count() == 0
    assert hard_negatives.mined(vectors(spark, [(1, 1, [0.5])])).count() == 0
    assert hard_negatives.mined(vectors(spark, [(100, 1, [0.5]), (200, 2, [0.5])])).count() == 0


def test_products_are_exact_beyond_doubles():
    a = np.full((2, 512), (1 << 25) - 1, dtype=np.int32)
    assert hard_negatives._product(a, -a).tolist() == [[-512 * ((1 << 25) - 1) ** 2] * 2] * 2
