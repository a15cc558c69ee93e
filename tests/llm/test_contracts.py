"""Values on odd tables, brute-force versions, held-out rows and bounds of work."""

import hashlib
import html
import os
import random
import re
import resource
import string
import time
import uuid
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from corvane.llm import bpe, embed_dedup, html_text, jaccard, langid, mixing, quality, secret_scan, simhash, toxicity

MID = "/root/testdata/sf0.01"
CLASH = "h string, row long, digit string, taken string, label string, part int, text2 string, last boolean, n string, key string, spans string, ids string, x string, lang_pred string, score string, predicted string"


def table(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """rows with columns that have the names of results and of working columns."""
    wide = table(spark, rows)
    for c in CLASH.split(", "):
        name, kind = c.split(" ")
        from pyspark.sql import functions as F

        wide = wide.withColumn(name, F.lit("1").cast(kind))
    return wide


ODD = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n", "en", "a", 2), (3, "one two", "en", "b", 7), (3, "one two", "en", "b", 7), (3, "other words", "de", "b", 11), (None, "one two", "en", "b", 7), (4, "12 !?", "fr", None, 5), (5, "word " * 30_000, "en", "a", 150_000)]


def test_values_on_odd_tables(spark):
    rows = clashing(spark, ODD)
    labels = table(spark, [(1, 1, 0), (3, 0, 1), (3, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = lambda df, *names: sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)

    one = bpe.round_trip(rows.select("doc_id", "text"))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got(one, "doc_id", "decoded_sha256") == sorted(((r[0], sha(r[1])) for r in ODD), key=repr)
    for scored in (quality.quality_scores(rows, labels), toxicity.toxicity_scores(rows, labels)):
        out = got(scored, "doc_id", "score")
        assert [x[0] for x in out] == sorted((r[0] for r in ODD), key=repr) and all(0 <= s <= 1 for _, s in out)
        assert len({s for i, s in out if i in (0, 1)}) == 1  # null is empty
    n = {0: 0, 1: 0, 2: 0, 4: 1, 5: 1, None: 1}
    found = got(jaccard.jaccard_components(rows), "doc_id", "n_shingles", "component_id")
    assert found == sorted([(i, k, i) for i, k in n.items()] + [(3, 1, 3)] * 3, key=repr)
    langs = got(langid.languages(rows), "doc_id", "lang_pred", "score")
    assert [x[1:] for x in langs if x[0] in (0, 1, 2, 4)] == [("und", 0.0)] * 4 and all(x[1] in ("en", "de") for x in langs if x[0] in (3, 5))
    spans = got(secret_scan.with_digests(secret_scan.secrets(rows)), "doc_id", "n_hex", "spans")
    assert spans == sorted(((r[0], 0, "") for r in ODD), key=repr)
    sizes = got(mixing.mixed(rows), "doc_id", "size")
    assert sizes == sorted(((r[0], len((r[1] or "").split())) for r in ODD), key=repr)
    prints = simhash.edited_fingerprints(rows).collect()
    zero = "0" * 32
    assert {x.fingerprint for x in prints if x.doc_id in (0, 1, 2)} == {zero} and len({x.fingerprint for x in prints if x.n_chars == 7}) == 1
    assert sorted(x.n_chars for x in prints) == sorted(len(r[1] or "") for r in ODD)

    empty = rows.where("false")
    for out in (bpe.round_trip(empty.select("doc_id", "text")), quality.quality_scores(empty, labels), toxicity.toxicity_scores(empty, labels), jaccard.jaccard_components(empty), langid.languages(empty), secret_scan.secrets(empty), mixing.mixed(empty), simhash.edited_fingerprints(empty)):
        assert out.count() == 0


def test_samples_are_bounded_by_rows(spark):
    """A labelled id with thousands of rows brings no more than the sample to the driver."""
    rows = table(spark, [(1, f"text {i}", "en", "a", 1) for i in range(3000)] + [(i, "good words here", "en", "a", 1) for i in range(10, 40)])
    labels = table(spark, [(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    from corvane.llm import common

    sample = common.first_rows(common.labelled(rows, labels, "quality", 4, 2, 500), 500, "text")
    assert sample.count() == 500
    assert quality.quality_scores(rows, labels, sample=500).count() == rows.count()


def test_rare_languages_are_learned(spark):
    r = random.Random(4)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, say("abcdef"), "aa", "s", 1) for i in range(6000)] + [(10_000 + i, say("uvwxyz"), "zz", "s", 1) for i in range(30)]
    out = langid.languages(table(spark, rows), sample=400).where("held_out and doc_id >= 10000").collect()
    assert out and all(x.lang_pred == "zz" for x in out)


def test_toxicity_and_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    t = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    assert (t.predicted == t.toxic).mean() > 0.95 and (t.predicted[t.toxic == 0] == 0).mean() > 0.97
    q = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert (q.predicted == q.quality).mean() > 0.93


def test_trees_equal_a_walk_by_hand():
    r = np.random.default_rng(3)
    x = r.standard_normal((500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.Trees.fit(x, y)
    for i in range(0, 500, 50):
        total = trees.bias
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[i, feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert abs(trees.score(x[i : i + 1])[0] - 1 / (1 + np.exp(-total))) < 1e-9
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


def test_sparse_weights_equal_plain_ftrl():
    """The update of each coordinate, written out for one weight at a time."""
    r = random.Random(5)
    docs = [np.array(sorted(r.sample(range(12), 4)), dtype=np.uint32) for _ in range(60)]
    y = np.array([float(3 in d) for d in docs])
    got = toxicity.Sparse.fit(docs, y)
    z, n = {}, {}
    bias = zb = nb = 0.0
    count = {k: sum(k in d for d in docs) for k in range(12)}

    def weight(k):
        if abs(z.get(k, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * toxicity.L1) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(y)):
            keys = [int(k) for k in docs[i] if count[int(k)] >= toxicity.LEAST]
            bias = -zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA)
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y[i]
            for k in keys:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[k]
                n[k] = old + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * bias
            nb += g * g
    want = {k: weight(k) for k in z if weight(k)}
    assert got.keys.tolist() == sorted(want) and np.allclose(got.weights, [want[k] for k in sorted(want)]) and abs(got.bias - bias) < 1e-9


def plain_base(text):
    """Base spans by the patterns as they are stated."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    bits = ["password", "Secret", "API_KEY", "apikey", "token", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "aB3/+_.-", "é", "\n", "x"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert sorted(secret_scan.base_spans(text)) == sorted((a, secret_scan.KINDS.index(k), b) for k, a, b in plain_base(text))


def test_random_strings_against_digests_paths_and_prose():
    """Recall on planted strings of six alphabets, and what else is taken for one."""
    encoder, r = secret_scan._encoder(secret_scan.default_path()), random.Random(8)
    found = lambda text: any(k == 3 for _, k, _ in secret_scan.random_spans(text, secret_scan.base_spans(text), encoder))
    full = string.ascii_letters + string.digits
    planted = [full, full + "+/", full + "-_", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters]
    hits = [found("key " + "".join(r.choice(a) for _ in range(n)) + " end") for a in planted for n in (20, 24, 32, 40, 64) for _ in range(60)]
    assert sum(hits) >= 0.995 * len(hits)
    words = "the quick report of second quarter revenue shows growth across every region and product".split()
    say = lambda joint, n: joint.join(r.choice(words) for _ in range(n))
    clean = [lambda: hashlib.sha256(str(r.random()).encode()).hexdigest().upper(), lambda: str(uuid.UUID(int=r.getrandbits(128))).upper(), lambda: "/" + say("/", 6), lambda: say("_", 5) + f"_v{r.randint(1, 20)}", lambda: say("-", 5) + "-x86_64-linux-gnu", lambda: f"2024-05-{r.randint(10, 28)}/12-30-00_000123", lambda: say(" ", 30), lambda: "=" * 60]
    wrong = [found("see " + f() + " end") for f in clean for _ in range(100)]
    assert sum(wrong) <= 0.01 * len(wrong)


def test_secret_scan_takes_time_in_proportion():
    encoder = secret_scan._encoder(secret_scan.default_path())
    for text in ("-" * 10_000 + "v2", "/a" * 100_000 + "!v2", "aB" * 200_000, ("AKIA" + "A" * 20 + " ") * 10_000):
        began = time.time()
        secret_scan.random_spans(text, secret_scan.base_spans(text), encoder)
        assert time.time() - began < 1


def test_mix_equals_sql_on_documents(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{MID}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    rows = mixing.mixed(spark.read.parquet(f"{MID}/documents.parquet")).select(names).collect()
    plain = lambda rs: sorted((*r[:3], round(r[3], 6), r[4]) for r in map(tuple, rs))
    assert plain(rows) == plain(con.execute(mixing.SQL).fetchall())


def test_mix_takes_no_source_above_its_target(spark):
    """Repeated rows, null ids and sources, long documents: never above the target, and no document that fits is left."""
    r = random.Random(9)
    rows = [(r.choice([None, i // 3, i]), "w " * r.choice([1, 5, 5, 30, 400]), None, r.choice(["a", "b", "c", None]), None) for i in range(400)]
    rows += [(7, "w " * 50, None, "d", None)] * 30
    got = mixing.mixed(table(spark, rows)).collect()
    for s in {x.source for x in got}:
        some = [x for x in got if x.source == s]
        gap = some[0].target - sum(x.taken for x in some)
        assert gap >= 0 and all(x.taken <= 2 * x.size for x in some)
        least = min(x.taken // x.size for x in some if x.size)
        assert not any(x.size and x.taken // x.size == least and x.size <= int(gap) for x in some) or least == 2


def test_mix_of_many_patterns_loses_no_word(spark, monkeypatch):
    """Targets are met whether flows are broadcast or shuffled, however many sets of sources there are."""
    r = random.Random(1)
    rows = [(i, "w " * 10, sorted(r.sample("abcdefgh", r.randint(1, 4)))) for i in range(600)]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), []
    for most in (200_000, 5):
        monkeypatch.setattr(mixing, "BROADCAST", most)
        found.append(sorted((x.doc_id, x.taken, x.target) for x in mixing.mixed(docs).collect()))
    assert found[0] == found[1] and len(found[0]) == 600 and all(0 <= t <= 20 for _, t, _ in found[0])
    targets = {s: t for (_, _, s), (_, _, t) in zip(rows, found[0], strict=True) for s in s[:1]}
    words = sum(t for _, t, _ in found[0])
    total = sum(t for s, t in targets.items())
    assert len({tuple(s) for _, _, s in rows}) > 100 and words > 0.9 * min(total, 12_000)


def test_flow_on_many_patterns_ends():
    r = random.Random(3)
    patterns = [(tuple(sorted(r.sample(range(40), r.randint(1, 5)))), r.randint(1, 1000)) for _ in range(20_000)]
    began = time.time()
    flow = mixing.min_cost_flow(patterns, [200_000] * 40, 2)
    assert time.time() - began < 20 and all(sum(f) <= 2 * z for f, (_, z) in zip(flow, patterns, strict=True))


def plain_simhash(text):
    """128 votes over distinct words (1) and adjacent pairs (2), with the hashes of the operator's terms."""
    import pyarrow as pa

    from corvane.llm.common import U, mix64, text_bytes, word_hashes, words

    data, offsets = text_bytes(pa.array([text], pa.large_string()))
    starts, ends, _ = words(data, offsets)
    h = [int(x) for x in word_hashes(data, starts, ends)]
    mixed = lambda x: int(mix64(np.array([x % 2**64], dtype=np.uint64))[0])
    terms = [(mixed(x >> 20), 1) for x in {x >> 20 << 20 for x in h}]
    terms += [(mixed(x >> 20), 2) for x in {mixed(a * 3 + b) >> 20 << 20 for a, b in zip(h, h[1:], strict=False)}]
    votes = np.zeros(128)
    for t, w in terms:
        for half, value in enumerate((t, mixed(t + 0x9E3779B97F4A7C15))):
            raw = value.to_bytes(8, "little")
            for j in range(64):
                votes[half * 64 + j] += w if raw[j // 8] >> (7 - j % 8) & 1 else -w
    assert U(0) == 0
    return np.packbits(votes > 0).tobytes().hex()


def test_fingerprints_equal_plain_votes(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").orderBy("doc_id").limit(60).collect()
    import pyarrow as pa

    got = [x.tobytes().hex() for x in simhash.fingerprints(pa.array([d.text for d in docs] + ["", "a", "a a b"], pa.large_string()))]
    assert got == [plain_simhash(d.text or "") for d in docs] + [plain_simhash(t) for t in ("", "a", "a a b")]


@pytest.mark.parametrize("common", [1000, 3])
def test_radius_search_equals_brute_force_on_a_whole_table(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common)
    r = random.Random(6)
    prints = [x.fingerprint for x in simhash.fingerprinted(spark.read.parquet(f"{MID}/documents.parquet")).collect()]
    for p in r.sample(prints, 60):  # near ones, so that there is something to find
        for _ in range(3):
            bits = int(p, 16)
            for _ in range(r.randint(1, 4)):
                bits ^= 1 << r.randrange(128)
            prints.append(f"{bits:032x}")
    distinct = sorted(set(prints))
    x = np.array([list(bytes.fromhex(p)) for p in distinct], dtype=np.uint8)
    want = set()
    for i in range(len(x)):
        d = np.bitwise_count(x ^ x[i]).sum(axis=1)
        want |= {(distinct[i], distinct[j], int(d[j])) for j in np.flatnonzero(d <= 3) if j > i}
    got = {tuple(p) for p in simhash.within_radius(spark.createDataFrame([(p,) for p in prints], "fingerprint string"), 3).collect()}
    assert got == want and len(want) > 100


def test_edited_texts_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: -x[0])
    got = {r.doc_id: r.edited_sha256 for r in simhash.edited_fingerprints(docs).collect()}
    for i, (k, t) in enumerate(rows):
        m, follow = len(t) // 3, rows[(i + 1) % len(rows)][1]
        assert got[k] == hashlib.sha256((t[: len(t) - m] + follow[:m]).encode()).hexdigest()


class Article(HTMLParser):
    """The text blocks inside <article>, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.blocks = False, [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text and self.inside:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("b", "i", "em", "a"):
            self.cut()
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "a", "br"):
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        self.parts.append(data)


def test_page_texts_equal_an_independent_extraction(spark):
    rows = html_text.main_texts(spark.read.parquet(f"{MID}/pages.parquet")).collect()
    pages = {p.page_id: p.html for p in spark.read.parquet(f"{MID}/pages.parquet").collect()}
    same = 0
    for x in rows:
        parser = Article()
        parser.feed(pages[x.page_id] or "")
        parser.close()
        same += x.text == "\n\n".join(parser.blocks)
        assert x.n_chars == len(x.text)
    assert len(rows) == len(pages) and same >= 0.99 * len(rows)


def test_many_languages_take_bounded_memory():
    r = np.random.default_rng(5)
    langs = [f"l{i}" for i in range(1000)]
    weights = r.standard_normal((1 << langid.BITS, len(langs))).astype(np.float32)
    model = langid.Model(langs, weights, np.zeros(len(langs)), 1.0)
    texts = ["some words of a language " * 400, "", None, "and others " * 10_000]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got, _ = model.logits(texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    hashes, owners, total, _ = langid.ngrams(texts[:1])
    plain = sum(weights[h].astype(np.float64).sum(axis=0) for h in hashes) / total[0]
    assert np.abs(got[0] - plain).max() < 1e-3


def test_layouts_without_a_frame():
    model = html_text.train()
    text = lambda page: html_text.extract([page], model)[0]
    assert text("<p>First words of the page here.</p><p>Second part of the page, with more words.</p>").count("\n\n") == 1
    assert text("<article><h1>Title of it</h1><p>Words of the text are here.</p><dl><dt>Term<dd>Meaning of it.</dl></article>").endswith("Term\n\nMeaning of it.")
    got = text('<article><h1>Title of it</h1><p>Words of the text are here.</p></article><section class="comments"><h2>Comments</h2><p>Great post.</p></section>')
    assert got == "Title of it\n\nWords of the text are here."
    r, right, every = np.random.default_rng(987), 0, 0
    for _ in range(300):
        x, y = html_text.labelled_page(html_text.sample_page(r))
        if len(x):
            batch, mask, _ = html_text.padded([x], None)
            right, every = right + int(((model.forward(batch, mask)[0][0] >= 0.5) == y).sum()), every + len(y)
    assert right >= 0.99 * every


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    model = html_text.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = r.standard_normal((2, 4, html_text.INPUT)), (r.random((2, 4)) > 0.5).astype(float)
    mask = np.array([[True] * 4, [True, True, True, False]])

    def loss():
        p = model.forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grad = model.gradients(x, mask, y)
    for k, w in model.p.items():
        for at in r.integers(0, w.size, 6):
            place = np.unravel_index(at, w.shape)
            was, step = w[place], 1e-3
            w[place] = was + step
            up = loss()
            w[place] = was - step
            slope = (up - loss()) / (2 * step)
            w[place] = was
            assert abs(slope - grad[k][place]) < 2e-4, k


def test_odd_pages(spark):
    kinds = "page_id long, url string, html string, text string, n_chars string, label string"
    rows = [(1, None, "<html><head><title>t</title><p>" + "First words of the page. " * 3, "x", "y", "z"), (2, "u", None, "x", "y", "z"), (2, "u", "", "x", "y", "z"), (None, "u", "plain &amp; simple text, and nothing else.", "x", "y", "z")]
    got = html_text.main_texts(spark.createDataFrame(rows, kinds))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((x.page_id or 0, x.n_chars == len(x.text)) for x in got.collect()) == [(0, True), (1, True), (2, True), (2, True)]
    assert html_text.main_texts(spark.createDataFrame([], kinds)).count() == 0
    assert [b[1] for b in html_text.blocks(rows[3][2])] == ["plain & simple text, and nothing else."]


def test_long_pages_take_time_and_memory_in_proportion():
    model = html_text.train()
    short = [b for i in range(40) for b in html_text.blocks(html_text.sample_page(np.random.default_rng(i)))]
    assert (model.label([short], most=64)[0] == model.label([short])[0]).all()
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    page = "<article>" + "".join(f"<p>word number {i} of it." for i in range(60_000)) + "</article>"
    labels = model.label([html_text.blocks(page)])[0]
    assert len(labels) == 60_000 and time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    for bad in ("<a " * 100_000, "<svg " * 100_000, "<!" * 200_000, "<p '" * 100_000, "<div>w " * 50_000, "<y>" * 20_000 + "</x>" * 20_000):
        began = time.time()
        html_text.blocks(bad)
        assert time.time() - began < 5
    assert html.unescape("&amp;") == "&" and zlib.crc32(b"") == 0 and os.sep


def links_by_hand(rows):
    x, lab = np.array([v for _, v, _ in rows]), np.array([k for _, _, k in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])


def test_recall_of_vectors_in_windows(spark):
    """Labels of several windows: 3,000 near copies, pairs just above the least cosine, many mid-sized groups."""
    r = np.random.default_rng(5)
    near = r.standard_normal(64) / 8 + 0.0173 * r.standard_normal((3000, 64))
    base = r.standard_normal((2500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = r.standard_normal((2500, 64))
    aside -= (aside * base).sum(axis=1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    angle = np.arccos(0.9801)
    pairs = np.concatenate([base, base * np.cos(angle) + aside * np.sin(angle)])
    groups = np.concatenate([r.standard_normal(64) / 8 + 0.0173 * r.standard_normal((30, 64)) for _ in range(120)])
    for x in (near, pairs, groups):
        rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
        want = links_by_hand(rows).sum(axis=1) - 1
        got = {x.vec_id: x for x in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        found = np.array([got[i].n_links for i in range(len(rows))])
        assert (found <= want).all() and found.sum() >= 0.9 * want.sum() > 0


def test_vectors_of_one_id_and_of_odd_tables(spark):
    r = np.random.default_rng(6)
    a, b = (r.standard_normal(8).tolist() for _ in range(2))
    kinds = "vec_id long, embedding array<double>, label int, node long, n_links string, h string, pass int, run long"
    rows = [(i, v, 1, 0, "x", "y", 0, 0) for i, v in ((2, a), (2, b), (5, a), (7, b), (7, b), (9, [1.0] * 9))]
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embed_dedup.near_vectors(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(2, 1, 2, True), (2, 2, 2, True), (5, 1, 2, False), (7, 2, 2, False), (7, 2, 2, False), (9, 0, 9, True)]
    assert embed_dedup.near_vectors(spark.createDataFrame([], kinds)).count() == 0
    long = [(i, [1.0 + i % 3, *([0.5] * 4999)], 1, 0, "x", "y", 0, 0) for i in range(40)]
    assert [x.n_links for x in embed_dedup.near_vectors(spark.createDataFrame(long, kinds)).collect()] == [39] * 40


@pytest.mark.parametrize("sizes", [(4, 1, 8), (3, 2, 4)])
def test_jaccard_tiles_lose_no_link(spark, monkeypatch, sizes):
    """Tiles and slices of a few sets, so that every way of large groups is taken."""
    import test_llm

    for name, value in zip(("TILE", "LEADERS", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    # An order of shingles that tells nothing: blocks are as large as they can be.
    monkeypatch.setattr(jaccard, "_sketch", lambda rows: np.zeros(1 << jaccard.SKETCH_BITS, dtype=np.uint32))
    test_llm.test_jaccard_equals_brute_force(spark)


def test_jaccard_of_documents_that_share_a_passage(spark):
    from pyspark.sql import functions as F

    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.hex(F.xxhash64(i, F.col("id")))), " ")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(f"p{i}" for i in range(80)) + " "), own).alias("text"))
    began = time.time()
    out = jaccard.jaccard_components(docs).agg(F.countDistinct("component_id").alias("n")).first().n
    assert out == 20_000 and time.time() - began < 120


def test_place_bound_keeps_every_linked_pair():
    """The bound by the first common shingle, on sets dealt at the threshold."""
    r = random.Random(11)
    for _ in range(2000):
        n, m = r.randint(2, 40), r.randint(2, 40)
        common = r.sample(range(100), min(n, m, r.randint(1, 40)))
        a, b = (sorted({*common, *r.sample(range(100, 200), max(0, k - len(common)))}) for k in (n, m))
        r.shuffle(rank := list(range(200)))
        a, b = (sorted(s, key=rank.__getitem__) for s in (a, b))
        k = len(set(a) & set(b))
        if not k or 100 * k < 80 * (len(a) + len(b) - k):
            continue
        first = next(x for x in a if x in b)
        least = jaccard.least_overlap(len(a), len(b), 80)
        for s in (a, b):
            assert s.index(first) <= len(s) - -(-80 * len(s) // 100)
            assert len(s) - min(255, s.index(first) * jaccard.STEPS // len(s)) * len(s) // jaccard.STEPS >= least


def test_pipeline_on_columns_of_any_name(spark):
    import corpus_pipeline

    raw = spark.read.parquet(f"{MID}/documents.parquet").limit(300)
    from pyspark.sql import functions as F

    for c in ("score", "lang_pred", "row", "times", "copy", "label", "component_id", "hash", "h", "taken"):
        raw = raw.withColumn(c, F.lit("own"))
    rows = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, MID)
        assert rows.columns == raw.columns, name
        assert rows.where("score <> 'own' or copy <> 'own'").count() == 0
    assert corpus_pipeline.encode_texts(spark, rows, MID).count() == rows.count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, raw.where("false"), MID).count() == 0


def test_pipeline_stages_equal_plain_versions(spark):
    """Stages 2, 3 and 4 against Python, on rows with nulls, repeated ids and ties."""
    import corpus_pipeline
    import test_llm

    r = random.Random(12)
    text = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    bases = [text(60) for _ in range(8)]
    rows = []
    for i in range(80):
        words = r.choice(bases).split()
        for _ in range(r.choice([0, 0, 1, 3])):
            words[r.randrange(len(words))] = "v%d" % r.randrange(10**6)
        rows.append((i, " ".join(words) + (" password=hunter2hunter2" if i % 7 == 0 else ""), "en", f"s{i % 3}" if i % 5 else None, 0))
    rows += [(100, None, "en", "s1", None), (101, "", "en", None, 0), (102, "tie", "en", "s1", 3), (103, "tie", "en", "s1", 3)]
    docs = table(spark, rows)
    label = test_llm.brute_components([x[1] for x in rows])[1]
    want = sorted(x for i, x in enumerate(rows) if label[i] == i)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((tuple(x) for x in kept.collect())) == want
    clean = corpus_pipeline.redact_secrets(spark, kept, "").collect()
    hide = lambda t: t and re.sub(r"password=[A-Za-z0-9+/_.=-]{12,}", "[SECRET]", t)
    assert sorted((x.doc_id, x.text) for x in clean) == [(x[0], hide(x[1])) for x in want]
    taken = {x.doc_id: x.taken // x.size for x in mixing.mixed(kept).collect() if x.size}
    out = corpus_pipeline.mix_sources(spark, kept, "").collect()
    assert sorted(x.doc_id for x in out) == sorted(i for i, n in taken.items() for _ in range(n))


def test_components_joined_by_more_edges(spark, tmp_path):
    """In one go and in two, on dealt graphs: the same labels."""
    from corvane.llm.common import components, joined_components, shared_folder

    r = random.Random(13)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    folder = shared_folder(spark)
    label = list(range(300))
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    want = {i: label[i] for i in {x for e in edges for x in e if e[0] != e[1]}}
    whole = components(frame(edges), folder)
    parts = joined_components(components(frame(edges[:120]), folder), frame(edges[120:]), folder)
    assert {x.node: x.label for x in whole.collect()} == want == {x.node: x.label for x in parts.collect()}
    assert joined_components(whole, frame(edges[:50]), folder) is whole
