"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters that are no letters read as blanks and letters as lower case; n-grams
of one to three characters are hashed. Document frequencies are counted over the
whole training fold. The weights are trained on about ``sample`` rows of it by
follow-the-regularised-leader with elastic-net penalties; a fifth of the sample
is kept back to fit the temperature that calibrates the scores. The sample holds
each language by its share, and about ``LEAST`` rows of it at least, of up to
``LANGS`` languages (the most frequent): rare languages are learned too. At most
``sample`` + LEAST * LANGS rows reach the driver.

Defined results: a null text or one without a letter is ``und`` with score 0;
without training rows every language is ``und``; rows keep null ids and repeated
rows are labelled each. Columns beyond doc_id, text and lang are not read, an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U, first_rows, shared_folder, slices, small_fold, stored, tidied

SAMPLE = 4_000
#: Rows that a language has in the sample, if it has so many, and languages that are learned.
LEAST, LANGS = 50, 1_000
#: log2 of the number of hashed n-grams.
BITS = 15
ORDERS = 3
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.3, 1e-3, 3, 20.0
#: Weights that are gathered at once while texts are scored.
GATHERED = 1 << 23
UND = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to itself if it is a letter, else to a blank."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32))
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """By order: hashed n-grams and the text of each; the number of n-grams and of letters of each text."""
    n = len(texts)
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower() + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edge = code == 0
    of = np.cumsum(edge) - edge
    code = np.where(edge, 0, _letter_table()[code]).astype(np.uint64)
    blank, letters = code <= 32, np.bincount(of[code > 32], minlength=n)
    hashes, owners, total = [], [], np.zeros(n)
    value, same, empty = np.zeros(len(code), dtype=np.uint64), ~edge, blank.copy()
    for k in range(ORDERS):
        m = len(code) - k
        if m <= 0:
            break
        value = value[:m] + (code[k:] + U(k + 1)) * _FACTORS[k]
        same = same[:m] & ~edge[k:]
        empty = empty[:m] & blank[k:]
        ok = same & ~empty
        hashes.append(((value[ok] * _FACTORS[0]) >> U(64 - BITS)).astype(np.int32))
        owners.append(of[:m][ok])
        total += np.bincount(owners[-1], minlength=n)
    return hashes, owners, total, letters


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights.astype(np.float32), bias, temperature

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        hashes, owners, total, letters = ngrams(texts)
        out = np.zeros((len(texts), len(self.langs)))
        most = max(1, GATHERED // max(len(self.langs), 1))  # n-grams whose weights are looked up together
        for h, of in zip(hashes, owners, strict=True):
            for at in range(0, len(h), most):
                some, own = h[at : at + most], of[at : at + most]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[first]] += np.add.reduceat(self.weights[some], first, axis=0)
        return out / np.maximum(total, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        logits, letters = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        known = letters > 0
        return [self.langs[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], idf: np.ndarray, seed: int = 11) -> Model:
    """rows: n-gram indexes and their relative frequencies; y: index of the language."""
    size, c = 1 << BITS, len(langs)
    z, n = np.zeros((size, c)), np.zeros((size, c))
    zb, nb = np.zeros(c), np.zeros(c)
    keep = np.arange(len(y)) % 5 != 4
    order = np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    bias = np.zeros(c)
    for _ in range(EPOCHS):
        for i in order.permutation(np.flatnonzero(keep)):
            at, tf = rows[i]
            x = (SCALE * tf * idf[at])[:, None]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            g = _softmax((w * x).sum(axis=0) + bias)
            g[y[i]] -= 1
            gx = x * g
            z[at] = zi + gx - (np.sqrt(ni + gx**2) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + gx**2
            zb += g - (np.sqrt(nb + g**2) - np.sqrt(nb)) / ALPHA * bias
            nb += g**2
    w = weights(z, n) * (SCALE * idf)[:, None]
    held = np.flatnonzero(~keep)
    temperature = 1.0
    if len(held):
        logits = np.array([(w[rows[i][0]] * rows[i][1][:, None]).sum(axis=0) + bias for i in held])
        grid = np.exp(np.linspace(np.log(0.2), np.log(5), 65))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(langs, w, bias, temperature)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's texts, and the n-grams of the texts in the sample."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("tf", pa.binary()), ("gram", pa.int32()), ("df", pa.int64())])
    df, docs = np.zeros(1 << BITS, dtype=np.int64), 0
    for batch in batches:
        for some in slices(batch, "text", rows=256):
            texts = some.column("text").to_pylist()
            hashes, owners, total, letters = ngrams(texts)
            seen = np.zeros((len(texts), 1 << BITS), dtype=bool)
            for h, of in zip(hashes, owners, strict=True):
                seen[of, h] = True
            df += seen.sum(axis=0)
            docs += int((letters > 0).sum())
            out = []
            for i in np.flatnonzero(np.array(some.column("sampled").to_pylist(), dtype=bool) & (letters > 0)).tolist():
                c = sum(np.bincount(h[slice(*np.searchsorted(of, [i, i + 1]))], minlength=1 << BITS) for h, of in zip(hashes, owners, strict=True))
                at = np.flatnonzero(c)
                out.append((some.column("doc_id")[i].as_py(), some.column("lang")[i].as_py(), at.astype(np.int32).tobytes(), (c[at] / total[i]).astype(np.float32).tobytes()))
            if out:
                k = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], schema.types[i]) for i in range(4)] + [pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], schema=schema)
    at = np.flatnonzero(df)
    k = len(at) + 1
    yield pa.RecordBatch.from_arrays([pa.nulls(k, t) for t in schema.types[:4]] + [pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[df[at], docs], pa.int64())], schema=schema)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    fold = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~small_fold(F.col("doc_id"), 5, 0))
    counts = {r["lang"]: r["n"] for r in fold.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGS).collect()}
    total = sum(counts.values())
    quota = {lang: min(n, max(LEAST, sample * n // total)) for lang, n in counts.items()}
    # A hash of the id takes each language's quota, about.
    shares = F.broadcast(spark.createDataFrame([(lang, q * 2**31 // counts[lang]) for lang, q in quota.items()], "lang string, share long"))
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < F.col("share")
    rows = fold.join(shares, "lang", "left").withColumn("sampled", F.coalesce(taken, F.lit(False))).select("doc_id", "text", "lang", "sampled")
    rows = stored(rows.mapInArrow(tidied(_counts), "doc_id long, lang string, at binary, tf binary, gram int, df long"), shared_folder(spark), "ngrams")
    df = rows.where("gram is not null").groupBy("gram").agg(F.sum("df").alias("df")).toPandas()
    some = first_rows(rows.where("gram is null"), sample + LEAST * LANGS, "lang", "at").toPandas().sort_values(["doc_id", "lang", "at"])
    if not len(some):
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    n = int(df.loc[df["gram"] == -1, "df"].iloc[0])
    grams = df[df["gram"] >= 0]
    idf = np.zeros(1 << BITS)
    idf[grams["gram"]] = np.log((1 + n) / (1 + grams["df"].to_numpy())) + 1
    langs = sorted(set(some["lang"]))
    order = np.random.default_rng(5).permutation(len(some))
    some = some.iloc[order]
    pairs = [(np.frombuffer(a, dtype=np.int32), np.frombuffer(t, dtype=np.float32).astype(np.float64)) for a, t in zip(some["at"], some["tf"], strict=True)]
    return train(pairs, np.array([langs.index(x) for x in some["lang"]]), langs, idf)


def languages(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs; the model is fitted on docs unless given."""
    model = model or fit(docs, sample)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(labeller(model, [])), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", small_fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def labeller(model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")):
    """An Arrow function that adds the language and its score, under these names, to doc_id or the columns to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", rows=256):
                lang, score = model.predict(some.column("text").to_pylist())
                columns = [some.column(c) for c in keep or ["doc_id"]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(keep or ["doc_id"]), *names])

    return run
