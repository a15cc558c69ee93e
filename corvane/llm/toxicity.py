"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z read as a-z. A document's features are
the distinct hashes of its words, of their stems (first STEMS bytes, for
inflected and compound words), of adjacent pairs and of pairs with one word
between. Training updates each coordinate at its own rate; the L1 penalty leaves
few weights, kept as a sorted array of hashes that every task gets. The fit takes
at most ``sample`` labelled rows outside the held-out fold.

Defined results: null and empty texts get the bias's score; without labelled
rows every score is 0.5; rows keep null ids and repeated rows are scored each. Of
several labels of an id the largest counts. Columns beyond doc_id, text and the
label are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U, NOT_ALNUM, first_rows, labelled, mix64, slices, small_fold, span_hashes, text_bytes, tidied, words

SAMPLE = 8_000
#: log2 of the feature space.
BITS = 30
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1.5, 0.5, 4
#: A feature needs so many documents of the sample.
LEAST = 3
STEMS = (4, 5, 6, 7, 8)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature hashes of all texts of a batch, the text of each, and the number of texts."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets, NOT_ALNUM)
    of = np.repeat(np.arange(n), np.diff(first))
    longer = [ends - starts > k for k in STEMS]
    h, *stems = span_hashes(data, [(starts, ends), *((starts[ok], starts[ok] + k) for k, ok in zip(STEMS, longer, strict=True))])
    parts, docs = [h, *stems], [of, *(of[ok] for ok in longer)]
    for gap, salt in ((1, 3), (2, 5)):
        if len(h) > gap:
            ok = of[gap:] == of[:-gap]
            parts.append(mix64(h[:-gap] * U(salt) + h[gap:] + U(gap))[ok])
            docs.append(of[gap:][ok])
    return (np.concatenate(parts) >> U(64 - BITS)).astype(np.uint32), np.concatenate(docs), n


class Sparse:
    """Sorted feature hashes with weights, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[keys & 0xFFFF] = True

    @classmethod
    def fit(cls, docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Sparse:
        if not len(y):
            return cls(np.zeros(0, np.uint32), np.zeros(0), 0.0)
        every, count = np.unique(np.concatenate(docs), return_counts=True)
        keys = every[count >= LEAST]
        rows = []
        for d in docs:
            at = np.searchsorted(keys, d)
            at[at == len(keys)] = 0
            rows.append(at[keys[at] == d] if len(keys) else at[:0])
        z, n = np.zeros(len(keys)), np.zeros(len(keys))
        zb = nb = bias = 0.0
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in order.permutation(len(y)):
                at = rows[i]
                zi, ni = z[at], n[at]
                w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
                bias = -zb / ((BETA + nb**0.5) / ALPHA)
                g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y[i]
                z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[at] = ni + g * g
                zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
                nb += g * g
        w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
        return cls(keys[w != 0], w[w != 0], float(bias))

    def score(self, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, self.bias)
        if len(self.keys):
            ok = self.maybe[x & 0xFFFF]
            x, of = x[ok], of[ok]
            at = np.searchsorted(self.keys, x)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == x
            pairs = np.unique(of[ok] * len(self.keys) + at[ok])
            total += np.bincount(pairs // len(self.keys), weights=self.weights[pairs % len(self.keys)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Sparse:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                x, of, n = features(some.column("text"))
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(1, n))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("label"), pa.array([np.unique(d).tobytes() for d in np.split(x[order], cuts)], pa.binary())], names=["doc_id", "label", "x"])

    rows = labelled(docs, labels, "toxic", 5, 0, sample).mapInArrow(tidied(run), "doc_id long, label int, x binary")
    rows = first_rows(rows, sample, "x").toPandas().sort_values(["doc_id", "x"])
    return Sparse.fit([np.frombuffer(x, dtype=np.uint32) for x in rows["x"]], rows["label"].to_numpy(dtype=np.float64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                score = model.score(*features(some.column("text")))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", small_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
