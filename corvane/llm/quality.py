"""Quality scores: histogram gradient-boosted trees over document statistics.

Every document becomes a row of statistics of its characters, words and lines,
computed by numpy over whole Arrow batches. Trees are grown on binned columns
(gradient and hessian histograms), complete to a fixed depth, and kept as flat
arrays of features, thresholds and leaf values, which a batch walks level by
level. The fit takes at most ``sample`` labelled rows, outside the held-out fold.

Defined results: null and empty texts have zero statistics and are scored like
any text; without labelled rows every score is 0.5; rows keep null ids
and repeated rows are scored each. Of several labels of an id the largest counts.
Columns beyond doc_id, text and the label are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U, LOWER, first_rows, labelled, mix64, slices, small_fold, text_bytes, tidied, word_hashes, words

SAMPLE = 12_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
_MARKS = np.frombuffer(b"!|#$%&*<>{}[]@^~=+_/\\\"';:?-()", dtype=np.uint8)
NAMES = (
    [
        *("log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "white", "other_ascii", "beyond_ascii"),
        *("words_ending_in_mark", "words_starting_upper", "words_all_upper", "words_without_letter", "distinct_words"),
        *("repeats_of_last_word", "distinct_pairs", "distinct_fives", "log_lines", "distinct_lines", "words_a_line"),
        *("sentence_ends", "log_longest_word", "most_common_byte"),
    ]
    + [f"mark_{chr(c)}" for c in _MARKS]
)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    keys = np.sort((doc.astype(np.uint64) << U(44)) | (hashes >> U(20)))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[fresh] >> U(44)).astype(np.int64), minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)), dtype=np.float32)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256) if len(data) else np.zeros((n, 256))
    chars = np.maximum(size - counts[:, 128:192].sum(axis=1), 1)  # UTF-8 continuation bytes are not characters
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    w = np.diff(first)
    w1 = np.maximum(w, 1)
    of = np.repeat(np.arange(n), w)
    share = lambda flags: np.bincount(of, weights=flags, minlength=n) / w1
    upper = (data >= 65) & (data <= 90)
    letter = ((LOWER[data] >= 97) & (LOWER[data] <= 122)) | (data >= 128)
    running = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    ups, letters = running(upper), running(letter)
    ups, letters, length = ups[ends] - ups[starts], letters[ends] - letters[starts], ends - starts
    last, head = data[ends - 1], data[starts]
    ends_in = ~(letter[ends - 1] | ((last >= 48) & (last <= 57)) | (last == 46) | (last == 44)) if len(starts) else np.zeros(0, dtype=bool)
    columns = [np.log1p(size), np.log1p(w), np.bincount(of, weights=length, minlength=n) / w1]
    columns += [counts[:, a:b].sum(axis=1) / chars for a, b in ((65, 91), (97, 123), (48, 58))]
    columns += [counts[:, [9, 10, 11, 12, 13, 32]].sum(axis=1) / chars]
    columns += [(counts[:, 33:48].sum(axis=1) + counts[:, 58:65].sum(axis=1) + counts[:, 91:97].sum(axis=1) + counts[:, 123:127].sum(axis=1)) / chars, counts[:, 192:].sum(axis=1) / chars]
    columns += [share(ends_in), share((head >= 65) & (head <= 90)), share((ups > 1) & (ups == letters)), share(letters == 0), _distinct(h, of, n) / w1]
    same = lambda gap: of[gap:] == of[:-gap]
    again = (h[1:] == h[:-1]) & same(1)
    columns += [np.bincount(of[1:], weights=again, minlength=n) / w1]
    two = same(1)
    columns += [_distinct(mix64(h[:-1] * U(3) + h[1:])[two], of[1:][two], n) / np.maximum(w - 1, 1)]
    if len(h) > 4:
        five = same(4)
        x = mix64(h[:-4] * U(3) + h[1:-3] * U(5) + h[2:-2] * U(7) + h[3:-1] * U(11) + h[4:] * U(13))[five]
        columns += [_distinct(x, of[4:][five], n) / np.maximum(w - 4, 1)]
    else:
        columns += [np.ones(n)]
    newline = data == 10
    breaks = np.zeros(256, dtype=bool)
    breaks[10] = True
    ls, le, lf = words(data, offsets, breaks)
    lines = np.diff(lf)
    lof = np.repeat(np.arange(n), lines)
    columns += [np.log1p(lines), _distinct(word_hashes(data, ls, le), lof, n) / np.maximum(lines, 1), w / np.maximum(lines, 1), share(last == 46)]
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    columns += [np.log1p(longest), counts.max(axis=1) / np.maximum(size, 1)]
    columns += [counts[:, c] / chars for c in _MARKS]
    del newline
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


class Trees:
    """Boosted complete trees as arrays: split feature and threshold by inner node, value by leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, bias: float):
        self.feature, self.threshold, self.value, self.bias = feature, threshold, value, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y) or y.min() == y.max():
            p = 0.5 if not len(y) else min(max(float(y.mean()), 0.02), 0.98)
            return cls(np.zeros((0, 2**DEPTH - 1), np.int32), np.zeros((0, 2**DEPTH - 1), np.float32), np.zeros((0, 2**DEPTH)), float(np.log(p / (1 - p))))
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS).astype(np.float32)) for j in range(f)]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
        p = float(y.mean())
        bias = np.log(p / (1 - p))
        margin = np.full(n, bias)
        features, thresholds, values = [], [], []
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-margin))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(n, dtype=np.int64)
            feat, thr = np.zeros(2**DEPTH - 1, np.int32), np.full(2**DEPTH - 1, np.inf, np.float32)
            for depth in range(DEPTH):
                k = 2**depth
                best = np.full(k, 1e-6)
                choice = [(-1, 0)] * k
                for j in range(f):
                    at = node * BINS + bins[:, j]
                    gl = np.cumsum(np.bincount(at, weights=g, minlength=k * BINS).reshape(k, BINS), axis=1)
                    hl = np.cumsum(np.bincount(at, weights=h, minlength=k * BINS).reshape(k, BINS), axis=1)
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gl[:, -1:] ** 2 / (hl[:, -1:] + 1)
                    gain[(hl < 2) | (hr < 2)] = 0
                    b = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(k), b] > best):
                        best[i], choice[i] = gain[i, b[i]], (j, int(b[i]))
                right = np.zeros(n, dtype=bool)
                for i, (j, b) in enumerate(choice):
                    if j >= 0:
                        feat[k - 1 + i], thr[k - 1 + i] = j, edges[j][min(b, len(edges[j]) - 1)]
                        mine = node == i
                        right[mine] = bins[mine, j] > b
                node = node * 2 + right
            gs, hs = np.bincount(node, weights=g, minlength=2**DEPTH), np.bincount(node, weights=h, minlength=2**DEPTH)
            leaf = -RATE * gs / (hs + 1)
            margin += leaf[node]
            features.append(feat)
            thresholds.append(thr)
            values.append(leaf)
        return cls(np.array(features), np.array(thresholds), np.array(values), float(bias))

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.bias)
        for feat, thr, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feat[node]] > thr[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                x = statistics(some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = labelled(docs, labels, "quality", 4, 2, sample).mapInArrow(tidied(run), "doc_id long, label int, x binary")
    rows = first_rows(rows, sample, "x").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(-1, len(NAMES))
    return Trees.fit(x, rows["label"].to_numpy(dtype=np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                score = model.score(statistics(some.column("text")))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", small_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
