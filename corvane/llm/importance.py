"""Resampling towards a target distribution: importance weights of hashed n-grams, drawn with Gumbel noise.

A feature is a run of one to ``longest`` words joined by one space; its bucket is the
CRC-32 of its UTF-8 bytes. No such string is built: the CRC of each word is found once,
over all words of an Arrow batch together, and the CRC of a run follows from those of its
parts, since crc(a + b) = shift(crc(a), len(b)) xor crc(b), where the shift is a linear
map over GF(2), kept as a matrix for each power of two of the length.

One look at the texts gives a stored table of bucket counts for each document, from which
the corpus' counts and then the weights come. Ranks come from a histogram of scores and
an order within equal scores, so nothing is sorted in one place.

Defined results: null and empty texts, and texts without a word, have no feature and
weight 0; a null id is drawn by the hash of an empty one and stands last among equal
scores; rows with the same id are drawn each, equal rows next to each other; an empty
corpus gives no rows, an empty target counts 0 in every bucket. A row's counts take 8
bytes a bucket that occurs, at most; a long text takes about 40 bytes a byte while it is
read. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, NOT_ALNUM, shared_folder, slices, stored, text_bytes, tidied, words

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words of more bytes go through zlib one by one.
LONG = 64
_POLYNOMIAL = np.uint32(0xEDB88320)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ _POLYNOMIAL, c >> 1).astype(np.uint32)
    return c


_TABLE = _byte_table()


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of the bytes: all spans take a byte at a time, the longest first, so that those still running stand together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for step in range(min(int(size[0]), LONG) if len(size) else 0):
        n = int(np.searchsorted(-size, -step))  # spans of more than step bytes
        crc[:n] = _TABLE[(crc[:n] ^ data[at[:n] + step]) & 255] ^ (crc[:n] >> 8)
    crc = ~crc
    for i in range(int(np.searchsorted(-size, -LONG))):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


@lru_cache(maxsize=64)
def _shift(power: int) -> np.ndarray:
    """The GF(2) matrix that appends 2**power zero bytes, as a table for each byte of the CRC."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power == 0:
        images = _TABLE[unit & 255] ^ (unit >> 8)
    else:
        half = _shift(power - 1)
        images = _applied(half, _applied(half, unit))
    tables = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):  # the image of a sum is the sum of images
        own, low = tables[bit // 8], 1 << bit % 8
        own[low : 2 * low] = own[:low] ^ images[bit]
    return tables


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs as parts of longer strings: each is shifted by so many bytes that follow."""
    crc = crc.copy()
    for power in range(int(size.max()).bit_length() if len(size) else 0):
        some = np.flatnonzero((size >> power) & 1)
        crc[some] = _applied(_shift(power), crc[some])
    return crc


def run_crcs(crc: np.ndarray, size: np.ndarray, of: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRC, text) of all runs of 1 to longest words of one text, joined by one space, from CRC, bytes and text of each word."""
    run, first = crc, of
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), size) ^ crc  # of a space and the word
    for n in range(1, longest + 1):
        yield run, first
        if n >= len(crc):
            return
        whole = of[n:] == first[: len(of) - n]
        run = np.where(whole, shifted(run[: len(of) - n], size[n:] + 1) ^ spaced[n:], 0).astype(np.uint32)
        first = np.where(whole, of[n:], -1)


def bucket_counts(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: words of each text, and (text, bucket, times) of the buckets that occur, by text."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, NOT_ALNUM)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    keys = []
    for crc, text in run_crcs(word_crcs(data, starts, ends), ends - starts, of, longest):
        inside = text >= 0
        keys.append(text[inside] * buckets + crc[inside].astype(np.int64) % buckets)
    key, times = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
    return n, key // buckets, key % buckets, times


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, times: int32 as bytes) of each whole text."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, of, bucket, times = bucket_counts(part.column("text"), longest, buckets)
                cut = np.searchsorted(of, np.arange(part.num_rows + 1))
                total = np.bincount(of, weights=times, minlength=part.num_rows).astype(np.int64)
                packed = [pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (bucket, times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(total), *packed], names=["doc_id", "n_words", "n_features", "buckets", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets binary, times binary")


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of packed rows, one after the other, and how many each row has."""
    rows = batch.column(name).to_pylist()
    return np.frombuffer(b"".join(rows), np.int32), np.array([len(r) // 4 for r in rows], dtype=np.int64)


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of each bucket over all documents: tasks add up their own, so a task sends a row for each bucket at most. The driver gets one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            bucket, _ = _column(batch, "buckets")
            total += np.bincount(bucket, weights=_column(batch, "times")[0], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.select("buckets", "times").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its share of the target over its share of the corpus, each bucket counted once more."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def weights(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of gains over a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, n = _column(batch, "buckets")
            part = np.concatenate([[0], np.cumsum(gain[bucket] * _column(batch, "times")[0])])
            ends = np.cumsum(n)
            weight = (part[ends] - part[ends - n]) // np.maximum(batch.column("n_features").to_numpy(), 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id: the same on every run."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(h, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, most: int, cuts: list[tuple[int, int]]) -> DataFrame:
    """The rows of scored (doc_id, n_words, n_features, weight, score) with their rank, null beyond most. cuts: rows of each score, from the highest.

    Equal rows become counts before they are ordered, and only rows of one score meet.
    """
    score, n = (np.array(x, dtype=np.int64) for x in (zip(*cuts, strict=True) if cuts else ((), ())))
    before = np.cumsum(n) - n
    keep = before < most
    spark, names = scored.sparkSession, ["doc_id", "n_words", "n_features", "weight", "score"]
    places = F.broadcast(spark.createDataFrame(list(zip(score[keep].tolist(), before[keep].tolist(), strict=True)), "score long, before long"))
    equal = scored.groupBy(names).agg(F.count("*").alias("n"))
    above = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    rows = equal.join(places, "score").withColumn("place", F.col("before") + F.coalesce(F.sum("n").over(above), F.lit(0)))
    rows = rows.select(*names, F.explode(F.sequence(F.col("place") + 1, F.col("place") + F.col("n"))).alias("rank"))
    rows = rows.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.join(places.select("score"), "score", "left_anti").select(names)
    return rows.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every document of docs (doc_id, text).

    rank: the place among the percent of the documents with at least so many words that are drawn, highest scores
    first; null for others. target: (text). The driver sees a row for each bucket and one for each score that occurs:
    scores are thousandths of logarithms of counts, some 100,000 at most.
    """
    folder = shared_folder(docs.sparkSession)
    counts = stored(features(docs, longest, buckets), folder, "features")
    aim = features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), longest, buckets)
    scored = weights(counts, gains(totals(counts, buckets), totals(aim, buckets)))
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), folder, "scores")
    able = scored.where(F.col("n_words") >= least)
    cuts = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = ranked(able, sum(n for _, n in cuts) * percent // 100, cuts)
    every = drawn.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


SQL = f"""
with crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b)) as tab),
letters as (select *, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from (select doc_id, text, row_number() over () as n, 0 as side from documents union all select null, text, row_number() over (), 1 from benchmark)),
found as (select side, n, unnest(regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from letters),
kinds as (select distinct word from found),
hashed as (select word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint) as bytes from kinds),
buckets as (select word, xor(list_reduce(bytes, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295), 4294967295) % {BUCKETS} as bucket from hashed, crc),
counted as (select side, n, bucket, count(*) as times from found join buckets using (word) group by all),
sums as (select bucket, coalesce(sum(times) filter (side = 0), 0)::double as s, coalesce(sum(times) filter (side = 1), 0)::double as t from counted group by bucket),
whole as (select sum(s) as s, sum(t) as t from sums),
gain as (select bucket, floor(1000 * ln((sums.t + 1) * (whole.s + {BUCKETS}) / ((sums.s + 1) * (whole.t + {BUCKETS}))))::bigint as gain from sums, whole),
parts as (select n, sum(times)::bigint as n_features, sum(gain * times)::bigint as total from counted join gain using (bucket) where side = 0 group by n),
scored as (
  select doc_id, n, coalesce(n_features, 0) as n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::bigint as weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise
  from letters left join parts using (n) where side = 0),
placed as (select n, row_number() over (order by weight + noise desc, doc_id) as rank, count(*) over () as able from scored where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, weight + noise as score, case when rank <= able * {PERCENT} // 100 then rank end as rank, n_features as n_words
from scored left join placed using (n)
"""
