"""Embedders and generators as Arrow functions; the built-in ones need no network.

A provider maps a list of texts to a list of vectors or texts. Batches close at
``BATCH_TEXTS`` texts or ``BATCH_CHARS`` characters.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.storage import complete_folders

# Limits of a batch.
BATCH_TEXTS, BATCH_CHARS = 100, 60_000


#: Words whose features a process keeps.
WORDS = 1 << 16


class _Features:
    """Places and signs of words and of their runs of three letters, found once for each word."""

    def __init__(self, dim: int):
        self.dim = dim
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size, self.start = np.zeros(1024, np.int64), np.zeros(1025, np.int64)
        self.hashes = np.zeros(8192, np.int64)

    def _add(self, word: str) -> int:
        n, marked = len(self.number), f"<{word}>"
        found = [zlib.crc32(t.encode()) for t in (word, *(marked[i : i + 3] for i in range(len(marked) - 2)))]
        start = self.start[n]
        if n + 1 == len(self.size):
            self.size, self.start = np.resize(self.size, 2 * len(self.size)), np.resize(self.start, 2 * len(self.size) + 1)
        if start + len(found) > len(self.hashes):
            self.hashes = np.resize(self.hashes, 2 * int(start + len(found)))
        self.size[n], self.start[n + 1] = len(found), start + len(found)
        self.hashes[start : start + len(found)] = found
        self.number[word] = n
        return n

    def of(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of each word, their places and signs, one word after the other."""
        if len(self.number) > WORDS:
            self.clear()
        at = np.array([n if (n := self.number.get(w)) is not None else self._add(w) for w in words], dtype=np.int64)
        size = self.size[at]
        ends = np.cumsum(size)
        hashes = self.hashes[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return size, hashes % self.dim, np.where(hashes >> 31, 1.0, -1.0)


@lru_cache(maxsize=4)
def _features(dim: int) -> _Features:
    return _Features(dim)


def hashed_embedder(dim: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Texts as signed counts of their hashed words and letter runs, scaled to length 1; texts that share words are near each other.

    Repeats of a word count by their logarithm. A text without a word is the zero vector.
    """

    def embed(texts: list[str]) -> np.ndarray:
        words = [Counter(t.lower().split()) for t in texts]
        size, place, sign = _features(dim).of(chain.from_iterable(words))
        row = np.repeat(np.arange(len(texts)), [len(c) for c in words])
        times = 1 + np.log(np.fromiter(chain.from_iterable(c.values() for c in words), np.int64, len(row)))
        out = np.bincount(np.repeat(row, size) * dim + place, sign * np.repeat(times, size), len(texts) * dim).reshape(-1, dim)
        norm = np.sqrt((out * out).sum(axis=1))[:, None]
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return embed


def batches(texts: list[str], most_texts: int = BATCH_TEXTS, most_chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        if held and (len(held) == most_texts or size + len(t) > most_chars):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def conjunctions() -> Callable[[list[str]], list[str]]:
    """Sub-queries without a model: the last paragraph of a prompt, less its label, cut at " and "."""
    return lambda prompts: [json.dumps(p.split("Question: ", 1)[-1].split(" and "), ensure_ascii=False) for p in prompts]


def backwards() -> Callable[[list[str]], list[str]]:
    """An order without a model, for tests: the snippets of a prompt from the last to the first."""
    return lambda prompts: [str(list(range(len(p.split("\nSnippets:\n", 1)[-1].splitlines())))[::-1]) for p in prompts]


EMBEDDERS: dict[str, Callable] = {"local": hashed_embedder}
GENERATORS: dict[str, Callable] = {"extractive": lambda: lambda prompts: [p[:200] for p in prompts], "conjunctions": conjunctions, "backwards": backwards}


def provider(kinds: dict[str, Callable], name: str, **options) -> Callable:
    if name not in kinds:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(kinds)}")
    return kinds[name](**options)


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, text: str = "text") -> DataFrame:
    """rows with embedding, model and dim."""
    names = [c for c in rows.columns if c not in ("embedding", "model", "dim")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            vectors = [v for some in batches([t or "" for t in batch.column(text).to_pylist()]) for v in embed(some)]
            new = [pa.array([np.asarray(v, dtype=np.float32) for v in vectors], pa.list_(pa.float32())), pa.array([model] * len(vectors), pa.string()), pa.array([len(v) for v in vectors], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names=[*names, "embedding", "model", "dim"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names]
    return rows.select(*names).mapInArrow(run, ", ".join([*kinds, "embedding array<float>", "model string", "dim int"]))


def generated(rows: DataFrame, generate: Callable[[list[str]], list[str]], prompt: str = "prompt", tolerant: bool = True) -> DataFrame:
    """rows with answer; the answers of a batch that fails are null, or, unless tolerant, the failure is raised."""

    def replies(prompts: list[str]) -> list[str | None]:
        try:
            return generate(prompts)
        except Exception:
            if not tolerant:
                raise
            return [None] * len(prompts)

    names = [c for c in rows.columns if c != "answer"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            answers = [a for some in batches([t or "" for t in batch.column(prompt).to_pylist()]) for a in replies(some)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(answers, pa.string())], names=[*names, "answer"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names]
    return rows.select(*names).mapInArrow(run, ", ".join([*kinds, "answer string"]))


def same_model(vectors: DataFrame, queries: DataFrame) -> None:
    """Refuses vectors and queries of different models or dimensions."""
    kinds = vectors.select("model", "dim").union(queries.select("model", "dim")).distinct().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"embeddings of different models: {kinds}")


def _called(prompts: list[str], call: Callable, tries: int, wait: float) -> list | None:
    """What a provider gives for a batch; a failure is tried again after wait, 2 wait, 4 wait ... seconds, and at last gives None."""
    for n in range(tries):
        try:
            got = call(prompts)
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} results for {len(prompts)} texts")
            return got
        except Exception:
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None


def ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, value) of all that was paid for, from every round that was written to its end; empty where nothing was."""
    schema = f"key string, value {kind}"
    rounds = complete_folders(spark, path)
    return spark.read.schema(schema).parquet(*rounds) if rounds else spark.createDataFrame([], schema)


def paid_once(rows: DataFrame, call: Callable[[list[str]], list], model: str, path: str, kind: str = "array<float>", text: str = "text", tries: int = 4, wait: float = 0.5, rounds: int = 5) -> DataFrame:
    """rows with value, what a provider (texts -> values of kind) gives for their text, each text of a model paid for once.

    The ledger at path holds values by a hash of model and text, so equal texts cost one call, and a run that was
    stopped goes on where it ended. Missing texts are dealt to tasks and go out in provider batches; a batch that fails
    is tried again after a growing wait, and what failed all tries is left to the next round. A round is a folder that
    counts once it is written to its end: a task that is run again writes the same round. After all rounds a text that
    was never answered fails the job; what was paid for stays in the ledger.
    """
    spark = rows.sparkSession
    key = F.sha2(F.concat(F.lit(f"{model}\x1f"), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
    schema = f"key string, value {kind}"
    arrow = to_arrow_type(spark.createDataFrame([], schema).schema["value"].dataType)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keys, texts = batch.column("key").to_pylist(), batch.column("said").to_pylist()
            at = 0
            for some in batches(texts):
                got = _called(some, call, tries, wait)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + len(some)]), pa.array(got, arrow)], names=["key", "value"])
                at += len(some)

    asked = rows.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("said")).dropDuplicates(["key"])
    for _ in range(rounds):
        missing = asked.join(ledger(spark, path, kind).select("key"), "key", "left_anti")
        if missing.limit(1).count() == 0:
            break
        missing.mapInArrow(run, schema).write.parquet(f"{path.rstrip('/')}/round-{uuid.uuid4().hex}")
    known = ledger(spark, path, kind)
    if asked.join(known.select("key"), "key", "left_anti").limit(1).count():
        raise RuntimeError("some texts were not answered; a further call goes on from the ledger")
    names = [c for c in rows.columns if c != "value"]
    return rows.select(*names, key.alias("_key")).join(known.withColumnRenamed("key", "_key"), "_key").select(*names, "value")
