"""Byte-level BPE encoding and decoding with the merges of a public tokenizer file.

Method: contiguous rank arrays. A short word is a row of parts and a row of the
ranks of adjacent pairs; the smallest rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are refreshed. All new words of an Arrow
batch that have the same length are rows of one matrix, so a scan, a deletion
and a refresh are each one numpy call for all of them. Words longer than
``SHORT`` bytes merge through a heap over a linked list: the same merges in
n log n steps.

Defined results: a null or empty text has no ids; the tokenizer's special
strings become their ids; ids out of the vocabulary decode to nothing; bytes
that are not UTF-8 decode to U+FFFD. Input columns are kept, and new columns
replace columns of the same name.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.common import shipped, slices, tidied

SHORT = 64
#: Runs that a worker remembers; beyond, it forgets all of them.
CACHE = 60_000
NONE = np.int64(1 << 40)

_WHITE = r"\t-\r \x85\xa0  -     　"
#: The public split pattern of byte-level BPE vocabularies, its white space written out.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: White space other than blanks and newlines, which few texts have.
_RARE = re.compile(r"[^\S \n]")
#: A blank beside other white space: only without these is every blank the start of a split word.
_ODD_BLANK = re.compile(r" (?=\s)|(?<=\s) ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@contextmanager
def _no_collection():
    """Without cyclic garbage collection: a batch makes millions of small tuples and no cycles, and each collection walks them all."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Encoded:
    """The ids of a batch: text i has flat[starts[i]:starts[i + 1]]."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray):
        self.flat, self.starts = flat, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def lists(self) -> list[list[int]]:
        return [self.flat[a:b].tolist() for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]

    def arrow(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), pa.array(self.flat, pa.int32()))


class ByteBpe:
    """Encoder and decoder; one for each Python worker and path (see ``load``)."""

    _loaded: dict[str, ByteBpe] = {}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # Byte-level vocabularies write a byte as a printable character: itself if printable, else one of 256 and up.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in char.items()}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first = np.array([vocab[char[b]] for b in range(256)], dtype=np.int64)
        self.v = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.v) + vocab[b] for a, b in merges], dtype=np.int64)
        self.to = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.by_pair = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        every = self.first[:, None] * self.v + self.first[None, :]
        self.by_bytes = self._rank(every.ravel()).reshape(256, 256)
        self.cache: dict = {}
        self.decimal = list(map(str, range(max(self.bytes) + 1)))
        self.longest_id = max(self.bytes)
        self.by_id = [self.bytes.get(i, b"") for i in range(self.longest_id + 1)]

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def _same_length(self, rows: np.ndarray) -> list[tuple[int, ...]]:
        """rows: uint8 matrix, a word in each row. The merges of all rows go on in step; rows without a pair left drop out."""
        done: list = [None] * len(rows)
        which = np.arange(len(rows))
        parts, ranks = self.first[rows], self.by_bytes[rows[:, :-1], rows[:, 1:]]
        while len(which):
            if parts.shape[1] > 1:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(at)), at]
                over = least == NONE
            else:
                over = np.ones(len(which), dtype=bool)
            if over.any():
                for i, ids in zip(which[over].tolist(), parts[over].tolist(), strict=True):
                    done[i] = tuple(ids)
                go = ~over
                which, parts, ranks = which[go], parts[go], ranks[go]
                if not len(which):
                    break
                at, least = at[go], least[go]
            here = np.arange(len(which))
            parts[here, at] = self.to[least]
            m = parts.shape[1]
            keep = np.arange(m - 1)[None, :]
            parts = np.take_along_axis(parts, keep + (keep > at[:, None]), axis=1)
            keep = np.arange(m - 2)[None, :]
            ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), axis=1)
            for shift in (-1, 0):
                ok = (at + shift >= 0) & (at + shift < m - 2)
                r, c = here[ok], at[ok] + shift
                ranks[r, c] = self._rank(parts[r, c] * self.v + parts[r, c + 1])
        return done

    def _long(self, word: bytes) -> tuple[int, ...]:
        ids = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, v, pair = len(ids), int(self.v), self.by_pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] * v + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.to[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := pair.get(ids[x] * v + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)

    def _merged(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-split words."""
        by_length: dict[int, list] = {}
        for w in pieces:
            raw = w.encode()
            by_length.setdefault(len(raw), []).append((w, raw))
        out: dict[str, tuple[int, ...]] = {}
        for n, group in by_length.items():
            if n <= SHORT:
                for k in range(0, len(group), 8192):
                    some = group[k : k + 8192]
                    rows = np.frombuffer(b"".join(raw for _, raw in some), dtype=np.uint8).reshape(-1, n)
                    out.update(zip((w for w, _ in some), self._same_length(rows), strict=True))
            else:
                out.update((w, self._long(raw)) for w, raw in group)
        return out

    def _runs_of(self, text: str, rare: bool) -> list:
        """A text as runs: a string goes with the blank before it, a tuple is one pre-split word, a number a special id."""
        out: list = []
        for piece in self.splitter.split(text) if self.splitter and any(s in text for s in self.special) else (text,):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece and (piece[0] == " " or piece[-1] == " " or "  " in piece or " \n" in piece or "\n " in piece or rare and _ODD_BLANK.search(piece)):
                out += [(w,) for w in _SPLIT.findall(piece)]
            elif piece:
                first, *rest = piece.split(" ")
                out += [(w,) for w in _SPLIT.findall(first)]
                out += rest
        return out

    @staticmethod
    def _words_of(run: str) -> list[str]:
        """The pre-split words of a run and the blank before it."""
        if run[-1] in ".,;:!?" and run[:-1].isalpha():
            return [" " + run[:-1], run[-1]]
        return _SPLIT.findall(" " + run)

    def encode_batch(self, texts: list[str]) -> Encoded:
        rare = any(_RARE.search(t) for t in texts)
        runs: list = []
        cuts = [0]
        for text in texts:
            runs += self._runs_of(text, rare)
            cuts.append(len(runs))
        place = dict.fromkeys(runs)
        keys = list(place)
        place.update(zip(keys, range(len(keys)), strict=True))
        codes = list(map(place.__getitem__, runs))
        found = list(map(self.cache.get, keys))
        plain: list[int] = []
        other: list[tuple[int, list[str]]] = []
        pieces: set[str] = set()
        for i, f in enumerate(found):
            if f is None:
                k = keys[i]
                if isinstance(k, int):
                    found[i] = (k,)
                elif isinstance(k, str) and k.isalpha():
                    plain.append(i)
                else:
                    w = [k[0]] if isinstance(k, tuple) else self._words_of(k)
                    other.append((i, w))
                    pieces.update(w)
        pieces.update([" " + keys[i] for i in plain])
        merged = self._merged(pieces)
        if len(self.cache) > CACHE:
            self.cache = {}
        for i in plain:
            self.cache[keys[i]] = found[i] = merged[" " + keys[i]]
        for i, w in other:
            self.cache[keys[i]] = found[i] = merged[w[0]] if len(w) == 1 else tuple(chain.from_iterable(map(merged.__getitem__, w)))
        length = np.array(list(map(len, found)), dtype=np.int64)
        every = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(length.sum()))
        begin = np.cumsum(length) - length
        at = np.array(codes, dtype=np.int64)
        times = length[at]
        upto = np.concatenate([[0], np.cumsum(times)])
        flat = every[np.repeat(begin[at] - upto[:-1], times) + np.arange(upto[-1])] if len(at) else every
        return Encoded(flat, upto[np.array(cuts)])

    def decode(self, ids: list[int]) -> str:
        try:
            return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace") if not ids or min(ids) >= 0 else self._decode_known(ids)
        except IndexError:
            return self._decode_known(ids)

    def _decode_known(self, ids: list[int]) -> str:
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


def _replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _with(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in kinds] + [T.StructField(n, k) for n, k in kinds.items()])


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids of each whole text."""
    place = shipped(df.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(place())
        for batch in batches:
            for some in _runs(batch, text):
                yield _replaced(some, **{ids: bpe.encode_batch([t or "" for t in some.column(text).to_pylist()]).arrow()})

    return df.mapInArrow(tidied(run), _with(df, **{ids: T.ArrayType(T.IntegerType())}))


def tokenized(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """df with ids, n_tokens and lossless (whether the ids decode to the text) instead of its text."""
    place = shipped(df.sparkSession, path or default_path())
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "lossless": T.BooleanType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(place())
        for batch in batches:
            for some in _runs(batch, text):
                texts = [t or "" for t in some.column(text).to_pylist()]
                with _no_collection():
                    every = bpe.encode_batch(texts)
                yield _replaced(
                    some.drop_columns([text]),
                    ids=every.arrow(),
                    n_tokens=pa.array(np.diff(every.starts), type=pa.int64()),
                    lossless=pa.array([bpe.decode(ids) == t for ids, t in zip(every.lists(), texts, strict=True)], type=pa.bool_()),
                )

    return df.mapInArrow(tidied(run), T.StructType([f for f in _with(df, **kinds).fields if f.name != text]))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; null ids give an empty text."""
    place = shipped(df.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(place())
        for batch in batches:
            yield _replaced(batch, **{text: pa.array([bpe.decode([i for i in x or [] if i is not None]) for x in batch.column(ids).to_pylist()], type=pa.string())})

    return df.mapInArrow(tidied(run), _with(df, **{text: T.StringType()}))


def _runs(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:


    return slices(batch, text, 2 << 20)


def round_trip(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 and decoded_sha256 of encoding each text and decoding the ids again.

    The same encoder and decoder as ``encode`` and ``decode``, one after the other in a task, so that ids need not pass through the JVM.
    """
    place = shipped(df.sparkSession, path or default_path())
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(place())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for some in _runs(batch, text):
                with _no_collection():
                    every = bpe.encode_batch([t or "" for t in some.column(text).to_pylist()])
                lists = every.lists()
                yield _replaced(
                    some.drop_columns([text]),
                    n_tokens=pa.array(np.diff(every.starts), type=pa.int64()),
                    ids_sha256=pa.array([sha(",".join(map(bpe.decimal.__getitem__, ids))) for ids in lists], type=pa.string()),
                    decoded_sha256=pa.array([sha(bpe.decode(ids)) for ids in lists], type=pa.string()),
                )

    schema = T.StructType([f for f in _with(df, **kinds).fields if f.name != text])
    return df.mapInArrow(tidied(run), schema)
