"""Secret scans: fixed patterns, and random strings that a public vocabulary encodes badly.

Base spans come from three patterns (an assignment to a secret's name, an access
key, a run of hex digits). The token-efficiency test adds ``random`` spans: a
candidate is a run of key characters outside the base spans, long enough, that
is no known digest or identifier (hex digests of usual lengths, UUIDs, numbers,
dates, words joined by marks); it counts if its characters per token under the
tiktoken vocabulary are at most ``RATIO``. A run that a base span covers in part
is tested in the parts that are left.

Defined results: null and empty texts have no spans; positions are code points,
ends exclusive; rows keep null ids and repeated rows; an empty table gives no
rows. ``redacted`` keeps all columns; the scan reads doc_id and text alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import shipped, slices, tidied

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_NAME = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is maximal, so this finds the runs of [0-9a-f]+ that are long enough.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}", re.ASCII)
RATIO = 2.0
#: Characters of a run that the vocabulary encodes at once: longer runs go in parts.
PART = 4096
#: Hex digits of known digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBERS = re.compile(r"[0-9_/+=-]+")
_MARKS = re.compile(r"[_/-]+")
#: What identifiers join by marks: a number, or a word or several in camel case with up to four digits behind (v2, x86).
_WORD = re.compile(r"(?:[A-Z]?[a-z]{1,19}(?:[A-Z][a-z]{2,19})*|[A-Z]{1,19})[0-9]{0,4}|[0-9]+")
_encoders: dict[str, object] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    if _NAME.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def known(run: str) -> bool:
    """Whether a run is a digest, a UUID, numbers and dates, or words and numbers joined by marks; one look at each character."""
    if _HEX.fullmatch(run):
        return len(run) in DIGESTS or run.isdigit()
    if _UUID.fullmatch(run) or _NUMBERS.fullmatch(run):
        return True
    first, *rest = _MARKS.split(run)
    return bool(rest) and not first[:1].isdigit() and all(not w or _WORD.fullmatch(w) for w in (first, *rest))


def n_tokens(run: str, encoder) -> int:
    return sum(len(encoder.encode_ordinary(run[i : i + PART])) for i in range(0, len(run), PART))


def random_spans(text: str, base: list[tuple[int, int, int]], encoder, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of key characters outside the base spans (in order of start) that the vocabulary encodes badly."""
    out, i, covered = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at, parts = max(m.start(), covered), []
        while i < len(base) and base[i][0] < m.end():
            if base[i][0] > at:
                parts.append((at, base[i][0]))
            at = covered = max(at, base[i][2])
            i += 1
        for a, b in [*parts, (at, m.end())]:
            if b - a >= LEAST and not known(text[a:b]) and b - a <= ratio * n_tokens(text[a:b], encoder):
                out.append((a, 3, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id and spans (an array of kind, start, end, by start and then by kind) of each row of docs."""
    place = shipped(docs.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(place())
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for text in some.column("text").to_pylist():
                    base = base_spans(text or "")
                    spans = sorted(base + random_spans(text or "", base, encoder, ratio))
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(docs: DataFrame, path: str | None = None, ratio: float = RATIO, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark; overlapping spans are replaced as one. Other columns stay."""
    place = shipped(docs.sparkSession, path or default_path())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(place())
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for text in some.column("text").to_pylist():
                    spans = base_spans(text) if text else []
                    spans = sorted(spans + random_spans(text, spans, encoder, ratio)) if text else []
                    parts, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    out.append("".join([*parts, text[at:]]) if spans else text)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else some.column(c) for c in names], names=names)

    return docs.mapInArrow(tidied(run), docs.schema)


def with_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, the digest of base spans and all spans joined."""
    said = lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "random"), said), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"), count("random"))
