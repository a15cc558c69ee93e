"""Quality rules as a ledger of bit masks.

Every rule is evaluated once for each document: one look at the text gives its
measurements, and each rule that fails sets a bit. The ledger (measurements and bits) is
a table; policies are masks with versions, applied to the bits without looking at a text
again, and ablations are sums over the few patterns of bits that occur.

Rules are conditions on whole numbers, so that they read the same in Spark and in SQL.

Defined results: a null or empty text measures 0 everywhere and fails for its number of
words; rows keep null and repeated ids and are measured each; empty tables give no rows.
Words and lines are compared as they stand, capitals included, by 64-bit hashes within
one text. A long text takes about 60 bytes a byte while it is read. Columns beyond doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U, mix64, slices, span_hashes, text_bytes, tidied, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_ellipsis_lines", "n_bullet_lines")
#: Rule -> when it fails. A rule's bit is its place; new rules go to the end, so that old ledgers stay readable.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "equal_lines": "n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines",
    "few_letters": "100 * n_letter_words < 70 * n_words",
    "ellipsis_lines": "n_lines >= 3 and 100 * n_ellipsis_lines > 30 * n_lines",
    "bullet_lines": "n_lines >= 3 and 100 * n_bullet_lines > 90 * n_lines",
}
#: Version -> the rules that it applies.
POLICIES = {1: ("few_words", "repeated_words"), 2: tuple(RULES)}
WINDOW = 5
_AS_IS = np.arange(256, dtype=np.uint8)
_SYMBOL, _LETTER, _LINE = (np.zeros(256, dtype=bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LINE[10] = True


def _again(keys: np.ndarray) -> np.ndarray:
    """True for the places whose key occurs at another place too."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measures(texts: pa.Array) -> np.ndarray:
    """A row of MEASURES for each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    of = np.repeat(np.arange(n), n_words)
    lines, stops, first_line = words(data, offsets, _LINE)
    at = np.searchsorted(starts, lines)
    own = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < stops) if len(starts) else np.zeros(len(lines), dtype=bool)
    of_line = np.repeat(np.arange(n), np.diff(first_line))[own]
    lines, stops, at = lines[own], stops[own], at[own]
    word, line = span_hashes(data, [(starts, ends), (lines, stops)], _AS_IS)
    count = lambda of, flags: np.bincount(of, weights=flags, minlength=n).astype(np.int64)
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    chars, letters, symbols = upto((data & 0xC0) != 0x80), upto(_LETTER[data]), upto(_SYMBOL[data])
    text = mix64(np.arange(1, n + 1, dtype=np.uint64))
    keys = mix64(line + text[of_line])
    kinds = np.unique(np.stack([of_line.astype(np.uint64), keys]), axis=1)[0].astype(np.int64) if len(keys) else of_line
    n_lines = np.bincount(of_line, minlength=n)

    covered = np.zeros(len(word) + 1, dtype=np.int64)
    whole = np.flatnonzero(of[WINDOW - 1 :] == of[: len(of) - WINDOW + 1]) if len(of) >= WINDOW else np.zeros(0, dtype=np.int64)
    key = text[of[whole]]
    for i in range(WINDOW):
        key = mix64(key * U(3) + word[whole + i])
    twice = whole[_again(key)]
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0

    head, tail = np.full(len(lines), 0), np.full(len(lines), 0)  # the first and the last three bytes of a line's words
    last = np.searchsorted(starts, stops) - 1
    for i in range(3):
        head = head * 256 + np.where(starts[at] + i < ends[at], data[np.minimum(starts[at] + i, len(data) - 1)], 0) if len(lines) else head
        tail = tail * 256 + np.where(ends[last] - 3 + i >= starts[last], data[np.maximum(ends[last] - 3 + i, 0)], 0) if len(lines) else tail
    bullet = (head >> 16 == 0x2D) | (head >> 16 == 0x2A) | (head == 0xE280A2)
    ellipsis = (tail == 0x2E2E2E) | (tail == 0xE280A6)
    columns = [n_words, count(of, chars[ends] - chars[starts]), symbols[offsets[1:]] - symbols[offsets[:-1]], n_lines - np.bincount(kinds, minlength=n), count(of, covered)]
    columns += [n_lines, count(of, letters[ends] > letters[starts]), count(of_line, ellipsis), count(of_line, bullet)]
    return np.stack(columns, axis=1).astype(np.int64)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules) -> int:
    return sum(bit(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, MEASURES, fail_bits) of each whole text."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = measures(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for rule, when in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(when), F.lit(bit(rule)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("fail_bits", bits)


def fails(rules) -> Column:
    """Whether one of the rules fails, from the bits alone."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def verdicts(rows: DataFrame, policies: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """The ledger's ids with a row for each version of the policy: (doc_id, version, kept, reasons: the failing bits of that version)."""
    each = [F.struct(F.lit(v).alias("version"), F.lit(mask(rules)).cast("long").alias("mask")) for v, rules in (policies or POLICIES).items()]
    reasons = F.col("fail_bits").bitwiseAND(F.col("p.mask"))
    return rows.withColumn("p", F.explode(F.array(*each))).select("doc_id", F.col("p.version").alias("version"), (reasons == 0).alias("kept"), reasons.alias("reasons"))


def ablation(rows: DataFrame, policies: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """What each rule does in each version: (version, rule, n_failed, n_alone, n_kept, n_kept_without, fails_with).

    n_alone: documents that no other rule of the version rejects; they come back without it. fails_with: the bits of the
    version's rules that fail beside it somewhere. Patterns of bits are counted first, so a few rows are left of any corpus.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit"), F.lit(mask(rules)).cast("long").alias("mask")) for v, rules in (policies or POLICIES).items() for r in rules]
    found = patterns.withColumn("p", F.explode(F.array(*each))).select("n", "p.*", F.col("fail_bits").bitwiseAND(F.col("p.mask")).alias("bits"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    failed, none = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == 0
    alone = F.col("bits") == F.col("bit")
    others = F.coalesce(F.bit_or(F.when(failed, F.col("bits").bitwiseXOR(F.col("bit")))), F.lit(0).cast("long"))
    out = found.groupBy("version", "rule", "bit").agg(total(failed).alias("n_failed"), total(alone).alias("n_alone"), total(none).alias("n_kept"), others.alias("fails_with"))
    return out.withColumn("n_kept_without", F.col("n_kept") + F.col("n_alone")).drop("bit")


def judged(docs: DataFrame, version: int = 2) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fail_bits) by a version of the policy."""
    base = fails(POLICIES[1])
    return ledger(docs).select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & ~fails(POLICIES[version])).alias("kept"), "fail_bits")


_BASE = " or ".join(f"({RULES[rule]})" for rule in POLICIES[1])
_BITS = " + ".join(f"case when {when} then {bit(rule)} else 0 end" for rule, when in RULES.items())
SQL = rf"""
with docs as (select doc_id, coalesce(text, '') as text, row_number() over () as n from documents),
word as (select n, w, row_number() over (partition by n order by i) as i from (select n, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from docs)),
five as (select n, i, lead(w, 4) over o as e, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as run from word window o as (partition by n order by i)),
twice as (select n, i from (select n, i, count(*) over (partition by n, run) as c from five where e is not null) where c > 1),
hit as (select n, count(distinct place) as n_repeat_words from (select n, unnest(range(i, i + 5)) as place from twice) group by n),
words as (select n, count(*) as n_words, sum(length(w))::bigint as word_chars, count(*) filter (regexp_matches(w, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) as n_letter_words from word group by n),
line as (select n, l from (select n, unnest(string_split(text, chr(10))) as l from docs) where regexp_matches(l, '[^\x20\x09-\x0D]')),
lines as (select n, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines, count(*) filter (regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) as n_ellipsis_lines, count(*) filter (regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')) as n_bullet_lines from line group by n),
measured as (
  select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_letter_words, 0) as n_letter_words, coalesce(n_ellipsis_lines, 0) as n_ellipsis_lines, coalesce(n_bullet_lines, 0) as n_bullet_lines
  from docs left join words using (n) left join hit using (n) left join lines using (n))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE} as base_failed, bits = 0 as kept, bits::bigint as fail_bits
from (select *, {_BITS} as bits from measured)
"""
