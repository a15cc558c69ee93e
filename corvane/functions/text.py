"""Scalar functions on texts: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide whether a question needs several steps.
COMPLEX_PATTERNS = [
    "compare",
    "contrast",
    "difference between",
    "versus",
    "vs",
    "relationship between",
    "how does .* affect",
    "impact of .* on",
    "before and after",
    "change from .* to",
    "trend",
    "why did .* when",
    "explain .* in context of",
    "combine",
    "integrate",
    "across",
    "multiple",
    "q1 and q2",
    "q2 and q3",
    "q3 and q4",
    "quarter",
]
NO_ANSWER = "I don't know based on the available context."


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def runs(text, underscore: bool = True) -> Column:
    """Runs of ASCII letters and digits (and underscores, for BM25) as they stand; null gives none. What explodes them lowers each row, inside generated code."""
    pattern = r"([A-Za-z0-9_]+)" if underscore else r"([A-Za-z0-9]+)"
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), F.lit(1))


def tokens(text, underscore: bool = True) -> Column:
    """Runs, lower-cased after they are found."""
    return F.transform(runs(text, underscore), F.lower)


def token_estimate(text) -> Column:
    """A quarter of the number of code points, rounded down."""
    return F.floor(F.length(F.coalesce(_col(text), F.lit(""))) / 4).cast("long")


def fusion_key(source, section, null: str = "") -> Column:
    """source#section; null stands for a missing part. Where parts that are there but hold no value must read None, null is "None"."""
    return F.concat(F.coalesce(_col(source), F.lit(null)), F.lit("#"), F.coalesce(_col(section), F.lit(null)))


def source_label(source, section) -> Column:
    return F.regexp_replace(fusion_key(source, section), r"^#+|#+$", "")


def chunk_id(source, section, text) -> Column:
    joined = F.concat(F.coalesce(_col(source), F.lit("")), F.lit("|"), F.coalesce(_col(section), F.lit("")), F.lit("|"), F.coalesce(_col(text), F.lit("")))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def preview(text, n: int = 200) -> Column:
    return F.concat(F.substring(F.coalesce(_col(text), F.lit("")), 1, n), F.lit("..."))


def is_complex(query) -> Column:
    """Whether a question looks as if it needs several steps."""
    q = F.coalesce(_col(query), F.lit(""))
    low = F.lower(q)
    marks = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return low.rlike("|".join(COMPLEX_PATTERNS)) | (marks > 1) | (F.contains(low, F.lit(" and ")) & (words > 10))


def to_number(text) -> Column:
    """Blank counts as 0; what is no number is null."""
    return F.coalesce(F.nullif(_col(text), F.lit("")), F.lit("0.0")).try_cast("double")


def or_unknown(text) -> Column:
    return F.coalesce(F.nullif(_col(text), F.lit("")), F.lit("Unknown"))


def cosine(a, b) -> Column:
    """0 for empty vectors, different lengths and zero norms; sums are doubles."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot / norms).otherwise(F.lit(0.0))


def context_hash(snippets) -> Column:
    """Sixteen hex digits of a list of (text, source) structs; stable within this library."""
    return F.substring(F.sha2(F.to_json(_col(snippets)).cast("binary"), 256), 1, 16)


def cache_key(kind: str, model, arguments) -> Column:
    """Kind, model and the hash of a struct of arguments."""
    return F.concat(F.lit(f"{kind}:"), _col(model), F.lit(":"), F.sha2(F.to_json(_col(arguments)).cast("binary"), 256))


def rate_limit_key(user, authorization, address) -> Column:
    """The user, else the name in a Basic header, else the address."""
    header = _col(authorization)
    name = F.split_part(F.decode(F.unbase64(F.substring(header, 7, 2**30)), "UTF-8"), F.lit(":"), F.lit(1))
    return F.when(F.coalesce(_col(user), F.lit("")) != "", F.concat(F.lit("user:"), _col(user))).when(F.startswith(header, F.lit("Basic ")), F.concat(F.lit("user:"), name)).otherwise(_col(address))


def utc_seconds(ts, zoned: bool = True) -> Column:
    """Whole seconds since 1970 in UTC of a timestamp; one without a zone is read as UTC, whatever the session's zone is."""
    if zoned:
        return F.unix_seconds(_col(ts))
    return F.unix_date(_col(ts).cast("date")).cast("long") * 86400 + F.hour(_col(ts)) * 3600 + F.minute(_col(ts)) * 60 + F.second(_col(ts))


def utc_day(ts, zoned: bool = True) -> Column:
    """The UTC day of a timestamp as text, whatever the session's zone is."""
    return F.date_from_unix_date(F.floor(utc_seconds(ts, zoned) / 86400).cast("int")).cast("string")


def zoned(df, name: str = "ts") -> bool:
    """Whether a column holds instants, and not local times."""
    return df.schema[name].dataType.typeName() == "timestamp"


def correlation_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def llm_order(reply, n) -> Column:
    """Positions that a reply lists, in its order, those out of range dropped; every position if it is no list of integers."""
    count = _col(n)
    listed = F.from_json(F.trim(_col(reply)), "array<int>")
    sound = listed.isNotNull() & F.trim(_col(reply)).rlike(r"^\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]$")
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(sound, F.filter(listed, lambda i: (i >= 0) & (i < count))).otherwise(every)


def subqueries(reply, query, most: int = 3) -> Column:
    """Strings of a JSON list, a code fence around it taken off, most of them at most; else the query alone."""
    text = F.trim(_col(reply))
    inner = F.when(F.contains(text, F.lit("```")), F.regexp_replace(F.regexp_replace(F.split_part(text, F.lit("```"), F.lit(2)), "^json", ""), r"^\s+|\s+$", "")).otherwise(text)
    listed = F.from_json(inner, "array<string>")
    sound = listed.isNotNull() & inner.rlike(r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$')
    return F.when(sound, F.slice(listed, 1, most)).otherwise(F.array(_col(query)))


def flat_messages(messages) -> Column:
    """Turns (array of role, content) joined by blank lines; the last system text goes before the first turn."""
    m = _col(messages)
    said = F.transform(F.filter(m, lambda x: x["role"].isin("user", "assistant")), lambda x: x["content"])
    system = F.coalesce(F.element_at(F.transform(F.filter(m, lambda x: x["role"] == "system"), lambda x: x["content"]), F.when(F.exists(m, lambda x: x["role"] == "system"), F.lit(-1)).otherwise(F.lit(None).cast("int"))), F.lit(""))
    joined = F.array_join(said, "\n\n")
    return F.when(F.size(said) == 0, system).when(system == "", joined).otherwise(F.concat(system, F.lit("\n\n"), joined))
