"""Prompts, answers and citations from ranked contexts (query_id, place, source_path, section_path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import NO_ANSWER, cache_key, context_hash, preview, source_label
from corvane.operators import store
from corvane.storage import shared_folder, stored

# The two prompts.
SYSTEM = (
    "You are a careful assistant. Answer ONLY using the provided context snippets. Cite sources in-line as "
    "[#] and include a final 'Citations' section listing source and section. If the answer is not in the "
    "context, reply: 'I don't know based on the available context.'"
)
RERANK = (
    "You are a helpful reranking assistant. Given a query and a list of snippets,\nreturn the indices of "
    "the top snippets in descending relevance order as a JSON list of integers.\nOnly output the JSON array "
    "(e.g., [2,0,1])."
)
#: The instruction that asks for sub-queries; an own wording, of which only the form of the reply matters.
DECOMPOSE = (
    "Split the question below into two to four short questions that can be answered one by one, with the "
    "words a search would need.\nReturn only a JSON array of strings."
)


def contexts(rows: DataFrame) -> DataFrame:
    """(query_id, query, snippets): each query's contexts in order of place."""
    snippet = F.struct("place", F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("section_path", F.lit("")).alias("section_path"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(snippet)).alias("snippets"))


def _flat(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def chat_prompt(query: Column, snippets: Column) -> Column:
    """The user's part of the prompt."""
    line = lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), _flat(F.trim(s["text"])), F.lit("\n(Source: "), s["source_path"], F.lit("#"), s["section_path"], F.lit(")"))
    return F.array_join(F.concat(F.array(F.lit("Query:"), query, F.lit("\nContext snippets:")), F.transform(snippets, line)), "\n")


def rerank_prompt(query: Column, snippets: Column) -> Column:
    line = lambda s, i: F.concat(i.cast("string"), F.lit(": "), _flat(s["text"]))
    return F.array_join(F.concat(F.array(F.lit(RERANK), F.concat(F.lit("Query: "), query), F.lit("Snippets:")), F.transform(snippets, line)), "\n")


def decompose_prompt(query: Column) -> Column:
    return F.concat(F.lit(DECOMPOSE), F.lit("\n\nQuestion: "), query)


def extractive_answer(snippets: Column) -> Column:
    """The first snippet's beginning and its citation; a fixed sentence without snippets."""
    top = F.element_at(snippets, 1)
    said = F.concat(F.lit("Based on [1], "), preview(top["text"]), F.lit("\n\nCitations: [1] "), source_label(top["source_path"], top["section_path"]))
    return F.when(F.size(snippets) == 0, NO_ANSWER).otherwise(said)


def answer_keys(asked: DataFrame, model: str) -> DataFrame:
    """asked (query_id, query, snippets) with the key that an answer is cached under: model, question, and what the model reads."""
    read = context_hash(F.transform("snippets", lambda s: F.struct(s["text"].alias("text"), s["source_path"].alias("source"))))
    return asked.withColumn("key", cache_key("llm", F.lit(model), F.struct("query", read.alias("context"))))


def answered(asked: DataFrame, cache: DataFrame, answer, model: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): answers (query_id, key, answer, cached) of asked (query_id, query, snippets), and the cache with those that were missing.

    cache: (key, value, at, expires_at). Live entries are taken as they are. What is missing is answered once a key,
    by ``answer`` (rows with query, snippets and prompt -> rows with answer), and kept for the time to live of answers;
    an answer that failed (null) is given out but not kept.
    """
    rows = answer_keys(asked, model)
    known = store.live(cache, now)
    missing = store.misses(rows, known).dropDuplicates(["key"])
    new = answer(missing.withColumn("prompt", chat_prompt(F.col("query"), F.col("snippets")))).select("key", F.col("answer").alias("value"))
    new = stored(new, shared_folder(asked.sparkSession), "answers")
    given = store.merged(rows.select("query_id", "key"), known, new).select("query_id", "key", F.col("value").alias("answer"), "cached")
    expires = (now + F.expr(f"interval {store.TTL['llm']} seconds")).alias("expires_at")
    fresh = new.where("value is not null").select("key", "value", now.alias("at"), expires)
    return given, store.put(cache, fresh)


def citations(rows: DataFrame) -> DataFrame:
    """(query_id, place, source_path, section_path, rule)."""
    return rows.select("query_id", "place", "source_path", "section_path", "rule")
