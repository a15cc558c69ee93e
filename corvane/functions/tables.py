"""Table functions for SQL: the chunker as a function that LATERAL can call.

Rows go to Python and come back in Arrow batches. A function of whole Arrow columns cannot
stand in LATERAL in this version of Spark, so this one gets a text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corvane.operators.chunking import MAX_TOKENS, OVERLAP_TOKENS, section_parts, split_text


@udtf(returnType="section_path: string, ordinal: int, chunk_index: int, text: string", useArrow=True)
class ChunkMarkdown:
    """chunk_markdown(text, max_tokens, overlap_tokens): the chunks of a text, as the operator of that name gives them; null numbers are the operator's own."""

    def eval(self, text: str, max_tokens: int, overlap_tokens: int) -> Iterator[tuple]:
        most = MAX_TOKENS if max_tokens is None else max_tokens
        tail = OVERLAP_TOKENS if overlap_tokens is None else overlap_tokens
        for ordinal, (path, part) in enumerate(section_parts(text or "")):
            pieces = split_text(part, most, tail)
            for i, piece in enumerate(pieces):
                yield path, ordinal, i if len(pieces) > 1 else None, piece


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    spark.udtf.register("chunk_markdown", ChunkMarkdown)
