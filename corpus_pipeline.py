"""A training corpus in five stages over documents: language, near-duplicates, secrets, source mix, tokens.

Every stage takes all rows that its predecessor kept and, but for the last,
returns the columns of documents. Stages are written as Parquet in the shared
folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import bpe, jaccard, langid, mixing, secret_scan
from corvane.llm.common import shared_folder, small, stored, tidied
from corvane.session import ship

#: Rows of (id, decision) up to which a decision is broadcast to the texts.
BROADCAST_ROWS = 250_000
#: A language below this score is no language.
LEAST_SCORE = 0.5
#: Columns of this module's own: their names clash with none of documents.
ROW, LANG, SCORE, TIMES, COPY = (f"corvane_{c}" for c in ("row", "lang", "score", "times", "copy"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose best language scores below LEAST_SCORE."""
    ship(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    kinds = T.StructType([*docs.schema.fields, T.StructField(LANG, T.StringType()), T.StructField(SCORE, T.DoubleType())])
    labelled = docs.mapInArrow(tidied(langid.labeller(model, docs.columns, (LANG, SCORE))), kinds)
    return labelled.where((F.col(LANG) != langid.UND) & (F.col(SCORE) >= LEAST_SCORE)).select(*named(docs))


def named(docs: DataFrame) -> list:
    """The columns of docs, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row (ROW): the id, or where ids are null or repeated a new one, kept in the shared folder."""
    ids = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if ids.limit(1).count() == 0:
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), shared_folder(docs.sparkSession), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates; rows without an id stay, and so do different documents of one id."""
    ship(spark)
    rows = numbered(docs)
    found = jaccard.jaccard_components(rows.select(F.when(F.col("doc_id").isNotNull(), F.col(ROW)).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(ROW), "component_id").where(f"{ROW} is not null")
    first = groups.where(f"component_id <> {ROW}").select("component_id").distinct()
    groups = groups.join(small(first, BROADCAST_ROWS), "component_id", "left_semi")
    keys = rows.select(ROW, "doc_id", F.xxhash64("text", "source", "lang").alias("hash"))
    least = groups.join(keys, ROW).groupBy("component_id").agg(F.min(F.struct("doc_id", "hash", ROW)).alias("x")).select(F.col(f"x.{ROW}").alias(ROW))
    gone = groups.select(ROW).join(small(least, BROADCAST_ROWS), ROW, "left_anti")
    return rows.join(small(gone, BROADCAST_ROWS), ROW, "left_anti").select(*named(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; documents stay."""
    ship(spark)
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*named(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    ship(spark)
    rows = numbered(docs)
    mix = mixing.mixed(rows.select("doc_id", "text", "source", ROW), row=ROW).where("taken > 0").select(ROW, F.expr("cast(taken div size as int)").alias(TIMES))
    taken = rows.join(small(mix, BROADCAST_ROWS), ROW)
    return taken.withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col(TIMES)))).select(*named(docs))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, their number, and whether they decode to it."""
    ship(spark)
    return bpe.tokenized(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("tokens", encode_texts),
]

#: Language, redaction by vocabulary and encoding have no SQL form; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex[:8]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
