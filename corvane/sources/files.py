"""Collections on disk: <base>/<department>/**/*.md and *.csv, read by Spark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import access
from corvane.functions.text import chunk_id
from corvane.operators import providers
from corvane.operators.chunking import chunk_markdown
from corvane.operators.store import write_version


def _described(rows: DataFrame, base: str) -> DataFrame:
    root = base.rstrip("/").split("/")[-1]
    dept = F.regexp_extract("source_path", rf"/{root}/([^/]+)/", 1)
    rows = rows.withColumn("owner_dept", dept).where(F.col("owner_dept").isin(access.DEPARTMENTS)).withColumn("doc_type", access.doc_type(F.col("source_path"))).where("doc_type <> 'unknown'")
    return rows.withColumn("sensitivity", access.default_sensitivity(F.col("owner_dept"), F.col("doc_type")))


def discover(spark: SparkSession, base: str) -> DataFrame:
    """(source_path, owner_dept, doc_type, sensitivity) of every known file, by path; a missing base has none."""
    schema = "source_path string, owner_dept string, doc_type string, sensitivity string"
    if not os.path.exists(base) and "://" not in base:
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(F.col("path").alias("source_path"))
    return _described(found, base).orderBy("source_path")


def markdown(spark: SparkSession, base: str) -> DataFrame:
    """Every Markdown file as one row with its metadata; undecodable bytes are dropped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").text(base, wholetext=True).select(F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("source_path"))
    return _described(rows, base)


def build_index(spark: SparkSession, base: str, **options) -> DataFrame:
    """Chunks of all Markdown files with their metadata, roles, role flags and ids."""
    docs = markdown(spark, base)
    chunks = chunk_markdown(docs.select("source_path", "text"), **options).join(docs.drop("text"), "source_path")
    roles = access.allowed_roles(F.col("owner_dept"), F.col("doc_type"), F.col("sensitivity"))
    chunks = chunks.withColumn("allowed_roles", roles).withColumn("id", chunk_id("source_path", "section_path", "text"))
    return chunks.select("*", *access.role_flags(F.col("allowed_roles")))


def dense_index(chunks: DataFrame, old: DataFrame | None, embed=None, model: str = "hashed-256") -> DataFrame:
    """Chunks of build_index with embedding, model and dim, in place of those of the same id in old; of repeated ids one stays.

    embed maps a list of texts to vectors and gets provider batches; the built-in embedder needs no network.
    """
    embed = embed or providers.provider(providers.EMBEDDERS, "local")
    new = providers.embedded(chunks.dropDuplicates(["id"]), embed, model)
    # The ids are taken from the chunks: whatever reads the new rows embeds them.
    return new if old is None else old.join(chunks.select("id"), "id", "left_anti").select(new.columns).unionByName(new)


def build_dense_index(spark: SparkSession, base: str, path: str, old: DataFrame | None = None, embed=None, **options) -> int:
    """Scans, chunks, embeds and writes a new version of the dense index of a folder; the number of its rows (a missing base: 0)."""
    if not os.path.exists(base) and "://" not in base:
        return 0
    return write_version(dense_index(build_index(spark, base, **options), old, embed), path).count()


def index_counts(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """One row: the numbers of chunks of the sparse index (chunk) and of the dense one."""
    return sparse.agg(F.countDistinct("chunk").alias("sparse")).crossJoin(dense.agg(F.count("*").alias("dense")))  # one row each


def hr_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every value stays a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def env_file(path: str) -> dict[str, str]:
    """k=v lines; quotes are taken off, comments and other lines left out; variables that are set stay."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                k, eq, v = line.strip().partition("=")
                if eq and not k.startswith("#"):
                    out[k.strip()] = os.environ.get(k.strip(), v.strip().strip("\"'"))
    return out


# Settings and their defaults.
SETTINGS = {
    "OPENAI_API_KEY": "",
    "OPENAI_EMBEDDING_MODEL": "text-embedding-3-small",
    "OPENAI_CHAT_MODEL": "gpt-4o-mini",
    "CHROMA_DB_DIR": ".chroma",
    "HR_AGGREGATE_MODE": "disabled",
    "HR_MASKED_ROWS_MODE": "disabled",
    "AUDIT_LOG_DIR": "logs/audit",
    "HOST": "127.0.0.1",
    "PORT": "8000",
}


def settings(**over: str) -> dict[str, str]:
    return {k: over.get(k, os.environ.get(k, v)) for k, v in SETTINGS.items()}
