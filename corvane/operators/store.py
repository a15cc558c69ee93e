"""Tables keyed by id: upserts, and caches with expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Seconds that cached answers and orders live; embeddings do not expire.
TTL = {"llm": 3600, "rerank": 3600, "emb": None}


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """old with the rows of new in place of those of the same key; the last of repeated keys wins. new's order column is left out."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*old.columns)
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last)


def live(cache: DataFrame, now) -> DataFrame:
    """Entries that have not expired (a null expires_at never does)."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def hits(asked: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return asked.join(cache.select(key), key, "left_semi")


def misses(asked: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return asked.join(cache.select(key), key, "left_anti")


def put(cache: DataFrame, new: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """The cache with new entries in place of older ones of their key; of repeated new keys the latest stays."""
    return upsert(cache, new.withColumn("_ord", F.col(order)), key, "_ord")


def merged(asked: DataFrame, cache: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Every row of asked with its value and whether it was cached: cached values first, else those computed for the misses (key, value).

    Rows keep their ordinal columns; a key that neither side has keeps a null value.
    """
    known = cache.select(key, "value", F.lit(True).alias("cached"))
    fresh = new.select(key, "value", F.lit(False).alias("cached")).join(cache.select(key), key, "left_anti")
    return asked.join(known.unionByName(fresh).dropDuplicates([key]), key, "left")


def within(cache: DataFrame, most: int, size: str = "size", at: str = "at", tie: str = "key") -> DataFrame:
    """The latest entries of a cache (at: timestamp) whose sizes add up to at most so much; older ones go.

    Sums by hour find the hour in which the limit falls; only its entries are added up one by one.
    """
    rows = cache.withColumn("_hour", F.date_trunc("hour", at))
    hours = rows.groupBy("_hour").agg(F.sum(size).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("_hour").desc()))  # a row an hour
    cut = hours.withColumn("upto", upto).where(F.col("upto") > most).agg(F.max_by(F.struct("_hour", (most - F.col("upto") + F.col("n")).alias("left")), "_hour").alias("c"))
    rows = rows.join(F.broadcast(cut))
    edge = rows.where(F.col("_hour") == F.col("c._hour"))
    order = Window.partitionBy("_hour").orderBy(F.col(at).desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_sum", F.sum(size).over(order)).where(F.col("_sum") <= F.col("c.left"))
    whole = rows.where(F.col("c").isNull() | (F.col("_hour") > F.col("c._hour")))
    return whole.select(cache.columns).unionByName(edge.select(cache.columns))


def stats(cache: DataFrame, size: str = "size") -> DataFrame:
    """One row: the number of entries and the sum of their sizes."""
    return cache.agg(F.count("*").alias("item_count"), F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"))


def clear(cache: DataFrame, path: str) -> DataFrame:
    """An empty version of the cache at path."""
    return write_version(cache.limit(0), path)


def write_version(df: DataFrame, path: str) -> DataFrame:
    """Writes a new version of a table to its own path and reads it."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
