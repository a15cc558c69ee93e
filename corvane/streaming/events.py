"""Event streams: request limits by window, audit logs by day, incremental indexes. Each works on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import correlation_id, utc_day, utc_seconds, zoned


def windows(events: DataFrame, width: str = "1 hour", more_than: int = 2, late: str = "1 day") -> DataFrame:
    """(window_start, user_id, n) of the windows in which a user had more events than allowed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > more_than).select(F.col("window.start").alias("window_start"), "user_id", "n")


def audit_rows(events: DataFrame) -> DataFrame:
    """Events with the UTC day they belong to, and the event as a JSON line; times without a zone are UTC, and an event without an id gets a new one."""
    own = zoned(events)
    micros = F.expr("extract(SECOND FROM ts)").cast("double") % 1
    line = F.to_json(F.struct((utc_seconds("ts", own) + micros).alias("ts"), F.coalesce(F.col("event_id").cast("string"), correlation_id()).alias("cid"), F.col("event_type").alias("event"), "user_id", "value"))
    return events.select("event_id", utc_day("ts", own).alias("day"), line.alias("line"))


def audit_sink(events: DataFrame, path: str, checkpoint: str | None = None):
    """Appends audit lines under path, a folder a day; a stream runs until its input is read."""
    rows = audit_rows(events).select("day", F.col("line").alias("value"))
    if not events.isStreaming:
        rows.write.mode("append").partitionBy("day").text(path)
        return None
    return rows.writeStream.format("text").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_files(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def indexed(new_chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the chunks of a stream to an index, those whose id it holds already left out.

    Every batch writes a partition of its own number anew, so a batch that is run again leaves no row twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["id"])
        try:
            known = spark.read.schema("id string, batch long").parquet(path).where(F.col("batch") < number).select("id")
            known.limit(1).count()
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        new = rows.join(known, "id", "left_anti") if known is not None else rows
        new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return new_chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

