"""Streams with state give the rows of their batch forms."""

import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import store
from corvane.streaming import stateful

MID = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, rows, tmp_path, make, parts):
    """All rows that a stream over files gives, one file a batch, in the order of parts."""
    path, name = str(tmp_path / "in"), "s" + uuid.uuid4().hex
    for i in parts:
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return [tuple(r) for r in spark.table(name).collect()]


def test_limits_of_a_stream_equal_those_of_a_batch(rocks, tmp_path):
    spark = rocks
    limits = {"default": "3/day", "purchase": "1/hour"}
    rows = spark.read.parquet(MID).limit(400).select((F.col("user_id") % 5).alias("key"), F.col("event_type").alias("name"), F.col("event_id").alias("id"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"))
    copies = rows.limit(40).select("key", "name", (F.col("id") + 100_000).alias("id"), "ts")  # requests at the same time
    rows = rows.unionByName(copies).cache()
    end = rows.agg(F.max("ts").alias("m")).first().m
    clock = spark.createDataFrame([(None, None, None, None)], rows.schema).select(F.lit(99).cast("long").alias("key"), F.lit("x").alias("name"), (F.lit(-1) - F.col("id")).alias("id"), F.lit(end).alias("ts"))
    late = clock.withColumn("ts", F.col("ts") + F.expr("interval 3 days")).withColumn("id", F.lit(-1).cast("long"))
    later = late.withColumn("id", F.lit(-2).cast("long"))
    ordered = rows.withColumn("part", F.ntile(3).over(Window.orderBy("ts")) - 1)
    ordered = ordered.unionByName(late.withColumn("part", F.lit(3))).unionByName(later.withColumn("part", F.lit(4)))
    assert streamed(spark, ordered, tmp_path / "patient", lambda s: stateful.limited_stream(s, limits, "60 days"), range(5)) == []  # nothing lies before that clock
    got = streamed(spark, ordered, tmp_path / "in_time", lambda s: stateful.limited_stream(s, limits, "1 day"), range(5))
    want = [tuple(r) for r in stateful.limited(rows, limits).collect()]
    assert sorted(x for x in got if x[2] >= 0) == sorted(want) and len(want) == 440
    assert {x[4] for x in want} == {True, False} and max(x[3] for x in want) == 4


def test_limits_by_hand(spark):
    rows = [("a", "chat", i, 60.0 * i / 25) for i in range(30)] + [("a", "search", 100, 1.0), ("b", "unknown", 101, 1.0), (None, "chat", 102, 1.0), ("c", "chat", 103, None), ("d", "admin", 104, -3.0), ("d", "admin", 105, -3.0)]
    found = stateful.limited(spark.createDataFrame(rows, "key string, name string, id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))))
    got = {r.id: (r.name, r.n, r.allowed) for r in found.collect()}
    assert set(got) == {*range(30), 100, 101, 104, 105} and got[101] == ("default", 1, True) and got[104] == got[105] == ("admin", 2, True)
    for i in range(30):
        n = sum(60.0 * i / 25 - 60 < 60.0 * j / 25 <= 60.0 * i / 25 for j in range(30))
        assert got[i] == ("chat", min(n, 21), n <= 20)
    with pytest.raises(ValueError, match="no rate"):
        stateful.rates({"x": "many/minute"})


def test_cache_of_a_stream_equals_the_batch(rocks, tmp_path):
    spark = rocks
    e = spark.read.parquet(MID).select(F.col("event_id").alias("key"), F.col("user_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"), "event_type").limit(500)
    ends = F.when(F.col("event_type") != "purchase", F.col("ts") + F.expr("interval 6 hours"))
    rows = e.withColumn("expires_at", ends).drop("event_type").cache()
    again = rows.where("key % 9 = 0").select("key", F.lit("new").alias("value"), (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.lit(None).cast("timestamp").alias("expires_at"))
    every = rows.unionByName(again)
    now = every.agg(F.max("ts").alias("m")).first().m
    order = Window.orderBy("ts")
    # Two rows at the last time move the clock there and let a batch run at it.
    tick = lambda i, part: spark.createDataFrame([(-i, "tick", now, None, part)], "key long, value string, ts timestamp, expires_at timestamp, part int")
    parts = every.withColumn("part", F.ntile(3).over(order) - 1).unionByName(tick(1, 3)).unionByName(tick(2, 4))
    got = streamed(spark, parts, tmp_path, stateful.cache_stream, range(5))
    over = {(k, v) for k, v, s in got if s == "over"}
    replaced = {k for k, v, s in got if v == "new"}
    live = {(k, v) for k, v, s in got if s == "kept" and (k, v) not in over and not (k in replaced and v != "new") and v != "tick"}
    batch = store.live(store.put(every.limit(0), every, "key", "ts"), F.lit(now))
    assert live == {(r.key, r.value) for r in batch.collect()}
    assert over and replaced
