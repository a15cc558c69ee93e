"""Restricted tables: pages, masked rows and safe averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import or_unknown, to_number
from corvane.operators.sparse_index import bounded
from corvane.storage import shared_folder, stored

# Column names that masking hides, and what stands in for them.
PII = ["name", "first_name", "last_name", "email", "phone", "address", "ssn", "national_id", "dob", "date_of_birth", "employee_id", "personal_email", "personal_phone"]
REDACTED = "[REDACTED]"
#: Steps of a histogram.
BINS = 2048
#: Columns that the strict option hides besides.
STRICT = ["full_name", "salary", "manager_id"]


def page(rows: DataFrame, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """limit rows by key after offset; a limit of 0 or less gives one row, a negative offset is 0."""
    return rows.orderBy(key).offset(max(0, offset)).limit(max(1, limit))


def masked(rows: DataFrame, strict: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    hidden = {*PII, *also, *(STRICT if strict else ())}
    return rows.select(*(F.lit(REDACTED).alias(c) if c.lower() in hidden else F.col(f"`{c}`") for c in rows.columns))


def safe_aggregates(rows: DataFrame, dept: str = "department", salary: str = "salary", rating: str = "performance_rating") -> DataFrame:
    """(department, n, avg_salary, avg_rating): blanks count as 0, what is no number is left out."""
    number = lambda c: to_number(F.col(c).cast("string"))
    return rows.groupBy(or_unknown(F.col(dept)).alias("department")).agg(F.count("*").alias("n"), F.round(F.avg(number(salary)), 6).alias("avg_salary"), F.round(F.avg(number(rating)), 6).alias("avg_rating"))


def nested_aggregates(rows: DataFrame, **columns: str) -> DataFrame:
    """One row: the total, and maps of counts and averages by department."""
    by = safe_aggregates(rows, **columns)
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("department", c))))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), as_map("n").alias("by_department"), as_map("avg_salary").alias("avg_salary"), as_map("avg_rating").alias("avg_rating"))


def latency_summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, median and p95: the element at int(0.95 n) of the sorted values, the largest below 20 values.

    Equal values are counted first. Counts by BINS steps between a group's least and largest value find the step of
    each place; only values of those steps are ranked, so that no task sorts a whole group.
    """
    found = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    stats = found.groupBy(F.col("g").alias("sg")).agg(F.sum("n").alias("all"), F.sum(F.col("v") * F.col("n")).alias("sum"), F.min("v").alias("low"), F.max("v").alias("high"))
    n = F.col("all")
    places = F.array((n + 1) / 2, n / 2 + 1, F.when(n < 20, n).otherwise(F.floor(n * 0.95) + 1))
    stats = stats.withColumn("places", F.transform(places, lambda x: F.floor(x)))
    folder = shared_folder(rows.sparkSession)  # a row a group or place: read by several joins, counted before each
    stats = stored(stats, folder, "stats")
    width = F.greatest((F.col("high") - F.col("low")) / BINS, F.lit(1e-300))
    step = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(BINS - 1))
    values = found.join(bounded(stats), F.col("g").eqNullSafe(F.col("sg"))).select("g", "v", "n", "places", step.alias("step"))
    steps = values.groupBy("g", "step").agg(F.sum("n").alias("m"), F.first("places").alias("places"))
    steps = steps.withColumn("upto", F.sum("m").over(Window.partitionBy("g").orderBy("step")))  # BINS rows a group
    holds = lambda upto, m: (F.col(upto) >= F.col("place")) & (F.col(upto) - F.col(m) < F.col("place"))
    wanted = steps.withColumn("place", F.explode("places")).where(holds("upto", "m"))
    wanted = wanted.select(F.col("g").alias("wg"), F.col("step").alias("ws"), "place", (F.col("upto") - F.col("m")).alias("below")).distinct()
    wanted = stored(wanted, folder, "wanted")
    inside = values.join(bounded(wanted), F.col("g").eqNullSafe(F.col("wg")) & (F.col("step") == F.col("ws")))
    inside = inside.withColumn("at", F.col("below") + F.sum("n").over(Window.partitionBy("wg", "ws", "place").orderBy("v"))).where(holds("at", "n"))
    hit = inside.groupBy("wg").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("found"))
    hit = stored(hit, folder, "hit")
    out = stats.join(bounded(hit), F.col("sg").eqNullSafe(F.col("wg")))
    at = lambda i: F.element_at("found", F.col("places")[i])
    mean, median = F.round(F.col("sum") / n, 6), F.round((at(0) + at(1)) / 2, 6)
    return out.select(F.col("sg").alias(by), n.alias("n"), mean.alias("mean"), median.alias("median"), F.round(at(2), 6).alias("p95"))


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order, without sorting them in one task: ranges of the order are counted, and only the range in which the n-th row lies is sorted by itself."""
    ranges = rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    ranges = stored(ranges, shared_folder(rows.sparkSession), "ranges")
    left, cut = n, -1
    for r in sorted(ranges.groupBy("_range").count().collect()):  # a row a range
        cut = r["_range"]
        if left <= r["count"]:
            break
        left -= r["count"]
    edge = ranges.where(F.col("_range") == cut).orderBy(order).limit(left)
    return ranges.where(F.col("_range") < cut).unionByName(edge).drop("_range")


def speedup(plain: DataFrame, cached: DataFrame, value: str, order: str) -> DataFrame:
    """One row: the mean of as many plain values, in order, as there are cached ones, by the mean of those; null where that is not positive."""
    n = cached.where(F.col(value).isNotNull()).count()
    first = first_rows(plain.where(F.col(value).isNotNull()).select(order, value), order, n)
    both = first.agg(F.avg(value).alias("a")).crossJoin(cached.agg(F.avg(value).alias("b")))  # one row each
    return both.select(F.when(F.col("b") > 0, F.round(F.col("a") / F.col("b"), 6)).alias("prefix_cache_speedup"))
