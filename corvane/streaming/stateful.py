"""Streams with state of their own: request limits over a sliding window, and a cache whose entries end.

Both keep a few numbers for each key, in Spark's state store, and act when the stream's
clock (the watermark) has passed a time, so that the order in which rows arrive does not
matter. Each has a batch form that gives the same rows. The streams need the RocksDB state
store (spark.sql.streaming.stateStore.providerClass) and Python's protobuf.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The named limits, and the seconds of their units.
LIMITS = {"default": "100/minute", "chat": "20/minute", "search": "60/minute", "admin": "10/minute"}
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def rates(limits: dict[str, str] | None = None) -> dict[str, tuple[int, int]]:
    """name -> (requests, microseconds) of limits such as 20/minute."""
    out = {}
    for name, rate in (LIMITS if limits is None else limits).items():
        n, _, unit = rate.partition("/")
        if unit not in UNITS or not n.isdigit():
            raise ValueError(f"no rate: {rate!r}")
        out[name] = (int(n), UNITS[unit] * 1_000_000)
    return out


def _requests(events: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, name, id, us): requests whose name has no limit fall under the default one."""
    name = F.when(F.col("name").isin(list(limits)), F.col("name")).otherwise("default")
    return events.where("key is not null and ts is not null").select("key", name.alias("name"), "id", F.unix_micros("ts").alias("us"), "ts")


def limited(events: DataFrame, limits: dict[str, str] | None = None) -> DataFrame:
    """(key, name, id, n, allowed) of requests (key, name, id, ts: timestamp): how many the key made under that name in the window that ends with the request.

    n stops at one more than the limit. A key's time is cut into windows, and each stands beside the one before it
    only, so a busy key is many groups.
    """
    known = rates(limits)
    rows = _requests(events, known)
    table = rows.sparkSession.createDataFrame([(n, *v) for n, v in known.items()], "name string, most long, width long")
    rows = rows.join(F.broadcast(table), "name").withColumn("part", F.expr("us div width") - F.when(F.col("us") < 0, 1).otherwise(0))
    both = rows.withColumn("at", F.explode(F.array("part", F.col("part") + 1)))
    # A range frame needs a constant width: the distance in windows of the own limit, in whole microseconds.
    each = []
    for name, (_, width) in known.items():
        frame = Window.partitionBy("key", "at").orderBy("us").rangeBetween(1 - width, 0)
        each.append(both.where(F.col("name") == name).withColumn("n", F.count(F.lit(1)).over(frame)))
    counted = each[0]
    for more in each[1:]:
        counted = counted.unionByName(more)
    n = F.least("n", F.col("most") + 1)
    return counted.where("at = part").select("key", "name", "id", n.alias("n"), (F.col("n") <= F.col("most")).alias("allowed"))


class _Sliding(StatefulProcessor):
    """Requests wait until the clock has passed them; the latest times of those that were answered are the state, as many as the limit."""

    def __init__(self, limits: dict[str, tuple[int, int]]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us long")
        self.held = handle.getListState("held", "us long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waits = set(self.handle.listTimers())
        for some in rows:
            for us, i in zip(some["us"].tolist(), some["id"].tolist(), strict=True):
                self.held.appendValue((int(us), int(i)))
                due = -(-int(us) // 1000)
                if due not in waits:
                    waits.add(due)
                    self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        most, width = self.limits[key[1]]
        held = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[0]) if self.held.exists() else []
        times = [r[0] for r in self.times.get()] if self.times.exists() else []
        due = [r for r in held if r[0] <= until]
        out, at = [], 0
        while at < len(due):
            us = due[at][0]
            same = [i for u, i in due[at:] if u == us]
            times = [t for t in times if t > us - width]
            n = min(len(times) + len(same), most + 1)
            out += [(key[0], key[1], i, n, n <= most) for i in same]
            times = (times + [us] * len(same))[-(most + 1) :]
            at += len(same)
        rest = held[len(due) :]
        self.held.put([*rest]) if rest else self.held.clear()
        self.times.put([(t,) for t in times]) if times else self.times.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "name", "id", "n", "allowed"])

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, limits: dict[str, str] | None = None, late: str = "1 minute") -> DataFrame:
    """limited() of a stream: a request is answered when the clock, late behind the newest request, has passed it."""
    known = rates(limits)
    rows = _requests(events, known).withWatermark("ts", late)
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key", "name").transformWithStateInPandas(_Sliding(known), f"key {kind}, name string, id long, n long, allowed boolean", "Append", "EventTime")


class _Entries(StatefulProcessor):
    """The latest entry of a key, until the clock passes its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "us long, value string, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.entry.get() if self.entry.exists() else None
        best = (before[0], before[1], before[2]) if before else None
        for some in rows:
            for us, value, ends in zip(some["us"].tolist(), some["value"].tolist(), some["ends"].tolist(), strict=True):
                if best is None or (us, value or "") >= (best[0], best[1] or ""):
                    best = (int(us), value, int(ends))
        if before is None or best != tuple(before):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.entry.update(best)
            if best[2] >= 0:
                self.handle.registerTimer(-(-best[2] // 1000) - 1)  # timers act when the clock is past them
            yield pd.DataFrame([(key[0], best[1], "kept")], columns=["key", "value", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entry = self.entry.get()
        self.entry.clear()
        yield pd.DataFrame([(key[0], entry[1], "over")], columns=["key", "value", "state"])

    def close(self) -> None:
        pass


def cache_stream(entries: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, value, state) of a stream of cache entries (key, value: string, ts, expires_at: null never ends): kept when an entry comes or replaces another, over when the clock passes its end.

    What was kept last and is not over is what the batch form (store.put, store.live) has at that clock; the state
    of a key that is over is gone. Ends count to the millisecond.
    """
    rows = entries.where("key is not null and ts is not null").select("key", F.col("value").cast("string").alias("value"), "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.unix_micros("expires_at"), F.lit(-1)).alias("ends"))
    kind = dict(rows.dtypes)["key"]
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Entries(), f"key {kind}, value string, state string", "Append", "EventTime")
