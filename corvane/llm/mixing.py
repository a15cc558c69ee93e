"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A pattern can give each of its words up to ``repeats`` times; every further
repetition costs more (convex costs), so the flow from patterns to the quotas of
their sources repeats as little as possible. The flow runs on patterns only, in
phases of one cost that push along all shortest ways at once. The driver holds a row
for each pattern that occurs, whatever their number, so that no word is lost: what
grows there is the number of different sets of sources, not of documents.

Documents then follow their pattern's flow in a seeded order (md5 of seed and id):
whole rounds first, then, for what is left, ``FILLS`` times the documents in order,
those that are too long for the gap left out, as far as their sum fits; at last the
largest document not yet taken that fits. Reruns agree.

Prefix sums of sizes are found without gathering a source: sums by the first hex
digits of the hash find the digit at which the gap ends, and only documents of
that digit are summed up one by one. What a fill took is known by a gap and a last
position for each pattern; no table of documents is written again.

Defined results: a null text has size 0; a null source is a source, last in
order; documents of size 0 take 0 words; rows without an id are ordered by their
text, repeated rows count each; clashing columns beside doc_id, text and source
are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import shared_folder, slices, small, stored, text_bytes, tidied, words

#: Patterns up to which their flows are broadcast; beyond, documents are shuffled to them.
BROADCAST = 200_000
DIGITS = 3
FILLS = 4


def sized(docs: DataFrame, row: str | None = None, seed: str = "") -> DataFrame:
    """doc_id, sources, size (words of white space's complement), h (the seeded order) and row (that column, long, or null) of each row."""
    several = dict(docs.dtypes)["source"].startswith("array")
    schema = "doc_id long, sources array<string>, size long, h string, row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                size = pa.array(np.diff(words(*text_bytes(some.column("text")))[2]), pa.int64())
                kept = {c: some.column(c) for c in ("doc_id", "sources", "h", "row")}
                yield pa.RecordBatch.from_pydict({c: size if c == "size" else kept[c] for c in ("doc_id", "sources", "size", "h", "row")})

    sources = F.array_sort(F.array_distinct("source")) if several else F.array("source")
    h = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))).cast("binary"))
    row = (F.col(row) if row else F.lit(None)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sources.alias("sources"), "text", h.alias("h"), row.alias("row"))
    return rows.mapInArrow(tidied(run), schema)


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share times all sizes, dealt by weight; no source gets over most times its size, and the excess is dealt again."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in sorted(free):
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * float(sizes[i])
        free -= set(over)
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[list[int]]:
    """Words that go from each pattern to each of its sources, of least cost among the largest flows.

    patterns: (sources, size). A pattern's r-th repetition costs r a word; unmet quotas stay unmet. Primal-dual:
    each phase finds the least costs from the start, then pushes blocking flows along the arcs of least cost.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
        return len(to) - 2

    big = sum(quotas) + 1
    member = []
    for i, (sources, size) in enumerate(patterns):
        for r in range(repeats):
            arc(start, i, size, r)
        member.append([arc(i, n + s, big, 0) for s in sources])
    for s, q in enumerate(quotas):
        arc(n + s, end, q, 0)
    potential = [0] * (n + m + 2)

    def least_costs() -> bool:
        """Adds the least reduced costs from the start to the potentials; whether the end can be reached."""
        far: list[int | None] = [None] * (n + m + 2)
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e]:
                    y = to[e]
                    w = d + cost[e] + potential[x] - potential[y]
                    if far[y] is None or w < far[y]:
                        far[y] = w
                        heapq.heappush(heap, (w, y))
        most = max(f for f in far if f is not None)
        for x, f in enumerate(far):
            potential[x] += most if f is None else f
        return far[end] is not None

    def levels() -> list[int]:
        """Steps from the start over arcs of least cost; -1 where there is no way."""
        level = [-1] * (n + m + 2)
        level[start] = 0
        edge = [start]
        while edge and level[end] < 0:
            new = []
            for x in edge:
                for e in out[x]:
                    y = to[e]
                    if cap[e] and level[y] < 0 and cost[e] + potential[x] == potential[y]:
                        level[y] = level[x] + 1
                        new.append(y)
            edge = new
        return level

    while least_costs():
        while (level := levels())[end] >= 0:
            tried = [0] * (n + m + 2)
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path = path[: next(i for i, e in enumerate(path) if not cap[e])]
                    x = to[path[-1]] if path else start
                while tried[x] < len(out[x]):
                    e = out[x][tried[x]]
                    if cap[e] and level[to[e]] == level[x] + 1 and cost[e] + potential[x] == potential[to[e]]:
                        break
                    tried[x] += 1
                else:
                    if not path:
                        break
                    x = to[path.pop() ^ 1]
                    tried[x] += 1
                    continue
                path.append(e)
                x = to[e]
    return [[cap[e ^ 1] for e in arcs] for arcs in member]


def weights_by_order(n: int) -> list[float]:
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(n)]


def plan_mix(totals: DataFrame, share: float = 1.5, most: float = 2.0, repeats: int = 2, weights=None) -> tuple[list, list]:
    """From (sources: sorted array, size) of all patterns: (source, size, target) of each source, and (sources, flow, size) of each pattern."""
    rows = [(tuple(r["sources"]), int(r["size"])) for r in totals.collect()]
    code = lambda s: (s is None, s or "")  # noqa: E731  Python orders strings by code point
    rows.sort(key=lambda r: [code(s) for s in r[0]])
    sources = sorted({s for r in rows for s in r[0]}, key=code)
    index = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for p, size in rows:
        for s in p:
            sizes[index[s]] += size
    target = targets(sizes, (weights or weights_by_order)(len(sources)), share, most)
    flow = min_cost_flow([(tuple(index[s] for s in p), size) for p, size in rows], [int(t) for t in target], repeats)
    return list(zip(sources, sizes, target, strict=True)), [(list(p), sum(f), size) for (p, size), f in zip(rows, flow, strict=True)]


def _taken(fills: int):
    """Whether one of so many fills took a row: it is not longer than the fill's gap and not behind its last position."""
    at = F.struct("h", "doc_id", "size", "row")
    took = [(F.col("size") <= F.col(f"gap{k}")) & F.coalesce(at <= F.col(f"last{k}"), F.lit(False)) for k in range(fills)]
    return reduce(lambda a, b: a | b, took, F.lit(False))


def _filled(base: DataFrame, flows: DataFrame, k: int) -> DataFrame:
    """flows with the last position of fill k and the gap after it."""
    gap, at = F.col(f"gap{k}"), F.struct("h", "doc_id", "size", "row")
    rows = base.join(small(flows, BROADCAST), F.col("sources").eqNullSafe(F.col("p"))).where(~_taken(k) & (F.col("size") > 0) & (F.col("size") <= gap))
    runs = rows.groupBy("p", "digit").agg(F.sum("size").alias("n"), F.first(gap).alias("gap"))
    runs = runs.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("digit")))
    # The digit whose documents do not all fit; none: past the last digit.
    cuts = runs.groupBy("p").agg(
        F.coalesce(F.min(F.when(F.col("upto") > F.col("gap"), F.col("digit"))), F.lit("g")).alias("cut"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.lit(0)).alias("whole"),
    )
    cuts = cuts.select(F.col("p").alias("cp"), "cut", "whole")
    edge = rows.join(small(cuts, BROADCAST), F.col("p").eqNullSafe(F.col("cp")) & (F.col("digit") == F.col("cut")))
    order = Window.partitionBy("p", "digit").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= gap - F.col("whole"))
    ends = edge.groupBy("cp").agg(F.max(at).alias("end"), F.max("upto").alias("part")).withColumnRenamed("cp", "ep")
    none = F.struct(F.col("cut").alias("h"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("row"))
    done = flows.join(cuts, F.col("p").eqNullSafe(F.col("cp")), "left").join(ends, F.col("p").eqNullSafe(F.col("ep")), "left")
    took = F.coalesce("whole", F.lit(0)) + F.coalesce("part", F.lit(0))
    last = F.when(F.col("cut").isNotNull(), F.coalesce("end", none))
    return done.select(*flows.columns, last.alias(f"last{k}"), (gap - took).alias(f"gap{k + 1}"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, repeats: int = 2, seed: str = "", row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row of docs (doc_id, text, source: string or array of strings).

    For a document of several sources, source_size and target are those of its first source.
    row names a column of distinct numbers, which the result then has too: ids may be null or repeated.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    base = stored(sized(docs, row, seed).withColumn("row", F.coalesce("row", F.monotonically_increasing_id())), folder, "sizes")
    base = base.withColumn("digit", F.substring("h", 1, DIGITS))
    by_source, by_pattern = plan_mix(base.groupBy("sources").agg(F.sum("size").alias("size")), share, most, repeats)
    flows = spark.createDataFrame([(p, f // s if s else 0, f % s if s else 0) for p, f, s in by_pattern], "p array<string>, rounds long, gap0 long")
    known = small(spark.createDataFrame([(s, int(z), float(t)) for s, z, t in by_source], "s string, source_size long, target double"), BROADCAST)
    for k in range(FILLS):
        flows = stored(_filled(base, flows, k), folder, "fills")
    rows = base.join(small(flows, BROADCAST), F.col("sources").eqNullSafe(F.col("p"))).withColumn("more", _taken(FILLS))
    fits = rows.where(~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col(f"gap{FILLS}")))
    last = fits.groupBy("p").agg(F.min(F.struct((-F.col("size")).alias("size"), "h", "doc_id", "row")).alias("x")).select(F.col("p").alias("lp"), F.col("x.row").alias("last"))
    out = rows.join(small(last, BROADCAST), F.col("sources").eqNullSafe(F.col("lp")), "left")
    extra = F.coalesce(F.col("row") == F.col("last"), F.lit(False))
    out = out.withColumn("taken", F.col("size") * (F.col("rounds") + (F.col("more") | extra).cast("long"))).withColumn("source", F.col("sources")[0])
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return out.join(known, F.col("source").eqNullSafe(F.col("s"))).select(*names, *([F.col("row").alias(row)] if row else []))


def _fill_sql(k: int) -> str:
    """The CTE of one fill: it reads more and gap of the one before."""
    fits = f"NOT more{k} AND size > 0 AND size <= gap{k}"
    order = "PARTITION BY source ORDER BY h, doc_id, size, n_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    took = f"{fits} AND upto{k} <= gap{k}"
    return f"""x{k} AS (SELECT *, sum(CASE WHEN {fits} THEN size END) OVER ({order}) AS upto{k} FROM m{k}),
m{k + 1} AS (SELECT *, more{k} OR ({took}) AS more{k + 1}, gap{k} - coalesce(sum(CASE WHEN {took} THEN size END) OVER (PARTITION BY source), 0) AS gap{k + 1} FROM x{k}),
"""


#: DuckDB SQL for the rows of op6.
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h, row_number() OVER () AS n_row FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / w, i) AS k FROM w),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight, sum(source_size) OVER () AS total FROM r),
f AS (SELECT * FROM c WHERE (1.5 * total - capped) * w / weight <= 2 * source_size ORDER BY k LIMIT 1),
t AS (SELECT c.source, c.source_size, CASE WHEN c.k < coalesce((SELECT k FROM f), 1000000000) THEN 2 * c.source_size ELSE ((SELECT 1.5 * total - capped FROM f) * c.w) / (SELECT weight FROM f) END AS target FROM c),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS flow, CAST(source_size AS BIGINT) AS z FROM t),
p AS (SELECT *, CASE WHEN z = 0 THEN 0 ELSE flow // z END AS rounds, CASE WHEN z = 0 THEN 0 ELSE flow % z END AS gap0 FROM q),
m0 AS (SELECT d.*, p.z, p.target, p.rounds, p.gap0, FALSE AS more0 FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
{"".join(_fill_sql(k) for k in range(FILLS))}l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT more{FILLS} AND size > 0 AND size <= gap{FILLS} THEN 0 ELSE 1 END, size DESC, h, doc_id, n_row) AS o FROM m{FILLS})
SELECT doc_id, size, CAST(z AS BIGINT) AS source_size, target, CAST(size * (rounds + CASE WHEN more{FILLS} OR (o = 1 AND size > 0 AND size <= gap{FILLS}) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM l
"""
