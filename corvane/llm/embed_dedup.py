"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one row first. In every pass the vectors of a label
and length are ordered lexicographically by concatenated random hashes (signs of
fixed projections). A window is a run of vectors whose leading hashes are equal;
the number of leading hashes grows with the label, so that a run of evenly spread
vectors keeps about ``target`` rows. All pairs of a window are compared. A pair at
the least cosine shares a window with a known probability, and there are as many
passes as make the share of pairs missed at most ``missed``; labels of up to
``target`` different vectors have one window and miss none.

Windows have no cap: a dense group makes a long run, which is packed into blocks
that meet pair by pair. Blocks around close centres are decided by their centres
and radii alone; the others as products of matrices. A pair counts in the first
pass that brings it together, so links are counted once. A pair of blocks gives
numbers of links and connecting edges, not links; components are found by joins.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without label or id, link with nothing; vectors of
different lengths never link. Repeated rows link with each other. Rows that share
an id are vectors of their own: each has its own links, and component_id is the
smallest id of its component. Columns beyond vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import components, shared_folder, small, stored, tidied

#: Least and most rows of a window of evenly spread vectors and of a block, and the numbers in each that decide between them.
LEAST_ROWS, MOST_ROWS, WINDOW_NUMBERS, BLOCK_NUMBERS = 256, 2048, 1 << 20, 1 << 19
#: Hashes of a pass, and rows of one product of matrices.
HASHES, STEP = 32, 256
#: Children of a node in the trees that connect linked rows.
FAN = 32
#: Labels of several windows up to which their sizes are broadcast.
BROADCAST_LABELS = 100_000
#: Linked vectors up to which their numbers and components are broadcast.
BROADCAST_NODES = 500_000
RUN = ["label", "dim", "pass", "run"]
_ROWS = "label string, dim int, pass int, run long, earlier binary, key long, node long, copies long, v binary"
_BLOCKS = (
    "block long, label string, dim int, pass int, run long, total long, lead long, nodes binary, copies binary,"
    " earlier binary, same binary, center binary, radius double, x binary"
)


def target(dim):
    """Different vectors of a window, if they are evenly spread."""
    return F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.floor(WINDOW_NUMBERS / dim)))


def block_rows(dim: int) -> int:
    return max(LEAST_ROWS, min(MOST_ROWS, BLOCK_NUMBERS // dim))


def passes(bits: int, least: float, missed: float) -> int:
    """Passes after which a pair at the least cosine shared no window of so many leading hashes with probability missed."""
    if not bits:
        return 1
    share = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return 1 if share >= 1 else max(2, math.ceil(math.log(missed) / math.log1p(-share)))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x


def keys(x: np.ndarray, number: int) -> np.ndarray:
    """The concatenated hashes of vectors in a pass."""
    dim = x.shape[1]
    planes = np.random.default_rng((dim, number)).standard_normal((dim, HASHES))
    return ((x @ planes) > 0) @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))


def _hashed(least: float, missed: float, kind: str):
    """A row for each pass of each vector; earlier holds its windows in the passes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            bits = np.array(batch.column("bits").to_pylist())
            for dim, b in sorted(set(zip(dims.tolist(), bits.tolist(), strict=True))):
                some = batch.take(pa.array(np.flatnonzero((dims == dim) & (bits == b))))
                raw = np.array(some.column("embedding").to_pylist(), dtype=kind).reshape(some.num_rows, dim)
                x, runs = unit(raw), np.zeros((some.num_rows, 0), dtype=np.int32)
                v = pa.array([r.tobytes() for r in raw], pa.binary())
                for number in range(passes(b, least, missed)):
                    key = keys(x, number)
                    before = pa.array([r.tobytes() for r in runs], pa.binary())
                    at = key >> (HASHES - b)
                    same = lambda k, t: pa.array(np.full(some.num_rows, k), t)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [some.column("label"), same(dim, pa.int32()), same(number, pa.int32()), pa.array(at), before, pa.array(key), some.column("node"), some.column("copies"), v],
                        names=["label", "dim", "pass", "run", "earlier", "key", "node", "copies", "v"],
                    )
                    runs = np.concatenate([runs, at[:, None].astype(np.int32)], axis=1)

    return run


def _packer(kind: str):
    """A sorted partition as blocks of rows of one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rows, now = TaskContext.get().partitionId() << 32, [], None
        schema = pa.schema([
            ("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("pass", pa.int32()), ("run", pa.int64()), ("total", pa.int64()), ("lead", pa.int64()),
            ("nodes", pa.binary()), ("copies", pa.binary()), ("earlier", pa.binary()), ("same", pa.binary()), ("center", pa.binary()), ("radius", pa.float64()), ("x", pa.binary()),
        ])

        def block() -> pa.RecordBatch:
            nodes, copies, earlier, v = zip(*rows, strict=True)
            raw = b"".join(v)
            x = unit(np.frombuffer(raw, dtype=kind).reshape(len(rows), -1))
            center = x.sum(axis=0)
            size = np.sqrt(center @ center)
            # Opposite vectors may have no centre: then the radius is that of everything.
            center = center / size if size > 1e-6 else x[0]
            radius = float(np.arccos(np.clip((x @ center).min(), -1, 1))) if size > 1e-6 else math.pi
            same = earlier[0] if len(set(earlier)) == 1 else None
            values = [number, *now, sum(copies), nodes[0], np.array(nodes, np.int64).tobytes(), np.array(copies, np.int64).tobytes()]
            values += [b"".join(earlier), same, center.tobytes(), radius, raw]
            return pa.RecordBatch.from_arrays([pa.array([k], f.type) for k, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
            for at, row in zip(zip(*map(column, RUN), strict=True), zip(*map(column, ("node", "copies", "earlier", "v")), strict=True), strict=True):
                if rows and (at != now or len(rows) >= block_rows(now[1])):
                    yield block()
                    number, rows = number + 1, []
                now = at
                rows.append(row)
        if rows:
            yield block()

    return run


def _forest(near: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows and columns of true cells that connect the same rows and columns as all true cells do."""
    if np.count_nonzero(near) <= sum(near.shape):
        at = np.nonzero(near)
        return [at[0]], [at[1]]
    left, free, a, b = near.any(axis=1), np.ones(near.shape[1], dtype=bool), [], []
    while left.any():
        edge = np.flatnonzero(left)[:1]
        left[edge] = False
        while len(edge):
            hit = near[edge]
            new = np.flatnonzero(hit.any(axis=0) & free)
            free[new] = False
            a.append(edge[hit[:, new].argmax(axis=0)])
            b.append(new)
            back = near[:, new]
            edge = np.flatnonzero(back.any(axis=1) & left)
            left[edge] = False
            a.append(edge)
            b.append(new[back[edge].argmax(axis=1)] if len(edge) else edge)
    return a, b


def _trees(edges: np.ndarray) -> np.ndarray:
    """Edges that connect the same nodes as edges (a < b) do, by trees of degree FAN + 1: no node becomes a hub of joins."""
    nodes, ends = np.unique(edges, return_inverse=True)
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in ends.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    label = np.array([find(i) for i in range(len(nodes))], dtype=np.int64)
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]) if len(order) else order
    return np.concatenate([np.zeros((0, 2), np.int64), *(_tree(nodes[some]) for some in np.split(order, cuts[1:]))])


def _tree(nodes: np.ndarray) -> np.ndarray:
    """Edges of a tree over ascending nodes."""
    return np.stack([nodes[(np.arange(1, len(nodes)) - 1) // FAN], nodes[1:]], axis=1)


def _output(nodes: np.ndarray, others: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    gap, gap2 = pa.nulls(len(edges), pa.int64()), pa.nulls(len(nodes), pa.int64())
    columns = [[pa.array(nodes), gap], [pa.array(others), gap], [gap2, pa.array(edges[:, 0])], [gap2, pa.array(edges[:, 1])]]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["node", "others", "a", "b"])


_OUTPUT = "node long, others long, a long, b long"


def _read(row: dict, kind: str, end: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nodes, copies = (np.frombuffer(row[c + end], np.int64) for c in ("nodes", "copies"))
    earlier = np.frombuffer(row["earlier" + end], np.int32).reshape(len(nodes), row["pass"])
    return nodes, copies, earlier, unit(np.frombuffer(row["x" + end], dtype=kind).reshape(len(nodes), -1))


def _compared(least: float, kind: str, itself: bool):
    """Numbers of links (node, others) and edges (a, b) of each block with itself, or of each pair of blocks."""

    def one(row: dict) -> pa.RecordBatch | None:
        nodes, copies, earlier, x = _read(row, kind)
        others, copies2, earlier2, y = (nodes, copies, earlier, x) if itself else _read(row, kind, "2")
        mine, theirs, a, b = np.zeros(len(nodes), np.int64), np.zeros(len(others), np.int64), [], []
        for s in range(0, len(nodes), STEP):
            near = x[s : s + STEP] @ y.T >= least
            if itself:
                near[np.arange(len(near)), np.arange(s, s + len(near))] = False
            if not near.any():
                continue
            for q in range(row["pass"]):
                near &= earlier[s : s + STEP, q][:, None] != earlier2[:, q][None, :]
            mine[s : s + STEP] = near @ copies2
            theirs += copies[s : s + STEP] @ near
            p, q = _forest(near)
            a += [nodes[s + k] for k in p]
            b += [others[k] for k in q]
        numbers = [(nodes, mine)] if itself else [(nodes, mine), (others, theirs)]
        found, count = (np.concatenate([n[k][n[1] > 0] for n in numbers]) for k in (0, 1))
        if not len(found):
            return None
        a, b = (np.concatenate([np.zeros(0, np.int64), *k]) for k in (a, b))
        a, b = np.minimum(a, b), np.maximum(a, b)
        return _output(found, count, _trees(np.stack([a, b], axis=1)[a < b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = one({n: batch.column(n)[i].as_py() for n in batch.schema.names})
                if out is not None:
                    yield out

    return run


def _decided(least: float):
    """Pairs of blocks that may link: whole (all of them link, by the centres) or not (to be compared)."""
    reach = math.acos(max(-1.0, min(1.0, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("block", "block2", "lead", "lead2", "total", "total2", "same", "same2", "center", "center2", "radius", "radius2")]
            for block, block2, lead, lead2, total, total2, same, same2, c, c2, r, r2 in zip(*columns, strict=True):
                known = same is not None and same2 is not None
                if known and (np.frombuffer(same, np.int32) == np.frombuffer(same2, np.int32)).any():
                    continue  # an earlier pass has all of these pairs
                apart = float(np.arccos(np.clip(np.frombuffer(c) @ np.frombuffer(c2), -1, 1)))
                if apart - r - r2 > reach + 1e-6:
                    continue
                out.append((block, block2, lead, lead2, total, total2, known and apart + r + r2 < reach - 1e-6))
            names = ["block", "block2", "lead", "lead2", "total", "total2", "whole"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.bool_() if i == 6 else pa.int64()) for i in range(7)], names=names)

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that the rows of a block have with whole blocks, and edges that connect its rows."""
    for batch in batches:
        for nodes, plus in zip(*(batch.column(c).to_pylist() for c in ("nodes", "plus")), strict=True):
            some = np.frombuffer(nodes, np.int64)
            yield _output(some, np.full(len(some), plus), _tree(np.sort(some)))


def _links(classes: DataFrame, folder: str, least: float, missed: float, kind: str) -> DataFrame:
    """(node, others) and (a, b) of all windows of classes (node, copies, label, embedding)."""
    rows = classes.withColumn("dim", F.size("embedding"))
    sizes = rows.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > target(F.col("dim")))
    bits = F.least(F.lit(HASHES - 2), F.ceil(F.log2(F.col("n") / target(F.col("dim"))))).cast("int")
    sizes = sizes.select("label", "dim", bits.alias("bits"))
    rows = rows.join(small(sizes, BROADCAST_LABELS), ["label", "dim"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    rows = rows.select("label", "dim", "bits", "node", "copies", "embedding").mapInArrow(tidied(_hashed(least, missed, kind)), _ROWS)
    order = [*RUN, "earlier", "key", "node"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidied(_packer(kind)), _BLOCKS)
    blocks = stored(packed, folder, "blocks")

    inner = blocks.where("pass = 0 or same is null").select("pass", "nodes", "copies", "earlier", "x")
    inner = inner.mapInArrow(tidied(_compared(least, kind, True)), _OUTPUT)
    about = blocks.select("block", *RUN, "lead", "total", "same", "center", "radius")
    about = about.join(about.groupBy(*RUN).agg(F.count("*").alias("blocks")).where("blocks > 1").select(*RUN), RUN)
    other = about.select(*RUN, *(F.col(c).alias(c + "2") for c in about.columns if c not in RUN))
    pairs = about.join(other, RUN).where("block < block2").mapInArrow(
        tidied(_decided(least)), "block long, block2 long, lead long, lead2 long, total long, total2 long, whole boolean"
    )
    pairs = stored(pairs, folder, "pairs")
    first = blocks.select("block", "pass", "nodes", "copies", "earlier", "x")
    second = first.select([F.col(c).alias(c + "2") for c in first.columns if c != "pass"])
    both = pairs.where("not whole").select("block", "block2").repartition(parts, "block", "block2")
    both = both.join(first.hint("merge"), "block").join(second.hint("merge"), "block2")
    whole = pairs.where("whole")
    plus = whole.select("block", F.col("total2").alias("plus")).unionByName(whole.select(F.col("block2").alias("block"), F.col("total").alias("plus")))
    plus = plus.groupBy("block").agg(F.sum("plus").alias("plus"))
    gap = F.lit(None).cast("long")
    joined = whole.select(gap.alias("node"), gap.alias("others"), F.least("lead", "lead2").alias("a"), F.greatest("lead", "lead2").alias("b"))
    found = inner.unionByName(both.mapInArrow(tidied(_compared(least, kind, False)), _OUTPUT)).unionByName(joined)
    found = found.unionByName(blocks.select("block", "nodes").join(plus, "block").mapInArrow(tidied(_spread), _OUTPUT))
    return stored(found, folder, "links")


def near_vectors(vectors: DataFrame, least: float = 0.98, missed: float = 0.05) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding: array, label)."""
    folder = shared_folder(vectors.sparkSession)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "float32" if single else "float64"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = rows.withColumn("sound", F.coalesce(sound & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    # 96 bits stand for a vector where its class is looked up.
    rows = rows.withColumn("h", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    classes = rows.where("sound").groupBy("label", "embedding", "h", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), folder, "classes")
    links = _links(classes, folder, least, missed, kind)
    labels = components(links.where("a is not null").select("a", "b"), folder).withColumnRenamed("label", "of")
    smallest = labels.join(classes.select("node", "rep"), "node").groupBy("of").agg(F.min("rep").alias("smallest"))
    others = links.where("node is not null").groupBy("node").agg(F.sum("others").alias("others"))
    found = small(labels.join(small(smallest, BROADCAST_NODES), "of"), BROADCAST_NODES)
    named = classes.select("label", "h", "h2", "node", "rep", "copies").join(small(others, BROADCAST_NODES), "node", "left").join(found, "node", "left")
    n_links = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    named = named.select("label", "h", "h2", n_links.alias("n_links"), F.coalesce("smallest", "rep").alias("component_id"))
    out = rows.where("sound").select("vec_id", "label", "h", "h2").join(named, ["label", "h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
