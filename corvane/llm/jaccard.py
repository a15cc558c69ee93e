"""Exact Jaccard join of word-shingle sets with count-vector R-trees.

Method. Shingles are hashed into groups and a document's set becomes a point of
group counts; the sum of coordinate minima bounds the overlap of two sets, or of
a set and a box of sets, and only pairs that pass are verified on whole sets.

1.  One pass counts shingles in a fixed-size sketch, which orders shingles from
    rare to frequent, and gives every document the size and digest of its set.
    Equal sets are one class from here on.
2.  A second pass sends each set's rarest shingles (as many as any set at the
    threshold must share one of) to buckets, packed, with the set's point. The
    place of a shingle in its set bounds what two sets share if that shingle is
    the first one that they share: all before it differ.
3.  Within a bucket, the points of the sets that share a shingle are indexed by
    an R-tree; leaves are groups around a leader, joined by every point whose
    bound with the leaf passes. A group row is (leader, member). What is left of
    a block of many unlike sets after ``LEADERS`` groups is cut into tiles.
4.  Groups get the whole sets of their members and are verified; pairs already
    connected are skipped, so that a large group of copies costs one comparison
    each. Groups above ``SLICE`` members are dealt out in slices beside their
    leader. What is then not connected to the leader is first compared among
    representatives, then cut into tiles.
5.  Tiles meet pair by pair, each pair of them in a task of its own, by finer
    points of their members; only pairs of sets that pass are verified.
6.  Links become components by joins (``common.components``).

No link between different sets is lost: the shingle prefix and all bounds are
necessary conditions of a link. The sketch only decides how much work is done.

Defined results: null or white-space texts have an empty set and link with
nothing; a row without an id keeps its n_shingles, links with nothing and has a
null component; repeated rows are members of one class. Rows that share an id
share a component (that of all their texts). Columns beyond doc_id and text are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U, components, joined_components, mix64, shared_folder, slices, small, stored, text_bytes, tidied, word_hashes, words

K = 5
#: log2 of the counters that order shingles by frequency; 4 MB for each task.
SKETCH_BITS = 20
CHUNKS = 64
#: Groups of a point, and points of a leaf.
GROUPS = 32
LEAF = 16
#: Members of a leader's group that one task verifies.
SLICE = 512
#: Groups that one task forms of a block, beyond which more than TILE free sets go to tiles, and members of a tile.
LEADERS, TILE = 64, 1024
#: Places in a set are kept in this many steps, those of a prefix in a byte.
STEPS = 1024
#: Group rows up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 400_000
#: Shingles of a bucket, about.
BUCKET = 1_500_000
#: Low bytes of a shingle's hash that verification compares: two different shingles agree once in 2.8e14.
SET_BYTES = 6
_FACTORS = mix64(np.arange(1, K + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    starts, ends, first = words(data, offsets)
    w = word_hashes(data, starts, ends)
    if len(w) >= K:
        h = w[: len(w) - K + 1] * _FACTORS[0]
        for j in range(1, K):
            h = h + w[j : len(w) - K + 1 + j] * _FACTORS[j]
        h = mix64(h)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= K:
            s = np.sort(h[a : b - K + 1])
            fresh = np.empty(len(s), dtype=bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s if fresh.all() else s[fresh])
        elif b > a:
            out.append(mix64((w[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a)))
        else:
            out.append(w[:0])
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def key_of(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def fine_point(s: np.ndarray) -> bytes:
    """Counts of a set in about half as many groups as it has shingles, a byte each; wider where a count needs it."""
    width = 1 << max(5, min(14, (len(s) - 1).bit_length() - 1))
    c = np.bincount((s & U(width - 1)).astype(np.int64), minlength=width)
    return zlib.compress((b"\x02" + c.astype(np.uint32).tobytes()) if c.max() > 255 else (b"\x01" + c.astype(np.uint8).tobytes()), 1)


def read_point(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, dtype=np.uint8 if raw[0] == 1 else np.uint32, offset=1).astype(np.int32)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of linked sets of these sizes: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    part = TaskContext.get().partitionId()
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("fine", pa.binary()), ("part", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
    seen: set[bytes] = set()
    for batch in batches:
        for some in slices(batch, "text"):
            sets = shingle_sets(some.column("text"))
            digests = [digest(s) if len(s) else None for s in sets]
            new, fine = [], []
            for s, d in zip(sets, digests, strict=True):
                if d is not None and d not in seen:
                    seen.add(d)
                    new.append(s)
                    fine.append(fine_point(s))
                else:
                    fine.append(None)
            if new:
                counts += np.bincount((np.concatenate(new) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            k = some.num_rows
            sizes = pa.array(list(map(len, sets)), pa.int64())
            found = [some.column("doc_id"), sizes, pa.array(digests, pa.binary()), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(k, t) for t in schema.types[4:])], schema=schema)
    parts = counts.astype(np.uint32).reshape(CHUNKS, -1)
    sums = [pa.array([part] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(CHUNKS, t) for t in schema.types[:4]), *sums], schema=schema)


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.uint32).astype(np.uint64) for x in group.column("counts").to_pylist())
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})


def _sketch(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up 64 tasks at a time; fixed size, so it may pass through the driver."""
    rows = rows.where("counts is not null").select("part", "chunk", "counts")
    most = rows.agg(F.max("part")).first()[0] or 0
    while True:
        rows = rows.withColumn("part", F.expr("cast(part div 64 as int)")).groupBy("part", "chunk").applyInArrow(_added, "part int, chunk int, counts binary")
        most //= 64
        if most == 0:
            break
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32).reshape(CHUNKS, -1)
    for r in rows.collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out.ravel()


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _packer(sketch, buckets: int, percent: int):
    """Second pass: (bucket, packed arrays) of each set's rarest shingles; a set goes out once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counters by their order: 20 bits hold it, whatever the counts are.
        counts = np.empty(1 << SKETCH_BITS, dtype=np.uint64)
        counts[np.argsort(sketch.value, kind="stable")] = np.arange(1 << SKETCH_BITS, dtype=np.uint64) << U(64 - SKETCH_BITS)
        seen: set[bytes] = set()
        toks: list[np.ndarray] = []
        places: list[np.ndarray] = []
        keys: list[int] = []
        sizes: list[int] = []
        points: list[np.ndarray] = []
        units: list[int] = []
        held = 0

        def flush():
            own = np.repeat(np.arange(len(toks)), [len(t) for t in toks])
            every, place = np.concatenate(toks), np.concatenate(places)
            at = ((every & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, own, place, every = at[order], own[order], place[order], ((every[order] >> U(16)) & U(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
            key, n, unit, point = np.array(keys, np.int64), np.array(sizes, np.int64), np.array(units, np.int32), np.array(points, np.uint8)
            out: list[list] = [[] for _ in range(8)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                who, times = np.unique(own[a:b], return_counts=True)  # own ascends within a bucket
                for column, x in zip(out, (int(at[a]), every[a:b], place[a:b], times.astype(np.uint32), key[who], n[who], unit[who], point[who]), strict=True):
                    column.append(x if isinstance(x, int) else _packed(x))
            for some in (toks, places, keys, sizes, points, units):
                some.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "tok", "place", "times", "key", "n", "unit", "point"])

        for batch in batches:
            for texts in slices(batch, "text"):
                for s in shingle_sets(texts.column("text")):
                    n = len(s)
                    if not n or (d := digest(s)) in seen:
                        continue
                    seen.add(d)
                    p = n - -(-percent * n // 100) + 1
                    rank = counts[s >> U(64 - SKETCH_BITS)] | (s & U((1 << (64 - SKETCH_BITS)) - 1))
                    some = np.argpartition(rank, p - 1)[:p]
                    toks.append(s[some[np.argsort(rank[some])]])
                    places.append(np.minimum(np.arange(p) * STEPS // n, 255).astype(np.uint8))
                    c = np.bincount((s & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
                    unit = -(-int(c.max()) // 255)
                    keys.append(key_of(d))
                    sizes.append(n)
                    units.append(unit)
                    points.append((-(-c // unit)).astype(np.uint8))
                    held += p
                if held > 1_000_000:
                    yield flush()
                    held = 0
        if toks:
            yield flush()

    return run


class RTree:
    """A bulk-loaded R-tree over points of group counts; boxes keep the largest count of each group and the range of set sizes.

    ``search`` gives every point whose overlap with the query, bounded by the sum of coordinate minima, can reach a link.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, percent: int):
        self.points, self.n, self.percent = points, n, percent
        spread = np.argsort(-points.var(axis=0))[:2]
        order = np.lexsort((points[:, spread[1]], points[:, spread[0]], n))
        # Tiles of similar size first, each ordered by the most spread coordinate.
        tile = max(LEAF, int(np.sqrt(len(n) / LEAF)) * LEAF)
        order = np.concatenate([t[np.argsort(points[t, spread[0]], kind="stable")] for t in (order[i : i + tile] for i in range(0, len(order), tile))])
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        hi = np.array([points[x].max(axis=0) for x in self.leaves])
        lo_n, hi_n = np.array([n[x].min() for x in self.leaves]), np.array([n[x].max() for x in self.leaves])
        self.levels = [(hi, lo_n, hi_n)]
        while len(hi) > LEAF:
            cuts = np.arange(0, len(hi), LEAF)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, cuts), np.minimum.reduceat(lo_n, cuts), np.maximum.reduceat(hi_n, cuts)
            self.levels.append((hi, lo_n, hi_n))

    def search(self, q: np.ndarray, n: int, share: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
        hi, lo_n, hi_n = self.levels[-1]
        at = np.arange(len(hi))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = self.levels[depth]
            ok = (100 * hi_n[at] >= self.percent * n) & (100 * n >= self.percent * lo_n[at])
            at = at[ok]
            at = at[np.minimum(hi[at], q).sum(axis=1) >= least_overlap(n, np.maximum(lo_n[at], -(-self.percent * n // 100)), self.percent)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)[None, :]).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        at = np.concatenate([self.leaves[i] for i in at])
        return at[passes(self.points[at], self.n[at], q, n, self.percent, None if share is None else share[at], most)]


def passes(points: np.ndarray, n: np.ndarray, q: np.ndarray, m: int, percent: int, share: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """Which points can link with the point q of m shingles; share and most bound what they can have in common besides."""
    close = (100 * n >= percent * m) & (100 * m >= percent * n)
    if share is not None:
        close &= np.minimum(share, most) >= least_overlap(n, m, percent)
    close[close] = np.minimum(points[close], q).sum(axis=1) >= least_overlap(n[close], m, percent)
    return close


def with_partner(n: np.ndarray, share: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a block have another one of a size at which what both can share suffices."""
    order = np.sort(n)
    # Overlap share needs n + m <= share (100 + percent) / percent; m is at least percent of n.
    low = np.searchsorted(order, -(-percent * n // 100), side="left")
    high = np.searchsorted(order, share * (100 + percent) // percent - n, side="right")
    own = (share * (100 + percent) // percent >= 2 * n).astype(np.int64)
    return high - low > own


def leader_groups(points: np.ndarray, n: np.ndarray, share: np.ndarray, percent: int, most: int | None = None) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Covers the pairs of points that can link: (leader, members) with every such pair together in a group; and the points left out.

    The leader is the point nearest the mean of those without a group; its group's home is what the
    R-tree finds around it, and any other point that can link with a home point visits. After most
    groups, more than TILE points without a group are left out: no pair of theirs is covered, all others are.
    """
    m = len(n)
    tree = RTree(points, n, percent) if m > 4 * LEAF else None
    free = np.ones(m, dtype=bool)
    every = np.arange(m)
    out = []
    count = 0
    while free.any():
        rest = every[free]
        if most is not None and count >= most and len(rest) > TILE:
            return out, rest
        count += 1
        leader = int(rest[np.abs(points[rest] - points[rest].mean(axis=0)).sum(axis=1).argmin()]) if len(rest) > 2 else int(rest[0])
        q, k, u = points[leader], int(n[leader]), int(share[leader])
        near = tree.search(q, k, share, u) if tree else every[passes(points, n, q, k, percent, share, u)]
        home = near[free[near]]
        free[home] = False
        free[leader] = False
        home = np.union1d(home, [leader])
        rest = np.setdiff1d(every, home)
        if len(rest):
            hi, low, high = points[home].max(axis=0), n[home].min(), n[home].max()
            ok = (100 * high >= percent * n[rest]) & (100 * n[rest] >= percent * low)
            rest = rest[ok]
            least = least_overlap(n[rest], np.maximum(low, -(-percent * n[rest] // 100)), percent)
            rest = rest[(np.minimum(points[rest], hi).sum(axis=1) >= least) & (np.minimum(share[rest], share[home].max()) >= least)]
        visit = [int(y) for y in rest if passes(points[home], n[home], points[y], int(n[y]), percent, share[home], int(share[y])).any()]
        if len(home) + len(visit) > 1:
            out.append((leader, np.concatenate([home, np.array(visit, dtype=np.int64)])))
    return out, every[:0]


def _grouper(percent: int):
    """Group rows (leader, member) of a bucket, and rows (block, tile, member, share) of what goes to tiles."""

    def run(group: pa.Table) -> pa.Table:
        def read(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(zlib.decompress(x), dtype=kind) for x in group.column(name).to_pylist()]

        toks, times, key = read("tok", np.uint32), np.concatenate(read("times", np.uint32)), read("key", np.int64)
        own = np.repeat(np.arange(len(times)), times)
        keys, first, who = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
        n = np.concatenate(read("n", np.int64))[first]
        points = np.concatenate([x.reshape(-1, GROUPS) for x in read("point", np.uint8)])[first].astype(np.int32) * np.concatenate(read("unit", np.int32))[first][:, None]
        pairs, at = np.unique((np.concatenate(toks).astype(np.uint64) << U(32)) | who[own].astype(np.uint64), return_index=True)
        tok, own = pairs >> U(32), (pairs & U(0xFFFFFFFF)).astype(np.int64)
        # What two sets can share at most if this is their first common shingle.
        share = n[own] - np.concatenate(read("place", np.uint8))[at].astype(np.int64) * n[own] // STEPS
        cuts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1], True])
        length = np.diff(cuts)
        two = cuts[:-1][length == 2]
        a, b, most = own[two], own[two + 1], np.minimum(share[two], share[two + 1])
        ok = (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a]) & (most >= least_overlap(n[a], n[b], percent))
        both = np.unique(a[ok] * len(keys) + b[ok])
        a, b = both // len(keys), both % len(keys)
        ok = np.minimum(points[a], points[b]).sum(axis=1) >= least_overlap(n[a], n[b], percent)
        rows = {(int(keys[x]), int(keys[y])) for x, y in zip(a[ok], b[ok], strict=True)}
        tiles: list[tuple[int, int, int, int]] = []
        blocks: dict[bytes, np.ndarray] = {}
        for s, k in zip(cuts[:-1][length > 2], length[length > 2], strict=True):
            ok = with_partner(n[own[s : s + k]], share[s : s + k], percent)
            members, some = own[s : s + k][ok], share[s : s + k][ok]
            if len(members) > 1:
                known = blocks.get(members.tobytes())
                blocks[members.tobytes()] = some if known is None else np.maximum(known, some)
        for block, some in blocks.items():
            members = np.frombuffer(block, dtype=np.int64)
            groups, left = leader_groups(points[members], n[members], some, percent, LEADERS)
            for leader, near in groups:
                lead = int(keys[members[leader]])
                rows.update((lead, int(k)) for k in keys[members[near]] if k != lead)
            if len(left):
                # Tiles of sets of similar size: many pairs of tiles are then too unlike.
                left = left[np.argsort(n[members[left]], kind="stable")]
                name = key_of(hashlib.blake2b(keys[members[left]].tobytes(), digest_size=16).digest())
                tiles += [(name, i // TILE, int(k), int(u)) for i, (k, u) in enumerate(zip(keys[members[left]], some[left], strict=True))]
        pairs = sorted(rows)
        columns = [[p[0] for p in pairs] + [None] * len(tiles), [p[1] for p in pairs] + [t[2] for t in tiles]]
        columns += [[None] * len(pairs) + [t[i] for t in tiles] for i in (0, 1, 3)]
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("leader", "member", "block", "tile", "share"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)})

    return run


_TILE = "block long, tile int, apart boolean, low long, high long, data binary"


def _tile(group: pa.Table) -> pa.Table:
    """The members of a tile with their finer points, packed."""
    rows = {r[0]: r for r in zip(*(group.column(c).to_pylist() for c in ("member", "n", "share", "label", "fine")), strict=True)}
    data = zlib.compress(pickle.dumps([rows[k] for k in sorted(rows)]), 1)
    n = [r[1] for r in rows.values()]
    one = lambda c: group.column(c)[0].as_py()
    return pa.table({
        "block": pa.array([one("block")], pa.int64()), "tile": pa.array([one("tile")], pa.int32()), "apart": pa.array([one("apart")], pa.bool_()),
        "low": pa.array([min(n)], pa.int64()), "high": pa.array([max(n)], pa.int64()), "data": pa.array([data], pa.binary()),
    })


def _tile_pairs(percent: int):
    """The pairs (leader, member) of two tiles, or of one, that can link and have different labels."""

    def read(data: bytes) -> tuple:
        keys, n, share, label, fine = zip(*pickle.loads(zlib.decompress(data)), strict=True)
        points = [read_point(f) for f in fine]
        flat = np.array([p.reshape(-1, GROUPS).sum(axis=0) for p in points])
        return np.array(keys), np.array(n), np.array(share), np.array(label), flat, points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, data2, itself in zip(*(batch.column(c).to_pylist() for c in ("data", "data2", "itself")), strict=True):
                keys, n, share, label, flat, points = read(data)
                keys2, n2, share2, label2, flat2, points2 = (keys, n, share, label, flat, points) if itself else read(data2)
                a, b = [], []
                for i in range(len(keys)):
                    rest = np.flatnonzero((label2 != label[i]) & ((np.arange(len(keys2)) < i) | (not itself)))
                    rest = rest[passes(flat2[rest], n2[rest], flat[i], int(n[i]), percent, share2[rest], int(share[i]))]
                    for j in rest.tolist():
                        width = min(len(points[i]), len(points2[j]))
                        x, y = (p.reshape(-1, width).sum(axis=0) for p in (points[i], points2[j]))
                        if np.minimum(x, y).sum() >= least_overlap(n[i], n2[j], percent):
                            a.append(int(keys[i]))
                            b.append(int(keys2[j]))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["leader", "member"])

    return run


def _tiled(rows: DataFrame, points: DataFrame, folder: str, percent: int) -> DataFrame:
    """Pairs (leader, member) that can link of rows (block, tile, apart, member, share, label): of two tiles of a block, one is apart."""
    members = rows.join(points, "member").withColumn("share", F.coalesce("share", "n"))
    tiles = stored(members.groupBy("block", "tile").applyInArrow(_tile, _TILE), folder, "tiles")
    about = tiles.select("block", "tile", "apart", "low", "high")
    other = about.select("block", *(F.col(c).alias(c + "2") for c in about.columns[1:]))
    close = (F.col("tile") <= F.col("tile2")) & (F.col("apart") | F.col("apart2"))
    close &= (100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = stored(about.join(other, "block").where(close).select("block", "tile", "tile2").repartition(parts, "block", "tile", "tile2"), folder, "tile-pairs")
    first, second = tiles.select("block", "tile", "data"), tiles.select("block", F.col("tile").alias("tile2"), F.col("data").alias("data2"))
    both = pairs.join(first.hint("merge"), ["block", "tile"]).join(second.hint("merge"), ["block", "tile2"])
    both = both.select("data", "data2", (F.col("tile") == F.col("tile2")).alias("itself"))
    return both.mapInArrow(tidied(_tile_pairs(percent)), "leader long, member long")


def _refiner(percent: int):
    """A group's members with their finer points: the parts of the group whose members can still link."""

    def run(group: pa.Table) -> pa.Table:
        lead = group.column("leader")[0].as_py()
        raw = dict(zip(group.column("member").to_pylist(), zip(group.column("n").to_pylist(), group.column("fine").to_pylist(), strict=True), strict=True))
        keys = sorted(raw, key=lambda k: (k != lead, k))
        n = np.array([raw[k][0] for k in keys], dtype=np.int64)
        points = [read_point(raw[k][1]) for k in keys]
        width = min(map(len, points))
        # Groups are low bits of the hash, so a wider point folds to a narrower one by adding its parts.
        flat = np.array([p.reshape(-1, width).sum(axis=0) for p in points])
        part = np.arange(len(keys))
        for i in range(1, len(keys)):
            rest = np.flatnonzero(part[:i] != part[i])
            for j in rest[passes(flat[rest], n[rest], flat[i], int(n[i]), percent)].tolist():
                if part[i] == part[j]:
                    continue
                common = min(len(points[i]), len(points[j]))
                a, b = (x.reshape(-1, common).sum(axis=0) for x in (points[i], points[j]))
                if np.minimum(a, b).sum() >= least_overlap(n[i], n[j], percent):
                    low, high = sorted((part[i], part[j]))
                    part[part == high] = low
        out = [(keys[p], k) for p, k in zip(part.tolist(), keys, strict=True) if keys[p] != k]
        return pa.table({"leader": pa.array([o[0] for o in out], pa.int64()), "member": pa.array([o[1] for o in out], pa.int64())})

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sets: list[np.ndarray], label: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets that link; pairs that labels or earlier links already connect are skipped."""
    m = len(sets)
    n = np.array(list(map(len, sets)), dtype=np.int64)
    width = 1 << max(5, min(10, int(n.max()).bit_length()))
    points = np.array([np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) for s in sets], dtype=np.int32)
    comp = np.array(label, dtype=np.int64)
    out = []
    for i in range(1, m):
        rest = np.flatnonzero(comp[:i] != comp[i])
        if not len(rest):
            continue
        rest = rest[passes(points[rest], n[rest], points[i], int(n[i]), percent)]
        while len(rest):
            j, rest = int(rest[0]), rest[1:]
            if comp[i] == comp[j]:
                continue
            k = overlap(sets[i], sets[j])
            if 100 * k >= percent * (n[i] + n[j] - k):
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
                rest = rest[comp[rest] != comp[i]]
    return out


def _read_set(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // SET_BYTES, 8), dtype=np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, SET_BYTES)
    return np.sort(wide.view(np.uint64).ravel())


def _verifier(percent: int):
    def run(group: pa.Table) -> pa.Table:
        rows: dict[bytes, tuple] = {}
        lead = group.column("leader")[0].as_py()
        for rep, key, label, s in zip(group.column("rep").to_pylist(), group.column("key").to_pylist(), group.column("label").to_pylist(), group.column("set").to_pylist(), strict=True):
            rows[s] = (key != lead, rep, label, s)
        some = sorted(rows.values())
        found = links([_read_set(x[3]) for x in some], [x[2] for x in some], percent) if len(some) > 1 else []
        return pa.table({"a": pa.array([some[i][1] for i, _ in found], pa.int64()), "b": pa.array([some[j][1] for _, j in found], pa.int64())})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third pass: the whole set of each group member, once for each of its groups."""
    for batch in batches:
        for some in slices(batch, "text"):
            sets = shingle_sets(some.column("text"))
            out: list[tuple] = []
            for s, rep, label, key, at in zip(sets, *(some.column(c).to_pylist() for c in ("doc_id", "label", "key", "at")), strict=True):
                if len(s) and key_of(digest(s)) == key:
                    raw = s.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()
                    out += [(x["leader"], x["slice"], rep, key, label, raw) for x in at]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["leader", "slice", "rep", "key", "label", "set"])


def _verified(docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """rows: doc_id, label, key, leader, slice. The links that the groups' whole sets have, as (a, b)."""
    by_doc = rows.groupBy("doc_id", "label", "key").agg(F.collect_set(F.struct("leader", "slice")).alias("at"))
    # The rows are the entries of all lists: their number bounds the bytes.
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    sets = docs.select("doc_id", "text").join(by_doc, "doc_id").mapInArrow(tidied(_sets), "leader long, slice int, rep long, key long, label long, set binary")
    return sets.groupBy("leader", "slice").applyInArrow(_verifier(percent), "a long, b long")


#: The digest's first eight bytes, little-endian: see key_of.
_KEY = "cast(conv(concat(" + ",".join(f"substr(hex(digest),{i},2)" for i in range(15, 0, -2)) + "),16,-10) as long)"


def _slices(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("leader").agg(F.count("*").alias("members")).select("leader", F.expr(f"cast(ceil(members / {SLICE}) as int)").alias("slices"))


def _sliced(grouped: DataFrame, reps: DataFrame) -> DataFrame:
    """Group rows dealt out in slices, the leader in each of them: leader, slices, key, slice and doc_id."""
    sizes = _slices(grouped)
    member = grouped.join(sizes, "leader").select("leader", "slices", F.col("member").alias("key"), F.expr("cast(pmod(xxhash64(member), slices) as int)").alias("slice"))
    lead = sizes.select("leader", "slices", F.col("leader").alias("key"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return member.unionByName(lead).join(reps.select("key", "doc_id"), "key")


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text), and the number of rows with an equal set (n_equal)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stored(docs.mapInArrow(tidied(_first_pass), "doc_id long, n long, digest binary, fine binary, part int, chunk int, counts binary"), folder, "sets")
    sketch = spark.sparkContext.broadcast(_sketch(first))
    rows = first.where("counts is null").select("doc_id", "n", "digest")
    total = rows.agg(F.sum(F.expr(f"n - (n * {percent} + 99) div 100 + 1"))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET)))

    packed = docs.mapInArrow(tidied(_packer(sketch, buckets, percent)), "bucket int, tok binary, place binary, times binary, key binary, n binary, unit binary, point binary")
    grouped = packed.groupBy("bucket").applyInArrow(_grouper(percent), "leader long, member long, block long, tile int, share long")
    grouped = stored(grouped, folder, "groups")
    tiles = grouped.where("leader is null").groupBy("block", "tile", "member").agg(F.max("share").alias("share"))
    grouped = grouped.where("leader is not null").select("leader", "member").distinct()
    points = first.where("fine is not null").select(F.expr(_KEY).alias("member"), "n", "fine")
    if tiles.limit(1).count():
        tiles = tiles.select("block", "tile", F.lit(True).alias("apart"), "member", "share", F.col("member").alias("label"))
        grouped = grouped.unionByName(_tiled(tiles, points, folder, percent)).distinct()
    grouped = stored(grouped, folder, "groups")
    sizes = _slices(grouped)
    together = grouped.unionByName(grouped.select("leader", F.col("leader").alias("member")).distinct()).join(sizes.where("slices = 1").select("leader"), "leader")
    refined = points.join(small(together, BROADCAST_ROWS), "member").groupBy("leader").applyInArrow(_refiner(percent), "leader long, member long")
    grouped = stored(refined.unionByName(grouped.join(sizes.where("slices > 1").select("leader"), "leader")).distinct(), folder, "refined")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_equal"))
    reps = stored(classes.withColumn("key", F.expr(_KEY)), folder, "classes")
    member = stored(_sliced(grouped, reps), folder, "members")
    edges = stored(_verified(docs, member.withColumn("label", F.col("doc_id")), percent), folder, "links")
    labels = components(edges, folder)
    large = member.where("slices > 1").select("leader", "key", "doc_id").distinct()
    if large.limit(1).count():
        for reps_only in (True, False):
            known = labels.withColumnRenamed("node", "doc_id")
            named = large.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
            head = named.where("key = leader").select("leader", F.col("label").alias("main"))
            named = named.join(head, "leader").withColumn("apart", F.col("label") != F.col("main"))
            if reps_only:
                # The first set of each label that is apart, as a group of its own.
                least = named.where("apart").groupBy("leader", "label").agg(F.min("key").alias("member"))
                lead = least.groupBy("leader").agg(F.min("member").alias("lead"))
                again = least.join(lead, "leader").select(F.col("lead").alias("leader"), "member").where("leader <> member").distinct()
            else:
                counts = named.groupBy("leader", "apart").agg(F.expr(f"cast(ceil(count(*) / {TILE}) as int)").alias("tiles"))
                tile = F.expr("cast(pmod(xxhash64(key), tiles) as int) * 2 + cast(apart as int)")
                cut = named.join(counts.where("apart").select("leader").distinct(), "leader").join(counts, ["leader", "apart"])
                cut = cut.select(F.col("leader").alias("block"), tile.alias("tile"), "apart", F.col("key").alias("member"), F.lit(None).cast("long").alias("share"), "label")
                again = _tiled(cut, points, folder, percent).distinct()
            again = stored(again, folder, "again")
            again = stored(_sliced(again, reps), folder, "again").join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
            labels = joined_components(labels, stored(_verified(docs, again, percent), folder, "links"), folder)
    named = reps.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", "n_equal", F.coalesce("label", "doc_id").alias("component_id"))
    out = rows.where("n > 0 and doc_id is not null").join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_equal")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_equal"))
    return out.unionByName(alone)
