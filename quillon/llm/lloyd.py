"""Centroid clustering: Lloyd's rounds by two trees, one of vectors and one of centroids."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, release, to_arrow, written

#: Vectors of one cover tree, and points of a leaf of each tree.
TILE, LEAF, CENTROID_LEAF = 1024, 48, 2
#: A node is not split if its halved radius would need more than one centre for each so many points.
WORTH = 8
#: Integers up to this size have squared distances that a long holds; up to the second, that a double holds exactly.
LIMIT, EXACT = 1 << 27, 1 << 22


class CoverTree:
    """Points in order of the tree, and its nodes: a range of points, a centre among them, a radius, children.

    The children of a node cover its points within half its radius; their
    centres are farther than that from each other, and the first child keeps the
    node's centre. Where halving takes too many centres the node stays a leaf.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        self.order: list[int] = []
        self.begin, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        if len(x):
            every = np.arange(len(x))
            self._build(x.astype(np.float64), every, 0, np.sqrt(((x - x[0]).astype(np.float64) ** 2).sum(axis=1)), leaf)

    def _build(self, x: np.ndarray, points: np.ndarray, centre: int, distance: np.ndarray, leaf: int) -> int:
        node, radius = len(self.begin), float(distance.max())
        for column, value in ((self.begin, len(self.order)), (self.end, 0), (self.centre, centre), (self.radius, radius), (self.children, [])):
            column.append(value)
        parts = self._cover(x, points, centre, distance, radius / 2) if len(points) > leaf and radius > 0 else None
        if parts:
            self.children[node] = [self._build(x, *part, leaf) for part in parts]
        else:
            self.order.extend(points.tolist())
        self.end[node] = len(self.order)
        return node

    @staticmethod
    def _cover(x: np.ndarray, points: np.ndarray, centre: int, distance: np.ndarray, radius: float) -> list | None:
        parts, most = [], max(4, len(points) // WORTH)
        while len(points):
            near = distance <= radius
            parts.append((points[near], centre, distance[near]))
            points = points[~near]
            if len(points):
                if len(parts) >= most:
                    return None
                centre = int(points[0])
                distance = np.sqrt(((x[points] - x[centre]) ** 2).sum(axis=1))
        return parts


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT:
        # every sum is an integer below 2**53
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(y)), np.int64)
    for j in range(len(y)):
        d = x.astype(np.int64) - y[j].astype(np.int64)
        out[:, j] = (d * d).sum(axis=1)
    return out


def nearest(x: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and squared distance of each point, in the order of ``x``.

    Pairs of a node of vectors and a node of centroids are passed over where the
    distance of their centres less both radii is beyond what some centroid
    guarantees for all vectors of the node. Leaves are compared exactly with the
    centroids that are left for them, leaves with the same ones together.
    """
    centres = x[tree.centre].astype(np.float64)
    to = np.sqrt(np.maximum(0, ((centres[:, None, :] - centroids[over.centre].astype(np.float64)[None]) ** 2).sum(axis=2)))
    slack = 1e-6 + 1e-9 * float(to.max(initial=0.0))
    radius = np.array(over.radius)
    left: dict[tuple, list] = {}
    stack = [(0, [0])]
    while stack:
        v, pairs = stack.pop()
        r, leaf, inner = tree.radius[v], not tree.children[v], True
        while inner:
            bound = min(to[v, c] for c in pairs) + r + slack
            pairs = [c for c in pairs if to[v, c] - r - radius[c] <= bound]
            # the wider side is opened; at a leaf of vectors all centroids are
            wide = {c for c in pairs if over.children[c] and (leaf or radius[c] >= r)}
            inner = bool(wide)
            if inner:
                pairs = [d for c in pairs for d in (over.children[c] if c in wide else [c])]
        if leaf:
            left.setdefault(tuple(sorted(k for c in pairs for k in over.order[over.begin[c] : over.end[c]])), []).append(v)
        else:
            stack.extend((u, pairs) for u in tree.children[v])
    cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    order = np.array(tree.order)
    for numbers, leaves in left.items():
        points = np.concatenate([order[tree.begin[v] : tree.end[v]] for v in leaves])
        d = squared(x[points], centroids[list(numbers)])
        best = d.argmin(axis=1)
        cluster[points], distance[points] = np.array(numbers, np.int32)[best], d[np.arange(len(points)), best]
    return cluster, distance


def _pack(tree: CoverTree) -> list[bytes]:
    child = [c for node in tree.children for c in node]
    parts = (tree.order, tree.begin, tree.end, tree.centre, [len(c) for c in tree.children], child)
    return [b"".join(np.array([len(p), *p], "<i4").tobytes() for p in parts), np.array(tree.radius, "<f8").tobytes()]


def _unpack(numbers: bytes, radius: bytes) -> CoverTree:
    tree, a, parts, at = CoverTree(np.empty((0, 1)), 1), np.frombuffer(numbers, "<i4"), [], 0
    while at < len(a):
        parts.append(a[at + 1 : at + 1 + a[at]].tolist())
        at += 1 + int(a[at])
    tree.order, tree.begin, tree.end, tree.centre, sizes, child = parts
    tree.radius, at = np.frombuffer(radius, "<f8").tolist(), 0
    for n in sizes:
        tree.children.append(child[at : at + n])
        at += n
    return tree


def _usable(vector: Column, dims: int, scale: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LIMIT))
    return (F.size(vector) == dims) & fine


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Vectors of ``dims`` finite components are kept and become the integers
    ``floor(scale * x)``. The first centroids are the ``k`` vectors with the
    smallest sha256 of ``seed:id``; each of ``rounds`` rounds assigns all vectors
    and moves every centroid that has some to the floor of their mean, all in
    exact integers; then they are assigned once more. ``distance`` is squared,
    and the inertias are sums of it over a cluster and over all.

    Tasks cut what they read into tiles and build a cover tree over each, once;
    the tiles are written and serve all rounds. In a round each task walks its
    trees against the tree of the centroids (see :func:`nearest`), which are
    broadcast (``k`` vectors), and gives one sum for each cluster; the sums are
    added by Spark. Nothing else is shuffled, and no group is gathered, so that
    neither a large cluster nor many copies of one vector matter.

    Edge cases: vectors that are null or of another length, or hold null or
    non-finite components, have no row; nor has one with a component beyond
    ``2**27 / scale``, whose squared distances a long need not hold. A null id is
    hashed as an empty one. Of rows with one id each is a vector of its own; for
    the first centroids ties go to the smaller vector. With fewer than ``k``
    vectors there are fewer centroids. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(_usable(F.col("v"), dims, scale))
    packed = "ids array<long>, v binary, numbers binary, radius binary"
    tiled = to_arrow(spark, packed)

    def tiles(batches):
        ids, held = [], []

        def one() -> pa.RecordBatch:
            x = np.concatenate(held)
            x = x.astype(np.int16 if np.abs(x).max() < 1 << 15 else np.int32)
            row = [ids.copy(), x.tobytes(), *_pack(CoverTree(x, LEAF))]
            ids.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, tiled, strict=True)], schema=tiled)

        for batch in batches:
            x = np.floor(np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, dims) * scale).astype(np.int64)
            names = batch.column("vec_id").to_pylist()
            at = 0
            while at < len(x):
                n = min(len(x) - at, tile - len(ids))
                held.append(x[at : at + n]), ids.extend(names[at : at + n])
                at += n
                if len(ids) == tile:
                    yield one()
        if ids:
            yield one()
        release()

    trees = written(source.mapInArrow(tiles, packed), "tiles")
    first = source.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.floor(np.array([r["v"] for r in first], np.float64).reshape(-1, dims) * scale).astype(np.int64)

    def walk(centroids: np.ndarray):
        shared = spark.sparkContext.broadcast(centroids)

        def run(batch: pa.RecordBatch):
            over = CoverTree(shared.value, CENTROID_LEAF)
            for row in batch.to_pylist():
                n = len(row["ids"])
                x = np.frombuffer(row["v"], np.int16 if len(row["v"]) == 2 * n * dims else np.int32).reshape(n, dims).astype(np.int64)
                yield row["ids"], x, *nearest(x, _unpack(row["numbers"], row["radius"]), shared.value, over)

        return run

    def sums(walked, k: int):
        def run(batches):
            n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            for batch in batches:
                for _, x, numbers, _ in walked(batch):
                    n += np.bincount(numbers, minlength=k)
                    np.add.at(total, numbers, x)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])
            release()

        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = trees.mapInArrow(sums(walk(centroids), len(centroids)), "cluster int, n long, total array<long>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dims)]).alias("total"))
        centroids = centroids.copy()
        for r in added.collect():  # one row for each cluster
            centroids[r["cluster"]] = [t // r["n"] for t in r["total"]]
    walked = walk(centroids)

    def assigned(batch: pa.RecordBatch):
        for ids, _, numbers, distance in walked(batch):
            yield ids, numbers, distance

    out = written(arrow_map(trees, assigned, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(inertia.values())
    rows = [(i, d, whole, hashlib.sha256(",".join(str(int(v)) for v in centroids[i]).encode()).hexdigest()) for i, d in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """The same for DuckDB over ``embeddings`` with distinct ids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} as (
  select vec_id, any_value(x.v) as v, min({{'d': cast(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint), 'k': c.k}}) as m
  from kept x cross join centre{r} c group by vec_id)""")
        if r < rounds:
            steps.append(f"""
mean{r} as (
  select k, list((s - ((s % n + n) % n)) // n order by i) as v from (
    select k, i, cast(sum(x) as bigint) as s, count(*) as n from (select m.k as k, unnest(v) as x, generate_subscripts(v, 1) as i from near{r}) group by k, i) group by k),
centre{r + 1} as (select c.k, coalesce(u.v, c.v) as v from centre{r} c left join mean{r} u on u.k = c.k)""")
    return f"""
with kept as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
centre0 as (select row_number() over (order by sha256('2:' || vec_id)) - 1 as k, v from kept order by sha256('2:' || vec_id) limit {k}),{",".join(steps)}
select vec_id, cast(m.k as integer) as cluster, m.d as distance, cast(sum(m.d) over (partition by m.k) as bigint) as cluster_inertia, cast(sum(m.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from near{rounds} join centre{rounds} c on c.k = m.k"""
