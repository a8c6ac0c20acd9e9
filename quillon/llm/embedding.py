"""Embedding near-dedup by PCA-ordered tiled comparison."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, to_arrow, written
from .graph import connected_components

#: Distinct vectors, chosen by a hash of their ids, that the rotation is fitted on.
FIT_ROWS = 4096
#: Bytes of one tile as it travels, and vectors that are compared at a time inside.
TILE_BYTES, INNER = 4_000_000, 512
#: Leading coordinates that bound a tile.
BOX = 4
#: Leading dimensions of the first step; later steps double it.
FIRST = 8


def rotations(sample: np.ndarray) -> np.ndarray:
    """Columns: principal directions of unit vectors, by falling second moment."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def tile_links(x: np.ndarray, y: np.ndarray, turn: np.ndarray | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows with cosine of at least ``threshold``.

    Unit vectors are rotated, so that leading dimensions carry most of the
    product. After each step the rest of a product is at most the product of
    the norms of the suffixes; pairs that cannot reach the threshold stop. What
    is left is decided by the cosine of the given vectors in double precision.
    """
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    u, v = x / nx[:, None], y / ny[:, None]
    if turn is not None:
        u, v = u @ turn, v @ turn
    d = u.shape[1]
    su = np.sqrt(np.maximum(0.0, np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1]))
    sv = np.sqrt(np.maximum(0.0, np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1]))
    slack = threshold - 1e-9
    k = min(FIRST, d)
    part = u[:, :k] @ v[:, :k].T
    bound = part + (np.outer(su[:, k], sv[:, k]) if k < d else 0.0)
    i, j = np.nonzero(bound >= slack)
    left = part[i, j]
    while k < d and len(i):
        more = min(d, 2 * k)
        if len(i) > len(u) * len(v) // 8:  # dense: whole tiles are cheaper than single pairs
            left = left + (u[:, k:more] @ v[:, k:more].T)[i, j]
        else:
            left = left + np.einsum("ij,ij->i", u[i, k:more], v[j, k:more])
        k = more
        ok = left + (su[i, k] * sv[j, k] if k < d else 0.0) >= slack
        i, j, left = i[ok], j[ok], left[ok]
    out = np.zeros((len(x), len(y)), bool)
    for lo in range(0, len(i), 65536):
        a, b = i[lo : lo + 65536], j[lo : lo + 65536]
        cosine = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
        out[a, b] = cosine >= threshold
    return out


def local_roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each vector reaches over the links (i, j)."""
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            return root
        root = new


def _usable(batch: pa.RecordBatch):
    hi, lo = [], []
    for v, label, id_ in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), batch.column("vec_id").to_pylist(), strict=True):
        ok = bool(v) and label is not None and id_ is not None and not any(x is None for x in v)
        if ok:
            a = np.array(v, np.float64) + 0.0  # one zero only
            n = float(np.sqrt(np.sum(a * a)))
            ok = bool(np.isfinite(a).all()) and n > 0 and math.isfinite(n)
        digest = xxhash.xxh3_128_digest(label.encode("utf-8", "replace") + b"\0" + a.tobytes()) if ok else None
        hi.append(int.from_bytes(digest[:8], "little", signed=True) if ok else None)
        lo.append(int.from_bytes(digest[8:], "little", signed=True) if ok else None)
    yield *(batch.column(c) for c in ("vec_id", "label", "embedding")), hi, lo


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", fit_rows: int = FIT_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows link if their labels are equal and their cosine is ``threshold`` or
    more. Equal vectors of a label (128-bit digest) become one class first. The
    classes of a label are cut into tiles of about ``tile_bytes`` along the two
    leading principal directions. Unit vectors within the threshold differ by at
    most ``sqrt(2 - 2 threshold)``, so only tiles whose boxes in the leading
    :data:`BOX` coordinates come that near meet, each pair in a task of its own;
    inside, blocks of :data:`INNER` vectors are passed over by the same bound. A
    vector is thus sent once for each tile that may hold a partner, not for each
    partner, and a small label not at all beyond its own tile. A pair of tiles
    returns sums and local roots, never its pairs. The rotation comes from a
    bounded sample and affects speed only.

    Edge cases: vectors that are null, empty, zero or hold null or non-finite
    components, null labels and null ids link with nothing: ``n_links`` is 0
    and ``component_id`` the row's own id. Vectors of different lengths never
    link. Repeated rows are vectors of their own that link with each other; rows
    that share an id share a component. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    real = "float" if kind == "array<float>" else "double"
    rows = written(
        arrow_map(
            vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{real}>").alias("embedding")),
            _usable,
            f"vec_id long, label string, embedding array<{real}>, hi long, lo long",
        ),
        "vectors",
    )
    classes = written(rows.where("hi is not null").groupBy("hi", "lo").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "classes")
    got = classes.orderBy(F.xxhash64("hi", "lo"), "hi").limit(fit_rows).select("embedding").toArrow().column(0).to_pylist()
    turns: dict[int, np.ndarray] = {}
    for d in {len(v) for v in got}:
        s = np.array([v for v in got if len(v) == d], np.float64)
        turns[d] = rotations(s / np.sqrt((s * s).sum(axis=1, keepdims=True)))
    shared = spark.sparkContext.broadcast(turns)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    dtype = np.float32 if real == "float" else np.float64

    def place(batch: pa.RecordBatch):
        lead, sizes, packed = [], [], []
        for v in batch.column("embedding").to_pylist():
            packed.append(np.array(v, dtype).tobytes())
            a = np.array(v, np.float64)
            a = a / np.sqrt(a @ a)
            t = shared.value.get(len(a))
            x = a @ t[:, :BOX] if t is not None else a[:BOX]
            lead.append(np.pad(x, (0, BOX - len(x))))
            sizes.append(len(a))
        yield *(batch.column(c) for c in ("label", "rep", "copies")), packed, sizes, lead

    kinds = "label string, rep long, copies long, v binary, d int, lead array<double>"
    placed = written(arrow_map(classes.select("label", "rep", "copies", "embedding"), place, kinds), "placed")
    # strips of a label by the first direction, tiles of a strip by the second
    tiles_of = F.ceil(F.count("*") * F.first(F.length("v")) / F.lit(tile_bytes))
    cuts = placed.groupBy("label", "d").agg(F.ceil(F.sqrt(tiles_of)).cast("int").alias("k"), F.percentile_approx(F.col("lead")[0], [i / 256 for i in range(1, 256)], 10000).alias("p"))
    place_of = lambda value, points, k: F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: F.get(points, (F.lit(256) * i / F.greatest(k, F.lit(2))).cast("int") - 1)), lambda q: (k > 1) & (q <= value)))
    strips = written(placed.join(written(cuts.select("label", "d", F.least("k", F.lit(256)).alias("k"), "p"), "cuts"), ["label", "d"]).withColumn("strip", place_of(F.col("lead")[0], F.col("p"), F.col("k"))).drop("k", "p"), "strips")
    cuts = strips.groupBy("label", "d", "strip").agg(F.least(tiles_of, F.lit(256)).cast("int").alias("k"), F.percentile_approx(F.col("lead")[1], [i / 256 for i in range(1, 256)], 10000).alias("p"))
    dealt = strips.join(written(cuts, "cuts"), ["label", "d", "strip"]).withColumn("part", place_of(F.col("lead")[1], F.col("p"), F.col("k"))).drop("k", "p")
    cell = ["label", "d", "strip", "part"]
    bounds = [f(F.col("lead")[i]).alias(f"{n}{i}") for i in range(BOX) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    tiles = dealt.groupBy(*cell).agg(F.ceil(F.sum(F.length("v")) / F.lit(2 * tile_bytes)).cast("int").alias("more"), *bounds)
    # a tile of many equal coordinates is split by a hash
    tiles = written(tiles.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("more") - 1))).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    other = tiles.select(F.col("label"), F.col("d"), F.col("tile").alias("u"), *[F.col(f"{n}{i}").alias(f"{n}{i}_") for i in range(BOX) for n in ("lo", "hi")])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}_") - F.col(f"hi{i}"), F.col(f"lo{i}") - F.col(f"hi{i}_")), F.lit(2.0)) for i in range(1, BOX)), F.pow(F.greatest(F.lit(0.0), F.col("lo0_") - F.col("hi0"), F.col("lo0") - F.col("hi0_")), F.lit(2.0)))
    pairs = tiles.join(other, ["label", "d"]).where((F.col("tile") <= F.col("u")) & (gap <= width * width)).select(F.col("tile").alias("t"), "u")
    pairs = written(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    whole = dealt.join(tiles.select(*cell, "more", "piece", "tile"), cell).where(F.col("piece") == F.pmod(F.xxhash64("rep"), F.col("more"))).select("tile", "rep", "copies", "v", "lead")
    sides = pairs.select(F.col("t").alias("tile"), "pair", F.lit(0).alias("side"), (F.col("t") == F.col("u")).alias("same")).unionByName(pairs.where("t <> u").select(F.col("u").alias("tile"), "pair", F.lit(1).alias("side"), F.lit(False).alias("same")))
    schema = "rep long, links long, root long"
    arrow = to_arrow(spark, schema)

    def compare(t: pa.Table) -> pa.Table:
        rep, copies, side = t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("side").to_numpy()
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), dtype).reshape(len(rep), -1)
        lead = np.stack(t.column("lead").to_pylist())
        turn = shared.value.get(v.shape[1])
        # blocks of neighbours in the first directions
        order = np.lexsort((lead[:, 1], np.floor(lead[:, 0] / width), side))
        rep, copies, side, v, lead = rep[order], copies[order], side[order], v[order], lead[order]
        alone = bool(t.column("same")[0].as_py())
        split = len(rep) if alone else int((side == 0).sum())
        blocks = [[(a, min(a + INNER, end)) for a in range(begin, end, INNER)] for begin, end in ((0, split), (split, len(rep)))]
        if alone:
            blocks[1] = blocks[0]
        box = {b: (lead[b[0] : b[1]].min(axis=0), lead[b[0] : b[1]].max(axis=0)) for b in (*blocks[0], *blocks[1])}
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in blocks[0]:
            for y in blocks[1]:
                if alone and y < x or np.sum(np.maximum(0, np.maximum(box[y][0] - box[x][1], box[x][0] - box[y][1])) ** 2) > width * width:
                    continue
                links = tile_links(v[x[0] : x[1]].astype(np.float64), v[y[0] : y[1]].astype(np.float64), turn, threshold)
                if x == y:
                    links = np.triu(links | links.T, 1)
                i, j = np.nonzero(links)
                left.append(i + x[0]), right.append(j + y[0])
        i, j = np.concatenate(left), np.concatenate(right)
        n = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        root = local_roots(i, j, rep)
        some = n > 0
        return pa.table([rep[some], n[some].astype(np.int64), root[some]], schema=arrow)

    found = written(whole.join(sides, "tile").groupBy("pair").applyInArrow(compare, schema), "links")
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = written(
        classes.select("hi", "lo", "rep", "copies").join(sums, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")),
        "components",
    )
    return (
        rows.select("vec_id", "hi", "lo")
        .join(named, ["hi", "lo"], "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
