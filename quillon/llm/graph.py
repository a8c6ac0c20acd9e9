"""Connected components and exact linking of bucketed candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, release, to_arrow, written

#: Linear rounds at most before all pairs across components are checked, the
#: number of such pairs for each member up to which they are checked at once, and
#: the share of a round's checks that must succeed for another one.
ROUNDS, PER_MEMBER, WORTH = 8, 4, 0.05
#: Bytes of payload in one tile of the last step, and what each member counts besides.
TILE_BYTES, TILE_MEMBER = 4_000_000, 4_000
#: Keys that a task groups before it sends them, and keys of one slice of their range.
TASK_KEYS, SLICE_KEYS = 1 << 21, 1 << 18


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label nodes by alternating large-star and small-star.

    Returns ``(node, root)`` for every node that has an edge to a smaller one;
    ``root`` is the smallest node it reaches. Nodes that are roots or have no
    edges are absent. Null ends and loops are ignored; repeated edges count
    once; no edges give no rows. Each round takes a partially aggregated
    minimum for each node, writes it and joins it back: as the minima are a table
    of their own, a node with very many neighbours can be split between tasks.
    """
    current = written(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct(), "edges"
    )
    seen = _fingerprint(current)
    while seen[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        down = written(large.groupBy("hi").agg(F.min("lo").alias("lo")), "down")
        lower = down.withColumnRenamed("lo", "m")
        small = large.join(lower, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(down).distinct()
        before, current = current, written(small, "edges")
        now = _fingerprint(current)
        discard(before, least, large, down)
        if now == seen:
            break
        seen = now
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first())


def _groups(key: np.ndarray, id_: np.ndarray) -> tuple:
    """Sorted keys with their ids, the first place of each key, and its least and greatest id."""
    order = np.argsort(key)
    key, id_ = key[order], id_[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    if not len(first):
        return key, id_, first, id_, id_
    return key, id_, first, np.minimum.reduceat(id_, first), np.maximum.reduceat(id_, first)


def _shared(key, id_, first, least, most) -> tuple:
    """(key, least id, id) of the keys that two ids or more have, each id once."""
    size = np.diff(np.concatenate([first, [len(key)]]))
    several = np.repeat(least != most, size)
    key, centre, id_ = key[several], np.repeat(least, size)[several], id_[several]
    order = np.lexsort((id_, key))
    key, centre, id_ = key[order], centre[order], id_[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])]) if len(key) else np.empty(0, bool)
    return key[new].view(np.int64), centre[new], id_[new]


def stars(keyed: DataFrame) -> DataFrame:
    """``(bucket, c, id)``: each id with a smaller one, or itself, as centre, for each key that ids share.

    ``keyed(id, keys)`` has a list of 64-bit keys for each id and may repeat rows.
    A task groups its keys before it sends them, so that a key leaves it once,
    with its least id; keys travel as packed slices of their range, whose number
    grows with the input. The ids of a key are thus joined over two levels of
    centres, and no key is gathered with all its ids in one task.
    """
    total = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = max(6, min(20, int(total // SLICE_KEYS).bit_length() + 1))
    shift = np.uint64(64 - bits)
    schema = "part int, keys binary, ids binary, bucket binary, c binary, id binary"
    arrow, out = to_arrow(keyed.sparkSession, schema), "bucket long, c long, id long"

    def packed(held: list) -> pa.RecordBatch:
        g = _groups(*map(np.concatenate, zip(*held, strict=True)))
        key, least = g[0][g[2]], g[3]
        edges = np.searchsorted(key >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(edges))
        rows = [(int(p), key[edges[p] : edges[p + 1]].tobytes(), least[edges[p] : edges[p + 1]].tobytes(), None, None, None) for p in some]
        rows.append((None, None, None, *(x.tobytes() for x in _shared(*g))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column("keys")
            flat = np.asarray(lists.flatten(), np.int64).view(np.uint64)
            held.append((flat, np.repeat(np.asarray(batch.column("id")), np.diff(np.asarray(lists.offsets)))))
            n += len(flat)
            if n >= TASK_KEYS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)
        release()

    sent = written(keyed.where("id is not null and keys is not null").select("id", "keys").mapInArrow(pack, schema), "keys")

    def unpack(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            yield [np.frombuffer(row[x], np.int64) for x in ("bucket", "c", "id")]

    names = to_arrow(keyed.sparkSession, out)

    def gather(t: pa.Table) -> pa.Table:
        key, id_ = (np.frombuffer(b"".join(t.column(x).to_pylist()), kind) for x, kind in (("keys", np.uint64), ("ids", np.int64)))
        return pa.table(list(_shared(*_groups(key, id_))), schema=names)

    within = arrow_map(sent.where("part is null").select("bucket", "c", "id"), unpack, out)
    between = sent.where("part is not null").select("part", "keys", "ids").groupBy("part").applyInArrow(gather, out)
    multi = written(within.unionByName(between).distinct(), "buckets")
    discard(sent)
    return multi


def link(multi: DataFrame, fetch: Callable[[DataFrame], DataFrame], linked: Callable) -> DataFrame:
    """Components of the verified links among all pairs that share a key.

    ``multi(bucket, c, id)`` is what :func:`stars` gives. ``fetch(ids)`` gives
    ``(id, payload)`` for a frame of ids. ``linked(left, right, ask)`` tells
    which pairs of two lists of payloads are linked: ``ask`` is a Boolean matrix
    of the pairs in question, or None for the pairs (0, 0), (1, 1) and so on; the
    answer has its shape (or is a vector). The result is ``(node, root)`` as from
    :func:`connected_components`.

    No bucket is expanded into all its pairs. First each member meets a centre
    of its bucket. While the members of buckets then still lie in
    more than one component, and linear rounds help, each member outside its
    bucket's largest component meets one more member of that, chosen by a hash.
    At last, for each largest component, the members outside it in its buckets
    are compared with it and with each other in tiles of bounded size, small
    components together in one, which return links between components only. Pairs inside a component need no check,
    so the components are those of the complete graph of links.
    """
    payload = written(fetch(multi.select("id").distinct()), "payload")

    def check(batch: pa.RecordBatch):
        chosen = batch.filter(pa.array(linked(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), None), pa.bool_()))
        yield chosen.column("a"), chosen.column("b")

    def verified(pairs: DataFrame) -> DataFrame:
        left = payload.select(F.col("id").alias("a"), F.col("payload").alias("pa"))
        right = payload.select(F.col("id").alias("b"), F.col("payload").alias("pb"))
        return written(arrow_map(pairs.join(right, "b").join(left, "a").select("a", "pa", "b", "pb"), check, "a long, b long"), "links")

    def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
        return connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))

    roots = connected_components(verified(multi.where("c <> id").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()))
    buckets, worth = multi.select("bucket", "id"), True
    for turn in range(ROUNDS + 1):
        labelled = buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
        sizes = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("one"))
        mixed = written(
            sizes.groupBy("bucket")
            .agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.max(F.struct("n", "root", "one")).alias("most"))
            .where("k > 1")
            .select("bucket", "all", F.col("most.root").alias("major"), F.col("most.one.id").alias("c")),
            "major",
        )
        # a bucket within one component is settled for good
        still = written(labelled.join(mixed, "bucket"), "mixed")
        cost = still.agg(F.count("*").alias("members"), F.sum(F.when(F.col("root") != F.col("major"), F.col("all")).otherwise(0)).alias("pairs")).first()
        if not cost["members"]:
            return roots
        if not worth or cost["pairs"] <= PER_MEMBER * cost["members"]:
            break
        pairs = written(still.where("root <> major").select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct(), "pairs")
        more = verified(pairs)
        found = more.count()
        worth = found > WORTH * pairs.count()
        buckets = still.select("bucket", "id")
        if found:
            roots = merged(roots, more)
            if not worth:
                now = roots.withColumnRenamed("node", "id").withColumnRenamed("root", "fresh")
                still = still.drop("root").join(now, "id", "left").withColumn("root", F.coalesce("fresh", "id")).drop("fresh")
        if not worth:
            break
    left = written(still.select("major", "id", "root").distinct(), "left")
    more = written(_across(left, payload, linked), "links")
    return roots if more.isEmpty() else merged(roots, more)


def _across(members: DataFrame, payload: DataFrame, linked: Callable) -> DataFrame:
    """Links ``(a, b)`` between the roots of ``members(major, id, root)`` of a major."""
    rows = written(members.withColumn("outside", F.col("root") != F.col("major")).join(payload, "id"), "across")
    weight = F.length("payload") + TILE_MEMBER
    parts = rows.groupBy("major").agg(
        *[F.ceil(F.sum(F.when(F.col("outside") == x, weight).otherwise(0)) / F.lit(TILE_BYTES)).cast("int").alias(name) for x, name in ((True, "outer"), (False, "inner"))],
        F.sum(weight).alias("weight"),
    )
    parts = written(parts.where("outer > 0"), "parts")
    small = F.col("weight") <= TILE_BYTES
    bins = max(1, -(-int(parts.where(small).agg(F.sum("weight")).first()[0] or 0) // TILE_BYTES))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(root: np.ndarray, x: np.ndarray, y: np.ndarray, data: list) -> np.ndarray:
        ask = root[x][:, None] != root[y][None, :]
        i, j = np.nonzero(linked([data[k] for k in x], [data[k] for k in y], ask) & ask)
        return np.unique(np.stack([root[x][i], root[y][j]], axis=1), axis=0)

    def together(t: pa.Table) -> pa.Table:
        # many components of few members
        t = t.sort_by("major")
        major, root, outside = (t.column(c).to_numpy() for c in ("major", "root", "outside"))
        data, cuts = t.column("payload").to_pylist(), np.flatnonzero(np.diff(major)) + 1
        found = [np.empty((0, 2), np.int64)]
        for begin, end in zip([0, *cuts], [*cuts, len(major)], strict=True):
            every = np.arange(begin, end)
            found.append(links(root, every[outside[begin:end]], every, data))
        edges = np.concatenate(found)
        return pa.table([edges[:, 0], edges[:, 1]], schema=schema)

    rows = rows.join(parts, "major")
    few = rows.where(small).withColumn("bin", F.pmod(F.xxhash64("major"), F.lit(bins))).select("bin", "major", "root", "outside", "payload").groupBy("bin").applyInArrow(together, "a long, b long")
    rows = rows.where(~small).withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("outer")).otherwise(F.greatest("inner", F.lit(1)))).cast("int"))
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    part = F.col("part")
    to = F.when(
        F.col("outside"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.greatest(F.col("inner"), F.lit(1)) - 1), lambda j: place("in", part, j, 0)),
            F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: place("out", F.least(part, j), F.greatest(part, j), 0)),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: place("in", i, part, 1)))
    dealt = rows.withColumn("to", F.explode(to)).select("major", F.col("to.kind").alias("kind"), F.col("to.i").alias("i"), F.col("to.j").alias("j"), F.col("to.side").alias("side"), "part", "root", "payload")
    def compare(t: pa.Table) -> pa.Table:
        root = t.column("root").to_numpy()
        data = t.column("payload").to_pylist()
        if t.column("kind")[0].as_py() == "in":
            side = t.column("side").to_numpy()
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        elif t.column("i")[0].as_py() == t.column("j")[0].as_py():
            x = y = np.arange(len(root))
        else:
            own = t.column("part").to_numpy() == t.column("i")[0].as_py()
            x, y = np.flatnonzero(own), np.flatnonzero(~own)
        if not len(x) or not len(y):
            return pa.table([[], []], schema=schema)
        edges = links(root, x, y, data)
        return pa.table([edges[:, 0], edges[:, 1]], schema=schema)

    return few.unionByName(dealt.groupBy("major", "kind", "i", "j").applyInArrow(compare, "a long, b long"))
