"""MinHash near-duplicates: universal minima, banding, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, arrow_map, written
from .graph import link, stars

#: 240 minima in 40 bands of 6: a pair at similarity 0.8 shares no band with
#: probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Words whose hashes a worker keeps.
CACHE = 131_072

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()
CACHES[__name__] = _words.clear


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``.

    A-Z are lower-cased; words are runs without ASCII white space. A text with
    fewer than ``size`` words gives its whole sequence as one shingle; no
    words or no text give an empty array.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = w[: len(w) - k + 1] + np.uint64(k)
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _MIX + w[j : len(w) - k + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    return np.unique(h ^ (h >> np.uint64(29)))


def _coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    draw = lambda: rng.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw()


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each multiply-add hash over the set, blockwise."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 128):
        np.minimum(out, (x[i : i + 128, None] * a + b).min(axis=0), out=out)
    return out


def _describe(size: int, bands: int, rows: int):
    a, b = _coefficients(bands * rows)
    place = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _MIX2

    def run(batch: pa.RecordBatch):
        n, hi, lo, keys = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, size)
            n.append(len(s))
            if not len(s):
                hi.append(None), lo.append(None), keys.append(None)
                continue
            print_ = xxhash.xxh3_128_digest(s.tobytes())
            hi.append(int.from_bytes(print_[:8], "little", signed=True))
            lo.append(int.from_bytes(print_[8:], "little", signed=True))
            m = minima(s, a, b).astype(np.uint64).reshape(bands, rows)
            h = place.copy()
            for j in range(rows):
                h = (h ^ (h >> np.uint64(31))) * _MIX + m[:, j]
            h = (h ^ (h >> np.uint64(32))) * _MIX2
            keys.append(h.view(np.int64))
        yield batch.column("id"), n, hi, lo, pa.array(keys, pa.list_(pa.int64()))

    return run


def _sets(size: int, bands: int, rows: int):
    a, b = _coefficients(bands * rows)

    def run(batch: pa.RecordBatch):
        out = []
        for text in batch.column("text").to_pylist():
            s = shingles(text, size)
            # the low byte of each minimum, then the whole set
            out.append(minima(s, a, b).astype(np.uint8).tobytes() + s.tobytes())
        yield batch.column("id"), out

    return run


def _linked(percent: int, count: int):
    # An estimate from 240 minima has a standard deviation of 0.026 at 0.8; a
    # pair 0.13 below the threshold is refused by its signature alone.
    floor = count * max(0.0, percent / 100 - 0.13)

    def sets(data: list) -> tuple[np.ndarray, list, np.ndarray]:
        prints = np.stack([np.frombuffer(x, np.uint8, count) for x in data])
        own = [np.frombuffer(x, np.uint64, (len(x) - count) // 8, count) for x in data]
        return prints, own, np.array([len(x) for x in own], np.int64)

    def run(left: list, right: list, ask: np.ndarray | None) -> np.ndarray:
        if not left or not right:
            return np.zeros(0 if ask is None else ask.shape, bool)
        if ask is None:
            out = np.zeros(len(left), bool)
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                out[k] = pair(x, y)
            return out
        p, xs, nx = sets(left)
        q, ys, ny = sets(right)
        every, place = np.unique(np.concatenate(ys), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(ny)[:-1]])
        out = np.zeros(ask.shape, bool)
        flags = np.zeros(len(every) + 1, bool)
        for i in range(len(left)):
            maybe = ask[i] & (100 * np.minimum(nx[i], ny) >= percent * np.maximum(nx[i], ny))
            at = np.flatnonzero(maybe)
            at = at[(q[at] == p[i]).sum(axis=1) >= floor]
            if not len(at):
                continue
            spot = np.minimum(np.searchsorted(every, xs[i]), len(every) - 1)
            spot = spot[every[spot] == xs[i]]
            flags[spot] = True
            both = np.add.reduceat(flags[place], starts)[at]
            flags[spot] = False
            out[i, at] = 100 * both >= percent * (nx[i] + ny[at] - both)
        return out

    def pair(x: bytes, y: bytes) -> bool:
        s, t = (len(x) - count) // 8, (len(y) - count) // 8
        if 100 * min(s, t) < percent * max(s, t) or np.count_nonzero(np.frombuffer(x, np.uint8, count) == np.frombuffer(y, np.uint8, count)) < floor:
            return False
        both = len(np.intersect1d(np.frombuffer(x, np.uint64, s, count), np.frombuffer(y, np.uint64, t, count), assume_unique=True))
        return 100 * both >= percent * (s + t - both)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of documents whose shingle sets overlap by ``percent`` or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.
    ``component_id`` is the smallest id reachable over links, ``kept`` tells
    whether it is the row's own.

    Documents with equal sets (128-bit digest) become one class before any
    comparison, so copies are never paired. The classes are banded by their
    minima; candidates are checked by signature and then on the full sets, and
    joined by large-star and small-star (:mod:`quillon.llm.graph`).

    Edge cases: null, empty and white-space texts have ``n_shingles`` 0 and
    link with nothing. A null id links with nothing: its ``component_id`` is
    null and ``kept`` true. Rows that share an id count as one document: their
    links are united. Repeated rows come back as often as they came in. An
    empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    info = written(
        arrow_map(source, _describe(size, bands, rows), "id long, n long, hi long, lo long, keys array<long>"), "signatures"
    )
    classes = written(info.where("hi is not null and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep")), "classes")
    owners = classes.select(F.col("rep").alias("id"), "hi", "lo")
    keyed = info.join(owners, ["id", "hi", "lo"], "left_semi").select("id", "keys")

    def fetch(ids: DataFrame) -> DataFrame:
        return arrow_map(source.join(ids, "id", "left_semi"), _sets(size, bands, rows), "id long, payload binary")

    roots = link(stars(keyed), fetch, _linked(percent, bands * rows))
    # classes meet their components first; then each document joins a table of its own, so that a class of very many copies can be split between tasks
    named = written(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("root", "rep").alias("component")), "components")
    return (
        info.select("id", "n", "hi", "lo")
        .join(named, ["hi", "lo"], "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, **options) -> DataFrame:
    """``docs`` without the rows that are not the first of their class, all columns kept.

    Rows are told apart by ``row_col``, a column of ``docs`` that is unique, not
    null and the same at every reading; without one they are numbered as they
    are written once. So ids may be null or repeat: each row is judged by its own
    text. Of a class the row with the smallest id stays (a null id comes last),
    of equal ids the one with the smallest row number. Rows without words stay.
    """
    source = docs.withColumn("__row", F.col(row_col)) if row_col else written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    named = near_duplicates(source, "__row", text_col, **options).where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id")
    known = written(named.join(source.select("__row", F.col(id_col).cast("long").alias("id")), "__row"), "named")
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("__row").alias("row"))
    # a table of its own, one row for each class, so that a class of very many copies can be split between tasks
    first = written(known.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("first.row").alias("first")), "first")
    gone = known.join(first, "component_id").where("__row <> first").select(F.col("__row").alias("__gone"))
    return source.join(gone, source["__row"] == gone["__gone"], "left_anti").drop("__row")
