"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, release, written

#: Characters of a q-gram; 5 bits of each make a code of at most 60 bits.
Q, SHORT_Q = 12, 8
#: Characters of a passage that must recur (a shorter item must recur whole).
WINDOW = 64
#: Share of a passage's characters that may be edited.
RATE = 0.05
#: Items of fewer characters leave no room for an edit; each must stand as a line of its own.
LEAST = 20
#: Width of a band of diagonals without its overlap.
BAND = 8
#: Characters of benchmark text that are held by a task at a time.
BLOCK_CHARS = 4_000_000
#: Shared q-grams of texts and items that are held at a time, and how far slices of one text overlap.
HITS, OVERLAP = 1_000_000, 4 * WINDOW


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def plan(length: int) -> tuple[int, int, int, int]:
    """Window, edit budget, q and least shared q-grams for an item of a length.

    Strings of w characters within e edits share at least w - q + 1 - q e
    q-grams. Long q-grams serve where that is 1 or more, short ones else."""
    w = min(length, WINDOW)
    e = math.floor(RATE * w)
    q = Q if w - Q + 1 - Q * e >= 1 else SHORT_Q
    return w, e, q, w - q + 1 - q * e


def grams(text: str, q: int = Q) -> np.ndarray:
    """A code of each q-gram, of 12 or 8 characters; equal q-grams have equal codes."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(c) < q:
        return np.empty(0, np.uint64)
    c = (c & np.uint32(31)).astype(np.uint64)
    two = c[:-1] << np.uint64(5) | c[1:]
    four = two[:-2] << np.uint64(10) | two[2:]
    eight = four[:-4] << np.uint64(20) | four[4:]
    return eight if q == SHORT_Q else eight[:-4] << np.uint64(20) | four[8:]


def align(pattern: str, text: str, most: int) -> int | None:
    """Least edits of ``pattern`` against a substring of ``text``, if at most ``most``.

    A band: ``text`` is the place expected plus some characters on either side,
    and a substring may start and end anywhere in it."""
    width = len(text) - len(pattern) + 2 * most + 1
    if width < 1:
        return None
    far = most + 1
    # column d of row i stands for the text position i + d - most
    row = [0 if 0 <= d - most <= len(text) else far for d in range(width)]
    for i, c in enumerate(pattern):
        new, best = [], far
        for d in range(width):
            j = i + d - most  # text index that a diagonal step consumes
            cost = far
            if 0 <= j < len(text):
                cost = row[d] + (text[j] != c)
            if d + 1 < width and row[d + 1] + 1 < cost:  # c is missing in the text
                cost = row[d + 1] + 1
            if d and new[d - 1] + 1 < cost and 0 <= j < len(text):  # text has one more
                cost = new[d - 1] + 1
            if cost > far:
                cost = far
            new.append(cost)
            best = min(best, cost)
        if best > most:
            return None
        row = new
    found = min((row[d] for d in range(width) if 0 <= len(pattern) + d - most <= len(text)), default=far)
    return found if found <= most else None


def begin_of(pattern: str, text: str) -> int:
    """Where the substring of ``text`` with the least edits against ``pattern`` begins; the latest of equal ones.

    Both are read from behind, where the best end is the beginning looked for."""
    row = [0] * (len(text) + 1)
    back = text[::-1]
    for i, c in enumerate(reversed(pattern), 1):
        new = [i]
        for j, t in enumerate(back):
            new.append(min(row[j] + (t != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return len(text) - row.index(min(row))


class Block:
    """A block of benchmark items: long and short ones by q-grams, very short ones as lines."""

    def __init__(self, items: list[tuple[int, str]]):
        planned = [(i, t, *plan(len(t))) for i, t in items if len(t) >= LEAST]
        self.parts = [Index([x for x in planned if x[4] == q], q) for q in (Q, SHORT_Q)]
        self.lines: dict[str, list[int]] = {}
        for i, t in items:
            if 0 < len(t) < LEAST:
                self.lines.setdefault(t, []).append(i)

    def search(self, texts: list):
        """(text number, item id, item start, length, text start, edits) of the longest match of each pair."""
        for part in self.parts:
            yield from part.search(texts)
        if self.lines:
            for k, text in enumerate(texts):
                seen, at = set(), 0
                for line in (text or "").split("\n"):
                    line = normalised(line)
                    for i in self.lines.get(line, ()):
                        if i not in seen:
                            seen.add(i)
                            yield k, i, 0, len(line), at, 0
                    at += len(line) + 1 if line else 0


class Index:
    """The q-grams of some benchmark items."""

    def __init__(self, items: list[tuple], q: int):
        self.items, self.q = items, q
        self.ready = False

    def build(self) -> None:
        codes, starts, at = [], [], 0
        for item in self.items:
            codes.append(grams(item[1], self.q))
            starts.append(at)
            at += len(codes[-1]) + self.q
        self.starts = np.array(starts, np.int64)
        place = np.concatenate([np.arange(len(c)) + s for c, s in zip(codes, starts, strict=True)] or [np.empty(0, np.int64)])
        code = np.concatenate(codes or [np.empty(0, np.uint64)])
        by = np.argsort(code, kind="stable")
        self.place = place[by]
        self.codes, first, self.times = np.unique(code[by], return_index=True, return_counts=True)
        self.first = first
        self.bits = max(16, min(24, int(len(code)).bit_length() + 5))
        self.there = np.zeros(1 << self.bits, bool)
        self.there[self.slot(self.codes)] = True
        self.ready = True

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, texts: list):
        if not self.items:
            return
        if not self.ready:
            self.build()
        for begin, end in chunks(texts):
            docs = [normalised(t) for t in texts[begin:end]]
            joined = "\0".join(docs)
            bounds = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
            code = grams(joined, self.q)
            at = np.flatnonzero(self.there[self.slot(code)]) if len(code) else np.empty(0, np.int64)
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
            same = self.codes[k] == code[at]
            at, k = at[same], k[same]
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + self.q < bounds[doc + 1]
            at, k, doc = at[inside], k[inside], doc[inside]
            best: dict[tuple[int, int], tuple] = {}
            for lo, hi in self._slices(at, doc, self.times[k]):
                n = self.times[k[lo:hi]]
                pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k[lo:hi]], n)
                g, p, d = self.place[pick], np.repeat(at[lo:hi], n), np.repeat(doc[lo:hi], n)
                item = np.searchsorted(self.starts, g, "right") - 1
                self._regions(docs, d, item, p - bounds[d], g - self.starts[item], best)
            for (d, i), (extent, cost, start, at_) in sorted(best.items()):
                yield begin + d, self.items[i][0], -start, extent, -at_, -cost

    @staticmethod
    def _slices(at: np.ndarray, doc: np.ndarray, n: np.ndarray):
        """Ranges of positions with about ``HITS`` hits at most: whole texts, or overlapping stretches of one text."""
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.searchsorted(doc, doc, "right")
        lo = 0
        while lo < len(at):
            hi = int(np.searchsorted(total, total[lo] + HITS, "right")) - 1
            if hi >= len(at):
                yield lo, len(at)
                return
            hi = max(hi, lo + 1)
            first = int(np.searchsorted(doc, doc[hi], "left"))
            if first > lo:  # the texts before the one that does not fit
                yield lo, first
                lo = first
                continue
            stop = int(ends[lo])
            while lo < stop:
                hi = min(stop, max(int(np.searchsorted(total, total[lo] + HITS, "right")) - 1, int(np.searchsorted(at[:stop], at[lo] + 2 * OVERLAP))))
                yield lo, hi
                lo = stop if hi >= stop else int(np.searchsorted(at[:stop], at[hi] - OVERLAP))

    def _regions(self, docs, doc, item, p, g, best):
        if not len(doc):
            return
        edits = np.array([x[3] for x in self.items])
        need = np.array([x[5] for x in self.items])
        diagonal = p - g
        band = diagonal // BAND
        again = diagonal - band * BAND < edits[item]  # the end of the band before, too
        doc, item, p, g, band = (np.concatenate([x, y[again]]) for x, y in ((doc, doc), (item, item), (p, p), (g, g), (band, band - 1)))
        order = np.lexsort((g, band, item, doc))
        doc, item, p, g, band = doc[order], item[order], p[order], g[order], band[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(doc)]]))
        for s, n in zip(first[size >= need[item[first]]], size[size >= need[item[first]]], strict=True):
            d, i = int(doc[s]), int(item[s])
            _, text, w, e, q, t = self.items[i]
            gs, keep = np.unique(g[s : s + n], return_index=True)
            if len(gs) < t:
                continue
            span = gs[t - 1 :] - gs[: len(gs) - t + 1] <= w - q
            if not span.any():
                continue
            found = self._verify(text, docs[d], w, e, q, gs, t, np.flatnonzero(span), int(band[s]))
            if found:
                extent = int(gs[-1]) + q - int(gs[0])
                start, at, cost = found
                ps = p[s : s + n][keep]
                row = (max(extent, w), -cost, -min(start, int(gs[0])), -min(at, int(ps.min())))
                if (d, i) not in best or row > best[d, i]:
                    best[d, i] = row

    @staticmethod
    def _verify(item: str, doc: str, w: int, e: int, q: int, gs, t: int, where, band: int):
        """A window of the item within its edit budget of the text, or None."""
        tried = set()
        for k in where:
            lo = max(0, int(gs[k + t - 1]) + q - w)
            for start in (min(int(gs[k]), len(item) - w), *range(lo, min(int(gs[k]), len(item) - w) + 1)):
                if start in tried:
                    continue
                tried.add(start)
                pattern = item[start : start + w]
                a = max(0, start + band * BAND - e)
                segment = doc[a : start + w + (band + 1) * BAND + 2 * e]
                at = segment.find(pattern)
                if at >= 0:
                    return start, a + at, 0
                cost = align(pattern, segment, e)
                if cost is not None:
                    return start, a + begin_of(pattern, segment), cost
        return None


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents that hold passages of the benchmark, one row per pair.

    ``doc_id, item_id, item_start, n_chars, doc_start, edits``: a window of
    ``WINDOW`` characters of the item (or the whole item, if shorter) recurs in
    the document with at most ``RATE`` of its characters edited, which is one for
    an item of ``LEAST`` characters. A shorter item is found where it is a whole
    line of the document. Texts are compared in lower case with white space
    collapsed. ``n_chars`` is the extent of the shared q-grams around the match,
    at least a window; positions count characters of the compared texts, and
    ``doc_start`` is where the verified window or the first shared q-gram begins;
    ``edits`` are those of the verified window.

    The benchmark is the query set: it is taken in blocks of at most about
    ``block_chars`` characters. Each block is sent to all tasks, which stream the
    documents through it, and is given up before the next one. Nothing of the
    documents is shuffled. A task holds about ``HITS`` shared q-grams at a time.

    Edge cases: null and empty texts and items match nothing; null ids are
    reported as they are; repeated rows of documents are reported each, repeated
    items count once. Of several matches of a pair the longest is reported, then
    the one with fewest edits, then the first. Very long texts are searched
    whole. Empty tables give no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_chars))
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block())

        def run(batch: pa.RecordBatch, shared=shared):
            ids = batch.column("id").to_pylist()
            found = list(shared.value.search(batch.column("text").to_pylist()))
            yield [ids[f[0]] for f in found], *([f[k] for f in found] for k in range(1, 6))

        part = arrow_map(source, run, "doc_id long, item_id long, item_start long, n_chars long, doc_start long, edits long")
        if len(blocks) > 1:
            part = written(part, "passages")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int):
    """Functions that each bring one block of the benchmark to the driver."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).orderBy("item", "text")
        yield lambda rows=rows: Block([(r["item"], normalised(r["text"])) for r in rows.collect()])


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, row_col: str | None = None) -> DataFrame:
    """``docs`` without the rows that hold a passage, all columns kept.

    Each row is judged by its own text, so ids may be null or repeat; other edge
    cases are those of :func:`find`. A benchmark of one block needs no join: rows
    pass through the search with all their columns. For a larger one the rows to
    remove are gathered block by block, told apart by ``row_col`` (unique, not
    null, the same at every reading) or else by a number written with them.
    """
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_chars))
    if len(blocks) > 1:
        source = docs.withColumn("__row", F.col(row_col)) if row_col else written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        gone = find(source, benchmark, "__row", text_col, item_col, item_text_col, block_chars).select(F.col("doc_id").alias("__gone")).distinct()
        return source.join(gone, source["__row"] == gone["__gone"], "left_anti").drop("__row")
    shared = docs.sparkSession.sparkContext.broadcast(blocks[0]())
    n = len(docs.columns)

    def run(batches):
        for batch in batches:
            bad = {f[0] for f in shared.value.search(batch.column(n).to_pylist())}
            kept = batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:n], schema=pa.schema(list(kept.schema)[:n]))
        release()

    return docs.select("*", F.col(text_col).cast("string").alias("__search")).mapInArrow(run, docs.schema)
