"""Line dedup: segment-partition edit join over the lines of all documents."""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, discard, written
from .graph import link, stars

#: Lines of fewer code points (without outer white space) repeat only if they are equal.
NEAR_CHARS = 20
#: Lines of so many words are compared by words, shorter ones by characters.
NEAR_WORDS = 20
#: Characters that may differ between two shorter lines.
CHAR_EDITS = 1
#: Word edits between longer lines: one for each so many words of the shorter line, up to a limit.
WORDS_PER_EDIT, MOST_WORD_EDITS = 20, 3
#: Lines whose keys a task remembers, so that a frequent line sends them once.
REMEMBER = 200_000


def word_edits(words: int) -> int:
    """Word edits that a line of so many words allows."""
    return min(MOST_WORD_EDITS, words // WORDS_PER_EDIT) if words >= NEAR_WORDS else 0


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the ``edits + 1`` nearly even segments of a line."""
    parts = edits + 1
    short, longer = divmod(length, parts)
    sizes = [short] * (parts - longer) + [short + 1] * longer
    out, at = [], 0
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def probes(size: int, edits) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, length) of what a line of ``size`` symbols sends.

    ``edits(length)`` is the budget of an indexed line of that length, which is
    split into one more segment than that. Two lines within the shorter one's
    budget share a key: the shorter one is indexed by its segments, and the
    longer one probes, for each length it may meet, the substrings whose shift
    leaves enough edits on either side.
    """
    out, length = [], size
    while length > 0 and size - length <= MOST_WORD_EDITS:
        most, delta = edits(length), size - length
        if delta <= most and length > most:
            for i, (p, n) in enumerate(segments(length, most)):
                left, right = i, most - i
                for at in range(max(0, p - left, p + delta - right), min(size - n, p + left, p + delta + right) + 1):
                    out.append((length, i, at, n))
        length -= 1
    return out


@functools.lru_cache(maxsize=4096)
def _char_probes(size: int) -> np.ndarray:
    return np.array(probes(size, lambda n: CHAR_EDITS if n >= NEAR_CHARS else -1), np.int64).reshape(-1, 4)


@functools.lru_cache(maxsize=4096)
def _word_probes(size: int) -> np.ndarray:
    return np.array(probes(size, lambda n: word_edits(n) or -1), np.int64).reshape(-1, 4)


#: Bytes between words, and the other white space of Unicode.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A random value of each byte.
_VALUES = np.random.RandomState(11).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all lines, joined, and how many words each line has."""
    joined = "\n".join(lines) + "\n"
    if _ODD.search(joined):
        joined = _ODD.sub(" ", joined)
    b = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    blank = _BLANK[b]
    start = np.flatnonzero(np.concatenate([[True], blank[:-1]]) & ~blank)
    end = np.flatnonzero(blank & ~np.concatenate([[True], blank[:-1]]))
    inside = np.flatnonzero(~blank)
    size = end - start
    place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    power = _powers(_BASE, 1 << int(max(size.max(initial=1), 1)).bit_length())
    h = np.add.reduceat(_VALUES[b[inside]] * power[place], np.cumsum(size) - size) if len(size) else np.empty(0, np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    count = np.diff(np.searchsorted(start, np.concatenate([[0], np.flatnonzero(b == 10) + 1])))
    return h ^ (h >> np.uint64(29)), count


#: An odd multiplier, its inverse modulo 2**64, and a mixer.
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = pow(_BASE, -1, 2**64)


@functools.lru_cache(maxsize=64)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _runs(symbols: np.ndarray, sizes: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sequences of symbols that are joined in one array: (sequence number, key).

    The hash of a run is the difference of two prefix sums of symbols times
    powers of a base, moved back by the base's inverse."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    most = 1 << int(max(sizes, default=1)).bit_length()
    up, down = _powers(_BASE, most), _powers(_INVERSE, most)
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * up[place], dtype=np.uint64)])
    which, out = [], []
    for size in np.unique(sizes):
        probe = table(int(size))
        if not len(probe):
            continue
        rows = np.flatnonzero(sizes == size)
        length, i, at, n = probe.T
        s = starts[rows][:, None]
        h = (total[s + (at + n)] - total[s + at]) * down[at] + ((length * 8 + i).astype(np.uint64) * _MIX)
        h = (h ^ (h >> np.uint64(31))) * _MIX
        out.append((h ^ (h >> np.uint64(29))).ravel())
        which.append(np.repeat(rows, len(probe)))
    return (np.concatenate(which), np.concatenate(out)) if out else (np.empty(0, np.int64), np.empty(0, np.uint64))


def keys_of(lines: list[str]) -> list:
    """For each line the hashes of its segments and of the substrings to probe, by characters and by words."""
    hashes, count = words_of(lines)
    size = np.array([len(x) for x in lines], np.int64)
    short = np.flatnonzero((size >= NEAR_CHARS) & (count <= NEAR_WORDS))  # one blank more may make one word more
    long = np.flatnonzero(count >= NEAR_WORDS)
    letters = np.frombuffer("".join([lines[i] for i in short]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letters = (letters + np.uint64(1)) * np.uint64(_BASE)
    a, x = _runs((letters ^ (letters >> np.uint64(27))) * _MIX, size[short], _char_probes)
    b, y = _runs(hashes[np.repeat(count >= NEAR_WORDS, count)], count[long], _word_probes)
    which, key = np.concatenate([short[a], long[b]]), np.concatenate([x, y ^ np.uint64(1)])
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(lines) + 1))
    key = key[order].view(np.int64)
    return [key[i:j] if j > i else None for i, j in itertools.pairwise(cuts)]


def sketches(lines: list[str]) -> np.ndarray:
    """256 parities of each line's words' counts: a word edit changes two of them at most."""
    out = [np.empty((0, 4), np.uint64)]
    for begin, end in chunks(lines):
        hashes, count = words_of(lines[begin:end])
        cell = np.repeat(np.arange(end - begin), count) * 256 + (hashes >> np.uint64(56)).astype(np.int64)
        odd = np.bincount(cell, minlength=256 * (end - begin)).astype(np.uint8) & 1
        out.append(np.packbits(odd).view(np.uint64).reshape(end - begin, 4))
    return np.concatenate(out)


def alike(s: str, t: str, u: list[str], v: list[str]) -> bool:
    """Whether two lines, with their words, count as the same."""
    few = min(len(u), len(v))
    if few >= NEAR_WORDS:
        return within(u, v, word_edits(few))
    return min(len(s), len(t)) >= NEAR_CHARS and within(s, t, CHAR_EDITS)


def within(s, t, most: int) -> bool:
    """Whether the edit distance of two strings, or lists of words, is at most ``most``.

    Common ends are cut off; the rest goes through a bit-parallel band of
    ``2 * most + 1`` diagonals: bit d of row k tells whether k edits reach
    that diagonal at the current column.
    """
    if abs(len(s) - len(t)) > most:
        return False
    if s == t:
        return True
    n = min(len(s), len(t))
    lo, hi = 0, n
    while lo < hi:  # length of the common start
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if s[:mid] == t[:mid] else (lo, mid - 1)
    begin, lo, hi = lo, 0, n - lo
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if s[len(s) - mid :] == t[len(t) - mid :] else (lo, mid - 1)
    s, t = s[begin : len(s) - lo], t[begin : len(t) - lo]
    if max(len(s), len(t)) <= most:
        return True
    # bit d stands for the diagonal j - i = d - most
    width = (1 << (2 * most + 1)) - 1
    where: dict = {}
    for j, c in enumerate(t):
        where[c] = where.get(c, 0) | 1 << (j + most)
    rows = [0] * (most + 1)
    for k in range(most + 1):  # before any column: k insertions
        rows[k] = ((1 << (k + 1)) - 1) << most & width
    for i, c in enumerate(s):
        match = where.get(c, 0) >> i & width
        before = 0
        new = []
        for k in range(most + 1):
            reach = rows[k] & match
            if k:
                reach |= rows[k - 1]  # substitution
                reach |= rows[k - 1] >> 1  # deletion of c
                reach |= new[k - 1] << 1  # insertion
            new.append(reach & width)
            before |= new[-1]
        rows = new
        if not before:
            return False
    end = len(t) - len(s) + most
    return any(r >> end & 1 for r in rows)


def _lines(least: int):
    seen: set[int] = set()

    def run(batch: pa.RecordBatch):
        ids, numbers, hashes, fresh, new = [], [], [], [], []
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for number, line in enumerate(text.split("\n") if text else ()):
                line = line.strip()
                if len(line) < least:
                    continue
                h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - 2**63
                if h not in seen:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(h)
                    fresh.append(len(ids)), new.append(line)
                ids.append(doc), numbers.append(number), hashes.append(h)
        sent = [None] * len(ids)
        for begin, end in chunks(new):
            for i, k in zip(fresh[begin:end], keys_of(new[begin:end]), strict=True):
                sent[i] = k
        yield ids, numbers, hashes, sent

    return run


def _texts(batch: pa.RecordBatch):
    ids, texts = [], []
    for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
        lines = text.split("\n")
        for x in wanted:
            if x["number"] < len(lines):
                line = lines[x["number"]].strip()
                if xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - 2**63 == x["h"]:
                    ids.append(x["h"]), texts.append(line)
    yield ids, texts


def _linked(left: list, right: list, ask: np.ndarray | None) -> np.ndarray:
    us, vs = [s.split() for s in left], [t.split() for t in right]
    if ask is None:
        return np.array([alike(*x) for x in zip(left, right, us, vs, strict=True)], bool)
    out = np.zeros(ask.shape, bool)
    if out.size <= 64:
        for i, j in zip(*np.nonzero(ask), strict=True):
            out[i, j] = alike(left[i], right[j], us[i], vs[j])
    else:
        chars, words = np.array([len(t) for t in right]), np.array([len(v) for v in vs])
        mine, prints = sketches(left), sketches(right)
        for i, (s, u) in enumerate(zip(left, us, strict=True)):
            near = abs(chars - len(s)) <= CHAR_EDITS
            if len(u) >= NEAR_WORDS:
                near |= abs(words - len(u)) <= MOST_WORD_EDITS
            at = np.flatnonzero(ask[i] & near)
            # a character that is a blank, edited, takes one word and gives two, or the other way round
            few = np.minimum(words[at], len(u))
            most = np.where(few >= NEAR_WORDS, 2 * np.minimum(MOST_WORD_EDITS, few // WORDS_PER_EDIT), 3)
            at = at[np.bitwise_count(prints[at] ^ mine[i]).sum(axis=1) <= most]
            for j in at:
                out[i, j] = alike(s, right[j], u, vs[j])
    return out


def _rebuild(batch: pa.RecordBatch):
    texts, totals, dropped = [], [], []
    for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
        lines = text.split("\n") if text is not None else []
        totals.append(len(lines))
        if gone and lines:
            out = set(gone)
            left = [x for i, x in enumerate(lines) if i not in out]
            dropped.append(len(lines) - len(left))
            texts.append("\n".join(left))
        else:
            dropped.append(0)
            texts.append(text)
    yield batch.column("row"), texts, totals, dropped


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """The lines to remove: ``id`` and ``gone``, an array of line numbers from 0.

    Lines are split at line feeds and compared without outer white space; blank
    lines stay. Equal lines of ``least`` code points or more repeat each other at
    any length. Lines of at least ``NEAR_WORDS`` words do so, too, within one word
    edit for each ``WORDS_PER_EDIT`` words of the shorter one, three at most;
    shorter lines of at least ``NEAR_CHARS`` code points within ``CHAR_EDITS``
    characters. Lines joined by chains of such pairs form a class; its first
    line, by document id and line number, stays and every other one goes.

    A line is known by a 64-bit hash; equal lines therefore meet before any
    comparison, and only one of them is compared.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(arrow_map(source, _lines(least), "id long, number long, h long, sent array<long>"), "lines")
    multi = stars(found.where("sent is not null").select(F.col("h").alias("id"), F.col("sent").alias("keys")))
    lines = written(found.select("id", "number", "h"), "lines")
    discard(found)
    places = written(lines.groupBy("h").agg(F.min(F.struct("id", "number")).alias("at"), F.count("*").alias("k")), "places")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = (
            places.join(ids.select(F.col("id").alias("h")), "h", "left_semi")
            .groupBy(F.col("at.id").alias("id"))
            .agg(F.collect_list(F.struct(F.col("at.number").alias("number"), "h")).alias("wanted"))
        )
        # hashed, as one row for each id is small, so that no text is sorted
        found = arrow_map(source.join(wanted.hint("shuffle_hash"), "id").select("text", "wanted"), _texts, "id long, payload string")
        return found.dropDuplicates(["id"])

    roots = link(multi, fetch, _linked).withColumnRenamed("node", "h")
    known = places.join(roots, "h", "left").select("h", "at", "k", F.coalesce("root", "h").alias("root"))
    first = known.groupBy("root").agg(F.sum("k").alias("all"), F.min("at").alias("first")).where("all > 1").select("root", "first")
    # one row for each repeated line, in a table of its own, so that a line that stands everywhere can be split between tasks
    stays = written(known.join(first, "root").select("h", "first"), "repeated")
    gone = lines.select("id", "number", "h").join(stays, "h").where("id <> first.id or number <> first.number")
    return gone.groupBy("id").agg(F.collect_set("number").alias("gone"))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``docs`` with repeated lines removed from the text (see :func:`repeated_lines`).

    All columns stay, ``text_col`` is rewritten, and ``n_lines`` and
    ``n_removed`` are added (replacing columns of these names).

    Edge cases: a null text has no lines and stays null; an empty text is one
    empty line, which stays. Rows with a null id pass unchanged and take no
    part. Rows that share an id are one document: both keep its first lines and
    lose the same numbers. Very long lines are compared whole. An empty table
    gives no rows.
    """
    gone = repeated_lines(docs, id_col, text_col, least).select(F.col("id").alias("__gone_id"), "gone")
    kept = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    row = F.struct(*[docs[c] for c in kept]).alias("row")
    slim = docs.select(row, docs[id_col].cast("long").alias("__id"), docs[text_col].cast("string").alias("text"))
    # line numbers are few beside the texts: they are hashed, so that no text is sorted
    joined = slim.join(gone.hint("shuffle_hash"), F.col("__id") == F.col("__gone_id"), "left")
    schema = slim.schema["row"].dataType.simpleString()
    out = arrow_map(joined.select("row", "text", "gone"), _rebuild, f"row {schema}, text string, n_lines long, n_removed long")
    columns = {c: F.col("row")[c] for c in kept} | {text_col: F.col("text")}
    return out.select(*[columns[c].alias(c) for c in docs.columns if c in columns], "n_lines", "n_removed")
