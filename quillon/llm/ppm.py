"""Language-model scoring: prediction by partial matching, and word unigrams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, discard, written

#: Bytes of the longest context.
ORDER = 5
#: Byte sequences and words whose values every task gets, the most frequent ones;
#: the values of all others are joined.
HEAD_CODES, HEAD_WORDS = 1 << 20, 1 << 17
#: Byte that ends a text and stands before its start.
END = 0


def _bytes_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with ``ORDER`` end marks before each text and one after.

    Also the positions to code (all but the leading marks) and how many each
    text has."""
    lead, end = bytes([END]) * ORDER, bytes([END])
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    joined = np.frombuffer(b"".join(lead + r + end for r in raw), np.uint8)
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    at = np.arange(lengths.sum()) + np.repeat(ORDER * np.arange(1, len(raw) + 1), lengths)
    return joined, at, lengths


def _codes(joined: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The longest context and the symbol of each position, a byte each."""
    b = joined.astype(np.uint64)
    code = np.zeros(len(at), np.uint64)
    for k in range(ORDER, -1, -1):
        code = code << np.uint64(8) | b[at - k]
    return code


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _grams(batch: pa.RecordBatch):
    """Longest contexts with their next symbol: how often in training texts (n) and in all (m)."""
    texts, held = batch.column("text").to_pylist(), batch.column("held").to_pylist()
    for kind in (False, True):
        own, parts = [t for t, h in zip(texts, held, strict=True) if h == kind], []
        for begin, end in chunks(own, 2_000_000):
            joined, at, _ = _bytes_of(own[begin:end])
            parts.append(np.unique(_codes(joined, at), return_counts=True))
            if len(parts) >= 8:
                parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
        if parts:
            code, m = _summed(*map(np.concatenate, zip(*parts, strict=True)))
            yield code.astype(np.int64), np.zeros_like(m) if kind else m, m


def _order(code: Column, k: int) -> Column:
    """The last ``k`` bytes of the context and the symbol."""
    return F.pmod(code, F.lit(256 ** (k + 1))) if k < ORDER else code


def code_values(grams: DataFrame) -> DataFrame:
    """``(code, m, value)``: log10 probability of the symbol of each code after its context.

    ``grams(code, n, m)`` are the distinct codes of all texts. The trie is a
    table of edges (context, symbol) with counts for each order, and one of
    nodes; no edge is left out. Escapes are estimated by method C: in a context
    seen T times with D distinct symbols a symbol seen c times has c / (T + D)
    and an escape D / (T + D). After an escape the symbols of the context left
    are excluded. As the symbols of a context are among those of its suffix, what
    is excluded at one level depends only on the context just left: its D, and
    the sum S of the counts that its symbols have in the suffix. A node therefore
    holds T, D and S. Below the empty context the symbols never seen are alike.

    A code seen in training has its value at the longest context. The others go
    down the orders, each by a join with that order's nodes and edges; the two
    shortest orders have at most 256 and 65,536 edges and are broadcast.
    """
    edges = {ORDER: grams.where("n > 0").select("code", "n")}
    for k in range(ORDER - 1, -1, -1):
        edges[k] = written(edges[k + 1].groupBy(_order(F.col("code"), k).alias("code")).agg(F.sum("n").alias("n")), "edges")
    nodes = {}
    for k in range(ORDER + 1):
        e = edges[k].withColumn("ctx", F.expr("code div 256"))
        if k:
            below = edges[k - 1].select(F.col("code").alias("suffix"), F.col("n").alias("s"))
            e = e.withColumn("suffix", _order(F.col("code"), k - 1)).join(F.broadcast(below) if k < 3 else below, "suffix")
        else:
            e = e.withColumn("s", F.lit(0).cast("long"))
        nodes[k] = written(e.groupBy("ctx").agg(F.sum("n").cast("double").alias("T"), F.count("*").cast("double").alias("D"), F.sum("s").cast("double").alias("S")), "nodes")
    seen = grams.where("n > 0").withColumn("ctx", F.expr("code div 256")).join(nodes[ORDER], "ctx").select("code", "m", F.log10(F.col("n") / (F.col("T") + F.col("D"))).alias("value"))
    zero = F.lit(0.0)
    todo = grams.where("n = 0").select("code", "m", F.lit(None).cast("double").alias("value"), zero.alias("escaped"), zero.alias("gone_s"), zero.alias("gone_d"))
    for k in range(ORDER, -1, -1):
        node, edge = nodes[k], edges[k].select(F.col("code").alias("edge"), F.col("n").alias("c"))
        if k < 2:
            node, edge = F.broadcast(node), F.broadcast(edge)
        todo = todo.withColumn("ctx", F.expr(f"(code div 256) % {256**k}L")).join(node, "ctx", "left")
        if k < ORDER:
            todo = todo.withColumn("edge", _order(F.col("code"), k)).join(edge, "edge", "left")
        else:
            todo = todo.withColumn("c", F.lit(None).cast("long"))
        T, D = F.col("T") - F.col("gone_s"), F.col("D") - F.col("gone_d")
        open_ = F.col("value").isNull()
        todo = todo.select(
            "code",
            "m",
            F.when(open_ & F.col("c").isNotNull(), F.col("escaped") + F.log10(F.col("c") / (T + D))).otherwise(F.col("value")).alias("value"),
            F.when(D > 0, F.col("escaped") + F.log10(D / (T + D))).otherwise(F.col("escaped")).alias("escaped"),
            F.coalesce("S", zero).alias("gone_s"),
            F.coalesce("D", zero).alias("gone_d"),
        )
    unseen = todo.select("code", "m", F.coalesce("value", F.col("escaped") - F.log10(F.lit(256.0) - F.col("gone_d"))).alias("value"))
    values = written(seen.unionByName(unseen), "values")
    discard(*edges.values(), *nodes.values())
    return values


def head_of(table: DataFrame, count: str, most: int) -> tuple[int, DataFrame, DataFrame]:
    """The most frequent rows, at most ``most``, by a threshold that all rows determine, and the rest."""
    level = F.floor(F.log2(count) * 4)
    sizes = {int(r[0]): r[1] for r in table.groupBy(level.alias("k")).count().collect()}
    least, size = 10**6, 0
    for k in sorted(sizes, reverse=True):
        if size + sizes[k] > most:
            break
        least, size = k, size + sizes[k]
    return size, table.where(level >= least), table.where(level < least)


class Lookup:
    """Places of keys in a sorted array, by hashing in several steps.

    Keys that meet in a slot go on to the next, smaller table; a slot that is
    empty tells at once that a key is absent."""

    MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.tables = []
        left = np.arange(len(keys))
        for mix in self.MIX:
            if not len(left):
                break
            bits = max(4, int(4 * len(left) - 1).bit_length())
            slot = self.slot(keys[left], mix, bits)
            table = np.zeros(1 << bits, np.int32)
            table[slot[::-1]] = left[::-1] + 1
            self.tables.append((mix, bits, table))
            left = left[table[slot] != left + 1]
        self.rest = keys[left]
        self.rest_at = left

    @staticmethod
    def slot(keys: np.ndarray, mix: int, bits: int) -> np.ndarray:
        return ((keys * np.uint64(mix)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, some = None, keys
        for mix, bits, table in self.tables:
            found = table[self.slot(some, mix, bits)] - 1
            hit = found >= 0
            hit &= self.keys[found] == some
            go = ~hit & (found >= 0)
            if left is None:
                out[hit] = found[hit]
                left = np.flatnonzero(go)
            else:
                out[left[hit]] = found[hit]
                left = left[go]
            some = keys[left]
            if not len(left):
                return out
        if left is not None and len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, some), len(self.rest) - 1)
            hit = self.rest[place] == some
            out[left[hit]] = self.rest_at[place[hit]]
        return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) - 2**63
        return value


_hashes = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, split at ASCII white space)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))


def _word_counts(batch: pa.RecordBatch):
    """Words: how often in training texts (c) and in all (m)."""
    texts, held = batch.column("text").to_pylist(), batch.column("held").to_pylist()
    for kind in (False, True):
        parts = [tokens(t) for t, h in zip(texts, held, strict=True) if h == kind]
        words, m = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
        yield words, np.zeros_like(m) if kind else m, m


def held_out_of(doc_id: Column, modulus: int = 5, remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD_WORDS, head_codes: int = HEAD_CODES) -> DataFrame:
    """Model and unigram scores of every document.

    Learned from the rows with ``crc32(doc_id) % 5 != 1``. Returns ``doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` sums ``log10((c + 0.5) / (N + 0.5 (V + 1)))`` over the words
    and one end mark. ``score`` is the log10 probability of the lower-cased bytes
    and an end under the partial-matching model (:func:`code_values`), which
    depends on nothing but the last bytes and the symbol; so each distinct
    sequence of ``ORDER + 1`` bytes is valued once.

    Counts of words and byte sequences are grouped aggregates over all rows. The
    ``head`` and ``head_codes`` most frequent ones, wherever they occur, are
    looked up in each task; all others are joined, those of a document once each.
    The heads bound what is broadcast and change no score. Words are known by
    64-bit hashes.

    Edge cases: null and empty texts are the end alone. A null id is not held
    out. Rows that share an id are scored each on their own. Very long texts are
    scored whole. Without training rows N is 0 and all symbols are alike. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out_of(F.col(id_col)).alias("held"))
    grams = written(arrow_map(rows.select("text", "held"), _grams, "code long, n long, m long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "grams")
    values = code_values(grams)
    discard(grams)
    words = written(arrow_map(rows.select("text", "held"), _word_counts, "w long, c long, m long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("m").alias("m")), "words")
    facts = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    ends = rows.where(~F.col("held")).count()
    N, V = int(facts[0] or 0) + ends, int(facts[1]) + (1 if ends else 0)
    scale = float(np.log10(N + 0.5 * (V + 1)))
    end_log = float(np.log10(ends + 0.5)) - scale

    def heads(table: DataFrame, key: str, value: str, most: int):
        _, top, rest = head_of(table, "m", most)
        got = top.select(key, value).toArrow().combine_chunks()
        by = np.argsort(got.column(key).to_numpy())
        return spark.sparkContext.broadcast((got.column(key).to_numpy()[by], got.column(value).to_numpy()[by])), rest

    word_head, word_rest = heads(words, "w", "c", head)
    code_head, code_rest = heads(values, "code", "value", head_codes)

    def run(batch: pa.RecordBatch):
        keys, counts = word_head.value
        codes, value = code_head.value
        look = _lookup(codes)
        texts = batch.column("text").to_pylist()
        n, known, base, lm, rare, times, odd, often = [], [], [], [], [], [], [], []
        for begin, end in chunks(texts):
            joined, at, lengths = _bytes_of(texts[begin:end])
            full = _codes(joined, at)
            spot = look.find(full)
            hit = spot >= 0
            total = np.concatenate([[0.0], np.cumsum(np.where(hit, value[spot] if len(value) else 0.0, 0.0))])
            edges = np.concatenate([[0], np.cumsum(lengths)])
            lm.extend(np.diff(total[edges]))
            missed = np.flatnonzero(~hit)
            cuts = np.searchsorted(missed, edges)
            for i in range(end - begin):
                u, k = np.unique(full[missed[cuts[i] : cuts[i + 1]]], return_counts=True)
                odd.append(u.astype(np.int64)), often.append(k)
        for text in texts:
            w = tokens(text)
            n.append(len(w) + 1)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
                hit = keys[at] == w
            else:
                at, hit = np.zeros(len(w), np.int64), np.zeros(len(w), bool)
            c = counts[at[hit]]
            known.append(int((c > 0).sum()) + (1 if ends else 0))
            base.append(float(np.sum(np.log10(c + 0.5) - scale)) + end_log)
            r, k = np.unique(w[~hit], return_counts=True)
            rare.append(r), times.append(k)
        longs = pa.list_(pa.int64())
        yield batch.column("id"), batch.column("held"), n, known, base, lm, *(pa.array(x, longs) for x in (rare, times, odd, often))

    scored = arrow_map(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, rare array<long>, times array<long>, odd array<long>, often array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    zipped = lambda key, count: scored.where(F.size(key) > 0).select("row", F.explode(F.arrays_zip(key, count)).alias("x")).select("row", F.col(f"x.{key}").alias("key"), F.col(f"x.{count}").alias("k"))
    tail = zipped("rare", "times").join(word_rest.select(F.col("w").alias("key"), "c"), "key")
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known"), F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - F.lit(scale))).alias("tail_base"))
    more = zipped("odd", "often").join(code_rest.select(F.col("code").alias("key"), "value"), "key")
    more = more.groupBy("row").agg(F.sum(F.col("k") * F.col("value")).alias("tail_lm"))
    slim = scored.select("doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "row")
    return (
        slim.join(tail, "row", "left")
        .join(more, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(N).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
            (F.col("lm") + F.coalesce("tail_lm", F.lit(0.0))).alias("score"),
        )
    )


_found: list = []


def _lookup(codes: np.ndarray) -> Lookup:
    """The worker's lookup of the head, built once for each broadcast."""
    if not _found or _found[0] is not codes:
        _found[:] = [codes, Lookup(codes.astype(np.uint64))]
    return _found[1]
