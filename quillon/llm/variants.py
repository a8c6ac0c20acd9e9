"""Spelling variants: words one edit apart, found by bands of letter parities."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, release, to_arrow, written
from .linededup import within

#: Code points and occurrences that a word needs.
LEAST_CHARS, LEAST_TIMES = 6, 5
#: How many times a form is more frequent than its variant.
RATIO = 5
#: Runs whose checksum this divides lose a letter.
DROPPED = 199
#: Distinct words that a task counts before it sends them.
TASK_WORDS = 200_000
#: Characters up to which the built-in edit distance is used.
SHORT = 200
#: Words of a key up to which they are compared with each other.
KEY_WORDS = 2000

# The letters a-z by falling frequency, dealt to the bands in turn.
FREQUENT = "etaoinshrdlucmfwypvbgkjqxz"
#: Bit of each letter: number j stands in band j % 3 at place j // 3.
LETTERS = FREQUENT + "".join(map(chr, range(0xC0, 0x100)))
_PLACE = np.zeros(0x100, np.int64)
for _j, _c in enumerate(LETTERS):
    _PLACE[ord(_c)] = _j

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_CHARS},}}")


def masks(words: list[str]) -> np.ndarray:
    """Parities of each word's letters, in three bands of 30 bits."""
    if not words:
        return np.empty((0, 3), np.int64)
    size = np.array([len(w) for w in words])
    place = _PLACE[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    starts = np.cumsum(size) - size
    bit = np.int64(1) << (place // 3)
    return np.stack([np.bitwise_xor.reduceat(np.where(place % 3 == b, bit, 0), starts) for b in range(3)], axis=1)


def words_of(doc_id, text: str) -> Counter:
    """Words of a text with their counts: lower-cased runs of letters, some of which lose a letter.

    Runs of fewer than ``LEAST_CHARS`` letters cannot give a word."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # bytes.lower() changes A-Z only
    for run, n in Counter(_RUN.findall(text.encode("utf-8", "replace").lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROPPED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_CHARS:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of all texts, counted in the tasks before they are shuffled."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "word string, n long"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches):
        held: Counter = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=arrow)
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if text:
                    held.update(words_of(doc_id, text))
                if len(held) >= TASK_WORDS:
                    yield send()
                    held = Counter()
        yield send()
        release()

    return source.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def _masked(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            m = masks(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m[:, b]) for b in range(3))], names=["word", "n", "m0", "m1", "m2"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, m0 long, m1 long, m2 long")


def _keys(length: Column) -> Column:
    """The keys of a word: (role, key).

    A replaced letter (role R on both sides) flips bits in two bands at most, so
    one of the three is equal; an inserted letter (role S the shorter word, X the
    longer) flips one bit, so two are. Words that are one edit apart also share
    the half that the edit is not in, which stands in the key with the length of
    the (shorter) word.
    """
    m, w = [F.col(f"m{b}") for b in range(3)], F.col("word")
    out = []

    def halves(size: Column, skip: int) -> list[Column]:
        h = F.floor(size / 2).cast("int")
        return [F.substring(w, F.lit(1), h), F.substring(w, h + 1 + skip, length)]

    for role, size, skip in (("R", length, 0), ("S", length, 0), ("X", length - 1, 1)):
        for half, part in enumerate(halves(size, skip)):
            for b in range(3):
                equal = [m[b]] if role == "R" else [m[(b + 1) % 3], m[(b + 2) % 3]]
                key = F.xxhash64(F.lit("R" if role == "R" else "I"), size, F.lit(half), part, F.lit(b), *equal)
                out.append(F.struct(F.lit(role).alias("role"), F.lit(half).alias("half"), F.lit(b).alias("band"), key.alias("key")))
    return F.array(*out)


def _sides(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = lambda df, x: df.select(F.col("key"), *[F.col(c).alias(c + x) for c in ("role", "half", "band", "word", "n", "m0", "m1", "m2")])
    return name(keyed.where("role <> 'X'"), "_a"), name(keyed.where("role <> 'S'"), "_b")


def near_pairs(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """``a, na, b, nb``: each pair of words one edit apart, once.

    Words with an equal key are compared in the join itself. A key of more than
    ``key_words`` words is first split by what a word is without one letter,
    which only words one edit apart share, so that no group is compared with
    itself beyond that size and none is cut.

    Tables that grow with the words are shuffled: their files are small beside
    the keys that come of them, and Spark would judge by the files and broadcast
    all keys.
    """
    masked = written(_masked(words), "masks")
    keyed = masked.withColumn("k", F.explode(_keys(F.length("word")))).select("k.*", "word", "n", "m0", "m1", "m2")
    hot = written(keyed.groupBy("key").count().where(F.col("count") > key_words).select("key"), "hot")
    # the built-in distance takes the square of the length: longer words are told apart below
    one = F.when(F.length("word_a") <= SHORT, F.levenshtein("word_a", "word_b", 1) == 1).otherwise(True)
    first_band = [F.col("m0_a") != F.col("m0_b"), F.col("m1_a") != F.col("m1_b")]
    h = F.floor(F.length("word_a") / 2).cast("int")
    # a pair that shares several keys counts at the first one
    replaced = (F.col("role_b") == "R") & (F.col("word_a") < F.col("word_b")) & ((F.col("band_a") == 0) | (first_band[0] & ((F.col("band_a") == 1) | first_band[1])))
    inserted = (F.col("role_b") == "X") & ((F.col("half_a") == 0) | (F.substring("word_a", F.lit(1), h) != F.substring("word_b", F.lit(1), h)))
    fits = F.when(F.col("role_a") == "R", replaced).otherwise(inserted) & (F.col("half_a") == F.col("half_b")) & (F.col("band_a") == F.col("band_b"))
    columns = [F.col("word_a").alias("a"), F.col("n_a").alias("na"), F.col("word_b").alias("b"), F.col("n_b").alias("nb")]
    busy = not hot.isEmpty()
    a, b = _sides(keyed.join(hot, "key", "left_anti") if busy else keyed)
    out = a.join(b.hint("merge"), "key").where(fits & one).select(*columns)
    if not busy:
        return _verified(out)
    w = F.col("word")
    without = F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda p: F.xxhash64(F.when(F.col("role") == "R", p).otherwise(F.lit(-1)), F.concat(F.substring(w, F.lit(1), p), F.substring(w, p + 2, F.length(w)))))
    rest = F.when(F.col("role") == "S", F.array(F.xxhash64(F.lit(-1), w))).otherwise(F.array_distinct(without))
    split = keyed.join(hot, "key", "left_semi").withColumn("key", F.explode(F.transform(rest, lambda r: F.xxhash64(F.col("key"), r))))
    a, b = _sides(split)
    return _verified(out.unionByName(a.join(b.hint("merge"), "key").where(fits & one).select(*columns)))


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        near = [len(a) <= SHORT or within(a, b, 1) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield batch.filter(pa.array(near, pa.bool_())).columns

    return arrow_map(pairs, run, "a string, na long, b string, nb long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms are followed to the last, twice as far in each round."""
    current = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        later = written(current.join(far.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        current = later.select("word", "root")
        if later.where("moved").isEmpty():
            return current


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_times: int = LEAST_TIMES, ratio: int = RATIO, key_words: int = KEY_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word.

    A word is a lower-cased (A-Z only) maximal run of letters of at least
    ``LEAST_CHARS`` code points that occurs ``least_times`` or more (see
    :func:`words_of`). Its form is the word one edit away with the largest count
    (ties: the smallest in code-point order) if that is ``ratio`` times its own;
    its root is what the forms lead to. ``n_near`` counts all words one edit away.

    Words are counted in the tasks, pairs meet by their keys (see
    :func:`near_pairs`), and the rest are aggregates by word.

    Edge cases: a null or empty text has no words; a null id is an empty one in
    the checksum. Repeated rows count each. Very long texts and runs are taken
    whole. An empty table gives no rows. Other columns are ignored.
    """
    words = written(word_counts(docs, id_col, text_col).where(F.col("n") >= least_times), "words")
    pairs = written(near_pairs(words, key_words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    near = written(both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("n"), F.col("b").alias("form"))).alias("best")), "near")
    all_words = words.join(near.hint("merge"), "word", "left").withColumn("is_form", -F.col("best.n") >= ratio * F.col("n"))
    formed = written(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_sql() -> str:
    """The same for DuckDB over ``documents`` with ids that are not null."""
    return rf"""
with recursive crc_table as (
  select i, i as c, 0 as k from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_table where k < 8),
crc as (select list(c order by i) as t from crc_table where k = 8),
run as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as r from documents) where length(r) >= {LEAST_CHARS} group by 1, 2),
bytes as (select *, list_transform(regexp_extract_all(hex(encode(cast(doc_id as varchar) || ':' || w)), '..'), lambda x: cast(('0x' || x) as bigint)) as b from run),
hashed as (
  select w, n, xor(list_reduce(list_prepend(4294967295, b), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) as h from bytes, crc),
word as (
  select w as word, cast(sum(n) as bigint) as n from (
    select case when h % {DROPPED} = 0 then substr(w, 1, cast(h % length(w) as bigint)) || substr(w, cast(h % length(w) as bigint) + 2) else w end as w, n from hashed)
  where length(w) >= {LEAST_CHARS} group by 1 having sum(n) >= {LEAST_TIMES}),
cut as (select distinct word, n, p, substr(word, 1, p) || substr(word, p + 2) as rest from (select word, n, unnest(range(0, length(word))) as p from word)),
pair as (
  select x.word as a, y.word as b, y.n as nb from cut x join cut y on x.p = y.p and x.rest = y.rest and x.word <> y.word
  union select x.word, y.word, y.n from cut x join word y on x.rest = y.word
  union select y.word, x.word, x.n from cut x join word y on x.rest = y.word),
best as (select a, count(*) as n_near, min({{'n': -nb, 'form': b}}) as m from pair group by a),
form as (select word, n, coalesce(n_near, 0) as n_near, case when -m.n >= {RATIO} * n then m.form end as form, case when -m.n >= {RATIO} * n then -m.n end as form_n from word left join best on a = word),
chain as (select word, form as at from form where form is not null union all select chain.word, form.form from chain join form on form.word = chain.at where form.form is not null),
last as (select chain.word, chain.at from chain join form on form.word = chain.at where form.form is null)
select form.word, form.form, coalesce(last.at, form.word) as root, form.n, form.n_near, form.form_n from form left join last on last.word = form.word"""
