"""Record linkage: keyed joins and one best value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ident import canonical_doi
from ..sources.store import materialised


#: Keys whose texts are joined at once where all keys of a locator are listed.
LISTED = 4096


def gathered(links: DataFrame, loc: str, key: str, pos: str, form: str) -> DataFrame:
    """For each locator its first form, ``occurrences``, and all whole-number keys that name it: ``sources``, in
    order, and ``n_sources``.

    Links are counted by key first; keys are joined to texts by ranges and those in order, so that a locator that
    stands everywhere is gathered in few pieces, not link by link."""
    by_key = links.groupBy(loc, key).agg(F.count("*").alias("k"), F.min(F.struct(key, pos, form)).alias("first"))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",")
    parts = by_key.groupBy(loc, F.floor(F.col(key) / LISTED).alias("range")).agg(F.min("first").alias("first"), F.sum("k").alias("k"), F.count(key).alias("n"), part.alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("range", "part")))), lambda x: x["part"])
    sources = F.when(F.sum("n") > 0, F.array_join(listed, ","))
    return parts.groupBy(loc).agg(F.min_by(f"first.{form}", F.when(F.col("n") > 0, F.col("first"))).alias(form), F.sum("k").alias("occurrences"), sources.alias("sources"), F.sum("n").alias("n_sources"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in a total order."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def best_value(df: DataFrame, keys: list[str], value: str, score: Column, order: str) -> DataFrame:
    """The best-scored value of a key; ties go to the first seen."""
    # a column of its own, so that both aggregates share one computation
    scored = df.withColumn("__score", score)
    return scored.groupBy(*keys).agg(F.min_by(F.col(value), F.struct((-F.col("__score")).alias("s"), F.col(order).alias("o"))).alias(value), F.max("__score").alias("score"))


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """F2, X11: the most frequent value of a key; ties go to the larger value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def preserving_merge(reference: DataFrame, sources: DataFrame, key: str, found: str = "found_in_any") -> DataFrame:
    """All reference rows, with the sources' columns and whether any source has the key."""
    return reference.join(sources.withColumn("__hit", F.lit(True)), key, "left").withColumn(found, F.coalesce("__hit", F.lit(False))).drop("__hit")


def cascade(df: DataFrame, candidates: list[tuple[str, Column]], value: str, source: str) -> DataFrame:
    """The first candidate that is not null, and the name of its source."""
    found = F.filter(F.array(*[F.struct(c.alias("v"), F.lit(n).alias("s")) for n, c in candidates]), lambda x: x["v"].isNotNull())
    top = F.try_element_at(found, F.lit(1))
    return df.withColumn(value, top["v"]).withColumn(source, F.coalesce(top["s"], F.lit("none")))


def remaining(all_rows: DataFrame, done: DataFrame, key: str, order: str | list[str], batch: int) -> DataFrame:
    """Rows whose key is not done, numbered in batches of fixed size.

    Rows are numbered in range partitions with an offset for each, so that no
    single task sees all of them."""
    left = all_rows.join(done.select(key).distinct(), key, "left_anti").where(F.col(key).isNotNull())
    return number(left, [order] if isinstance(order, str) else order, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / batch).cast("long")).drop("__n")


def number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of the columns, without one task for all rows.

    Rows are written once, in sorted range partitions; counts and numbers both
    come from that table, so that the offsets of the partitions fit. Rows of
    equal order columns are told apart by where they were read, so that a very
    frequent value is spread over several partitions; their numbers are
    consecutive, in no given order. An empty table gives no rows.
    """
    placed = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    # partition number and place in it, in the bits of one value
    kept = materialised(placed.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition
    offsets = sizes.select("__part", before.alias("__before"))
    return kept.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, (F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1).cast("long")).drop("__part", "__before", "__at")


def fallback_lookup(rows: DataFrame, table: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str, order: str) -> DataFrame:
    """A value by one key, else by another; ``matched_by`` names the key.

    Of the table's rows with equal keys the first by ``order`` counts (equal
    orders: the smallest value)."""
    pick = lambda key, k, v: table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(k)).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("m")).select(k, F.col("m.v").alias(v))
    a, b = pick(first[1], "__a", "__va"), pick(second[1], "__b", "__vb")
    out = rows.join(a, rows[first[0]] == a["__a"], "left").join(b, rows[second[0]] == b["__b"], "left")
    by = F.when(F.col("__a").isNotNull(), first[0]).when(F.col("__b").isNotNull(), second[0]).otherwise("none")
    return out.withColumn(value, F.coalesce("__va", "__vb")).withColumn("matched_by", by).drop("__a", "__va", "__b", "__vb")


def normal_title(title: Column) -> Column:
    """Lower-case letters and digits with one blank between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def matched_by_doi_or_title(rows: DataFrame, table: DataFrame, doi: str, title: str, value: str, order: str, least: int = 30) -> DataFrame:
    """``value`` of the table's entry with the same DOI, else with the same normalised title; ``matched_by`` is doi, title or ''.

    Both have columns ``doi`` and ``title``. Titles of fewer than ``least``
    characters match nothing. Of entries with one DOI or title the first by
    ``order`` counts, of equal orders the smallest value. DOIs are compared in
    canonical form; blank ones match nothing."""
    keyed = table.select(F.nullif(canonical_doi(F.col(doi)), F.lit("")).alias("__doi"), normal_title(F.col(title)).alias("__title"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("__e"))
    first = lambda k: keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("__e").alias(f"{k}_e"))
    asked = rows.withColumn("__doi", F.nullif(canonical_doi(F.col(doi)), F.lit(""))).withColumn("__title", normal_title(F.col(title)))
    titles = first("__title").where(F.length("__title") >= least)
    out = asked.join(first("__doi"), "__doi", "left").join(titles, "__title", "left")
    by = F.when(F.col("__doi_e").isNotNull(), "doi").when(F.col("__title_e").isNotNull(), "title").otherwise("")
    return out.withColumn("matched_by", by).withColumn(value, F.coalesce("__doi_e", "__title_e")["v"]).drop("__doi", "__title", "__doi_e", "__title_e")


def positional_join(left: DataFrame, right: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows joined by position, only for keys with as many rows on both sides."""
    count = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    same = count(left, "__l").join(count(right, "__r"), key).where("__l = __r").select(key)
    return left.join(right, [key, pos]).join(same, key, "left_semi")


def union_first(streams: list[DataFrame], key: str) -> DataFrame:
    """Streams in order; a key's first stream wins, and the smallest of its rows there."""
    all_rows = None
    for i, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(i))
        all_rows = s if all_rows is None else all_rows.unionByName(s, allowMissingColumns=True)
    rest = [c for c in all_rows.columns if c not in (key, "stream")]
    return all_rows.groupBy(key).agg(F.min(F.struct("stream", *rest)).alias("__m")).select(key, "__m.*")


#: Distinct hashes of probes up to which they are sent to every task.
SENT_HASHES = 500_000


def contains_blocked(texts: DataFrame, probes: DataFrame, text_id: str, text: str, probe_id: str, probe: str, words: int = 8) -> DataFrame:
    """Which texts contain which probes, blocked on hashes of word runs.

    A probe is known by its first ``words`` words, or by all if it has fewer,
    which must stand as whole words in the text; a text offers all its runs of
    those lengths. Only pairs with an equal run are tested with ``contains``.
    Where the probes are few (counted first), their hashes are sent to the tasks
    and no run of a text leaves its task without one; else runs are shuffled. An
    empty or null probe is in no text."""

    def run(ws: Column, at: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), F.array_join(F.slice(ws, at, n), " "))

    def runs(c: Column, n: int) -> Column:
        # the outer transform binds the words once for all runs
        some = lambda ws: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: run(ws, i, n))).otherwise(F.array().cast("array<long>"))
        return F.transform(F.array(F.split(c, " ")), some)[0]

    known = probes.where(F.coalesce(F.col(probe), F.lit("")) != "").select(probe_id, probe, F.split(probe, " ").alias("__w")).withColumn("__n", F.least(F.size("__w"), F.lit(words)))
    lengths = sorted(r[0] for r in known.select("__n").distinct().collect())  # ``words`` of them at most
    if not lengths:
        return texts.select(text_id, F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id)).limit(0)
    key = F.lit(None).cast("long")
    for n in lengths:
        key = F.when(F.col("__n") == n, run(F.col("__w"), F.lit(1), n)).otherwise(key)
    p = known.withColumn("__h", key).select(probe_id, probe, "__h")
    few = p.select("__h").distinct().limit(SENT_HASHES + 1).count() <= SENT_HASHES
    # only hashes travel; texts are fetched by id for the pairs that are left
    h = texts.select(text_id, F.explode(F.array_distinct(F.concat(*[runs(F.col(text), n) for n in lengths]))).alias("__h"))
    if few:
        h = h.join(F.broadcast(p.select("__h").distinct()), "__h", "left_semi")
    pairs = h.join(p, "__h").select(text_id, probe_id, probe).distinct()
    return texts.select(text_id, text).join(pairs, text_id).where(F.contains(F.col(text), F.col(probe))).select(text_id, probe_id).distinct()
