"""Flow of a corpus between its stages: joins with provenance, checks of files, distributions, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_by(df: DataFrame, known: DataFrame, key: str, condition: Column, name: str = "reused") -> DataFrame:
    """Rows that meet a condition and whose key is known, told apart from the rest."""
    hit = known.select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(name, F.coalesce(condition & F.col("__hit"), F.lit(False))).drop("__hit")


def merged_text(base: DataFrame, found: DataFrame, key: str, value: str, valid) -> DataFrame:
    """The base's own text if valid, else the found one if valid, with ``provenance``."""
    rows = base.join(found.select(key, F.col(value).alias("__found")), key, "left")
    own, other = F.coalesce(valid(F.col(value)), F.lit(False)), F.coalesce(valid(F.col("__found")), F.lit(False))
    source = F.when(own, "original").when(other, "recovered").otherwise("none")
    return rows.withColumn("provenance", source).withColumn(value, F.when(own, F.col(value)).when(other, F.col("__found"))).drop("__found")


def candidate_text(rows: DataFrame, key: str, value: str, order: str, longest: bool) -> DataFrame:
    """a key's first text that is not empty, or its longest one, the first of equal ones."""
    some = rows.where(F.coalesce(F.length(value), F.lit(0)) > 0)
    rank = F.struct(F.length(value).alias("n"), (-F.col(order)).alias("o")) if longest else (-F.col(order))
    return some.groupBy(key).agg(F.max_by(F.col(value), rank).alias(value), F.max_by(F.col(order), rank).alias(order))


def upsert(base: DataFrame, updates: DataFrame, dependents: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Updated rows, and the dependents that stay and that are no longer valid."""
    new = updates.select(key, F.col(value).alias("__new"))
    fresh = base.join(new, key, "left").withColumn("updated", F.col("__new").isNotNull()).withColumn(value, F.coalesce("__new", value)).drop("__new")
    return fresh, dependents.join(new, key, "left_anti"), dependents.join(new, key, "left_semi")


def enriched(base: DataFrame, sources: list[tuple[str, DataFrame]], key: str, order: str | None = None) -> DataFrame:
    """Columns of several sources by key, and for each whether it knows the key; no row is lost.

    Of a source's rows with equal keys the first by ``order``, a column of the
    source that is not kept, counts; without one, or where it ties, the smallest row."""
    out = base
    for name, s in sources:
        rest = [c for c in s.columns if c not in (key, order)]
        first = F.struct(*[F.col(c) for c in ([order] if order else [])], *rest, F.lit(True).alias("__any"))
        one = s.groupBy(key).agg(F.min(first).alias("__m")).select(key, *[F.col("__m")[c].alias(c) for c in rest])
        out = out.join(one.withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out


def outcome_diff(before: DataFrame, after: DataFrame, key: str, target: str) -> DataFrame:
    """Each earlier outcome ``(category, confidence)`` with the present one, driven by the earlier."""
    new = after.select(key, F.col("category").alias("new_category"), F.col("confidence").alias("new_confidence"), F.lit(True).alias("__there"))
    rows = before.select(key, F.col("category").alias("old_category"), F.col("confidence").alias("old_confidence")).join(new, key, "left")
    there = F.coalesce("__there", F.lit(False))
    changed = there & ~F.col("old_category").eqNullSafe(F.col("new_category"))
    is_target = lambda c: F.coalesce(F.col(c) == target, F.lit(False))
    return (
        rows.withColumn("changed", changed)
        .withColumn("flip_in", changed & is_target("new_category"))
        .withColumn("flip_out", changed & is_target("old_category"))
        .withColumn("trend", F.when(~there, "missing").when(F.col("old_confidence").eqNullSafe(F.col("new_confidence")), "stable").when((F.col("old_confidence") == "low") & (F.col("new_confidence") == "high"), "up").when((F.col("old_confidence") == "high") & (F.col("new_confidence") == "low"), "down").otherwise("other"))
        .withColumn("new_category", F.when(there, F.col("new_category")).otherwise("(missing)"))
        .drop("__there")
    )


def membership(df: DataFrame, lists: list[tuple[str, Column, DataFrame, str]]) -> DataFrame:
    """``sources``, the names of the lists ``(name, value, table, column)`` that hold a row's value, in order."""
    out, names = df, []
    for i, (name, value, members, column) in enumerate(lists):
        known = members.select(F.col(column).alias(f"__k{i}")).where(f"__k{i} <> ''").distinct().withColumn(f"__m{i}", F.lit(name))
        out = out.withColumn(f"__v{i}", value).join(known, F.col(f"__v{i}") == F.col(f"__k{i}"), "left").drop(f"__v{i}", f"__k{i}")
        names.append(F.col(f"__m{i}"))
    return out.withColumn("sources", F.array_compact(F.array(*names))).drop(*[f"__m{i}" for i in range(len(lists))])


def two_way(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, as ``(key, side)``."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "missing").unionByName(only(right, left, "stray"))


def first_match(found: DataFrame, wanted: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For each key the first of its values that is wanted."""
    return found.join(wanted.select(value).distinct(), value, "left_semi").groupBy(key).agg(F.min_by(value, order).alias(value))


def write_back(rows: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with status and path of their results, and what is still missing."""
    got = results.select(key, F.col("status").alias("__s"), F.col("path").alias("__p"))
    out = rows.join(got, key, "left").withColumn("status", F.coalesce("__s", "status")).withColumn("path", F.coalesce("__p", "path")).drop("__s", "__p")
    return out, out.where("status <> 'retrieved'")


def file_status(rows: DataFrame, source: DataFrame, target: DataFrame, path: str, name: str) -> DataFrame:
    """Whether a file has a path, its source exists, it is already in place."""
    out = rows.join(source.select(F.col("path").alias("__src")).distinct(), F.col(path) == F.col("__src"), "left").join(target.select(F.col("name").alias("__dst")).distinct(), F.col(name) == F.col("__dst"), "left")
    state = F.when(F.col(path).isNull(), "no_path").when(F.col("__dst").isNotNull(), "in_place").when(F.col("__src").isNull(), "source_missing").otherwise("to_copy")
    return out.withColumn("state", state).drop("__src", "__dst")


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """counts of the values of several columns, each on its own, from one pass."""
    sets = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(sets).alias("x")).where("x.value is not null").groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def in_scope(category: Column, confidence: Column, target: str) -> Column:
    """Yes, uncertain or no."""
    hit = F.coalesce(category == target, F.lit(False))
    return F.when(hit & (confidence == "high"), "yes").when(hit & (confidence == "low"), "uncertain").otherwise("no")


def nested_counts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """for each key a map from value to count for each column, in the order of the values."""
    parts = []
    for c in columns:
        counted = df.where(F.col(c).isNotNull()).groupBy(key, F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        parts.append(counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(c)))
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


def buckets(value: Column) -> Column:
    """0, 1-2, 3-5 or 6+."""
    return F.when(value == 0, "0").when(value <= 2, "1-2").when(value <= 5, "3-5").otherwise("6+")


def forward_fill(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value that is not null, up to each row."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def grouped_fields(df: DataFrame, keys: list[str], field: str, order: str) -> DataFrame:
    """The distinct fields of a group, in order of first appearance."""
    first = df.groupBy(*keys, field).agg(F.min(order).alias("__o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", field))), lambda x: x[field]).alias("fields"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """how many rows have something in each column."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in columns])


def merged_verdicts(df: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """One row for equal verdicts, with how often they occur; the first one's other columns stay."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(F.struct(order, *[c for c in keep if c != order])).alias("__f")).select(*keys, "occurrences", *[F.col(f"__f.{c}").alias(c) for c in keep])


def review_flag(field: Column, verdict: Column, value: Column, figure_only: Column, ranges: dict[str, tuple[int, int]], toys: list[str]) -> Column:
    """Why a verdict on a cell needs a look: figures, numbers out of range, control data, contradictions."""
    from ..functions.text import first_int

    n = first_int(value)
    low, high = (F.create_map(*[F.lit(x) for f, r in ranges.items() for x in (f, r[i])]) for i in (0, 1))
    ranged = (verdict == "fills_blank") & field.isin(*ranges)
    return (
        F.when(F.coalesce(figure_only, F.lit(False)), "review:figure_only_unverified")
        .when(ranged & n.isNull(), "review:unparseable_number")
        .when(ranged & ((n < F.try_element_at(low, field)) | (n > F.try_element_at(high, field))), "hold:out_of_range")
        .when(field.isin("dataset_name", "dataset_type") & F.lower(F.trim(value)).isin(*toys), "hold:suspected_control_dataset")
        .when(verdict == "contradicts", "review:extraction_vs_si_disagreement")
        .otherwise("review")
    )


def eligibility(subcategory: Column, reasons: dict[str, str]) -> Column:
    """``(decision, reason)``: include, exclude for a reason, or look at it."""
    why = F.try_element_at(F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]), subcategory)
    out = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))
    return (
        F.when(subcategory.isNull(), out("review_manually", F.lit("missing")))
        .when(subcategory == "other_unresolved", out("review_manually", F.lit("unresolved")))
        .when(why.isNotNull(), out("exclude", why))
        .otherwise(out("include", F.lit("")))
    )


def flagged(df: DataFrame, column: str, value: str, order: str, most: int | None = None) -> DataFrame:
    """Rows whose flag has a value in any case; at most so many if asked, the first ones."""
    out = df.where(F.upper(column) == value.upper())
    return out if most is None else out.orderBy(order).limit(most)


def labelled(value: Column, label: str) -> Column:
    """Whether a list in a cell holds a label."""
    return F.array_contains(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.trim(x)), label)


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, unless any of them breaks the condition: then nothing is written."""
    return df.withColumn("__ok", F.assert_true(condition, message)).where(F.col("__ok").isNull()).drop("__ok")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows either side has alone, counting repeats."""
    mark = lambda df, x: df.withColumn("__x", F.lit(x))
    both = mark(a, 1).unionByName(mark(b, -1)).groupBy(*a.columns).agg(F.sum("__x").alias("x"))
    return both.agg(F.coalesce(F.sum(F.greatest("x", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("x"), F.lit(0))), F.lit(0)).alias("only_right"))


def without(df: DataFrame, key: str, value) -> DataFrame:
    """All rows but those of one key."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def append_absent(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Further rows whose key is not there yet."""
    return df.unionByName(more.join(df.select(key), key, "left_anti").dropDuplicates([key]))


def manifest(plans: DataFrame, passes: list[str], key: str, chunk: str) -> DataFrame:
    """A task for each paper, chunk and pass."""
    return plans.select(key, chunk, F.explode(F.array(*map(F.lit, passes))).alias("pass")).withColumn("task_id", F.concat_ws("_", F.col(key).cast("string"), F.col(chunk).cast("string"), "pass"))


def units(files: DataFrame, key: str, content: str, priority: str, order: str) -> DataFrame:
    """P5: files of a paper, each content once, by priority; ``rank`` counts from 1."""
    hashed = files.withColumn("digest", F.sha1(F.col(content)))
    first = hashed.withColumn("__r", F.row_number().over(W.partitionBy(key, "digest").orderBy(priority, order))).where("__r = 1").drop("__r")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(priority, order, "digest")))


def merge_by_kind(cells: DataFrame, keys: list[str], field: str, chunk: str, value: str, kinds: DataFrame, grades: list[str]) -> DataFrame:
    """Chunks of each field folded as its kind asks: lists united, grades and Booleans by the highest,
    others by the first that is there. ``chunk_id`` is merged, but for papers of one chunk, which stay as they are.

    ``kinds`` has one row for each field and is sent to all tasks: dealt out by field, all cells would go to a few."""
    rank = F.create_map(*[F.lit(x) for i, g in enumerate(grades) for x in (g, i)])
    r = F.coalesce(F.try_element_at(rank, F.col(value)), F.lit(-1))
    rows = cells.join(F.broadcast(kinds), field).where(F.col(value).isNotNull())
    n = cells.groupBy(*keys).agg(F.count_distinct(chunk).alias("__n"))
    first = F.min(F.struct(chunk, value))[value]
    ordered = F.sort_array(F.collect_list(F.struct(chunk, value)))
    union = F.aggregate(ordered, F.array().cast("array<string>"), lambda xs, x: F.when(F.exists(xs, lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x[value]))), xs).otherwise(F.concat(xs, F.array(x[value]))))
    folded = rows.groupBy(*keys, field, "kind").agg(
        F.when(F.first("kind") == "list", F.array_join(union, "; "))
        .when(F.first("kind") == "grade", F.min_by(value, F.struct((-r).alias("r"), F.col(chunk).alias("c"))))
        .when(F.first("kind") == "bool", F.when(F.max(F.col(value) == "true"), "true").otherwise("false"))
        .otherwise(first)
        .alias(value),
        F.min(chunk).cast("string").alias("__chunk"),
    )
    return folded.join(n, keys).withColumn("chunk_id", F.when(F.col("__n") > 1, "merged").otherwise(F.col("__chunk"))).drop("__n", "__chunk", "kind")


def even_pages(df: DataFrame, key: str, text: str, pages: Column) -> DataFrame:
    """A text cut into so many pages of equal length; the last one takes what is left."""
    n, per = F.length(text), F.floor(F.length(text) / pages)
    rows = df.where(pages > 0).select(key, n.alias("__n"), per.alias("__p"), pages.alias("__k"), F.explode(F.sequence(F.lit(1), pages)).alias("page"))
    return rows.select(key, "page", ((F.col("page") - 1) * F.col("__p")).alias("char_start"), F.when(F.col("page") < F.col("__k"), F.col("page") * F.col("__p")).otherwise(F.col("__n")).alias("char_end"))


def file_decision(name: Column, kind: Column, source: Column) -> Column:
    """``(keep, reason)`` of a supplementary file: notebooks, documents of supplements, readme files, settings and
    tables of results stay; everything else goes for a named cause."""
    base, ext = F.lower(F.substring_index(name, "/", -1)), F.regexp_extract(F.lower(name), r"(\.[^./]+)$", 1)
    data, config = base.rlike(r"dataset|train|test|label|annotation"), base.rlike(r"config|hyperparam|settings|params")
    metrics = base.rlike(r"metric|result|performance|score|accuracy")
    out = lambda keep, reason: F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason"))
    return (
        F.when(ext == ".ipynb", out(True, "notebook"))
        .when(kind.isin("pdf", "document") & source.isin("chrome_si", "si", "deposit"), out(True, "si_document"))
        .when(base.rlike(r"^read\W?me"), out(True, "readme"))
        .when((ext.isin(".yaml", ".yml", ".cfg", ".ini", ".toml") | (config & ext.isin(".json", ".py", ".txt", ""))) & (~data | config), out(True, "config"))
        .when((kind == "spreadsheet") & metrics, out(True, "metrics_table"))
        .when(ext.isin(".npy", ".npz", ".mat", ".h5", ".hdf5", ".pkl"), out(False, "array_dump"))
        .when(base.rlike(r"manifest|checksum|md5|sha256"), out(False, "manifest"))
        .when(kind == "spreadsheet", out(False, "dataset_table"))
        .when((kind == "pdf") & (source == "oa"), out(False, "full_text_redundant"))
        .when((kind == "data") & (source == "oa"), out(False, "metadata"))
        .when(kind == "image", out(False, "image"))
        .when(kind == "code", out(False, "bulk_code"))
        .when(kind == "data", out(False, "data_other"))
        .when(kind == "archive", out(False, "archive_container"))
        .otherwise(out(False, "other"))
    )
