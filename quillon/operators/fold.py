"""Folds of chunk rows into one value, and overlays of corrections.

A key with a single chunk comes back unchanged from every fold (X16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_union(df: DataFrame, keys: list[str], chunk: str, value: str) -> DataFrame:
    """distinct values in order of first appearance."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, F.lower(F.trim(value)).alias("__n")).agg(F.min(F.struct(chunk, value)).alias("__f"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("__f")), lambda x: x[value]).alias("vals"))


def fold_grade(df: DataFrame, keys: list[str], chunk: str, value: str, grades: list[str]) -> DataFrame:
    """The highest grade, the earliest on ties; unknown grades only if there is no other."""
    table = F.create_map(*[F.lit(x) for i, g in enumerate(grades) for x in (g, i)])
    rank = F.coalesce(F.try_element_at(table, F.col(value)), F.lit(-1))
    return df.groupBy(*keys).agg(F.min_by(value, F.struct((-rank).alias("r"), F.col(chunk).alias("c"))).alias("grade"), (F.count_distinct(F.when(rank >= 0, rank)) > 1).alias("disagreement"))


def fold_bool(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """whether any is true, and whether they differ."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(value), F.lit(False)).alias("any_true"), (F.count_distinct(value) > 1).alias("mixed"))


def fold_scalar(df: DataFrame, keys: list[str], chunk: str, value: str) -> DataFrame:
    """F8: the first value that is not null, and the other values."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.struct(chunk, value))[value].alias("val"), F.collect_set(value).alias("__all"))
    return first.select(*keys, "val", F.array_sort(F.array_except("__all", F.array("val"))).alias("alternates"))


def consolidate(df: DataFrame, keys: list[str], part: str, parts: list[str], value: Column) -> DataFrame:
    """one row per key with a column for each part."""
    return df.groupBy(*keys).pivot(part, parts).agg(value)


def overlay(base: DataFrame, corrections: DataFrame, key: str, value: str, new: str, expected: str | None = None) -> DataFrame:
    """Corrected values with what was replaced; guarded by the expected old value."""
    fixed = corrections.select(F.col(key).alias("__k"), F.col(new).alias("__new"), *([F.col(expected).alias("__old")] if expected else []))
    out = base.join(fixed, base[key] == fixed["__k"], "left")
    hit = F.col("__new").isNotNull() & ((F.col("__old").eqNullSafe(F.col(value))) if expected else F.lit(True))
    return (
        out.withColumn("corrected", F.coalesce(hit, F.lit(False)))
        .withColumn("replaced", F.when(F.col("corrected"), F.col(value)))
        .withColumn(value, F.when(F.col("corrected"), F.col("__new")).otherwise(F.col(value)))
        .drop("__k", "__new", *(["__old"] if expected else []))
    )


def append_distinct(current: Column, decisions: Column) -> Column:
    """Values appended in order, unless the cell has them already in any case."""
    start = F.filter(F.transform(F.split(F.coalesce(current, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    known = lambda xs, v: F.exists(xs, lambda x: F.lower(x) == F.lower(F.trim(v)))
    return F.array_join(F.aggregate(decisions, start, lambda xs, v: F.when(known(xs, v), xs).otherwise(F.concat(xs, F.array(F.trim(v))))), "; ")


def fill_if_empty(current: Column, picked: Column) -> Column:
    """S16, E9."""
    return F.coalesce(F.nullif(F.trim(current), F.lit("")), picked)
