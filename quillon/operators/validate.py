"""Validation with error codes, and routing of what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: list[tuple[str, Column]]) -> Column:
    """The codes of the rules that hold, in order; X28: codes, never text of values."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in rules]))


def first_error(rules: list[tuple[str, Column]], ok: str = "ok") -> Column:
    """The first rule that holds."""
    out = F.lit(ok)
    for code, condition in reversed(rules):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out


def long_enough(text: Column, chars: int = 250, words: int = 30) -> Column:
    """Enough characters and enough words between white space."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (F.length(bare) >= chars) & (F.size(F.split(bare, r"(?U)\s+")) >= words)


def extracted_text(text: Column, title: Column, chars: int = 250, words: int = 30, most_alike: float = 0.8) -> Column:
    """The first reason not to take a text that was located in a document: empty, placeholder, too few characters or words, its own title or too much like it; else ok."""
    t, low, name = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z'\-]+"), F.lit(0)))
    both = F.size(F.array_intersect(found(low), found(name)))
    alike = F.try_divide(both, F.size(F.array_union(found(low), found(name))))
    return first_error(
        [
            ("empty", t == ""),
            ("placeholder", low.rlike(r"\babstract\s+(is\s+)?not\s+available\b|\bno\s+abstract(\s+available)?\b|\babstract\s+unavailable\b")),
            (f"chars<{chars}", F.length(t) < chars),
            (f"words<{words}", F.regexp_count(t, F.lit(r"[A-Za-z][A-Za-z'\-]+")) < words),
            ("abstract_is_title", (flat(name) != "") & (F.contains(flat(name), flat(low)) | F.contains(flat(low), flat(name)))),
            (f"title_jaccard>={most_alike:.2f}", (flat(name) != "") & (F.size(found(name)) > 0) & (F.size(found(low)) > 0) & (alike >= most_alike)),
        ]
    )


def histogram(df: DataFrame, column: str = "errors") -> DataFrame:
    """rows by code, without what follows a colon."""
    return df.select(F.explode(column).alias("e")).groupBy(F.substring_index("e", ":", 1).alias("code")).agg(F.count("*").alias("n"))


def route(new: DataFrame, history: DataFrame | None, key: str, errors_column: str = "errors", order: str = "ord") -> DataFrame:
    """Quarantine, duplicate or keep.

    A row is a duplicate if the history has its key or an earlier valid row of
    the same batch does; without a history nothing is."""
    valid = F.size(errors_column) == 0
    if history is None:
        return new.withColumn("route", F.when(valid, "keep").otherwise("quarantine"))
    known = history.select(F.col(key).alias("__known")).distinct()
    first = new.where(valid).groupBy(key).agg(F.min(order).alias("__first")).withColumnRenamed(key, "__key")
    out = new.join(known, new[key] == known["__known"], "left").join(first, new[key] == first["__key"], "left")
    duplicate = F.col("__known").isNotNull() | (F.col(order) > F.col("__first"))
    return out.withColumn("route", F.when(~valid, "quarantine").when(duplicate, "duplicate").otherwise("keep")).drop("__known", "__key", "__first")
