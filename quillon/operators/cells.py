"""Cells of a wide table as rows: their state, what may be said of them, agreement of two raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import is_absent
from .derive import _map

#: What stands for no label at all.
EMPTY = "∅"


def unverified_fields(cell: Column) -> Column:
    """Field names of 'C.field; D.other' without their prefix."""
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^[^.]*\.", ""))))


def priority(field: Column) -> Column:
    """G52."""
    return F.when(field.isin(*vocab.HIGH_PRIORITY), "high").when(field.isin(*vocab.LOW_PRIORITY), "low").otherwise("medium")


def state(value: Column, arity: Column) -> Column:
    """Absent or what kind of value; an empty yes-or-no cell is absent."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    truth = F.when(low.isin("true", "1", "yes"), "BOOL_TRUE").when(low.isin("false", "0", "no"), "BOOL_FALSE").otherwise("ABSENCE")
    absent = is_absent(value, "targets") | ((arity == "list") & (low == "[]"))
    return F.when(arity == "bool", truth).when(absent, "ABSENCE").when(arity == "list", "REAL_LIST").otherwise("REAL_SCALAR")


def verdicts(state_column: Column) -> Column:
    """The verdicts allowed in a state."""
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return (
        F.when(state_column == "ABSENCE", words("fills_blank", "confirms_absence", "not_found"))
        .when(state_column == "REAL_LIST", words("appends_extra", "confirms", "contradicts", "not_found"))
        .otherwise(words("confirms", "contradicts", "not_found"))
    )


def targets(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """A row per paper and field; ``fields`` gives each field's arity. No shuffle."""
    long = df.select(key, *[F.col(f).cast("string") for f in fields]).unpivot(key, list(fields), "field", "current_value")
    with_arity = long.withColumn("arity", _map(fields, F.col("field"))).withColumn("state", state(F.col("current_value"), F.col("arity")))
    return with_arity.withColumn("priority", priority(F.col("field"))).withColumn("allowed_verdicts", verdicts(F.col("state")))


def rater_flag(value: Column, human_release: bool = False) -> Column:
    """True and false stay, else whether it starts with yes; data on request are no release."""
    s = _base(value)
    yes = F.when(s.isin("true", "false"), s == "true").otherwise(s.startswith("yes"))
    return F.when(s.rlike(vocab.ON_REQUEST), False).otherwise(s.startswith("yes")) if human_release else yes


def _base(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"(?U)\s+", " ")


def label_set(value: Column, lenient: bool) -> Column:
    """Labels of a cell, sorted, with aliases resolved; a lenient set holds coarser labels."""
    whole = F.coalesce(_map(vocab.WHOLE_ALIAS, _base(value)), _base(value))

    def one(t: Column) -> Column:
        t = F.coalesce(_map(vocab.TOKEN_ALIAS, t), t)
        t = F.when(is_absent(t, "agreement"), EMPTY).otherwise(t)
        return F.coalesce(_map(vocab.COARSE, t), t) if lenient else t

    parts = F.filter(F.transform(F.split(whole, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    out = F.array_sort(F.array_distinct(F.transform(parts, one)))
    return F.when(is_absent(whole, "agreement") | (F.size(parts) == 0), F.array(F.lit(EMPTY))).otherwise(out)


def validation_label(value: Column) -> Column:
    """How data were split for validation, as a set of one."""
    s = _base(value)
    kind = F.when(s.startswith("not reported") | is_absent(s, "agreement"), EMPTY).when(F.contains(s, F.lit("fold")), "k_fold").when(s.rlike(r"split|%|\d+\s*[-/]\s*\d+"), "holdout").otherwise(s)
    return F.array(kind)


def agree(a: Column, b: Column, lenient: bool) -> Column:
    """Equal sets; leniently, sets that share a label or one within the other."""
    if not lenient:
        return F.array_sort(a) == F.array_sort(b)
    return F.arrays_overlap(a, b) | (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def rating_pair(human: Column, other: Column, lenient: bool, one_sided: str = "exclude") -> Column:
    """The labels ``(agreed, a, b)`` that a pair of label sets counts with; null if it does not count.

    Sets that agree count with the other rater's smallest label on both sides,
    sets that do not with the smallest of each. Where one side has no label the
    pair is left out, or agrees with the label there is, or disagrees, as
    ``one_sided`` says: exclude, agree or disagree."""
    if one_sided not in ("exclude", "agree", "disagree"):
        raise ValueError(f"one_sided is {one_sided!r}")
    empty = lambda c: c == F.array(F.lit(EMPTY))
    pair = lambda agreed, a, b: F.struct(F.lit(agreed).alias("agreed"), F.array_min(a).alias("a"), F.array_min(b).alias("b"))
    there = F.when(empty(other), human).otherwise(other)
    alone = {"exclude": F.lit(None), "agree": pair(True, there, there), "disagree": pair(False, human, other)}[one_sided]
    return F.when(empty(human) != empty(other), alone).when(agree(human, other, lenient), pair(True, other, other)).otherwise(pair(False, human, other))
