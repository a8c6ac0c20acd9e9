"""Corpus statistics: metric registries, cross-tabulations, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def wrapped_sum(c: Column) -> Column:
    """The sum of longs modulo 2**64 as a long: the plain sum wherever that is one, and no error beyond."""
    whole, half = [F.lit(str(n)).cast("decimal(20,0)") for n in (2**64, 2**63)]
    rest = F.pmod(F.sum(c.cast("decimal(20,0)")), whole)
    return F.when(rest < half, rest).otherwise(rest - whole).cast("long")


def registry(df: DataFrame, metrics: dict[str, Column], populations: dict[str, Column]) -> DataFrame:
    """counts of all metrics in all populations from one pass, one row per metric."""
    flat = [F.count_if(m & p).alias(f"{i}_{j}") for i, m in enumerate(metrics.values()) for j, p in enumerate(populations.values())]
    row = df.agg(*flat)
    cells = [F.struct(F.lit(name).alias("metric"), *[F.col(f"{i}_{j}").alias(p) for j, p in enumerate(populations)]) for i, name in enumerate(metrics)]
    return row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


#: Kinds of metrics: which values of a field count. Of ``label`` each label of a list counts once for a row.
METRIC_KINDS = ("rows", "eq", "ne", "in", "not_in", "true", "false", "reported", "absent", "nonempty", "empty", "prefix", "label", "distinct")


def metric_table(df: DataFrame, metrics: DataFrame, populations: dict[str, Column], compare: tuple[str, str] | None = None) -> DataFrame:
    """Metrics that are rows ``(metric, field, kind, argument)`` counted in all populations, one row each.

    Rows of ``df`` become (field, value) cells, which are counted by value in one
    aggregate; metrics then meet the counts of their field. So neither the plan
    nor the passes over ``df`` grow with the number of metrics. Values are
    compared as trimmed text, nulls as ''. The argument of ``in`` and ``not_in``
    is a list by '|'. ``compare`` adds ``delta``, the second population less the
    first. A field that ``df`` lacks, or an unknown kind, is an error."""
    asked = metrics.agg(F.collect_set("field").alias("f"), F.collect_set("kind").alias("k")).first()
    unknown = set(asked["f"]) - set(df.columns) | set(asked["k"]) - set(METRIC_KINDS)
    if unknown:
        raise ValueError(f"no such field or kind: {sorted(unknown)}")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cell = lambda c, form, v: F.struct(F.lit(c).alias("field"), F.lit(form).alias("form"), v.alias("value"))
    as_label = lambda c: lambda x: cell(c, "label", x)
    fields = sorted(asked["f"])
    cells = [F.array(*[cell(c, "value", text(c)) for c in fields])] if fields else [F.array().cast("array<struct<field:string,form:string,value:string>>")]
    listed = sorted(r["field"] for r in metrics.where("kind = 'label'").select("field").distinct().collect())
    for c in listed:
        labels = F.array_distinct(F.filter(F.transform(F.split(text(c), ";"), lambda x: F.trim(x)), lambda x: x != ""))
        cells.append(F.transform(labels, as_label(c)))
    names = list(populations)
    marked = df.select(*[F.coalesce(p, F.lit(False)).alias(f"__{i}") for i, p in enumerate(populations.values())], F.explode(F.concat(*cells)).alias("c"))
    counts = marked.groupBy("c.field", "c.form", "c.value").agg(*[F.count_if(f"__{i}").alias(f"__{i}") for i in range(len(names))])
    value, low, a = F.col("value"), F.lower("value"), F.coalesce(F.col("argument"), F.lit(""))
    absent = low.isin(*vocab.ABSENCE["statistics"])
    tests = {
        "rows": F.lit(True), "eq": value == a, "ne": value != a, "in": F.array_contains(F.split(a, r"\|"), value), "not_in": ~F.array_contains(F.split(a, r"\|"), value),
        "true": low == "true", "false": low == "false", "reported": ~absent, "absent": absent, "nonempty": value != "", "empty": value == "", "prefix": value.startswith(a), "label": value == a, "distinct": F.lit(True),
    }
    hit = F.lit(False)
    for kind, test in tests.items():
        hit = F.when(F.col("kind") == kind, test).otherwise(hit)
    form = F.when(F.col("kind") == "label", "label").otherwise("value")
    joined = metrics.withColumn("form", form).join(counts, ["field", "form"], "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    total = lambda i: F.when(F.first("kind") == "distinct", F.count_if(F.col("hit") & (F.col(f"__{i}") > 0))).otherwise(F.sum(F.when(F.col("hit"), F.col(f"__{i}")).otherwise(0)))
    out = joined.groupBy("metric").agg(*[total(i).cast("long").alias(n) for i, n in enumerate(names)])
    return out.withColumn("delta", F.col(compare[1]) - F.col(compare[0])) if compare else out


def crosstab(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Counts on fixed axes; totals take in values beyond the axis."""
    some = df.where(F.col(row).isin(*rows))
    return some.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(f"n_{c}") for c in columns], F.count("*").alias("total"))


def k_of_n(df: DataFrame, criteria: list[Column]) -> DataFrame:
    """how many rows meet all, at least two, and any of the criteria."""
    met = reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in criteria])
    return df.agg(F.count_if(met == len(criteria)).alias("all_of"), F.count_if(met >= 2).alias("two_or_more"), F.count_if(met >= 1).alias("any_of"))


def cohen(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Observed and expected agreement and kappa for each key; kappa is null where undefined."""
    joint = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    total = joint.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreed"))
    left = joint.groupBy(*keys, F.col(a).alias("v")).agg(F.sum("n").alias("x"))
    right = joint.groupBy(*keys, F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    chance = left.join(right, [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = total.join(chance, keys, "left") if keys else total.join(F.broadcast(chance))
    pe = F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.withColumn("po", F.col("agreed") / F.col("n")).withColumn("pe", pe).withColumn("kappa", F.try_divide(F.col("po") - F.col("pe"), F.nullif(1 - F.col("pe"), F.lit(0.0)))).select(*keys, "n", "po", "pe", "kappa")


def composite(fields: DataFrame) -> DataFrame:
    """Expected agreement weighted by the share of cells."""
    po, pe = F.sum(F.col("po") * F.col("n")) / F.sum("n"), F.sum(F.col("pe") * F.col("n")) / F.sum("n")
    return fields.agg(F.sum("n").alias("n"), po.alias("po"), pe.alias("pe")).withColumn("kappa", F.try_divide(F.col("po") - F.col("pe"), F.nullif(1 - F.col("pe"), F.lit(0.0))))


def transitions(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """counts of each state and the next one of the same key."""
    from pyspark.sql import Window as W

    return df.withColumn("next", F.lead(state).over(W.partitionBy(key).orderBy(*order))).where("next is not null").groupBy(state, "next").agg(F.count("*").alias("n"))
