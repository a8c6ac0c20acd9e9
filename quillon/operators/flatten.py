"""Nested field entries as flat columns, generated from a registry of fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound


@dataclass(frozen=True)
class Field:
    """A field of the registry: its name, the pass it belongs to, its group, and what it asks for."""

    name: str
    part: str
    group: str = ""
    quote: bool = True
    derived: bool = False
    human: bool = False
    allowed: tuple = ()


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _wrapped(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _list(v: Column) -> Column:
    """An entry as a list of its items: a list's own, else the one, none of a missing one."""
    none = F.array().cast("array<variant>")
    return bound(_kind(v), lambda kind: F.when(kind.startswith("ARRAY"), _get(v, "$", "array<variant>")).when(kind == "VOID", none).otherwise(F.array(v)))


def scalar_text(v: Column) -> Column:
    """A value as text: TRUE and FALSE, a person as 'family, given', a metric as 'name=value', other objects as JSON, nothing as ''."""
    text = lambda path: F.coalesce(_get(v, path, "string"), F.lit(""))
    has = lambda name: _get(v, f"$.{name}").isNotNull()
    person = F.regexp_replace(F.concat(text("$.family"), F.lit(", "), text("$.given")), "^[, ]+|[, ]+$", "")
    thing = F.when(has("family") | has("given"), person).when(has("metric_name"), F.concat(text("$.metric_name"), F.lit("="), text("$.value"))).otherwise(F.to_json(v))
    return bound(
        _kind(v),
        lambda kind: F.when(kind == "VOID", "")
        .when(kind == "BOOLEAN", F.when(_get(v, "$", "boolean"), "TRUE").otherwise("FALSE"))
        .when(kind.startswith("OBJECT"), thing)
        .when(kind.startswith("ARRAY"), F.to_json(v))
        .otherwise(_get(v, "$", "string")),
    )


def unwrapped(entry: Column) -> Column:
    """The values of an entry, each out of its wrapper ``{value, quote}`` if it has one."""
    return F.transform(_list(entry), lambda x: F.when(_wrapped(x), _get(x, "$.value")).otherwise(x))


def first_scalar(entry: Column, lower: bool = True) -> Column:
    """The first value as trimmed text, in lower case unless told otherwise."""
    out = F.trim(F.coalesce(scalar_text(F.try_element_at(unwrapped(entry), F.lit(1))), F.lit("")))
    return F.lower(out) if lower else out


def all_values(entry: Column, sep: str = " ; ") -> Column:
    """All values that are not blank, joined."""
    return F.array_join(F.filter(F.transform(unwrapped(entry), scalar_text), lambda x: F.trim(x) != ""), sep)


def value_set(entry: Column) -> Column:
    """The values in lower case, trimmed, each once, in order."""
    return F.array_distinct(F.filter(F.transform(unwrapped(entry), lambda x: F.lower(F.trim(scalar_text(x)))), lambda x: x != ""))


def value_and_quote(entry: Column) -> tuple[Column, Column]:
    """An entry's values by '; ' and its quotes by ' | '."""
    values = F.filter(F.transform(unwrapped(entry), scalar_text), lambda x: x != "")
    quotes = F.transform(_list(entry), lambda x: F.when(_wrapped(x), scalar_text(_get(x, "$.quote"))))
    return F.array_join(values, "; "), F.array_join(F.filter(quotes, lambda x: F.coalesce(x, F.lit("")) != ""), " | ")


def column_spec(ids: list[str], registry: list[Field]) -> list[tuple[str, str, str]]:
    """C11: (kind, column, field) in order: ids, values with their quotes by pass, human fields with a justification, derived fields."""
    out = [("id", c, c) for c in ids]
    for f in registry:
        if not f.derived and not f.human:
            out.append(("value", f.name, f.name))
            if f.quote:
                out.append(("quote", f"{f.name}_quote", f.name))
    for f in registry:
        if f.human:
            out += [("human", f.name, f.name), ("quote", f"{f.name}_justification", f.name)]
    return out + [("derived", f"{f.name} (derived)", f.name) for f in registry if f.derived]


def value_columns(columns: list[str]) -> dict[str, int]:
    """The place of each column that is no quote; of equal names the first."""
    out: dict[str, int] = {}
    for i, c in enumerate(columns):
        if c and not c.endswith("_quote"):
            out.setdefault(c, i)
    return out


def flattened(df: DataFrame, record: str, ids: list[str], registry: list[Field]) -> DataFrame:
    """One row per record with the columns of :func:`column_spec`, all text.

    ``record`` is a VARIANT: ``passes.<part>.<field>`` for extracted fields,
    ``derived.<field>.value`` for derived ones; human columns are left blank."""
    r, of = F.col(record), {f.name: f for f in registry}
    out = []
    for kind, column, name in column_spec(ids, registry):
        if kind == "id":
            value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        elif kind == "derived":
            value = scalar_text(_get(r, f"$.derived['{name}'].value"))
        elif of[name].human:
            value = F.lit("")
        else:
            entry = _get(r, f"$.passes['{of[name].part}']['{name}']")
            value = bound(entry, (lambda e: value_and_quote(e)[1]) if kind == "quote" else (lambda e: value_and_quote(e)[0]))
        out.append(value.alias(column))
    return df.select(*out)


#: Flags of an entry and the value that raises them.
FLAGS = {"grade_disagreement": ("_grade_disagreement", True), "boolean_nonunanimity": ("_boolean_unanimity", False), "quote_unverified": ("_quote_unverified", True), "image_only": ("_image_only", True)}


def audit_flags(df: DataFrame, record: str, key: str, parts: list[str]) -> DataFrame:
    """What there is to check of each record: ``key``, the most chunks of a pass, whether any was rescued, and
    for each flag the entries ``pass.field`` that raise it, once for each item, in order; contradictions as text."""
    r = F.col(record)
    none = F.create_map().cast("map<string,variant>")
    raised = {}
    for flag, (name, value) in FLAGS.items():

        def of(part: str, name=name, value=value) -> Column:
            fields = F.map_entries(F.coalesce(_get(r, f"$.passes['{part}']", "map<string,variant>"), none))
            hit = lambda x: F.coalesce(_get(x, f"$['{name}']", "boolean") == value, F.lit(False))
            return F.flatten(F.transform(fields, lambda e: F.transform(F.filter(_list(e["value"]), hit), lambda _: F.concat(F.lit(f"{part}."), e["key"]))))

        raised[flag] = F.array_join(F.flatten(F.array(*[of(p) for p in parts])), "; ")
    chunks = F.greatest(F.lit(0), *[F.coalesce(_get(r, f"$.passes['{p}']._meta.n_chunks", "int"), F.when(_get(r, f"$.passes['{p}']").isNotNull(), 1), F.lit(0)) for p in parts])
    rescued = F.array_contains(F.array(*[F.coalesce(_get(r, f"$.passes['{p}']._meta._rescued", "boolean"), F.lit(False)) for p in parts]), True)
    said = lambda c, n: F.coalesce(_get(c, f"$.{n}", "string"), F.lit("None"))
    against = F.transform(F.filter(_list(_get(r, "$.passes.E.contradictions")), _wrapped), lambda c: F.concat(F.lit("["), said(c, "severity"), F.lit("] "), said(c, "field_a"), F.lit(" vs "), said(c, "field_b"), F.lit(": "), said(c, "note")))
    return df.select(key, chunks.alias("n_chunks_any"), rescued.alias("rescued_any"), *[c.alias(n) for n, c in raised.items()], F.array_join(against, " || ").alias("contradictions"))
