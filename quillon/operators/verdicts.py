"""Rules for verdicts and extracted cells: error codes, routes, rescue, overlays of whole passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from .validate import errors


def flat(value: Column) -> Column:
    """The form in which quotes and sources are compared: lower case, one blank for white space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), vocab.WHITE + "+", " "))


def _category_errors(part: Column, name: str, title: Column, abstract: Column) -> list[tuple[str, Column]]:
    field, quote = part["evidence_field"], part["evidence_quote"]
    source = F.when(field == "title", title).when(field == "abstract", abstract)
    missing = F.coalesce(quote, F.lit("")) == ""
    return [
        (f"{name}_category_invalid", ~F.coalesce(part["category"].isin(*vocab.CATEGORIES), F.lit(False))),
        (f"{name}_evidence_field_invalid", ~F.coalesce(field.isin(*vocab.EVIDENCE_FIELDS), F.lit(False))),
        (f"{name}_evidence_quote_missing", missing),
        (f"{name}_evidence_quote_not_in_source", ~missing & ~F.coalesce((flat(quote) != "") & F.contains(flat(source), flat(quote)), F.lit(False))),
    ]


def screening_errors(v: Column, title: Column, abstract: Column, known: Column) -> Column:
    """The error codes of a screening verdict, in the order of the rules.

    ``v`` has ``record_id, primary, secondary`` (each ``category, evidence_quote,
    evidence_field``), ``secondary_other`` (something else than an object stands
    there), ``confidence, reasoning, flags, parse_error``. A verdict that cannot
    be read, has no id or an unknown one has that error alone. A flag that excuses
    it from grounding leaves the category and the confidence to be checked."""
    primary, secondary = v["primary"], v["secondary"]
    there = primary.isNotNull()
    sure = F.coalesce(v["confidence"].isin(*vocab.CONFIDENCE), F.lit(False))
    guard = lambda rules, cond: [(code, cond & holds) for code, holds in rules]
    second = secondary.isNotNull()
    rules = [("missing_or_invalid_primary", ~there), *guard(_category_errors(primary, "primary", title, abstract), there)]
    own = guard(_category_errors(secondary, "secondary", title, abstract), second)
    own.insert(1, ("secondary_equals_primary", second & there & secondary["category"].eqNullSafe(primary["category"])))
    rules += [("secondary_invalid_type", ~second & F.coalesce(v["secondary_other"], F.lit(False))), *own]
    rules += [("confidence_invalid", ~sure), ("reasoning_missing", v["reasoning"].isNull())]
    excused = F.coalesce(F.arrays_overlap(v["flags"], F.array(*map(F.lit, vocab.ESCAPE_FLAGS))), F.lit(False))
    lone = lambda code: F.array(F.lit(code))
    valid = F.coalesce(primary["category"].isin(*vocab.CATEGORIES), F.lit(False))
    return (
        F.when(v["parse_error"].isNotNull(), lone("parse_error_line"))
        .when(F.coalesce(v["record_id"], F.lit("")) == "", lone("missing_record_id"))
        .when(~F.coalesce(known, F.lit(False)), lone("record_id_not_in_corpus"))
        .when(excused & ~there, lone("flagged_but_missing_primary"))
        .when(excused & ~valid, lone("flagged_but_invalid_category"))
        .when(excused & ~sure, lone("flagged_but_invalid_confidence"))
        .when(excused, F.array().cast("array<string>"))
        .otherwise(errors(rules))
    )


def subscreen_errors(v: Column, source: Column, known: Column) -> Column:
    """The error codes of a second-screening verdict, given as VARIANT.

    Both answers must be Booleans, the outcome must be theirs together, and each
    positive answer needs a quote from the title or the abstract."""
    get = lambda key, kind="string": F.try_variant_get(v, f"$.{key}", kind)
    is_bool = lambda key: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "BOOLEAN", F.lit(False))
    keys = F.json_object_keys(F.to_json(v))
    missing = F.array_except(F.array(*map(F.lit, vocab.SUBSCREEN_KEYS)), keys)
    a, b = "ionising_modality_present", "quantum_sensing_in_ionising_context"
    outcome = F.coalesce(get("verdict").isin(vocab.PROMOTE, vocab.STAY), F.lit(False))
    checked = is_bool(a) & is_bool(b) & outcome
    both = get(a, "boolean") & get(b, "boolean")
    loose = lambda flag, quote: known & is_bool(flag) & get(flag, "boolean") & ~((flat(get(quote)) != "") & F.contains(flat(source), flat(get(quote))))
    found = errors(
        [
            ("verdict_invalid", ~outcome),
            ("confidence_invalid", ~F.coalesce(get("confidence").isin(*vocab.CONFIDENCE), F.lit(False))),
            (f"{a}_not_bool", ~is_bool(a)),
            (f"{b}_not_bool", ~is_bool(b)),
            ("verdict_inconsistent_with_booleans_should_promote", checked & both & (get("verdict") != vocab.PROMOTE)),
            ("verdict_inconsistent_with_booleans_should_stay", checked & ~both & (get("verdict") != vocab.STAY)),
            ("ionising_modality_quote_not_in_source", loose(a, "ionising_modality_quote")),
            ("context_quote_not_in_source", loose(b, "context_quote")),
            ("record_id_not_in_batch", ~known),
        ]
    )
    lists = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing_keys:"), F.array_join(F.array_sort(missing), ",")))).otherwise(F.array().cast("array<string>"))
    return F.when(v.isNull(), F.array(F.lit("not_a_json_object"))).otherwise(F.concat(lists, found))


def value_error(kind: Column, value: Column, allowed: Column, low: Column, high: Column) -> Column:
    """What is wrong with a VARIANT value of a declared type; null if nothing is.

    Absent values pass for lists of choices; a Boolean is no integer, but 0 and 1
    pass for Booleans."""
    shape = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    absent = value.isNull() | (shape == "VOID") | ((shape == "STRING") & text.is_absent(as_text, "validator"))
    number = F.try_variant_get(value, "$", "long")
    whole = F.coalesce(shape == "BIGINT", F.lit(False))
    chosen = absent | F.coalesce((shape == "STRING") & F.array_contains(allowed, as_text), F.lit(False)) | (F.size(F.coalesce(allowed, F.array().cast("array<string>"))) == 0)
    truth = F.coalesce((shape == "BOOLEAN") | (whole & number.isin(0, 1)), F.lit(False))
    return (
        F.when((kind == "enum") & ~chosen, "enum_violation")
        .when((kind == "multi_enum") & ~chosen, "multi_enum_member_violation")
        .when((kind == "bool") & ~truth, "bool_violation")
        .when((kind == "int") & ~whole, "int_violation")
        .when((kind == "int_range") & ~whole, "int_range_type")
        .when((kind == "int_range") & (number < low), "int_below_min")
        .when((kind == "int_range") & (number > high), "int_above_max")
    )


def cell_errors(cells: DataFrame, registry: DataFrame, sources: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """``cells(key, field, pos, value, quote, image_only)`` with an ``error``, null if there is none.

    A value of the wrong type is that error. Else, where the field needs a quote
    and the value is present, the quote must stand in the whole source
    ``sources(key, text)``. Strictly, nothing comes from an image only, a missing
    quote has its own code, and a quote that is not found may be rescued
    (``rescued`` names how). ``registry(field, kind, allowed, low, high,
    requires_quote, derived)`` is a small table that is sent to all tasks; derived fields are not checked."""
    spec = registry.where("not coalesce(derived, false)")
    # dealt out by field, all cells would go to a few tasks
    rows = cells.join(F.broadcast(spec), "field").join(sources.select(key, "text"), key, "left")
    wrong = value_error(F.col("kind"), F.col("value"), F.col("allowed"), F.col("low"), F.col("high"))
    as_text = F.try_variant_get("value", "$", "string")
    absent = F.col("value").isNull() | text.is_absent(F.lower(as_text), "refill" if strict else "validator")
    needs = F.col("requires_quote") & ~absent
    found = (flat(F.col("quote")) != "") & F.contains(flat(F.col("text")), flat(F.col("quote")))
    no_quote = text.is_absent(F.col("quote"), "validator")
    image = F.coalesce(F.col("image_only"), F.lit(False))
    rows = rows.withColumn("__wrong", wrong).withColumn("__found", found)
    if not strict:
        out = F.when(F.col("__wrong").isNotNull(), F.col("__wrong")).when(needs & ~image & (no_quote | ~F.col("__found")), "quote_not_in_source")
        return rows.withColumn("error", out).select(*cells.columns, "error")
    rows = rows.withColumn("__rescue", F.when(needs & ~no_quote & ~F.col("__found"), text.rescue_quote(as_text, F.col("quote"), F.col("text"))))
    out = (
        F.when(F.col("__wrong").isNotNull(), F.col("__wrong"))
        .when(needs & image, "image_only_not_allowed")
        .when(needs & no_quote, "missing_quote_for_positive")
        .when(needs & ~F.col("__found") & F.col("__rescue").isNull(), "quote_not_in_source")
    )
    rows = rows.withColumn("error", out).withColumn("rescued", F.when(F.col("error").isNull(), F.col("__rescue.kind")))
    return rows.select(*cells.columns, "error", "rescued")


def conditional_errors(cells: DataFrame, rules: list[tuple[str, str, str]], key: str, enabled: bool = False) -> DataFrame:
    """``key, field`` of fields that are required but absent; off unless asked for.

    A rule is (field, field of the condition, value). The value ``not_none`` means
    any present value but none; a condition ``<field>_contains_other`` means that
    one of that field's values is other."""
    if not enabled:
        return cells.select(key, "field").limit(0)
    per = cells.groupBy(key).agg(F.collect_set(F.struct("field", "value")).alias("cells"))

    def some(field: str, test) -> Column:
        return F.coalesce(F.exists("cells", lambda c: (c["field"] == field) & test(c["value"])), F.lit(False))

    present = lambda v: ~text.is_absent(v, "validator")
    found = []
    for field, condition, wanted in rules:
        if condition.endswith("_contains_other"):
            met = some(condition.removesuffix("_contains_other"), lambda v: v == "other")
        elif wanted == "not_none":
            met = some(condition, present)
        else:
            met = _equals(condition, wanted, some)
        found.append(F.when(met & ~some(field, present), F.lit(field)))
    return per.select(key, F.explode(F.array_compact(F.array(*found))).alias("field"))


def _equals(condition: str, wanted: str, some) -> Column:
    return some(condition, lambda v: v == wanted)


def pass_route(codes: Column, rescued: Column) -> Column:
    """Accepted, rescued or quarantined; errors of structure are never rescued."""
    structural = F.exists(codes, lambda e: ~F.contains(e, F.lit("quote_not_in_source")))
    return F.when(F.size(codes) == 0, "accepted").when(structural, "quarantine_structural").when(rescued, "rescued").otherwise("quarantine_quote")


def list_error(value: Column, key: str = "contradictions") -> Column:
    """Whether a record's member is missing or no list."""
    return ~F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")).startswith("ARRAY"), F.lit(False))


def disposition(status: Column, has_record: Column, category: Column) -> Column:
    """What becomes of a quarantined verdict: taken back as it is, with its field corrected or its quote
    marked, screened again, or left unmatched."""
    return (
        F.when(~has_record, "unmatched")
        .when(~F.coalesce(category.isin(*vocab.CATEGORIES), F.lit(False)), "requeue")
        .when(status == "verbatim", "rescued")
        .when(status.isin("verbatim_other_field", "relaxed_other_field"), "rescued_field_corrected")
        .when(status == "relaxed", "rescued_relaxed")
        .otherwise("requeue")
    )


def revalidated(rows: DataFrame, codes: str = "errors") -> tuple[DataFrame, DataFrame]:
    """What stays and what goes to quarantine when all is validated anew."""
    return rows.where(F.size(codes) == 0), rows.where(F.size(codes) > 0)


def progress(tasks: DataFrame, replies: DataFrame, done: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Tasks, replies, done and pending by ``by``; a task is known by ``keys``."""
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = tasks.join(mark(replies, "__replied"), keys, "left").join(mark(done, "__done"), keys, "left")
    return rows.groupBy(*by).agg(
        F.count("*").alias("tasks"), F.count_if(F.col("__replied")).alias("replies"), F.count_if(F.col("__done")).alias("done"), F.count_if(F.col("__done").isNull()).alias("pending")
    )


def replace_passes(base: DataFrame, refills: DataFrame, quarantined: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Whole passes replaced by their refills, unless any chunk of the refill is in quarantine; ``replaced`` tells."""
    good = refills.join(quarantined.select(*keys).distinct(), keys, "left_anti").select(*keys, *[F.col(c).alias(f"__{c}") for c in columns]).withColumn("__hit", F.lit(True))
    out = base.join(good, keys, "left").withColumn("replaced", F.coalesce("__hit", F.lit(False)))
    for c in columns:
        out = out.withColumn(c, F.when(F.col("replaced"), F.col(f"__{c}")).otherwise(F.col(c)))
    return out.drop("__hit", *[f"__{c}" for c in columns])


def flag_ungrounded(cells: DataFrame, failed: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Cells named in a quarantine whose quote stands nowhere in the source get ``flag``."""
    named = failed.select(key, "field").distinct().withColumn("__named", F.lit(True))
    rows = cells.join(named, [key, "field"], "left").join(sources.select(key, F.col("text").alias("__text")), key, "left")
    lost = ~((flat(F.col("quote")) != "") & F.contains(flat(F.col("__text")), flat(F.col("quote"))))
    return rows.withColumn("flag", F.coalesce(F.col("__named"), F.lit(False)) & lost).drop("__named", "__text")
