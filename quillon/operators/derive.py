"""Rule-based derivation of graded fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import is_absent


def _map(table: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def score_of(flags: list[Column]) -> Column:
    """H4, H5: how many are true."""
    out = F.lit(0)
    for f in flags:
        out = out + flag(f).cast("int")
    return out


def ionising(primary: Column, secondary: Column, kinds: list[str]) -> Column:
    """H1: null if no modality is reported."""
    known = lambda c: ~is_absent(c, "validator")
    return F.when(known(primary) | known(secondary), flag(primary.isin(*kinds)) | flag(secondary.isin(*kinds)))


def multimodal(secondary: Column) -> Column:
    """H2."""
    return ~is_absent(secondary, "validator")


def reproducibility(code: Column, data: Column, weights: Column) -> Column:
    """H3: mixed releases fall to the nearest single one."""
    c, d, w = flag(code), flag(data), flag(weights)
    return F.when(c & d & w, "code_plus_data_plus_weights").when(c, "code_only").when(d, "data_only").when(w, "weights_or_circuit_params_only").otherwise("none")


def mitigation_clarity(kind: Column, strategy: Column) -> Column:
    """H6, X1: 'none' needs the type none_reported and no strategy at all."""
    return F.when(kind.isin(*vocab.NAMED_MITIGATION), "high").when((kind == "none_reported") & is_absent(strategy, "validator"), "none").otherwise("low")


def realism(grade: Column) -> Column:
    """H7, X4."""
    return _map(vocab.REALISM, grade)


def honest(explicit: Column, accounting: Column) -> Column:
    """H8, X5."""
    return flag(explicit) & (accounting >= 3)


def summary_quality(signals: list[Column]) -> Column:
    """H9: up to two concerns are low, up to four moderate."""
    n = score_of(signals)
    return F.when(n <= 2, "low_concern").when(n <= 4, "moderate_concern").otherwise("high_concern")


def paradigm_axis(sub: Column) -> Column:
    """H13."""
    return F.coalesce(_map(vocab.PARADIGM_AXIS, sub), F.lit("other"))


def modality_family(sub: Column) -> Column:
    """Unknown subcategories are unspecified."""
    return F.coalesce(_map(vocab.MODALITY_FAMILY, sub), F.lit("unspecified"))


def prefix_family(value: Column, prefixes: list[tuple[str, str]], default: str = "other") -> Column:
    """the family of the first prefix that fits."""
    out = F.lit(default)
    for p, name in reversed(prefixes):
        out = F.when(value.startswith(p), name).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """A derived field: its name, the columns and derived fields it needs, and its expression over them."""

    name: str
    needs: tuple[str, ...]
    value: Callable[..., Column]


def _either(a: Column, b: Column) -> Column:
    return flag(a) | flag(b)


def _reported(*values: Column) -> Column:
    return score_of([~is_absent(v, "validator") for v in values])


def _concerns(baseline: Column, real: Column, accounting: Column, honest_: Column, tier: Column, tested: Column, validated: Column, outer_set: Column) -> Column:
    return summary_quality([baseline.isin("none", "weak"), real == "toy", accounting < 2, ~honest_, tier == "none", ~flag(tested), ~_either(validated, outer_set)])


#: H1-H9 over the extracted fields; the order they are written in does not matter.
RULES = [
    Rule("summary_methodological_quality", ("baseline_rigour_grade", "dataset_realism_rob", "quantum_resource_accounting_completeness", "honest_resource_reporting", "reproducibility_tier", "statistical_testing_present", "external_validation_used", "external_test_set"), _concerns),
    Rule("ionising_flag", ("modality_primary", "modality_secondary"), lambda a, b: ionising(a, b, vocab.IONISING)),
    Rule("multimodal", ("modality_secondary",), multimodal),
    Rule("reproducibility_tier", ("code_release", "data_release", "weights_release"), reproducibility),
    Rule("clinical_translation_readiness", ("sample_size_justification_reported", "external_validation_used", "regulatory_pathway_addressed", "prospective_clinical_present"), lambda *flags: score_of(list(flags))),
    Rule("quantum_resource_accounting_completeness", ("qubit_count", "circuit_depth", "gate_count", "shot_count"), _reported),
    Rule("error_mitigation_clarity", ("error_mitigation_type", "error_mitigation_strategy"), mitigation_clarity),
    Rule("dataset_realism_rob", ("dataset_realism_grade",), realism),
    Rule("honest_resource_reporting", ("real_vs_sim_explicit", "quantum_resource_accounting_completeness"), honest),
]


def layers(rules: list[Rule], columns: list[str]) -> list[list[Rule]]:
    """Rules in steps, each of which needs only columns and fields of earlier steps.

    A rule that names itself or one that waits for it, a missing column and two
    rules of one name are errors."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"several rules derive {sorted({n for n in names if names.count(n) > 1})}")
    missing = {n for r in rules for n in r.needs} - set(columns) - set(names)
    if missing:
        raise ValueError(f"no column or rule gives {sorted(missing)}")
    known, left, out = set(columns) - set(names), list(rules), []
    while left:
        ready = [r for r in left if set(r.needs) <= known]
        if not ready:
            raise ValueError(f"rules wait for each other: {sorted(r.name for r in left)}")
        out.append(ready)
        known |= {r.name for r in ready}
        left = [r for r in left if r not in ready]
    return out


def derived(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``df`` with all derived fields, planned as one projection for each step of the rules' dependences.

    A derived field replaces a column of its name; rules see the derived one."""
    for step in layers(RULES if rules is None else rules, df.columns):
        df = df.withColumns({r.name: r.value(*[F.col(n) for n in r.needs]) for r in step})
    return df
