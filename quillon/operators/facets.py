"""Rules that resolve vague labels from other fields.

All take and give columns; a null input counts as an absent field. Where a field
holds many values the caller passes its first, and for data set names all of
them, joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import is_absent
from .derive import _map


def _low(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def _said(value: Column, stage: str, default: str) -> Column:
    return F.when(is_absent(value, stage), default).otherwise(F.trim(value))


def modality_subcategory(primary: Column, dataset: Column) -> Column:
    """A named modality, or what the data set's name says of 'other'; X32: other names stay."""
    raw, data = _low(primary), _low(dataset)
    named = F.coalesce(_map(vocab.MODALITY_ALIAS, raw), raw)
    tokens = sum((data.rlike(p).cast("int") for p in vocab.MODALITY_TOKENS), F.lit(0))
    guess = (
        F.when(data.rlike(vocab.ENDOSCOPY), "endoscopy")
        .when(data.rlike(vocab.MANY_MODALITIES) | (tokens >= 2), "multimodal")
        .when(data.rlike(vocab.SOME_MODALITY), "unspecified_medical_imaging")
        .otherwise("other")
    )
    return F.when(named.isin("other", ""), guess).otherwise(named)


def task_subcategory(task: Column, title: Column) -> Column:
    """A concrete task, or what the title says of 'analysis' and 'other'."""
    raw, name = _low(task), _low(title)
    tail = F.when(raw == "analysis", "analysis").otherwise("other_method")
    for label, pattern in reversed(vocab.TASK_TITLE):
        tail = F.when(name.rlike(pattern), label).otherwise(tail)
    return F.when(raw.isin(*vocab.TASK_CONCRETE), raw).when(raw.isin("analysis", "other"), tail).otherwise("other_method")


def task_axis(sub: Column) -> Column:
    """H16."""
    return F.coalesce(_map(vocab.TASK_AXIS, sub), F.lit("other"))


def task_family(sub: Column) -> Column:
    """H16."""
    return F.coalesce(_map(vocab.TASK_FAMILY, sub), F.lit("other"))


def task_tags(axis: Column, secondary: Column) -> Column:
    """The axis, and fusion if there is a second modality."""
    return F.when(is_absent(secondary, "axis") | (axis == "fusion"), axis).otherwise(F.concat(axis, F.lit("; fusion")))


def paradigm_facets(paradigm: Column, note: Column, title: Column, platform: Column, task: Column, encodings: Column) -> Column:
    """The facets of a paper, the one that decides first; ``encodings`` is an array."""
    raw, head = _low(paradigm), _low(title)
    both = F.trim(F.concat(_low(note), F.lit(" "), head))
    own = {
        "annealing": _low(platform) == "annealing",
        "detector_instrumentation": _low(task) == "instrumentation",
        "quantum_image_representation": F.exists(F.coalesce(encodings, F.array().cast("array<string>")), lambda x: _low(x).isin(*vocab.PARADIGM_ENCODINGS)),
    }
    hit = [F.when(own.get(name, F.lit(False)) | (head if name == "review_or_perspective" else both).rlike(p), F.lit(name)) for name, p in vocab.PARADIGM_WORDS.items()]
    found = F.array_compact(F.array(*hit))
    return F.when(raw.isin(*vocab.PARADIGM_CONCRETE), F.array(raw)).when(F.size(found) > 0, found).otherwise(F.array(F.lit("other_unresolved")))


def hardware_subcategory(platform: Column, run: Column, vendor: Column) -> Column:
    """The platform; else the vendor's substrate in real runs; else the way of running."""
    real = _low(run).isin("real", "both")
    return (
        F.when(_map(vocab.HARDWARE_PLATFORM, _low(platform)).isNotNull(), _map(vocab.HARDWARE_PLATFORM, _low(platform)))
        .when(real & _low(vendor).rlike(vocab.NMR), "nmr")
        .when(_low(run) == "simulator", "simulator_only")
        .when(real, "real_hardware_unspecified")
        .otherwise("not_reported")
    )


def hardware_facets(run: Column, framework: Column, level: Column) -> Column:
    """H14."""
    mode = F.concat(F.lit("mode="), F.coalesce(F.nullif(_low(run), F.lit("")), F.lit("not_reported")))
    by = F.when(~is_absent(framework, "hardware"), F.concat(F.lit("framework="), _low(framework)))
    return F.concat_ws("; ", mode, by, F.when(_low(level).isin(*vocab.TRANSPILED), "transpiled=yes").otherwise("transpiled=nr"))


def execution_context(run: Column, mitigation: Column) -> Column:
    """A simulator is noisy if error mitigation is named, in its own spelling."""
    named = F.coalesce(F.trim(mitigation).isin(*vocab.NAMED_MITIGATION), F.lit(False))
    return F.when(_low(run).isin("real", "both"), "real_qpu").when(_low(run) != "simulator", "not_reported").when(named, "noisy_simulator").otherwise("ideal_or_unspecified_simulator")


def execution_basis(run: Column, mitigation: Column, vendor: Column, platform: Column, level: Column) -> Column:
    """What the context rests on."""
    way = F.concat(F.lit("real_or_simulator="), _low(run))
    named = F.coalesce(F.trim(mitigation).isin(*vocab.NAMED_MITIGATION), F.lit(False))
    kind = F.coalesce(F.nullif(F.trim(mitigation), F.lit("")), F.lit("absent"))
    signal = (
        F.when(_low(run).isin("real", "both"), way)
        .when((_low(run) == "simulator") & named, F.concat(way, F.lit("; noise signal error_mitigation_type="), kind))
        .when(_low(run) == "simulator", F.concat(way, F.lit("; no noise signal (error_mitigation_type="), kind, F.lit(")")))
        .otherwise(F.concat(F.lit("real_or_simulator absent/unexpected ("), F.coalesce(F.nullif(_low(run), F.lit("")), F.lit("absent")), F.lit(")")))
    )
    rest = [F.concat(F.lit(name), _said(c, "axis", "not_reported")) for name, c in (("vendor=", vendor), ("qubit_modality=", platform), ("compilation_level=", level))]
    return F.concat(signal, F.lit(" | "), F.concat_ws("; ", *rest))
