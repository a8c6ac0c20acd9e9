"""Queries of rules, cells and repairs; signals are dealt to rows of the driver's tables by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells, facets, segment
from .catalog import query, table


def _deal(key: str, values: list) -> str:
    """A CASE that deals values to keys in turn, the same in both dialects."""
    cases = " ".join(f"when {i} then {'null' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values))
    return f"case {key} % {len(values)} {cases} end"


_SIGNALS = {
    "modality": _deal("p_partkey", ["MRI", "X-ray", "other", "OCT", None, " ct "]),
    "dataset": _deal("p_partkey", ["Kvasir", "MedNIST", "CT and MRI scans", "medical images", "EEG", None, "pet"]),
    "second": _deal("p_partkey", ["CT", "not_reported", None, "n/a"]),
    "task": _deal("p_partkey", ["analysis", "other", "classification", "Fusion", None, "instrumentation", "guess"]),
    "title": "p_name || ' ' || " + _deal("p_partkey", ["Edge Extraction by circuits", "Quantum-Enhanced network", "a survey of qubo", "Brain age", "image enhancement", "Quantum-inspired adder", "Lossless quantum image", "nothing", "QCA cells", "entangled photons", "survival"]),
    "paradigm": _deal("p_partkey", ["other", "QML", None, "other", "frqi"]),
    "platform": _deal("p_partkey", ["superconducting", "annealing", None, "not_reported", "photonic", "liquid"]),
    "run": _deal("p_partkey", ["real", "simulator", "both", None, "simulator"]),
    "vendor": _deal("p_partkey", ["IBM", "desk (NMR)", None]),
    "framework": _deal("p_partkey", ["Qiskit", "none_reported", None, "PennyLane"]),
    "level": _deal("p_partkey", ["default_transpilation", "none", None]),
    "mitigation": _deal("p_partkey", ["ZNE", "zne", "none_reported", None]),
    "encoding": _deal("p_partkey", ["NEQR", "angle", "amplitude", None, "angle", "angle", "angle"]),
}
_DEALT = "select p_partkey, " + ", ".join(f"{v} as {k}" for k, v in _SIGNALS.items()) + " from part"


def _signals(spark, d):
    return table(spark, d, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in _SIGNALS.items()])


@query(f"""
with s as ({_DEALT}),
m as (select p_partkey, case lower(trim(coalesce(modality, ''))) when 'x-ray' then 'x_ray' when '' then 'other' else lower(trim(modality)) end as named, lower(coalesce(dataset, '')) as ds from s),
r as (select p_partkey, case when named <> 'other' then named when ds = 'kvasir' then 'endoscopy' when ds in ('mednist', 'ct and mri scans') then 'multimodal' when ds = 'medical images' then 'unspecified_medical_imaging' else 'other' end as modality_sub from m)
select p_partkey, modality_sub, case modality_sub when 'mri' then 'mr' when 'x_ray' then 'radiological_ionising' when 'ct' then 'radiological_ionising' when 'endoscopy' then 'optical' when 'multimodal' then 'multimodal' when 'unspecified_medical_imaging' then 'unspecified' when 'other' then 'other' else 'unspecified' end as modality_fam from r""")
def modality_axis(spark, d):
    """H15, X32."""
    sub = facets.modality_subcategory(F.col("modality"), F.col("dataset"))
    from ..operators.derive import modality_family

    return _signals(spark, d).select("p_partkey", sub.alias("modality_sub"), modality_family(sub).alias("modality_fam"))


@query(rf"""
with s as ({_DEALT}),
r as (select p_partkey, second, lower(coalesce(task, '')) as raw, lower(title) as t from s),
u as (select p_partkey, second, case when raw in ('classification', 'fusion', 'instrumentation') then raw when raw in ('analysis', 'other') then case when regexp_matches(t, 'edge (detection|extraction)') then 'edge_detection' when t like '%survival%' then 'survival' when t like '%brain age%' then 'regression' when t like '%enhancement%' then 'image_enhancement' when t like '%quantum image%' or t like '%lossless quantum%' then 'image_representation' when raw = 'analysis' then 'analysis' else 'other_method' end else 'other_method' end as sub from r),
x as (select *, case when sub in ('classification', 'fusion', 'instrumentation') then sub when sub = 'image_enhancement' then 'super_resolution' when sub = 'image_representation' then 'other' else 'analysis' end as axis from u)
select p_partkey, sub, axis, case when sub in ('classification', 'survival', 'regression') then 'predictive' when sub in ('edge_detection', 'image_enhancement') then 'image_to_image' when sub = 'image_representation' then 'representation' else 'other' end as family, case when second = 'CT' and axis <> 'fusion' then axis || '; fusion' else axis end as tags from x""")
def imaging_task_axis(spark, d):
    """H16."""
    s = _signals(spark, d).withColumn("sub", facets.task_subcategory(F.col("task"), F.col("title"))).withColumn("axis", facets.task_axis(F.col("sub")))
    return s.select("p_partkey", "sub", "axis", facets.task_family(F.col("sub")).alias("family"), facets.task_tags(F.col("axis"), F.col("second")).alias("tags"))


@query(rf"""
with s as ({_DEALT}),
r as (select p_partkey, lower(coalesce(paradigm, '')) as raw, lower(title) as t, platform, task, encoding from s),
f as (select p_partkey, raw, list_filter([
  case when regexp_matches(t, '\b(review|perspective|survey)\b') then 'review_or_perspective' end,
  case when regexp_matches(t, 'cellular automata|\bqca\b') then 'quantum_cellular_automata' end,
  case when platform = 'annealing' or t like '%qubo%' or t like '%anneal%' then 'annealing' end,
  case when task = 'instrumentation' or t like '%detector%' then 'detector_instrumentation' end,
  case when t like '%adder%' then 'quantum_arithmetic_logic' end,
  case when encoding = 'NEQR' or t like '%quantum image%' then 'quantum_image_representation' end,
  case when regexp_matches(t, 'quantum[ \-]inspired') then 'quantum_inspired' end,
  case when t like '%entangl%' then 'quantum_physics_phenomenon' end], lambda x: x is not null) as fs from r)
select p_partkey, case when raw in ('qml', 'frqi') then raw else coalesce(fs[1], 'other_unresolved') end as sub, case when raw in ('qml', 'frqi') then raw when len(fs) > 0 then array_to_string(fs, '; ') else 'other_unresolved' end as facets, raw not in ('qml', 'frqi') and len(fs) > 1 as ambiguous from f""")
def paradigm_facets(spark, d):
    """H11, H12."""
    c = F.col
    found = facets.paradigm_facets(c("paradigm"), F.lit(None).cast("string"), c("title"), c("platform"), c("task"), F.array("encoding"))
    return _signals(spark, d).select("p_partkey", found.alias("f")).select("p_partkey", c("f")[0].alias("sub"), F.array_join("f", "; ").alias("facets"), (F.size("f") > 1).alias("ambiguous"))


@query(f"""
with s as ({_DEALT})
select p_partkey,
  case when platform = 'superconducting' then 'gate_superconducting' when platform in ('annealing', 'photonic') then platform when run in ('real', 'both') and vendor = 'desk (NMR)' then 'nmr' when run = 'simulator' then 'simulator_only' when run in ('real', 'both') then 'real_hardware_unspecified' else 'not_reported' end as hardware,
  'mode=' || coalesce(run, 'not_reported') || case when framework in ('Qiskit', 'PennyLane') then '; framework=' || lower(framework) else '' end || case when level = 'default_transpilation' then '; transpiled=yes' else '; transpiled=nr' end as hardware_facets,
  case when run in ('real', 'both') then 'real_qpu' when run is null then 'not_reported' when mitigation = 'ZNE' then 'noisy_simulator' else 'ideal_or_unspecified_simulator' end as context,
  case when run in ('real', 'both') then 'real_or_simulator=' || run when run is null then 'real_or_simulator absent/unexpected (absent)' when mitigation = 'ZNE' then 'real_or_simulator=simulator; noise signal error_mitigation_type=ZNE' else 'real_or_simulator=simulator; no noise signal (error_mitigation_type=' || coalesce(mitigation, 'absent') || ')' end || ' | vendor=' || coalesce(vendor, 'not_reported') || '; qubit_modality=' || coalesce(platform, 'not_reported') || '; compilation_level=' || case when level = 'default_transpilation' then level else 'not_reported' end as context_basis
from s""")
def hardware_execution(spark, d):
    """H14, H17."""
    c = F.col
    return _signals(spark, d).select(
        "p_partkey",
        facets.hardware_subcategory(c("platform"), c("run"), c("vendor")).alias("hardware"),
        facets.hardware_facets(c("run"), c("framework"), c("level")).alias("hardware_facets"),
        facets.execution_context(c("run"), c("mitigation")).alias("context"),
        facets.execution_basis(c("run"), c("mitigation"), c("vendor"), c("platform"), c("level")).alias("context_basis"),
    )


@query(f"""
with s as (select p_partkey, {_deal("p_partkey", ["yes", "False", "", None])} as code_release, {_deal("p_partkey", ["MNIST; OASIS", "[]", "n/a", "-", "ADNI"])} as dataset_name, {_deal("p_partkey", ["NR", None, "none_reported"])} as funding_source, p_name as title from part),
l as (select p_partkey, 'code_release' as field, 'bool' as arity, 'high' as priority, code_release as v from s union all select p_partkey, 'dataset_name', 'list', 'high', dataset_name from s union all select p_partkey, 'funding_source', 'scalar', 'low', funding_source from s union all select p_partkey, 'title', 'scalar', 'medium', title from s),
t as (select *, case when arity = 'bool' then case v when 'yes' then 'BOOL_TRUE' when 'False' then 'BOOL_FALSE' else 'ABSENCE' end when v is null or v in ('[]', 'n/a', '-', 'none_reported') then 'ABSENCE' when arity = 'list' then 'REAL_LIST' else 'REAL_SCALAR' end as state from l)
select p_partkey, field, state, priority, case state when 'ABSENCE' then 'fills_blank,confirms_absence,not_found' when 'REAL_LIST' then 'appends_extra,confirms,contradicts,not_found' else 'confirms,contradicts,not_found' end as allowed from t""")
def target_cells(spark, d):
    """One row per part and field."""
    dealt = {"code_release": ["yes", "False", "", None], "dataset_name": ["MNIST; OASIS", "[]", "n/a", "-", "ADNI"], "funding_source": ["NR", None, "none_reported"]}
    wide = table(spark, d, "part").select("p_partkey", *[F.expr(_deal("p_partkey", v)).alias(k) for k, v in dealt.items()], F.col("p_name").alias("title"))
    arity = {"code_release": "bool", "dataset_name": "list", "funding_source": "scalar", "title": "scalar"}
    return cells.targets(wide, "p_partkey", arity).select("p_partkey", "field", "state", "priority", F.array_join("allowed_verdicts", ",").alias("allowed"))


_HUMAN = _deal("o_orderkey", ["QCNN", "lung; brain", "Radiography", "not reported", "qml, grover", "a, b"])
_OTHER = _deal("o_orderkey", ["qml", "neurology", "x-ray", "none", "x", "b, a", "pulmonology"])


@query(f"""
with s as (select o_orderkey, {_HUMAN} as h, {_OTHER} as a from orders),
n as (select o_orderkey, case h when 'QCNN' then ['qcnn'] when 'lung; brain' then ['brain', 'lung'] when 'Radiography' then ['x-ray'] when 'not reported' then ['∅'] when 'qml, grover' then ['grover', 'qml'] else ['a', 'b'] end as h, case h when 'QCNN' then ['qml'] when 'lung; brain' then ['neurology', 'pulmonology'] when 'Radiography' then ['x-ray'] when 'not reported' then ['∅'] when 'qml, grover' then ['other', 'qml'] else ['a', 'b'] end as hl, case a when 'none' then ['∅'] when 'b, a' then ['a', 'b'] else [a] end as a from s)
select array_to_string(hl, ';') as human, array_to_string(a, ';') as other, h = a as strict, len(list_intersect(hl, a)) > 0 as lenient, count(*) as n from n group by 1, 2, 3, 4""")
def label_agreement(spark, d):
    """Two raters' label sets, strictly and leniently."""
    s = table(spark, d, "orders").select(F.expr(_HUMAN).alias("h"), F.expr(_OTHER).alias("a"))
    strict, loose = [cells.label_set(F.col(c), False) for c in "ha"], [cells.label_set(F.col(c), True) for c in "ha"]
    return s.groupBy(F.array_join(loose[0], ";").alias("human"), F.array_join(loose[1], ";").alias("other"), cells.agree(*strict, False).alias("strict"), cells.agree(*loose, True).alias("lenient")).agg(F.count("*").alias("n"))


@query(r"""
with s as (select doc_id, text, substr(text, 12, 40) as q from documents where text is not null),
p as (select doc_id, text, q, strpos(text, q) as i from s)
select doc_id, case when q = '' then '' else regexp_extract(substr(text, 1, i - 1), '[\p{L}\p{N}]*$') || q || regexp_extract(substr(text, i + length(q)), '^[\p{L}\p{N}]*') end as snapped from p""")
def quote_snap(spark, d):
    """Quotes cut within words, widened."""
    s = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.substring("text", 12, 40).alias("q"))
    return s.select("doc_id", text.snap_quote(F.col("q"), F.col("text")).alias("snapped"))


@query("""
select event_id, case when event_id % 3 = 2 then null else 'e' || event_id end as record_id, case when event_id % 3 = 2 then null else event_type end as category, case when event_id % 3 = 2 then null when event_id % 3 = 1 then '(truncated)' else 'a "b" {c' end as quote from events""")
def verdict_repair(spark, d):
    """Verdicts that are whole, cut within the first object, and cut before it."""
    whole = F.format_string('{"record_id": "e%d", "primary": {"category": "%s", "evidence_quote": "a \\"b\\" {c", "evidence_field": "title"}, "secondary": null}', "event_id", "event_type")
    at = F.when(F.col("event_id") % 3 == 0, F.length(whole)).when(F.col("event_id") % 3 == 1, F.instr(whole, "evidence_quote") + 3).otherwise(F.instr(whole, "primary") + 3)
    fixed = text.repair_verdict(F.substring(whole, F.lit(1), at))
    return table(spark, d, "events").select("event_id", fixed.alias("v")).select("event_id", "v.record_id", F.col("v.primary.category").alias("category"), F.col("v.primary.evidence_quote").alias("quote"))


@query("""
select c.conv_id, string_agg('[' || case when role = 'user' then 'markdown' else 'code' end || ' cell]' || chr(10) || text || case when role = 'user' then '' else chr(10) || chr(10) || '[output]' || chr(10) || turn end, chr(10) || chr(10) order by turn) as body
from conversations c where text is not null and trim(text) <> '' group by 1""")
def notebook_cells(spark, d):
    """P10: conversations as notebooks, and their text."""
    c = table(spark, d, "conversations").where("text is not null and trim(text) <> ''")
    # a list for the one kind of source and a string for the other, as notebooks have them
    body = F.to_json(F.array("text"))
    source = F.when(F.col("role") == "user", body).otherwise(F.substring(body, F.lit(2), F.length(body) - 2))
    kind = F.when(F.col("role") == "user", "markdown").otherwise("code")
    outputs = F.when(F.col("role") == "user", "[]").otherwise(F.concat(F.lit('[{"data": {"text/plain": ["'), F.col("turn").cast("string"), F.lit('"]}}]')))
    cell = F.concat(F.lit('{"cell_type": "'), kind, F.lit('", "source": '), source, F.lit(', "outputs": '), outputs, F.lit("}"))
    books = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("cells"))
    return books.select("conv_id", text.notebook_text(F.concat(F.lit('{"cells": ['), F.array_join(F.transform("cells", lambda x: x["cell"]), ","), F.lit("]}"))).alias("body"))


@query()
def pack_pages_sections(spark, d):
    """Lines as pages, runs that end before a section near their end."""
    docs = table(spark, d, "documents")
    page_rows = segment.pages(docs, "doc_id", "text", "\n")
    marks = page_rows.where("page % 7 = 0").select("doc_id", F.col("char_start").alias("start"))
    return segment.plan_pages(page_rows, "doc_id", 20000, sections=marks)
