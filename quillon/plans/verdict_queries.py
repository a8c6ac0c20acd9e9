"""Queries of verdicts and cells; their parts are dealt to documents by id, quotes are cut from the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import validate, verdicts
from .catalog import query, table
from .rule_queries import _deal

_FLAT = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_TITLE = "case when instr(text, chr(10)) > 0 then substr(text, 1, instr(text, chr(10)) - 1) else '' end"
_BODY = "case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else text end"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _quote(key: str) -> str:
    return f"case {key} when 0 then substr(title, 1, 30) when 1 then substr(body, 11, 40) when 2 then 'no such quote zzz' when 3 then '' when 4 then '  ' || substr(body, 3, 25) end"


_V = {
    "record_id": "case when doc_id % 23 = 0 then null when doc_id % 29 = 0 then 'x' || doc_id else 'd' || doc_id end",
    "there": "doc_id % 19 <> 0",
    "p_cat": _deal("doc_id", ["QC_FOR_IMAGING", "OTHER", "BAD", "QUANTUM_DOTS", "OTHER", None, "OTHER"]),
    "p_field": _deal("doc_id", ["title", "abstract", "abstract", "body", "title", None, "abstract", "abstract", "title", "abstract", "abstract"]),
    "p_quote": _quote("doc_id % 6"),
    "s_kind": "doc_id % 5",
    "s_cat": _deal("doc_id", ["OTHER", "QUANTUM_DOTS", "BAD"]),
    "s_field": _deal("doc_id", ["abstract", "title", "page", "abstract"]),
    "s_quote": _quote("(doc_id + 1) % 6"),
    "confidence": _deal("doc_id", ["high", "low", "high", "medium", "low", None, "high", "low", "high"]),
    "reasoning": _deal("doc_id", ["because", "x", None, "y", "z", "because", "w"]),
    "flag": "case when doc_id % 11 = 0 then '_manual' when doc_id % 13 = 0 then 'odd' end",
    "broken": "case when doc_id % 31 = 0 then '{' end",
}
_VERDICTS = "select *, " + ", ".join(f"{v} as {k}" for k, v in _V.items()) + f" from (select doc_id, {_TITLE} as title, {_BODY} as body from documents)"


def _verdicts(spark, d):
    at = F.locate("\n", F.col("text"))
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.when(at > 0, F.expr("substring(text, 1, locate(chr(10), text) - 1)")).otherwise("").alias("title"),
        F.when(at > 0, F.expr("substring(text, locate(chr(10), text) + 1)")).otherwise(F.col("text")).alias("body"),
    )
    docs = docs.select("*", *[F.expr(v).alias(k) for k, v in _V.items()])
    part = lambda x: F.struct(F.col(f"{x}_cat").alias("category"), F.col(f"{x}_quote").alias("evidence_quote"), F.col(f"{x}_field").alias("evidence_field"))
    v = F.struct(
        "record_id",
        F.when(F.col("there"), part("p")).alias("primary"),
        F.when(F.col("s_kind") > 1, part("s")).alias("secondary"),
        (F.col("s_kind") == 1).alias("secondary_other"),
        "confidence",
        "reasoning",
        F.array_compact(F.array("flag")).alias("flags"),
        F.col("broken").alias("parse_error"),
    )
    return docs.select("doc_id", "title", "body", v.alias("v"))


def _sql_part(x: str, there: str) -> list[str]:
    source = f"case {x}_field when 'title' then title when 'abstract' then body end"
    name = {"p": "primary", "s": "secondary"}[x]
    return [
        f"case when {there} and ({x}_cat is null or {x}_cat not in {_LIST(vocab.CATEGORIES)}) then '{name}_category_invalid' end",
        f"case when {there} and ({x}_field is null or {x}_field not in ('title', 'abstract')) then '{name}_evidence_field_invalid' end",
        f"case when {there} and coalesce({x}_quote, '') = '' then '{name}_evidence_quote_missing' end",
        f"case when {there} and coalesce({x}_quote, '') <> '' and not coalesce({_FLAT(x + '_quote')} <> '' and {x}_field in ('title', 'abstract') and contains({_FLAT(source)}, {_FLAT(x + '_quote')}), false) then '{name}_evidence_quote_not_in_source' end",
    ]


_S = _sql_part("s", "s_kind > 1")
_S.insert(1, "case when s_kind > 1 and there and s_cat is not distinct from p_cat then 'secondary_equals_primary' end")
_SURE = "confidence is not null and confidence in ('high', 'low')"
_CODES = f"""
with v as ({_VERDICTS}),
e as (select doc_id, title, body, case when broken is not null then ['parse_error_line'] when record_id is null then ['missing_record_id'] when record_id like 'x%' then ['record_id_not_in_corpus']
  when flag = '_manual' then case when not there then ['flagged_but_missing_primary'] when p_cat is null or p_cat not in {_LIST(vocab.CATEGORIES)} then ['flagged_but_invalid_category'] when not ({_SURE}) then ['flagged_but_invalid_confidence'] else [] end
  else list_filter([case when not there then 'missing_or_invalid_primary' end, {", ".join(_sql_part("p", "there"))}, case when s_kind = 1 then 'secondary_invalid_type' end, {", ".join(_S)}, case when not ({_SURE}) then 'confidence_invalid' end, case when reasoning is null then 'reasoning_missing' end], lambda x: x is not null) end as codes, p_quote, p_field, p_cat, record_id, there from v)
"""


def _coded(spark, d):
    rows = _verdicts(spark, d)
    # the corpus is a table of its own: a verdict joins it by its id
    corpus = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    rows = rows.join(corpus, rows["v.record_id"] == corpus["id"], "left")
    return rows.withColumn("errors", verdicts.screening_errors(F.col("v"), F.col("title"), F.col("body"), F.col("id").isNotNull()))


@query(_CODES + "select doc_id, array_to_string(codes, ',') as errors from e")
def screening_verdicts(spark, d):
    """The error codes of screening verdicts on documents."""
    return _coded(spark, d).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query(_CODES + ", x as (select unnest(codes) as code from e) select code, count(*) as n from x group by code union all select 'kept', count(*) from e where len(codes) = 0")
def revalidate_all(spark, d):
    """All verdicts validated anew: how many stay, and why the others go."""
    kept, gone = verdicts.revalidated(_coded(spark, d))
    return validate.histogram(gone).unionByName(kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("code"), "n"))


_STATUS = f"""case when {_FLAT('p_quote')} = '' then 'not_found' when contains({_FLAT('own')}, {_FLAT('p_quote')}) then 'verbatim' when contains({_FLAT('other')}, {_FLAT('p_quote')}) then 'verbatim_other_field' when bare <> '' and contains(bare_own, bare) then 'relaxed' when bare <> '' and contains(bare_other, bare) then 'relaxed_other_field' else 'not_found' end"""
_BARE = lambda c: f"trim(regexp_replace(regexp_replace({_FLAT(c)}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(
    _CODES
    + f""", q as (select *, case when p_field = 'title' then title else body end as own, case when p_field = 'title' then body else title end as other from e where len(codes) > 0),
r as (select *, {_BARE('p_quote')} as bare, {_BARE('own')} as bare_own, {_BARE('other')} as bare_other from q),
s as (select *, {_STATUS} as status from r)
select disposition, count(*) as events, count(distinct bucket) as buckets from (select doc_id % 50 as bucket, case when record_id is null or record_id like 'x%' then 'unmatched' when not there or p_cat is null or p_cat not in {_LIST(vocab.CATEGORIES)} then 'requeue' when status = 'verbatim' then 'rescued' when status in ('verbatim_other_field', 'relaxed_other_field') then 'rescued_field_corrected' when status = 'relaxed' then 'rescued_relaxed' else 'requeue' end as disposition from s) group by 1"""
)
def quarantine_rescue(spark, d):
    """What becomes of quarantined verdicts, as events and as distinct buckets of ids."""
    bad = _coded(spark, d).where(F.size("errors") > 0)
    p = F.col("v.primary")
    status = text.quote_status(F.when(p.isNotNull(), p["evidence_quote"]), p["evidence_field"], F.col("title"), F.col("body"))
    out = verdicts.disposition(F.col("status"), F.col("id").isNotNull(), p["category"])
    return bad.withColumn("status", status).select((F.col("doc_id") % 50).alias("bucket"), out.alias("disposition")).groupBy("disposition").agg(F.count("*").alias("events"), F.count_distinct("bucket").alias("buckets"))


@query(f"""
with v as ({_VERDICTS}), q as (select case when p_field = 'title' then title else body end as own, case when p_field = 'title' then body else title end as other, p_quote from v),
r as (select *, {_BARE('p_quote')} as bare, {_BARE('own')} as bare_own, {_BARE('other')} as bare_other from q)
select status, count(*) as n from (select {_STATUS} as status from r) group by 1""")
def quote_statuses(spark, d):
    """Five statuses of quotes against their own field and the other one."""
    quote, field = F.expr(_V["p_quote"]), F.expr(_V["p_field"])
    rows = _verdicts(spark, d).select("doc_id", "title", "body")
    return rows.select(text.quote_status(quote, field, F.col("title"), F.col("body")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


_SUB = {
    "present": _deal("event_id", ["true", "false", '"yes"', "true", "null", "true"]),
    "context": _deal("event_id", ["true", "false", "true", '"no"']),
    "verdict": _deal("event_id", ["promote_to_IN", "stay_OUT", "stay_OUT", "maybe", "promote_to_IN"]),
    "confidence": _deal("event_id", ["high", "low", "sure"]),
    "mq": _deal("event_id", ["Gamma Ray", "neutron", "gamma  ray", ""]),
    "cq": _deal("event_id", ["NV centre", "laser", "nv  CENTRE x", "nv centre"]),
}
_SOURCE = "'A gamma ray is seen by an NV centre'"


@query(f"""
with s as (select event_id, {", ".join(f"{v} as {k}" for k, v in _SUB.items())}, event_id % 7 = 0 as short, event_id % 17 <> 0 as known, event_id % 41 = 0 as broken from events),
b as (select *, present in ('true', 'false') as pb, context in ('true', 'false') as cb, verdict in ('promote_to_IN', 'stay_OUT') as ok from s)
select event_id, array_to_string(case when broken then ['not_a_json_object'] else list_filter([
  case when short then 'missing_keys:doi,reasoning' end, case when not ok then 'verdict_invalid' end, case when confidence = 'sure' then 'confidence_invalid' end,
  case when not pb then 'ionising_modality_present_not_bool' end, case when not cb then 'quantum_sensing_in_ionising_context_not_bool' end,
  case when pb and cb and ok and present = 'true' and context = 'true' and verdict <> 'promote_to_IN' then 'verdict_inconsistent_with_booleans_should_promote' end,
  case when pb and cb and ok and not (present = 'true' and context = 'true') and verdict <> 'stay_OUT' then 'verdict_inconsistent_with_booleans_should_stay' end,
  case when known and present = 'true' and mq not in ('Gamma Ray', 'gamma  ray') then 'ionising_modality_quote_not_in_source' end,
  case when known and context = 'true' and cq not in ('NV centre', 'nv centre') then 'context_quote_not_in_source' end,
  case when not known then 'record_id_not_in_batch' end], lambda x: x is not null) end, ';') as errors from b""")
def subscreen_verdicts(spark, d):
    """The error codes of second-screening verdicts, given as JSON texts."""
    e = table(spark, d, "events").select("event_id", *[F.expr(v).alias(k) for k, v in _SUB.items()])
    rest = F.when(F.col("event_id") % 7 == 0, "").otherwise(', "doi": "10.1/x", "reasoning": "r"')
    whole = F.concat(
        F.lit('{"record_id": "e", "ionising_modality_name": "n", "ionising_modality_present": '), "present", F.lit(', "quantum_sensing_in_ionising_context": '), "context", F.lit(', "verdict": "'), "verdict",
        F.lit('", "confidence": "'), "confidence", F.lit('", "ionising_modality_quote": "'), "mq", F.lit('", "context_quote": "'), "cq", F.lit('"'), rest, F.lit("}"),
    )
    v = F.try_parse_json(F.when(F.col("event_id") % 41 == 0, F.lit("{")).otherwise(whole))
    # columns of their own: each row's text is parsed once, not for every member that is read
    e = e.select("event_id", v.alias("v"), F.expr(_SOURCE).alias("source"))
    out = verdicts.subscreen_errors(F.col("v"), F.col("source"), F.col("event_id") % 17 != 0)
    return e.select("event_id", F.array_join(out, ";").alias("errors"))


_FIELDS = [
    ("grade", "enum", "['none', 'weak', 'strong']", "null", "null", True),
    ("kinds", "multi_enum", "['a', 'b']", "null", "null", False),
    ("released", "bool", "null", "null", "null", True),
    ("qubits", "int", "null", "null", "null", False),
    ("depth", "int_range", "null", "1", "50", True),
    ("name", "string", "null", "null", "null", True),
]
_VALUES = ['"weak"', "3", "true", "60", "null", '"not_reported"', '"a"', "0", "1.5", '"Eauouon and more"', "false"]
_CELL = f"""
with f as (select * from (values {", ".join(f"({i}, '{n}', '{k}', {a}, {lo}, {hi}, {str(q).lower()})" for i, (n, k, a, lo, hi, q) in enumerate(_FIELDS))}) t(i, field, kind, allowed, low, high, needs)),
c as (select doc_id, text, field, kind, allowed, low, high, needs, {_deal("(doc_id + i * 3)", _VALUES)} as j, case (doc_id + i) % 4 when 0 then substr(text, 5, 30) when 1 then 'nothing of this stands there' when 2 then null else 'zz ' || substr(text, 8, 60) end as quote, (doc_id + i) % 13 = 0 as image from documents, f),
t as (select *, json_type(j) as ty, json_extract_string(j, '$') as s from c),
a as (select *, ty = 'NULL' or (ty = 'VARCHAR' and lower(trim(s)) in ('', 'not_reported', 'none', 'not_applicable', 'null')) as gone from t),
w as (select *, case when kind in ('enum', 'multi_enum') and not (gone or (ty = 'VARCHAR' and list_contains(allowed, s))) then case kind when 'enum' then 'enum_violation' else 'multi_enum_member_violation' end
  when kind = 'bool' and not (ty = 'BOOLEAN' or (ty in ('UBIGINT', 'BIGINT') and s in ('0', '1'))) then 'bool_violation' when kind = 'int' and ty not in ('UBIGINT', 'BIGINT') then 'int_violation'
  when kind = 'int_range' and ty not in ('UBIGINT', 'BIGINT') then 'int_range_type' when kind = 'int_range' and cast(s as double) < low then 'int_below_min' when kind = 'int_range' and cast(s as double) > high then 'int_above_max' end as wrong,
  coalesce({_FLAT('quote')} <> '' and contains({_FLAT('text')}, {_FLAT('quote')}), false) as found from a)
"""


def _cells(spark, d):
    docs = table(spark, d, "documents")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f[0]).alias("field")) for i, f in enumerate(_FIELDS)])
    c = docs.select("doc_id", "text", F.explode(rows).alias("c")).select("doc_id", "text", "c.*")
    quote = "case (doc_id + i) % 4 when 0 then substr(text, 5, 30) when 1 then 'nothing of this stands there' when 2 then null else 'zz ' || substr(text, 8, 60) end"
    cells = c.select("doc_id", "field", F.try_parse_json(F.expr(_deal("(doc_id + i * 3)", _VALUES))).alias("value"), F.expr(quote).alias("quote"), ((F.col("doc_id") + F.col("i")) % 13 == 0).alias("image_only"))
    spec = [(n, k, None if a == "null" else eval(a), None if lo == "null" else int(lo), None if hi == "null" else int(hi), q, False) for n, k, a, lo, hi, q in _FIELDS]  # noqa: S307
    registry = spark.createDataFrame(spec, "field string, kind string, allowed array<string>, low long, high long, requires_quote boolean, derived boolean")
    return cells, registry, docs


@query(_CELL + "select doc_id, field, case when wrong is not null then wrong when needs and not gone and not image and (coalesce(lower(trim(quote)), '') in ('', 'not_reported', 'none', 'not_applicable', 'null') or not found) then 'quote_not_in_source' end as error from w")
def cell_validation(spark, d):
    """Types, choices and bounds of cells, and their quotes against the whole text."""
    cells, registry, docs = _cells(spark, d)
    return verdicts.cell_errors(cells, registry, docs, "doc_id").select("doc_id", "field", "error")


@query(_CELL + """select field, coalesce(error, 'ok') as error, count(*) as n from (select field, case when wrong is not null then wrong when needs and not (gone or lower(trim(s)) in ('none_reported', 'false')) then case when image then 'image_only_not_allowed' when quote is null or lower(trim(quote)) in ('', 'not_reported', 'none', 'not_applicable', 'null') then 'missing_quote_for_positive' when not found then case
    when contains(b, bv) and length(bv) >= 4 and v_ok then 'ok' when r >= 5 then 'ok' else 'quote_not_in_source' end end end as error from (
  select *, trim(regexp_replace(regexp_replace({0}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as b, trim(regexp_replace(regexp_replace({1}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as bv, ty <> 'NULL' as v_ok,
    (select max(j2 - i2) from range(0, 12) x(i2), range(1, 13) y(j2) where j2 - i2 >= 5 and len(ws) >= j2 and contains(trim(regexp_replace(regexp_replace({0}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), array_to_string(ws[i2 + 1:j2], ' ')) and length(array_to_string(ws[i2 + 1:j2], ' ')) >= 20) as r
  from (select *, list_filter(string_split(trim(regexp_replace(regexp_replace({2}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') as ws from w))) group by 1, 2""".replace("{0}", _FLAT("text").replace("lower(", "lower(")).replace("{1}", _FLAT("s")).replace("{2}", _FLAT("quote")))
def refill_validation(spark, d):
    """Strictly: nothing from images, a quote for each present value, and a bounded rescue."""
    cells, registry, docs = _cells(spark, d)
    out = verdicts.cell_errors(cells, registry, docs, "doc_id", strict=True)
    return out.select("field", F.coalesce("error", F.lit("ok")).alias("error")).groupBy("field", "error").agg(F.count("*").alias("n"))


@query("""
with c as (select o_orderkey as k, case o_orderkey % 4 when 0 then 'other' when 1 then 'neqr' end as enc, case o_orderkey % 3 when 0 then 'none' when 1 then 'gradcam' end as mech, case o_orderkey % 5 when 0 then 'yes' end as code, case o_orderkey % 7 when 0 then 'x' end as detail, case o_orderkey % 2 when 0 then 'u' end as url from orders)
select field, count(*) as n from (select k, unnest(list_filter([case when enc = 'other' and detail is null then 'encoding_detail' end, case when mech is not null and mech <> 'none' and detail is null then 'method_name' end, case when code = 'yes' and url is null then 'code_url' end], lambda x: x is not null)) as field from c) group by 1""")
def conditional_required(spark, d):
    """Fields that others make necessary."""
    deal = {"encoding": _deal("o_orderkey", ["other", "neqr", None, None]), "mechanism": _deal("o_orderkey", ["none", "gradcam", None]), "code": _deal("o_orderkey", ["yes", None, None, None, None])}
    detail, url = _deal("o_orderkey", ["x"] + [None] * 6), _deal("o_orderkey", ["u", None])
    wide = table(spark, d, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in (deal | {"encoding_detail": detail, "method_name": detail, "code_url": url}).items()])
    cells = wide.unpivot("o_orderkey", wide.columns[1:], "field", "value")
    rules = [("encoding_detail", "encoding_contains_other", ""), ("method_name", "mechanism", "not_none"), ("code_url", "code", "yes")]
    return verdicts.conditional_errors(cells, rules, "o_orderkey", enabled=True).groupBy("field").agg(F.count("*").alias("n"))


@query(_CELL + """, e as (select doc_id, list(case when wrong is not null then wrong when needs and not gone and not image and not found then 'quote_not_in_source' end) as codes, bool_or(found) as any_found from w group by doc_id),
x as (select doc_id, any_found, list_filter(codes, lambda c: c is not null) as codes from e)
select route, count(*) as n from (select case when len(codes) = 0 then 'accepted' when len(list_filter(codes, lambda c: not contains(c, 'quote_not_in_source'))) > 0 then 'quarantine_structural' when any_found then 'rescued' else 'quarantine_quote' end as route from x) group by 1""")
def pass_routes(spark, d):
    """Records with wrong types are quarantined at once, others may be rescued."""
    cells, registry, docs = _cells(spark, d)
    checked = verdicts.cell_errors(cells, registry, docs, "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    q = verdicts.flat(F.col("quote"))
    per = checked.groupBy("doc_id").agg(F.collect_list("error").alias("codes"), F.bool_or((q != "") & F.contains(verdicts.flat(F.col("text")), q)).alias("some"))
    return per.select(verdicts.pass_route(F.col("codes"), F.col("some")).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("select event_type, count(*) filter (where event_id % 4 <> 1) as bad, count(*) as n from events group by 1")
def reconciliation_lists(spark, d):
    """Records whose contradictions are no list."""
    j = F.expr(_deal("event_id", ['{"contradictions": "none"}', '{"contradictions": [1, 2]}', "{}", '{"contradictions": null}']))
    rows = table(spark, d, "events").select("event_type", verdicts.list_error(F.try_parse_json(j)).alias("bad"))
    return rows.groupBy("event_type").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"))


@query("""
with t as (select o_orderkey as k, o_orderpriority as p from orders), r as (select distinct l_orderkey as k from lineitem where l_quantity > 40), x as (select distinct l_orderkey as k from lineitem where l_quantity > 45)
select p as o_orderpriority, count(*) as tasks, count(r.k) as replies, count(x.k) as done, count(*) - count(x.k) as pending from t left join r on r.k = t.k left join x on x.k = t.k group by 1""")
def task_progress(spark, d):
    """Orders as tasks, large lines as replies, larger ones as done."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return verdicts.progress(table(spark, d, "orders"), li.where("l_quantity > 40"), li.where("l_quantity > 45"), ["o_orderkey"], ["o_orderpriority"])


@query("""
with r as (select l_orderkey as k, l_linestatus as p, sum(l_quantity) as q from lineitem group by 1, 2), f as (select k, p, q * 2 as q from r where k % 3 = 0), bad as (select distinct l_orderkey as k, l_linestatus as p from lineitem where l_returnflag = 'R' and l_discount > 0.08)
select r.k as l_orderkey, r.p as l_linestatus, round(coalesce(f.q, r.q), 4) as q, f.q is not null as replaced from r left join (select * from f where not exists (select 1 from bad where bad.k = f.k and bad.p = f.p)) f on f.k = r.k and f.p = r.p""")
def refill_overlay(spark, d):
    """Whole passes replaced, but for those with a chunk in quarantine."""
    li = table(spark, d, "lineitem")
    base = li.groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    refills = base.where("l_orderkey % 3 = 0").withColumn("q", F.col("q") * 2)
    out = verdicts.replace_passes(base, refills, li.where("l_returnflag = 'R' and l_discount > 0.08"), ["l_orderkey", "l_linestatus"], ["q"])
    return out.select("l_orderkey", "l_linestatus", F.round("q", 4).alias("q"), "replaced")


@query(_CELL + "select field, count(*) filter (where doc_id % 2 = 0 and not found) as flagged, count(*) as n from w group by 1")
def flag_patch(spark, d):
    """Cells named in a quarantine and grounded nowhere are flagged."""
    cells, _, docs = _cells(spark, d)
    out = verdicts.flag_ungrounded(cells, cells.where("doc_id % 2 = 0"), docs, "doc_id")
    return out.groupBy("field").agg(F.count_if("flag").alias("flagged"), F.count("*").alias("n"))


@query("""
select user_id, event_id, n_attempts from (select *, count(*) over (partition by user_id) as n_attempts, row_number() over (partition by user_id order by event_type = 'purchase' desc, value > 50 desc, event_id) as r from events where user_id % 5 <> 0) where r = 1""")
def best_attempt(spark, d):
    """A user's best event: a purchase, then a large one, then the first; settled users are left out."""
    from ..operators import link

    e = table(spark, d, "events")
    settled = e.where("user_id % 5 = 0").select("user_id").distinct()
    open_ = e.join(settled, "user_id", "left_anti")
    best = link.first_by(open_, ["user_id"], [(F.col("event_type") == "purchase").desc(), (F.col("value") > 50).desc(), F.col("event_id")])
    return best.join(open_.groupBy("user_id").agg(F.count("*").alias("n_attempts")), "user_id").select("user_id", "event_id", "n_attempts")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def latest_wins(spark, d):
    """The last entry of each key in an append-only log."""
    from ..operators import link

    return link.first_by(table(spark, d, "events"), ["user_id"], [F.col("event_id").desc()]).select("user_id", "event_type", "event_id")
