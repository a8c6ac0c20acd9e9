"""Queries of the corpus flow: joins with provenance, checks, distributions, sets, links and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ident, text, vocab
from ..operators import corpus, link, validate
from .catalog import query, table
from .rule_queries import _deal


@query("select o_orderpriority, o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) as reused, count(*) as n from orders group by 1, 2")
def reuse_split(spark, d):
    """Finished orders with a large line, told apart from the rest."""
    li = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpus.split_by(table(spark, d, "orders"), li, "o_orderkey", F.col("o_orderstatus") == "F").groupBy("o_orderpriority", "reused").agg(F.count("*").alias("n"))


@query("""
with f as (select doc_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then 'short' end as t from documents), b as (select doc_id, case when doc_id % 4 = 0 then text when doc_id % 4 = 1 then '' end as t from documents)
, v as (select b.t as b, f.t as f, length(trim(b.t, ' ' || chr(10))) >= 250 and len(regexp_split_to_array(trim(b.t, ' ' || chr(10)), '[ \n]+')) >= 30 as bv, length(trim(f.t, ' ' || chr(10))) >= 250 and len(regexp_split_to_array(trim(f.t, ' ' || chr(10)), '[ \n]+')) >= 30 as fv from b join f on f.doc_id = b.doc_id)
select case when bv then 'original' when fv then 'recovered' else 'none' end as provenance, count(*) as n, cast(coalesce(sum(length(case when bv then b when fv then f end)), 0) as bigint) as chars from v group by 1""")
def text_provenance(spark, d):
    """A document's own text, else a recovered one, with provenance."""
    docs = table(spark, d, "documents")
    b = docs.select("doc_id", F.expr("case when doc_id % 4 = 0 then text when doc_id % 4 = 1 then '' end").alias("t"))
    f = docs.select("doc_id", F.expr("case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then 'short' end").alias("t"))
    out = corpus.merged_text(b, f, "doc_id", "t", validate.long_enough)
    return out.groupBy("provenance").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars"))


@query("""
with s as (select conv_id, turn, text from conversations where length(text) > 0)
select a.conv_id, a.first_turn, b.long_turn from (select conv_id, min(turn) as first_turn from s group by 1) a join (select conv_id, turn as long_turn from (select *, row_number() over (partition by conv_id order by length(text) desc, turn) as r from s) where r = 1) b on a.conv_id = b.conv_id""")
def text_strategies(spark, d):
    """the first turn with a text, and the longest."""
    c = table(spark, d, "conversations")
    first = corpus.candidate_text(c, "conv_id", "text", "turn", longest=False).select("conv_id", F.col("turn").alias("first_turn"))
    return first.join(corpus.candidate_text(c, "conv_id", "text", "turn", longest=True).select("conv_id", F.col("turn").alias("long_turn")), "conv_id")


@query("""
select 'updated' as what, count(*) as n, round(sum(o_totalprice * 2), 2) as total from orders where o_orderkey % 9 = 0 union all select 'unchanged', count(*), round(sum(o_totalprice), 2) from orders where o_orderkey % 9 <> 0
union all select 'kept', count(*), round(sum(l_extendedprice), 2) from lineitem where l_orderkey % 9 <> 0 or l_orderkey not in (select o_orderkey from orders) union all select 'removed', count(*), round(sum(l_extendedprice), 2) from lineitem where l_orderkey % 9 = 0 and l_orderkey in (select o_orderkey from orders)""")
def upsert_invalidation(spark, d):
    """Updated orders, and the lines that lose their ground."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))
    fresh, kept, removed = corpus.upsert(o, o.where("k % 9 = 0").withColumn("v", F.col("v") * 2), li, "k", "v")
    total = lambda df, name: df.agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")).select(F.lit(name).alias("what"), "n", "total")
    return total(fresh.where("updated"), "updated").unionByName(total(fresh.where("not updated"), "unchanged")).unionByName(total(kept, "kept")).unionByName(total(removed, "removed"))


@query("""
select c_mktsegment, n_name is not null as has_nation, o.k is not null as has_orders, s.k is not null as has_supplier, count(*) as n from customer left join (select * from nation where n_regionkey < 3) on n_nationkey = c_nationkey left join (select distinct o_custkey as k from orders where o_totalprice > 300000) o on o.k = c_custkey left join (select distinct s_suppkey as k from supplier) s on s.k = c_custkey group by 1, 2, 3, 4""")
def candidate_enrichment(spark, d):
    """Customers with what three sources know of them."""
    c = table(spark, d, "customer")
    nations = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    out = corpus.enriched(corpus.enriched(c, [("nation", nations)], "c_nationkey"), [("orders", o), ("supplier", s)], "c_custkey")
    return out.groupBy("c_mktsegment", "has_nation", "has_orders", "has_supplier").agg(F.count("*").alias("n"))


@query("""
select l.doc_id, quality, toxic, n_chars from labels l join documents d on d.doc_id = l.doc_id where quality = 0 or toxic = 1""")
def rater_join(spark, d):
    """Documents that both tables know, flagged ones in order."""
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.where("quality = 0 or toxic = 1").orderBy(F.desc("toxic"), "quality", "doc_id")


_OLD = _deal("o_orderkey", ["QC_FOR_IMAGING", "OTHER", "QUANTUM_DOTS"])
_NEW = _deal("o_orderkey", ["QC_FOR_IMAGING", "OTHER", "OTHER", "QC_FOR_IMAGING", "OTHER"])
_CONF = [_deal("o_orderkey", ["high", "low"]), _deal("o_orderkey", ["low", "high", "high"])]


@query(f"""
with b as (select o_orderkey, {_OLD} as oc, {_CONF[0]} as of, {_NEW} as nc, {_CONF[1]} as nf, o_orderkey % 11 <> 0 as there from orders)
select oc as old_category, case when there then nc else '(missing)' end as new_category, case when not there then 'missing' when of = nf then 'stable' when of = 'low' then 'up' else 'down' end as trend,
  count(*) filter (where there and oc <> nc) as changed, count(*) filter (where there and oc <> nc and nc = 'QC_FOR_IMAGING') as flip_in, count(*) filter (where there and oc <> nc and oc = 'QC_FOR_IMAGING') as flip_out, count(*) as n from b group by 1, 2, 3""")
def verdict_diff(spark, d):
    """Earlier outcomes against the present ones."""
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.expr(_OLD).alias("category"), F.expr(_CONF[0]).alias("confidence"))
    new = o.where("o_orderkey % 11 <> 0").select("o_orderkey", F.expr(_NEW).alias("category"), F.expr(_CONF[1]).alias("confidence"))
    out = corpus.outcome_diff(old, new, "o_orderkey", "QC_FOR_IMAGING")
    return out.groupBy("old_category", "new_category", "trend").agg(*[F.count_if(c).alias(c) for c in ("changed", "flip_in", "flip_out")], F.count("*").alias("n"))


_VENUE = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
with p as (select p_partkey, {_VENUE("p_name || '!'")} as name, {_VENUE("p_brand")} as brand, p_type, p_size from part),
a as (select distinct {_VENUE("p_name")} as k from part where p_partkey % 50 = 0), b as (select distinct {_VENUE("p_brand")} as k from part where p_size = 7), c as (select distinct p_type as k from part where p_retailprice > 1000 and p_size < 3)
select sources, count(*) as n from (select array_to_string(list_filter([case when a.k is not null then 'journal' end, case when b.k is not null then 'publisher' end, case when c.k is not null then 'kind' end], lambda x: x is not null), ',') as sources from p left join a on a.k = p.name left join b on b.k = p.brand left join c on c.k = p.p_type) group by 1""")
def venue_check(spark, d):
    """Which lists name a part, by normalised names."""
    p = table(spark, d, "part")
    lists = [
        ("journal", text.venue_name(F.concat("p_name", F.lit("!"))), p.where("p_partkey % 50 = 0").select(text.venue_name(F.col("p_name")).alias("k")), "k"),
        ("publisher", text.venue_name(F.col("p_brand")), p.where("p_size = 7").select(text.venue_name(F.col("p_brand")).alias("k")), "k"),
        ("kind", F.col("p_type"), p.where("p_retailprice > 1000 and p_size < 3").select(F.col("p_type").alias("k")), "k"),
    ]
    return corpus.membership(p, lists).select(F.array_join("sources", ",").alias("sources")).groupBy("sources").agg(F.count("*").alias("n"))


_MERGED = {"field": _deal("l_orderkey", ["qubit_count", "dataset_name", "title"]), "verdict": _deal("l_partkey", ["fills_blank", "confirms", "contradicts"]), "value": _deal("l_suppkey", ["1,234 qubits", "MNIST", "some", "12", "toy data"])}


@query(f"""
with v as (select l_orderkey % 300 as sn, {", ".join(f"{v} as {k}" for k, v in _MERGED.items())}, l_quantity > 48 as figure, l_orderkey * 10 + l_linenumber as ord, l_shipmode0 as quote from (select *, l_returnflag || l_linestatus as l_shipmode0 from lineitem)),
m as (select sn, field, verdict, value, figure, count(*) as occurrences, min(ord) as ord from v group by 1, 2, 3, 4, 5),
n as (select *, try_cast(replace(regexp_extract(value, '[0-9][0-9,]*'), ',', '') as bigint) as k from m)
select case when figure then 'review:figure_only_unverified' when verdict = 'fills_blank' and field = 'qubit_count' and k is null then 'review:unparseable_number' when verdict = 'fills_blank' and field = 'qubit_count' and (k < 1 or k > 1000) then 'hold:out_of_range'
  when field = 'dataset_name' and lower(value) in ('toy data', 'mnist') then 'hold:suspected_control_dataset' when verdict = 'contradicts' then 'review:extraction_vs_si_disagreement' else 'review' end as flag, count(*) as n, cast(sum(occurrences) as bigint) as occurrences, cast(sum(ord) as bigint) as first_ords from n group by 1""")
def verdict_merge(spark, d):
    """Equal verdicts counted once, then flagged for review."""
    li = table(spark, d, "lineitem")
    v = li.select((F.col("l_orderkey") % 300).alias("sn"), *[F.expr(e).alias(k) for k, e in _MERGED.items()], (F.col("l_quantity") > 48).alias("figure"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("quote"))
    m = corpus.merged_verdicts(v, ["sn", "field", "verdict", "value", "figure"], "ord", ["ord", "quote"])
    flag = corpus.review_flag(F.col("field"), F.col("verdict"), F.col("value"), F.col("figure"), {"qubit_count": (1, 1000)}, ["toy data", "mnist"])
    return m.select(flag.alias("flag"), "occurrences", "ord").groupBy("flag").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"), F.sum("ord").alias("first_ords"))


@query("""
select side, count(*) as n, min(k) as first_key from (select distinct o_custkey as k, 'missing' as side from orders where o_custkey % 4 <> 0 and o_custkey not in (select c_custkey from customer where c_custkey % 3 <> 0) union select c_custkey, 'stray' from customer where c_custkey % 3 <> 0 and c_custkey not in (select o_custkey from orders where o_custkey % 4 <> 0)) group by 1""")
def stray_and_missing(spark, d):
    """Keys that only one side has."""
    a = table(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    return corpus.two_way(a, b, "k").groupBy("side").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query("""
select o_custkey, arg_min(o_orderpriority, o_orderkey) as o_orderpriority from orders where o_orderpriority in ('2-HIGH', '3-MEDIUM') group by 1""")
def first_wanted(spark, d):
    """A customer's first priority that is among those wanted."""
    wanted = spark.createDataFrame([("2-HIGH",), ("3-MEDIUM",)], "o_orderpriority string")
    return corpus.first_match(table(spark, d, "orders"), wanted, "o_custkey", "o_orderpriority", "o_orderkey")


@query("""
select source, count(*) as n, cast(coalesce(sum(length(v)), 0) as bigint) as chars from (select case when l.doc_id is not null then 'csl' when b.item_id is not null then 'cache' when p.page_id is not null then 'fetch' when d.lang = 'en' then 'workbook' else 'none' end as source,
  case when l.doc_id is not null then 'q' || quality when b.item_id is not null then b.text when p.page_id is not null then p.url when d.lang = 'en' then d.source end as v
  from documents d left join labels l on l.doc_id = d.doc_id left join benchmark b on b.item_id = d.doc_id left join pages p on p.page_id = d.doc_id) group by 1""")
def source_cascade(spark, d):
    """A document's entry from the first of four sources."""
    docs = table(spark, d, "documents")
    keyed = lambda name, key, value: table(spark, d, name).select(F.col(key).alias("doc_id"), value)
    rows = docs.join(keyed("labels", "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("a")), "doc_id", "left").join(keyed("benchmark", "item_id", F.col("text").alias("b")), "doc_id", "left").join(keyed("pages", "page_id", F.col("url").alias("c")), "doc_id", "left")
    out = link.cascade(rows, [("csl", F.col("a")), ("cache", F.col("b")), ("fetch", F.col("c")), ("workbook", F.when(F.col("lang") == "en", docs["source"]))], "v", "found")
    return out.groupBy(F.col("found").alias("source")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("v")), F.lit(0)).alias("chars"))


@query("""
with o as (select o_orderkey, o_custkey, o_totalprice, case when o_orderkey % 6 = 0 then null else 'f' || o_orderkey || '.pdf' end as path from orders),
r as (select o_orderkey, case when l_returnflag = 'R' then 'retrieved' else 'failed' end as status from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 1 where o_orderkey % 2 = 0)
select state, status, count(*) as n from (select coalesce(r.status, 'missing') as status, case when o.path is null then 'no_path' when o.o_orderkey % 10 = 1 then 'in_place' when o.o_orderkey % 4 = 3 then 'source_missing' else 'to_copy' end as state from o left join r on r.o_orderkey = o.o_orderkey) group by 1, 2""")
def fetch_write_back(spark, d):
    """Results of fetches written back, and what to do with each file."""
    o = table(spark, d, "orders")
    path = F.expr("case when o_orderkey % 6 <> 0 then 'f' || o_orderkey || '.pdf' end")
    rows = o.select("o_orderkey", F.lit("missing").alias("status"), path.alias("path"))
    lines = table(spark, d, "lineitem").where("l_linenumber = 1 and l_orderkey % 2 = 0")
    got = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "retrieved").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("path"))
    out, _ = corpus.write_back(rows, got, "o_orderkey")
    files = o.select("o_orderkey", F.expr("'f' || o_orderkey || '.pdf'").alias("path"), F.expr("'f' || o_orderkey || '.pdf'").alias("name"))
    state = corpus.file_status(out.withColumn("name", F.col("path")), files.where("o_orderkey % 4 <> 3").select("path"), files.where("o_orderkey % 10 = 1").select("name"), "path", "name")
    return state.groupBy("state", "status").agg(F.count("*").alias("n"))


_SCREEN = {"primary_category": _OLD, "secondary_category": _deal("o_orderkey", [None, "OTHER", None, "QUANTUM_DOTS"]), "confidence": _CONF[0]}


@query(f"""
with v as (select o_orderkey, {", ".join(f"{e} as {k}" for k, e in _SCREEN.items())} from orders)
select field, value, count(*) as n from (select 'primary_category' as field, primary_category as value from v union all select 'secondary_category', secondary_category from v union all select 'confidence', confidence from v
  union all select 'in_scope', case when primary_category = 'QC_FOR_IMAGING' and confidence = 'high' then 'yes' when primary_category = 'QC_FOR_IMAGING' and confidence = 'low' then 'uncertain' else 'no' end from v) where value is not null group by 1, 2""")
def screening_summary(spark, d):
    """Distributions of categories and confidence, and what is in scope."""
    v = table(spark, d, "orders").select(*[F.expr(e).alias(k) for k, e in _SCREEN.items()])
    v = v.withColumn("in_scope", corpus.in_scope(F.col("primary_category"), F.col("confidence"), "QC_FOR_IMAGING"))
    return corpus.distributions(v, [*_SCREEN, "in_scope"])


@query("""
select c_mktsegment, string_agg(s || '=' || n, ',' order by s) as statuses, any_value(p) as priorities from (select c_mktsegment, o_orderstatus as s, count(*) as n from orders join customer on c_custkey = o_custkey group by 1, 2) a
join (select c_mktsegment, string_agg(s || '=' || n, ',' order by s) as p from (select c_mktsegment, o_orderpriority as s, count(*) as n from orders join customer on c_custkey = o_custkey group by 1, 2) group by 1) b using (c_mktsegment) group by 1""")
def nested_report(spark, d):
    """A report with a map of counts for each column."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    out = corpus.nested_counts(rows, "c_mktsegment", ["o_orderstatus", "o_orderpriority"])
    line = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("c_mktsegment", line("o_orderstatus").alias("statuses"), line("o_orderpriority").alias("priorities"))


@query("select cast(year(o_orderdate) as integer) as o_year, count(*) as n, count(*) filter (where c_custkey is null) as unmatched from orders left join (select * from customer where c_custkey % 5 <> 0) on c_custkey = o_custkey group by 1")
def year_histogram(spark, d):
    """Orders by year, and how many found no customer."""
    c = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    o = corpus.enriched(table(spark, d, "orders"), [("customer", c)], "o_custkey")
    return o.groupBy(F.year("o_orderdate").alias("o_year")).agg(F.count("*").alias("n"), F.count_if(~F.col("has_customer")).alias("unmatched"))


@query("""
select c_mktsegment, count(*) as n, round(avg(c_acctbal), 4) as mean_balance, count(*) filter (where c_acctbal < 0) as negative, cast(sum(case when k is null then 1 else 0 end) as bigint) as gap from customer left join (select distinct o_custkey as k from orders where o_orderstatus = 'P') on k = c_custkey group by rollup(c_mktsegment)""")
def harvest_summary(spark, d):
    """counts, means and gaps by segment, and in all."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    c = corpus.enriched(table(spark, d, "customer"), [("pending", o)], "c_custkey")
    return c.rollup("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(~F.col("has_pending")).alias("gap"))


_NAMES = ["si/Table_results.xlsx", "oa/paper.pdf", "deposits/x/train.npy", "README.md", "si/supp.pdf", "code/run.ipynb", "deposits/model_config.json", "si/dataset.csv", "oa/meta.json", "fig/one.PNG", "deposits/all.tar.gz", "deposits/manifest.txt", "src/a.py", "_chrome_si/s.docx", "notes.odd", "deposits/labels.json"]


@query(f"""
with f as (select event_id, user_id, {_deal("event_id", _NAMES)} as p from events), g as (select *, lower(regexp_extract(p, '[^/]+$')) as base, lower(regexp_extract(p, '(\\.[^./]+)$', 1)) as ext, '/' || lower(p) as lp from f),
k as (select *, case {" ".join(f"when ext in ({', '.join(repr(e) for e in es)}) then '{k}'" for k, es in vocab.FILE_KINDS.items())} else 'other' end as kind, case when lp like '%/\\_chrome\\_si/%' escape '\\' then 'chrome_si' when lp like '%/si/%' then 'si' when lp like '%/deposits/%' then 'deposit' when lp like '%/oa/%' then 'oa' else 'other' end as source from g),
r as (select *, regexp_matches(base, 'dataset|train|test|label|annotation') as isdata, regexp_matches(base, 'config|hyperparam|settings|params') as isconf, regexp_matches(base, 'metric|result|performance|score|accuracy') as ismet from k)
select kind, source, case when source in ('chrome_si', 'si', 'deposit') and kind in ('pdf', 'spreadsheet', 'document', 'data') then 'si_enrichment' when kind = 'code' then 'code' when source = 'oa' and kind = 'pdf' then 'full_text_redundant' when source = 'oa' and kind = 'data' then 'metadata' when kind in ('image', 'archive') then kind else 'other' end as relevance,
  case when ext = '.ipynb' then 'notebook' when kind in ('pdf', 'document') and source in ('chrome_si', 'si', 'deposit') then 'si_document' when regexp_matches(base, '^read[^a-z0-9_]?me') then 'readme'
  when (ext in ('.yaml', '.yml', '.cfg', '.ini', '.toml') or (isconf and ext in ('.json', '.py', '.txt', ''))) and (not isdata or isconf) then 'config' when kind = 'spreadsheet' and ismet then 'metrics_table' when ext in ('.npy', '.npz', '.mat', '.h5', '.hdf5', '.pkl') then 'array_dump'
  when regexp_matches(base, 'manifest|checksum|md5|sha256') then 'manifest' when kind = 'spreadsheet' then 'dataset_table' when kind = 'pdf' and source = 'oa' then 'full_text_redundant' when kind = 'data' and source = 'oa' then 'metadata' when kind = 'image' then 'image' when kind = 'code' then 'bulk_code' when kind = 'data' then 'data_other' when kind = 'archive' then 'archive_container' else 'other' end as reason, count(*) as n
from r group by 1, 2, 3, 4""")
def file_filter(spark, d):
    """Kinds, sources and relevance of files, and which stay."""
    p = F.expr(_deal("event_id", _NAMES))
    f = table(spark, d, "events").select(p.alias("p")).withColumn("kind", ident.file_kind(F.col("p"))).withColumn("source", ident.file_source(F.col("p")))
    f = f.withColumn("relevance", ident.file_relevance(F.col("source"), F.col("kind"))).withColumn("reason", corpus.file_decision(F.col("p"), F.col("kind"), F.col("source"))["reason"])
    return f.groupBy("kind", "source", "relevance", "reason").agg(F.count("*").alias("n"))


_SUBS = _deal("p_partkey", ["qml", "review_or_perspective", "other_unresolved", None, "quantum_inspired"])


@query(f"""select case when s is null or s = 'other_unresolved' then 'review_manually' when s in ('review_or_perspective', 'quantum_inspired') then 'exclude' else 'include' end as decision, case when s is null then 'missing' when s = 'other_unresolved' then 'unresolved' when s = 'review_or_perspective' then 'no primary study' when s = 'quantum_inspired' then 'no quantum part' else '' end as reason, count(*) as n from (select {_SUBS} as s from part) group by 1, 2""")
def eligibility_cull(spark, d):
    """Decisions with reasons, counted."""
    out = corpus.eligibility(F.expr(_SUBS), {"review_or_perspective": "no primary study", "quantum_inspired": "no quantum part"})
    return table(spark, d, "part").select(out.alias("x")).groupBy("x.decision", "x.reason").agg(F.count("*").alias("n"))


_LABELS = _deal("p_partkey", ["brain; lung", "lung", "", None, "Brain", " brain ;skin"])


@query(f"""
select count(*) filter (where upper(coalesce(flag, '')) = 'TRUE') as yes, count(*) filter (where list_contains(list_transform(string_split(coalesce(ls, ''), ';'), lambda x: trim(x)), 'brain')) as brain, count(*) filter (where coalesce(ls, '') <> '') as nonempty,
  count(*) filter (where not coalesce(lower(trim(ls)) in ('', 'not_reported', 'not reported', 'nr', 'n/a', 'na'), true)) as reported from (select {_LABELS} as ls, {_deal("p_partkey", ["TRUE", "false", "True", None])} as flag from part)""")
def metric_predicates(spark, d):
    """Predicates of the statistics."""
    p = table(spark, d, "part").select(F.expr(_LABELS).alias("ls"), F.expr(_deal("p_partkey", ["TRUE", "false", "True", None])).alias("flag"))
    return p.agg(F.count_if(F.upper("flag") == "TRUE").alias("yes"), F.count_if(corpus.labelled(F.col("ls"), "brain")).alias("brain"), F.count_if(F.coalesce("ls", F.lit("")) != "").alias("nonempty"), F.count_if(~text.is_absent(F.col("ls"), "statistics")).alias("reported"))


@query("""
with a as (select l_partkey, l_quantity from lineitem where l_linenumber <= 3), b as (select l_partkey, l_quantity from lineitem where l_linenumber >= 2), ca as (select l_partkey, l_quantity, count(*) as x from a group by 1, 2), cb as (select l_partkey, l_quantity, count(*) as y from b group by 1, 2)
select cast(sum(greatest(coalesce(x, 0) - coalesce(y, 0), 0)) as bigint) as only_left, cast(sum(greatest(coalesce(y, 0) - coalesce(x, 0), 0)) as bigint) as only_right from ca full join cb on ca.l_partkey = cb.l_partkey and ca.l_quantity = cb.l_quantity""")
def row_audit(spark, d):
    """Rows that only one of two tables has, after a check of both."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    a = corpus.checked(li.where("l_linenumber <= 3"), F.col("l_quantity") > 0, "quantity").drop("l_linenumber")
    return corpus.same_rows(a, li.where("l_linenumber >= 2").drop("l_linenumber"))


@query("""
with o as (select o_custkey, lower(trim(o_orderpriority)) as p, o_orderkey from orders)
select 'distinct' as what, count(distinct p) as n from o union all select 'taken', count(*) from (select * from o order by o_orderkey limit 40) union all select 'without_one', count(*) from o where o_custkey <> 7 union all select 'without_links', count(*) from customer where c_custkey not in (select o_custkey from o)
union all select 'appended', (select count(*) from supplier) + count(*) from customer where c_custkey not in (select s_suppkey from supplier)""")
def small_sets(spark, d):
    """Distinct keys, the first ones, all but one, those without links, appended ones."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    parts = [
        count(o.select(F.lower(F.trim("o_orderpriority")).alias("p")).distinct(), "distinct"),
        count(o.orderBy("o_orderkey").limit(40), "taken"),
        count(corpus.without(o, "o_custkey", 7), "without_one"),
        count(c.join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti"), "without_links"),
        count(corpus.append_absent(s, c, "k"), "appended"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select p_brand, p_name, n from (select p_brand, p_name, count(*) as n from part group by 1, 2) order by n desc, p_name desc, p_brand desc limit 12")
def top_fields(spark, d):
    """The twelve most frequent pairs, ties by name downwards."""
    return table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("p_name"), F.desc("p_brand")).limit(12)


@query("""
with m as (select l_orderkey, l_linenumber, l_returnflag, l_shipdate, count(*) over (partition by l_orderkey) as k from lineitem)
select b, count(*) as n from (select case when count(*) filter (where l_returnflag = 'R') = 0 then '0' when count(*) filter (where l_returnflag = 'R') <= 2 then '1-2' when count(*) filter (where l_returnflag = 'R') <= 5 then '3-5' else '6+' end as b from m group by l_orderkey) group by 1""")
def section_buckets(spark, d):
    """orders by the number of returned lines."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return n.groupBy(corpus.buckets(F.col("k")).alias("b")).agg(F.count("*").alias("n"))


@query("""
with e as (select user_id, event_id, value, case when event_type = 'purchase' then event_id end as mark from events), f as (select *, last_value(mark ignore nulls) over (partition by user_id order by event_id) as heading from e)
select user_id, coalesce(heading, -1) as heading, count(*) as n, round(sum(value), 4) as total from f group by 1, 2""")
def heading_fill(spark, d):
    """Events counted under the last purchase before them."""
    e = table(spark, d, "events").withColumn("heading", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return corpus.forward_fill(e, "user_id", "event_id", "heading").groupBy("user_id", F.coalesce("heading", F.lit(-1)).alias("heading")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select l_orderkey, l_linestatus, string_agg(l_returnflag, ',' order by o, l_returnflag) as fields from (select l_orderkey, l_linestatus, l_returnflag, min(l_linenumber) as o from lineitem group by 1, 2, 3) group by 1, 2")
def quarantine_groups(spark, d):
    """The distinct fields of each group, in order of appearance."""
    return corpus.grouped_fields(table(spark, d, "lineitem"), ["l_orderkey", "l_linestatus"], "l_returnflag", "l_linenumber").select("l_orderkey", "l_linestatus", F.array_join("fields", ",").alias("fields"))


@query("select count(*) as rows, count(*) filter (where trim(coalesce(text, '')) <> '') as text, count(*) filter (where trim(coalesce(toxic, '')) <> '') as toxic from (select d.text, cast(l.toxic as varchar) as toxic from documents d left join labels l on l.doc_id = d.doc_id)")
def entry_completeness(spark, d):
    """F44."""
    return corpus.completeness(table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left"), ["text", "toxic"])


_KINDS = [("flags", "list"), ("grade", "grade"), ("open", "bool"), ("first", "scalar")]


@query("""
with c as (select l_orderkey, l_linenumber, l_returnflag as flags, case l_returnflag when 'N' then 'weak' when 'A' then 'strong' else 'odd' end as grade, case when l_linestatus = 'O' then 'true' else 'false' end as open, case when l_quantity > 10 then l_linestatus || l_returnflag end as first, count(*) over (partition by l_orderkey) as k0 from lineitem),
n as (select l_orderkey, count(distinct l_linenumber) as k, min(l_linenumber) as lone, (select 1) as z from c group by 1),
u as (select l_orderkey, string_agg(flags, '; ' order by o, flags) as value from (select l_orderkey, flags, min(l_linenumber) as o from c group by 1, 2) group by 1),
g as (select l_orderkey, arg_min(grade, (case grade when 'strong' then -1 when 'weak' then 0 else 1 end) * 1000 + l_linenumber) as value from c group by 1),
b as (select l_orderkey, case when bool_or(open = 'true') then 'true' else 'false' end as value from c group by 1),
s as (select l_orderkey, arg_min(first, {'l': l_linenumber, 'v': first}) as value, min(l_linenumber) as m from c where first is not null group by 1),
x as (select l_orderkey, 'flags' as field, value, null as m from u union all select l_orderkey, 'grade', value, null from g union all select l_orderkey, 'open', value, null from b union all select l_orderkey, 'first', value, m from s)
select x.l_orderkey, field, value, case when k > 1 then 'merged' else cast(coalesce(m, lone) as varchar) end as chunk_id from x join n on n.l_orderkey = x.l_orderkey""")
def merge_dispatch(spark, d):
    """Each field folded as its kind asks."""
    li = table(spark, d, "lineitem")
    values = F.array(
        F.struct(F.lit("flags").alias("field"), F.col("l_returnflag").alias("value")),
        F.struct(F.lit("grade").alias("field"), F.when(F.col("l_returnflag") == "N", "weak").when(F.col("l_returnflag") == "A", "strong").otherwise("odd").alias("value")),
        F.struct(F.lit("open").alias("field"), F.when(F.col("l_linestatus") == "O", "true").otherwise("false").alias("value")),
        F.struct(F.lit("first").alias("field"), F.when(F.col("l_quantity") > 10, F.concat("l_linestatus", "l_returnflag")).alias("value")),
    )
    cells = li.select("l_orderkey", "l_linenumber", F.explode(values).alias("c")).select("l_orderkey", "l_linenumber", "c.*")
    kinds = spark.createDataFrame(_KINDS, "field string, kind string")
    return corpus.merge_by_kind(cells, ["l_orderkey"], "field", "l_linenumber", "value", kinds, ["weak", "strong"]).select("l_orderkey", "field", "value", "chunk_id")


@query("""
select doc_id, cast(page as bigint) as page, cast((page - 1) * floor(length(text) / 7) as bigint) as char_start, cast(case when page < 7 then page * floor(length(text) / 7) else length(text) end as bigint) as char_end from documents, range(1, 8) r(page) where text is not null""")
def even_pages(spark, d):
    """Seven pages of equal length."""
    out = corpus.even_pages(table(spark, d, "documents").where("text is not null"), "doc_id", "text", F.lit(7))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("page", "char_start", "char_end")])


@query("select l_orderkey || '_' || l_linenumber || '_' || p as task_id, p as pass from lineitem, (values ('A'), ('B')) t(p)")
def task_manifest(spark, d):
    """A task for each paper, chunk and pass."""
    return corpus.manifest(table(spark, d, "lineitem"), ["A", "B"], "l_orderkey", "l_linenumber").select("task_id", "pass")


@query("""
with f as (select l_orderkey as k, l_linenumber as o, l_returnflag || l_linestatus as c, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as p from lineitem), g as (select *, row_number() over (partition by k, c order by p, o) as r from f)
select k, sha1(c) as digest, row_number() over (partition by k order by p, o, sha1(c)) as rank from g where r = 1""")
def unit_build(spark, d):
    """P5: each content once for a paper, by priority."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("o"), F.concat("l_returnflag", "l_linestatus").alias("c"), F.expr("case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end").alias("p"))
    return corpus.units(f, "k", "c", "p", "o").select("k", "digest", F.col("rank").cast("long").alias("rank"))


_LOCATORS = ["https://github.com/a/b", "10.5281/zenodo.123", "https://zenodo.org/record/1", "in the appendix", "https://example.org/x", "10.1234/abc", "MNIST", "http://www.kaggle.com/d", "https://doi.org/10.1016/j.x.1"]


@query(f"""
with c as (select event_id, {_deal("event_id", _LOCATORS)} as v, case event_id % 2 when 0 then 'code_url' else 'data_identifier' end as f from events),
r as (select *, regexp_matches(v, '(?i)https?://') as u, regexp_matches(v, '(?i)\\b10\\.[0-9]{{4,9}}/|doi\\.org/') as o, regexp_matches(v, '(?i)github|gitlab|bitbucket|codeocean') as g, regexp_matches(v, '(?i)zenodo|figshare|dryad|osf\\.io') as z from c)
select case when g then 'code_repository' when z and o and not u then 'data_doi' when z then 'data_repository' when f = 'code_url' then 'code_repository' when o and not u then 'data_doi' when u then 'external_data_url' else 'named_dataset_ref' end as kind, g or z or (f = 'code_url' and (u or o)) or (f <> 'code_url' and o and not u) as fetch,
  case when g or z then '' when f = 'code_url' and not (u or o) then 'locator_unresolved' when f = 'code_url' then '' when o and not u then '' when u then 'review' else 'not_a_target' end as note,
  case when regexp_matches(v, 'github\\.com|zenodo\\.org') then 'author_deposit' when contains(v, 'kaggle.com') then 'public_portal' when contains(v, '10.1016/j.x.1') then 'article_doi' when f = 'code_url' and event_id % 3 = 0 then 'si_reference' when u or o then 'other_url' else 'other' end as class, count(*) as n from r group by 1, 2, 3, 4""")
def link_triage(spark, d):
    """What cells with locators are, and whether to fetch them."""
    c = table(spark, d, "events").select("event_id", F.expr(_deal("event_id", _LOCATORS)).alias("v"), F.expr("case event_id % 2 when 0 then 'code_url' else 'data_identifier' end").alias("f"))
    kind = F.when((F.col("f") == "code_url") & (F.col("event_id") % 3 == 0), "supplementary_material")
    out = c.select(ident.triage(F.col("f"), F.col("v")).alias("t"), ident.link_class(F.col("v"), kind, F.lit("10.1016/j.x.1")).alias("class"))
    return out.groupBy("t.kind", "t.fetch", "t.note", "class").agg(F.count("*").alias("n"))


_DOIS = ["see DOI 10.1109/ABC.12;", "https://doi.org/10.1364/x", "10.9999/zz", "none", "doi:10.18280/ria.1)."]


@query(f"""
with c as (select event_id, {_deal("event_id", _DOIS)} as v from events), f as (select event_id, v, regexp_replace(regexp_extract(v, '(?i)(10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '[.,;:)]+$', '') as doi from c),
g as (select *, case when lower(doi) like '10.%' then split_part(lower(doi), '/', 1) else '' end as prefix from f)
select doi, case prefix {" ".join(f"when '{k}' then '{v}'" for k, v in vocab.PUBLISHERS.items())} else prefix end as publisher, case when doi = '' then 'unknown' else regexp_replace(split_part(doi, '/', -1), '[^A-Za-z0-9_.-]', '_', 'g') end as name, substr(sha256(v), 1, 16) as hash, count(*) as n from g group by 1, 2, 3, 4""")
def doi_publishers(spark, d):
    """DOIs found in texts, their publishers and names."""
    c = table(spark, d, "events").select(F.expr(_deal("event_id", _DOIS)).alias("v")).withColumn("doi", ident.found_doi(F.col("v")))
    return c.groupBy("doi", ident.publisher(F.col("doi")).alias("publisher"), ident.safe_record_id(F.col("doi")).alias("name"), ident.prompt_hash(F.col("v")).alias("hash")).agg(F.count("*").alias("n"))


@query(r"""
with p as (select page_id, url, html, list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')) as hs, regexp_extract(url, '^[a-z]+://[^/?#]*') as host, regexp_extract(url, '^[a-z]+://[^?#]*/') as folder, regexp_extract(url, '^([a-z]+:)//', 1) as scheme from pages),
a as (select page_id, list_distinct(list_transform(hs, lambda x: case when regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:') then x when starts_with(x, '//') then scheme || x when starts_with(x, '/') then host || x else case when length(folder) > length(host) then folder else host || '/' end || x end)) as ls from p)
select page_id, len(ls) as n_links, len(list_filter(ls, lambda u: contains(lower(u), '/pdf') or lower(u) like '%.pdf' or contains(lower(u), '.pdf?') or contains(lower(u), 'europepmc'))) as n_pdf, md5(array_to_string(list_sort(ls), ' ')) as digest from a""")
def absolute_links(spark, d):
    """Absolute targets of a page, each once, and how many look like PDFs."""
    p = table(spark, d, "pages").withColumn("ls", ident.hrefs(F.col("html"), F.col("url")))
    return p.select("page_id", F.size("ls").cast("long").alias("n_links"), F.size(F.filter("ls", lambda u: ident.is_pdf_like(u))).cast("long").alias("n_pdf"), F.md5(F.array_join(F.array_sort("ls"), " ")).alias("digest"))


@query(r"""
select doc_id, len(regexp_extract_all(text, '�')) >= 2 or len(regexp_extract_all(text, 'Ã|â€™|â€“|â€œ')) >= 2 or length(text) < 60 or length(text) = 0 as garbled from documents where text is not null""")
def garbled_texts(spark, d):
    """Texts that look damaged; line feeds of these tables are few enough to count as they are."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", text.garbled(F.regexp_replace("text", r"[\n\t\r\x{a0}]", " "), 60).alias("garbled"))


@query(r"""
with s as (select doc_id, text, substr(text, 9, 40) as q from documents), f as (select doc_id, trim(regexp_replace(lower(coalesce(case doc_id % 3 when 0 then translate(q, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 1 then replace(q, ' ', '') else q || ' zzz' end, '')), '\s+', ' ', 'g')) as q, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) as t from s)
select doc_id, (q <> '' and contains(t, q)) or (length(regexp_replace(q, '[^a-z0-9]+', '', 'g')) >= 15 and contains(regexp_replace(t, '[^a-z0-9]+', '', 'g'), regexp_replace(q, '[^a-z0-9]+', '', 'g'))) as grounded from f""".replace(r"\s", vocab.WHITE))
def link_grounding(spark, d):
    """Quotes found with white space and case folded, or by letters and digits alone."""
    s = table(spark, d, "documents").withColumn("q", F.substring("text", 9, 40))
    q = F.when(F.col("doc_id") % 3 == 0, F.translate("q", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(F.col("doc_id") % 3 == 1, F.replace("q", F.lit(" "), F.lit(""))).otherwise(F.concat("q", F.lit(" zzz")))
    return s.select("doc_id", text.grounded_link(q, F.col("text")).alias("grounded"))


_HEADS = ["1. Introduction", "Abstract", "a) Methods", "2) Results and Discussion:", "In our methods we see. it", "IV. Conclusions", "Data: something long", "A B S T R A C T", "Appendix B"]


@query(f"""
with e as (select event_id, {_deal("event_id", _HEADS)} as h from events), d as (select user_id, e.event_id, h, row_number() over (partition by user_id order by e.event_id) as i from e join events v on v.event_id = e.event_id),
n as (select *, case h when '1. Introduction' then 'introduction' when 'Abstract' then 'abstract' when 'a) Methods' then 'methods' when '2) Results and Discussion:' then 'results' when 'IV. Conclusions' then 'conclusion' when 'A B S T R A C T' then 'abstract' when 'Appendix B' then 'appendix' end as s, event_id % 4 <> 0 as blank from d),
c as (select * from n where s is not null and (blank or i = 1)),
k as (select *, min(case when s = 'introduction' then i end) over (partition by user_id) as first_intro from c),
m as (select *, max(case when s = 'abstract' and (first_intro is null or i < first_intro) then i end) over (partition by user_id) as a1, max(case when s = 'abstract' then i end) over (partition by user_id) as a2 from k)
select user_id, string_agg(s, ',' order by i) as sections from m where s <> 'abstract' or i = coalesce(a1, a2) group by 1""")
def section_headers(spark, d):
    """Headings of texts put together from lines; of repeated abstracts the last before the introduction stays."""
    from ..operators import segment

    e = table(spark, d, "events").select("user_id", "event_id", F.expr(_deal("event_id", _HEADS)).alias("h"))
    # a heading follows a blank line, but for every fourth one, and a line of prose follows it
    line = F.concat(F.when(F.col("event_id") % 4 != 0, "\n").otherwise(""), "h", F.lit("\nsome words of prose here\n"))
    texts = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("t")))), lambda x: x["t"]), "").alias("t"))
    texts = texts.withColumn("t", F.regexp_replace("t", r"^\n", ""))
    out = segment.sections(texts, "user_id", "t")
    return out.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "section"))), lambda x: x["section"]), ",").alias("sections"))
