"""Queries over the star schema, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import derive, fold, link, stats, validate
from ..sources.store import fresh_path
from .catalog import query, table

_RULES = """list_filter([case when json_extract(props, '$') is null then 'props_invalid' end, case when event_type not in ('view', 'click', 'purchase') then 'type_invalid' end, case when value is null then 'value_missing' end, case when value > 100 then 'value_high' end, case when user_id % 7 = 0 then 'user_blocked' end], lambda x: x is not null)"""


def _checked_events(events):
    rules = [
        ("props_invalid", F.try_parse_json("props").isNull()),
        ("type_invalid", ~F.col("event_type").isin("view", "click", "purchase")),
        ("value_missing", F.col("value").isNull()),
        ("value_high", F.col("value") > 100),
        ("user_blocked", F.col("user_id") % 7 == 0),
    ]
    return events.withColumn("errors", validate.errors(rules))


@query(f"select event_id, array_to_string({_RULES}, ',') as errors from events")
def verdict_errors(spark, d):
    """Error codes of each event."""
    return _checked_events(table(spark, d, "events")).select("event_id", F.array_join("errors", ",").alias("errors"))


@query(f"select e as code, count(*) as n from (select unnest({_RULES}) as e from events) group by e")
def error_histogram(spark, d):
    """F15."""
    return validate.histogram(_checked_events(table(spark, d, "events")))


_ROUTE = f"""
with c as (select event_id, user_id, value, len({_RULES}) as k from events),
f as (select *, min(case when k = 0 then event_id end) over (partition by user_id) as first from c)
select route, count(*) as n from (select case when k > 0 then 'quarantine' when user_id in (select c_custkey from customer where c_custkey % 3 = 0) or event_id > first then 'duplicate' else 'keep' end as route from f) group by route"""


@query(_ROUTE)
def quarantine_split(spark, d):
    """Routes of events, one kept for each user that is not known yet."""
    known = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    routed = validate.route(_checked_events(table(spark, d, "events")), known, "user_id", order="event_id")
    return routed.groupBy("route").agg(F.count("*").alias("n"))


@query()
def stream_ingest_events(spark, d):
    """S1 as a stream: the events kept after ingesting the table once."""
    from ..streaming.ingest import ingest

    home = fresh_path(spark, "ingest")
    schema = table(spark, d, "events").schema
    source = f"{d}/events.parquet"
    folder = source.rsplit("/", 1)[0] + "/events.parque[t]"
    ingest(spark, folder, schema, _checked_events, "user_id", "event_id", home + "/kept", home + "/quarantine", home + "/checkpoint")
    return spark.read.parquet(home + "/kept").select("event_id", "user_id", "event_type", "value")


@query("""
select o_custkey, y as o_year, n from (select o_custkey, y, n, row_number() over (partition by o_custkey order by n desc, y desc) as r from (select o_custkey, cast(year(o_orderdate) as integer) as y, count(*) as n from orders group by 1, 2)) where r = 1""")
def year_mode(spark, d):
    """F2, X11."""
    return link.modal(table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("o_year")), ["o_custkey"], "o_year")


@query("""
select c_custkey, coalesce(big, any_price, c_acctbal) as value, case when big is not null then 'large_order' when any_price is not null then 'order' when c_acctbal is not null then 'balance' else 'none' end as source
from customer left join (select o_custkey, max(o_totalprice) filter (where o_totalprice > 200000) as big, max(o_totalprice) as any_price from orders group by 1) on o_custkey = c_custkey""")
def first_acceptable_cascade(spark, d):
    """a customer's value from the first source that has one."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))).alias("big"), F.max("o_totalprice").alias("any_price"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    return link.cascade(c, [("large_order", F.col("big")), ("order", F.col("any_price")), ("balance", F.col("c_acctbal"))], "value", "source").select("c_custkey", "value", "source")


@query("select c_custkey, c_name, n_orders, n_orders is not null as found_in_any from customer left join (select o_custkey, count(*) as n_orders from orders group by 1) on o_custkey = c_custkey")
def left_preserving_merge(spark, d):
    """E1, E2."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return link.preserving_merge(table(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("""
select provenance, count(*) as n from (select case when v1.k is not null then 'v1_reused' when v2.k is not null then 'v2' else 'failed' end as provenance from part
  left join (select distinct l_partkey as k from lineitem where l_quantity > 48) v1 on v1.k = p_partkey left join (select distinct l_partkey as k from lineitem where l_returnflag = 'R' and l_discount > 0.09) v2 on v2.k = p_partkey) group by provenance""")
def priority_coalesce_provenance(spark, d):
    """E3, F16."""
    li = table(spark, d, "lineitem")
    v1 = li.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("a", F.lit(1))
    v2 = li.where("l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("b", F.lit(1))
    p = table(spark, d, "part").select("p_partkey").join(v1, "p_partkey", "left").join(v2, "p_partkey", "left")
    return link.cascade(p, [("v1_reused", F.col("a")), ("v2", F.col("b"))], "value", "provenance").select(F.when(F.col("provenance") == "none", "failed").otherwise(F.col("provenance")).alias("provenance")).groupBy("provenance").agg(F.count("*").alias("n"))


@query("""
select c_custkey, cast(floor((row_number() over (order by c_custkey) - 1) / 25) as bigint) as batch from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)""")
def anti_join_resume(spark, d):
    """Customers without a large order, in batches of 25."""
    done = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return link.remaining(table(spark, d, "customer").select("c_custkey"), done, "c_custkey", "c_custkey", 25)


@query("""
select l_orderkey, l_linenumber, l_suppkey, cast(floor((row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey) - 1) / 1000) as bigint) as batch
from lineitem where l_suppkey is not null and l_suppkey not in (select s_suppkey from supplier where s_acctbal > 5000)""")
def resume_batches(spark, d):
    """All columns of the lines whose supplier is not done, in batches of a thousand."""
    done = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"]
    return link.remaining(table(spark, d, "lineitem"), done, "l_suppkey", order, 1000).select("l_orderkey", "l_linenumber", "l_suppkey", "batch")


@query("select c_mktsegment, count(*) as n from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') group by 1")
def semi_join(spark, d):
    """E6."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""
select s_suppkey, coalesce(a.n_name, b.n_name) as n_name, case when a.n_nationkey is not null then 'k1' when b.n_regionkey is not null then 'k2' else 'none' end as matched_by
from (select s_suppkey, case when s_suppkey % 3 = 0 then null else s_nationkey end as k1, s_nationkey % 5 as k2 from supplier) left join nation a on a.n_nationkey = k1 left join (select n_regionkey, min(n_name) as n_name from nation group by 1) b on b.n_regionkey = k2""")
def two_key_fallback(spark, d):
    """By nation, else by region."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("k1"), (F.col("s_nationkey") % 5).alias("k2"))
    n = table(spark, d, "nation")
    by_region = n.groupBy("n_regionkey").agg(F.min("n_name").alias("n_name")).select(F.lit(None).cast("int").alias("n_nationkey"), "n_regionkey", "n_name")
    keyed = n.select("n_nationkey", F.lit(None).cast("int").alias("n_regionkey"), "n_name").unionByName(by_region)
    return link.fallback_lookup(s, keyed, ("k1", "n_nationkey"), ("k2", "n_regionkey"), "n_name", "n_name").select("s_suppkey", "n_name", "matched_by")


@query("select l_orderkey, array_to_string(list_transform(list_sort(list({'l': l, 'v': l_shipmode})), lambda x: x.v), ';') as vals from (select l_orderkey, l_returnflag as l_shipmode, min(l_linenumber) as l from lineitem group by 1, 2) group by 1")
def fold_union(spark, d):
    """F5."""
    out = fold.fold_union(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag")
    return out.select("l_orderkey", F.array_join("vals", ";").alias("vals"))


@query("""
select l_orderkey, arg_min(l_returnflag, -g * 100 + l_linenumber) as grade, count(distinct g) > 1 as disagreement from (select l_orderkey, l_linenumber, l_returnflag, case l_returnflag when 'N' then 0 when 'A' then 1 when 'R' then 2 end as g from lineitem) group by 1""")
def fold_grade(spark, d):
    """Return flags as grades."""
    return fold.fold_grade(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag", ["N", "A", "R"])


@query("select l_orderkey, bool_or(l_discount > 0.08) as any_true, count(distinct l_discount > 0.08) > 1 as mixed from lineitem group by 1")
def fold_bool(spark, d):
    """F7."""
    return fold.fold_bool(table(spark, d, "lineitem").withColumn("b", F.col("l_discount") > 0.08), ["l_orderkey"], "b")


@query("""
select l_orderkey, val, array_to_string(list_sort(list_filter(vs, lambda x: x <> val)), ';') as alternates from (select l_orderkey, arg_min(l_linestatus || l_returnflag, {'l': l_linenumber, 'v': l_linestatus || l_returnflag}) as val, list_distinct(list(l_linestatus || l_returnflag)) as vs from lineitem where l_quantity > 10 group by 1)""")
def fold_scalar(spark, d):
    """F8."""
    v = table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_quantity") > 10, F.concat("l_linestatus", "l_returnflag")))
    return fold.fold_scalar(v, ["l_orderkey"], "l_linenumber", "v").select("l_orderkey", "val", F.array_join("alternates", ";").alias("alternates"))


@query("""select l_orderkey, round(coalesce(sum(l_quantity) filter (where l_linestatus = 'O'), 0), 4) as "O", round(coalesce(sum(l_quantity) filter (where l_linestatus = 'F'), 0), 4) as "F" from lineitem group by 1""")
def consolidate_pivot(spark, d):
    """F10."""
    out = fold.consolidate(table(spark, d, "lineitem"), ["l_orderkey"], "l_linestatus", ["O", "F"], F.sum("l_quantity"))
    return out.select("l_orderkey", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("O", "F")])


_OVERLAY = "select o_orderkey, case when o_orderkey % 10 = 0 and o_orderstatus = 'F' then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 10 = 0 and o_orderstatus = 'F' then 'F' end as replaced, o_orderkey % 10 = 0 and o_orderstatus = 'F' as corrected from orders"


def _overlaid(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    fixes = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("new"), F.lit("F").alias("old"))
    return fold.overlay(orders, fixes, "o_orderkey", "o_orderstatus", "new", "old")


@query(_OVERLAY)
def overlay_coalesce(spark, d):
    """Guarded corrections."""
    return _overlaid(spark, d)


@query(f"select corrected, replaced, count(*) as n from ({_OVERLAY}) group by 1, 2")
def overlay_audit(spark, d):
    """What the corrections did."""
    return _overlaid(spark, d).groupBy("corrected", "replaced").agg(F.count("*").alias("n"))


@query("""
select o_orderkey, tier, quality from (select o_orderkey, case when c and d and w then 'code_plus_data_plus_weights' when c then 'code_only' when d then 'data_only' when w then 'weights_or_circuit_params_only' else 'none' end as tier,
  case when n <= 2 then 'low_concern' when n <= 4 then 'moderate_concern' else 'high_concern' end as quality from (
  select o_orderkey, bool_or(l_discount > 0.05) as c, bool_or(l_tax > 0.05) as d, bool_or(l_returnflag = 'R') as w,
    cast(bool_or(l_discount > 0.05) as int) + cast(bool_or(l_tax > 0.05) as int) + cast(bool_or(l_returnflag = 'R') as int) + cast(count(*) < 3 as int) + cast(max(l_quantity) < 25 as int) as n
  from orders join lineitem on l_orderkey = o_orderkey group by 1))""")
def derived_summary_quality(spark, d):
    """H3, H4, H9 on signals of an order's lines."""
    flags = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").groupBy("o_orderkey").agg(
        F.bool_or(F.col("l_discount") > 0.05).alias("c"), F.bool_or(F.col("l_tax") > 0.05).alias("d"), F.bool_or(F.col("l_returnflag") == "R").alias("w"), (F.count("*") < 3).alias("few"), (F.max("l_quantity") < 25).alias("small")
    )
    return flags.select("o_orderkey", derive.reproducibility(F.col("c"), F.col("d"), F.col("w")).alias("tier"), derive.summary_quality([F.col(x) for x in ("c", "d", "w", "few", "small")]).alias("quality"))


_FAMILY = "case when p_type like 'STANDARD%' or p_type like 'PROMO%' then 'common' when p_type like 'ECONOMY%' then 'budget' else 'other' end"


@query(f"select {_FAMILY} as family, count(*) as n, count(distinct p_brand) as brands from part group by 1")
def prefix_family(spark, d):
    """F19, F20."""
    p = table(spark, d, "part").withColumn("family", derive.prefix_family(F.col("p_type"), [("STANDARD", "common"), ("PROMO", "common"), ("ECONOMY", "budget")]))
    return p.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("select axis, count(*) as n from (select case p_size % 6 when 0 then 'quantum_machine_learning' when 1 then 'qaoa_quantum_optimisation' when 2 then 'frqi_neqr_encoding' when 3 then 'frqi_neqr_encoding' when 4 then 'variational_algorithms' else 'other' end as axis from part) group by 1")
def axis_rollup(spark, d):
    """H13, F40."""
    kinds = F.array(*map(F.lit, ["qml", "qaoa", "frqi", "neqr", "vqe", "no_such"]))
    return table(spark, d, "part").select(derive.paradigm_axis(kinds[F.col("p_size") % 6]).alias("axis")).groupBy("axis").agg(F.count("*").alias("n"))


_METRICS = {"all": "true", "urgent": "o_orderpriority = '1-URGENT'", "open": "o_orderstatus = 'O'", "dear": "o_totalprice > 150000", "recent": "o_orderdate >= timestamp '1996-01-01'"}
_REGISTRY = " union all ".join(f"select '{k}' as metric, count(*) filter (where {v}) as everyone, count(*) filter (where ({v}) and o_custkey % 10 <> 0) as restricted from orders" for k, v in _METRICS.items())


def _registry(spark, d):
    return stats.registry(table(spark, d, "orders"), {k: F.expr(v.replace("timestamp '", "timestamp_ntz '")) for k, v in _METRICS.items()}, {"everyone": F.lit(True), "restricted": F.expr("o_custkey % 10 <> 0")})


@query(_REGISTRY)
def metric_registry(spark, d):
    """all metrics and populations in one pass."""
    return _registry(spark, d)


@query(f"select metric, everyone - restricted as delta, cast(floor(100.0 * restricted / everyone + 0.5) as bigint) as percent from ({_REGISTRY})")
def metric_delta(spark, d):
    """F18, F21, F22."""
    return _registry(spark, d).select("metric", (F.col("everyone") - F.col("restricted")).alias("delta"), text.half_up(100.0 * F.col("restricted") / F.col("everyone")).alias("percent"))


@query("select count(*) filter (where k = 3) as all_of, count(*) filter (where k >= 2) as two_or_more, count(*) filter (where k >= 1) as any_of from (select cast(l_quantity > 25 as int) + cast(l_discount > 0.05 as int) + cast(l_returnflag = 'R' as int) as k from lineitem)")
def kofn_criteria(spark, d):
    """F23."""
    return stats.k_of_n(table(spark, d, "lineitem"), [F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_returnflag") == "R"])


@query("""select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "n_F", count(*) filter (where o_orderstatus = 'O') as "n_O", count(*) as total from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1""")
def crosstab_totals(spark, d):
    """F24, X30."""
    return stats.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["F", "O"])


_RATED = "select 'quality' as field, cast(quality as varchar) as a, cast(cast(d.n_chars > 500 as int) as varchar) as b from labels l join documents d on d.doc_id = l.doc_id union all select 'toxic', cast(toxic as varchar), cast(cast(contains(lower(d.text), 'idiot') as int) as varchar) from labels l join documents d on d.doc_id = l.doc_id"
_KAPPA = f"""
with p as ({_RATED}), t as (select field, count(*) as n, count(*) filter (where a = b) as k from p group by 1),
x as (select field, a as v, count(*) as x from p group by 1, 2), y as (select field, b as v, count(*) as y from p group by 1, 2),
e as (select x.field, sum(x.x * y.y) as xy from x join y on x.field = y.field and x.v = y.v group by 1),
f as (select t.field, n, k / n as po, coalesce(xy, 0) / (n * n) as pe from t left join e on e.field = t.field)"""


def _kappa(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "text"), "doc_id")
    cells = F.array(
        F.struct(F.lit("quality").alias("field"), F.col("quality").cast("string").alias("a"), (F.col("n_chars") > 500).cast("int").cast("string").alias("b")),
        F.struct(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("a"), F.contains(F.lower("text"), F.lit("idiot")).cast("int").cast("string").alias("b")),
    )
    return stats.cohen(t.select(F.explode(cells).alias("c")).select("c.*"), "a", "b", ["field"])


def _rounded(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in ("po", "pe", "kappa") else F.col(c) for c in names])


@query(_KAPPA + "select field, n, round(po, 6) as po, round(pe, 6) as pe, round((po - pe) / nullif(1 - pe, 0), 6) as kappa from f")
def cohen_kappa_field(spark, d):
    """F26."""
    return _rounded(_kappa(spark, d), ["field", "n", "po", "pe", "kappa"])


@query(_KAPPA + ", g as (select cast(sum(n) as bigint) as n, sum(po * n) / sum(n) as po, sum(pe * n) / sum(n) as pe from f) select n, round(po, 6) as po, round(pe, 6) as pe, round((po - pe) / nullif(1 - pe, 0), 6) as kappa from g")
def cohen_kappa_composite(spark, d):
    """F27, X14."""
    return _rounded(stats.composite(_kappa(spark, d)), ["n", "po", "pe", "kappa"])


@query(f"""
with p as (select field, nullif(a, '0') as a, nullif(b, '0') as b from ({_RATED}))
select mode, field, count(*) as n, cast(sum(cast(case when a is not null and b is not null then a = b else mode = 'agree' end as int)) as bigint) as agreed
from p, (values ('exclude'), ('agree'), ('disagree')) m(mode) where (a is not null or b is not null) and (mode <> 'exclude' or (a is not null and b is not null)) group by 1, 2""")
def pair_policy_modes(spark, d):
    """one-sided pairs left out, agreeing or disagreeing."""
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "text"), "doc_id")
    one = lambda c: F.when(c, F.lit("1"))
    cells = F.array(
        F.struct(F.lit("quality").alias("field"), one(F.col("quality") == 1).alias("a"), one(F.col("n_chars") > 500).alias("b")),
        F.struct(F.lit("toxic").alias("field"), one(F.col("toxic") == 1).alias("a"), one(F.contains(F.lower("text"), F.lit("idiot"))).alias("b")),
    )
    p = t.select(F.explode(cells).alias("c"), F.array(*map(F.lit, ["exclude", "agree", "disagree"])).alias("modes")).select("c.*", F.explode("modes").alias("mode"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    p = p.where((F.col("a").isNotNull() | F.col("b").isNotNull()) & ((F.col("mode") != "exclude") | both))
    return p.groupBy("mode", "field").agg(F.count("*").alias("n"), F.count_if(F.when(both, F.col("a") == F.col("b")).otherwise(F.col("mode") == "agree")).alias("agreed"))


@query('select event_type, "next", count(*) as n from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as "next" from events) where "next" is not null group by 1, 2')
def transition_matrix(spark, d):
    """F17."""
    return stats.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("select o_orderstatus, count(*) as n, cast(floor(100.0 * count(*) / (select count(*) from orders) + 0.5) as bigint) as percent from orders group by 1")
def percent_half_up(spark, d):
    """F22, X21."""
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return o.join(F.broadcast(o.agg(F.sum("n").alias("t"))), F.lit(True)).select("o_orderstatus", "n", text.half_up(100.0 * F.col("n") / F.col("t")).alias("percent"))


@query("select o_custkey, count(*) as n from orders group by 1 order by n desc, min(o_orderkey) limit 15")
def topk_ties(spark, d):
    """The fifteen most frequent, ties by first appearance."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("f")).orderBy(F.desc("n"), "f").limit(15).select("o_custkey", "n")


@query("""
select key, arg_min(name, s) as name, min(s) as stream from (select c_custkey as key, c_name as name, 0 as s from customer where c_custkey % 2 = 0 union all select s_suppkey, s_name, 1 from supplier union all select c_custkey, c_name, 2 from customer) group by 1""")
def union_first_wins(spark, d):
    """Three streams, the first to name a key wins."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return link.union_first([c.where("key % 2 = 0"), s, c], "key").select("key", "name", "stream")


@query("""
select (select count(*) from (select c_custkey from customer intersect select o_custkey from orders)) as both_sides, (select count(*) from (select c_custkey from customer except select o_custkey from orders)) as only_left, (select count(*) from (select o_custkey from orders except select c_custkey from customer)) as only_right""")
def set_ops_counts(spark, d):
    """From one full outer join of the keys."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("b", F.lit(1))
    j = a.join(b, "k", "full")
    return j.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("both_sides"), F.count_if(F.expr("a = 1 and b is null")).alias("only_left"), F.count_if(F.expr("b = 1 and a is null")).alias("only_right"))


@query("select o_orderkey from orders order by md5(cast(o_orderkey as varchar) || '#42'), o_orderkey limit 150")
def hash_sample(spark, d):
    """A seeded sample of fixed size, by a hash of key and seed."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("#42"))), "o_orderkey").limit(150)


@query("""
select status, count(*) as n from (select case when json_valid(p) then 'valid' when regexp_matches(p, '^\\{\\s*"[a-z_]+"\\s*:\\s*[^,}]') then 'recovered' else 'error' end as status
  from (select case when event_id % 3 = 0 then substr(props, 1, length(props) - 4) else props end as p from events)) group by 1""")
def json_repair_status(spark, d):
    """A third of the objects cut short, then read as far as they go."""
    p = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 4)")).otherwise(F.col("props"))
    t = table(spark, d, "events").select(p.alias("p"))
    status = F.when(F.try_parse_json("p").isNotNull(), "valid").when(F.col("p").rlike(r'^\{\s*"[a-z_]+"\s*:\s*[^,}]'), "recovered").otherwise("error")
    return t.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))
