"""Queries of single values: identifiers and names, absence vocabularies, rescue levels, numbers and answers, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ident, text, vocab
from ..operators import cells
from .catalog import query, table
from .rule_queries import _deal

_MARKS = ["https://doi.org/10.1109/A.", " doi: 10.1000/x(1)", "http://dx.doi.org/10.5555/Y", "see 10.1234/q, and 10.1234/Q;", "none of them", "(10.7777/z)"]
_GIVEN = f"{_deal('o_orderkey', _MARKS)} || case when o_orderkey % 6 in (3, 4) then '' else cast(o_custkey as string) end"
_TRIM = r"regexp_replace(regexp_replace({}, '^[ \t\r\n.,;)]+|[ \t\r\n.,;)]+$', '', 'g'), '^\(+', '')"
_CANON = _TRIM.format(r"regexp_replace(regexp_replace(trim(v), '(?i)^\s*https?://(dx\.)?doi\.org/\s*', ''), '(?i)^\s*doi\s*:\s*', '')")


@query(rf"""
with g as (select {_GIVEN.replace('as string)', 'as varchar)')} as v, o_custkey from orders), c as (select v, lower({_CANON}) as doi from g)
select v, doi, regexp_matches(doi, '\b10\.\d{{4,9}}/\S+\b') as like_doi, array_to_string(list_transform(list_distinct(list_transform(regexp_extract_all(v, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+'), lambda x: regexp_replace(lower(x), '[.,;:)]+$', ''))), lambda x: x), ' ') as found,
  substr(regexp_replace(regexp_replace(lower(doi), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) as stable, regexp_replace(doi, '[^A-Za-z0-9._-]+', '_', 'g') as file, 'S' || regexp_replace(lower(trim(doi)), '[^0-9a-z]', '_', 'g') as key, count(*) as n from c group by all""")
def identifier_forms(spark, d):
    """The canonical form of a DOI, those in a text, and names made of one."""
    v = table(spark, d, "orders").select(F.expr(_GIVEN).alias("v"))
    v = v.withColumn("doi", ident.canonical_doi(F.col("v")))
    # the order of the SQL's distinct list is not fixed, that of the function is; texts hold one DOI or two equal ones
    out = v.select("v", "doi", ident.is_doi_like(F.col("doi")).alias("like_doi"), F.array_join(ident.dois_in(F.col("v")), " ").alias("found"), ident.stable_name(F.col("doi")).alias("stable"), ident.safe_file_name(F.col("doi")).alias("file"), ident.citation_key(F.col("doi")).alias("key"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


_WORDS = [None, "", " ", "None", "NULL", "not_reported", "Not Reported", "none_reported", "n/a", "NA", "nr", "-", "nan", "False", "not_applicable", "nor reported", "a value"]
_IN = lambda words: "(" + ", ".join("'" + w + "'" for w in words) + ")"


@query(f"""
with w as (select {_deal('p_partkey', _WORDS)} as v, p_brand from part)
select p_brand, v, {', '.join(f"v is null or lower(trim(v)) in {_IN(words)} as {stage}" for stage, words in vocab.ABSENCE.items())}, case when v is null or lower(trim(v)) in {_IN(vocab.ABSENCE['metadata'])} then '' else trim(v) end as cleaned, count(*) as n from w group by all""")
def absence_by_stage(spark, d):
    """What counts as absent at each stage, and what the cleaner leaves."""
    w = table(spark, d, "part").select("p_brand", F.expr(_deal("p_partkey", _WORDS)).alias("v"))
    out = w.select("p_brand", "v", *[text.is_absent(F.col("v"), stage).alias(stage) for stage in vocab.ABSENCE], text.clean(F.col("v")).alias("cleaned"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


_SOURCE = "'We train a hybrid quantum-' || chr(10) || 'classical model on ' || o_orderpriority || ' (with depth ' || o_custkey || ') here.'"
_QUOTE = """case o_orderkey % 6 when 0 then 'hybrid quantumclassical model on ' || o_orderpriority when 1 then 'quantum-classical model' when 2 then '"quantum-classical model on ' || o_orderpriority || '"!' when 3 then 'with depth / ' || o_custkey || ' - here' when 4 then 'no such phrase ' || o_custkey else '' end"""
_LEVELS = """case o_orderkey % 6 when 0 then 'R0' when 1 then 'R1' when 2 then 'R2' when 3 then 'R3' else 'unverified' end"""


@query(f"select o_orderpriority, {_LEVELS} as level, count(*) as n from orders group by 1, 2")
def rescue_levels(spark, d):
    """How a quote is found: as it stands, rejoined, without outer signs, or by letters and digits alone."""
    o = table(spark, d, "orders").select("o_orderpriority", F.expr(_SOURCE.replace("|| o_custkey ||", "|| cast(o_custkey as string) ||")).alias("s"), F.expr(_QUOTE).alias("q"))
    return o.groupBy("o_orderpriority", text.rescue_level(F.col("q"), F.col("s")).alias("level")).agg(F.count("*").alias("n"))


_ANSWERS = ["Yes, on request", "no", None, " YES", "yesterday", "TRUE"]
_UNVERIFIED = ["C.qubit_count; D.evidence", "A.title", "", None, "B.x, B.x; y"]
_PEOPLE = """case c_custkey % 4 when 0 then 'Doe, J.' when 1 then 'Doe, J., Collective' when 2 then 'Doe, J., Collective, Roe, ' || left(c_name, 1) || '., et al.' else '' end"""


@query(f"""
with c as (select c_custkey, c_name, c_acctbal, {_deal('c_custkey', _ANSWERS)} as answer, {_deal('c_custkey', _UNVERIFIED)} as cell from customer)
select c_custkey, 1000 + c_custkey as first_number, cast(floor(c_custkey % 7 * 1600 + length(c_name) * 0.25) as bigint) as tokens, lower(trim(coalesce(answer, ''))) like 'yes%' as said_yes,
  case c_custkey % 5 when 0 then 'qubit_count,evidence' when 1 then 'title' when 4 then 'x,y' else '' end as fields, {_PEOPLE} as authors, 'dual-positron a-b-c ' || c_custkey as joined from c""")
def numbers_and_answers(spark, d):
    """First numbers, token estimates, answers, field lists, authors and rejoined words."""
    c = table(spark, d, "customer").withColumn("answer", F.expr(_deal("c_custkey", _ANSWERS))).withColumn("cell", F.expr(_deal("c_custkey", _UNVERIFIED)))
    k = F.col("c_custkey")
    person = lambda f, g, x: F.struct(F.lit(f).alias("family"), (F.lit(g) if isinstance(g, str) or g is None else g).cast("string").alias("given"), F.lit(x).cast("string").alias("literal"))
    doe, group, roe, last = person("Doe", "Jane", None), person("", None, "Collective"), person("Roe", F.col("c_name"), None), person("Poe", "E", None)
    people = F.slice(F.array(doe, group, roe, last), 1, F.when(k % 4 == 0, 1).when(k % 4 == 1, 2).when(k % 4 == 2, 4).otherwise(0))
    return c.select(
        "c_custkey",
        text.first_int(F.concat(F.lit("about "), F.format_number(k + 1000, 0), F.lit(" of 9"))).alias("first_number"),
        text.token_estimate(k % 7, F.length("c_name")).alias("tokens"),
        text.said_yes(F.col("answer")).alias("said_yes"),
        F.array_join(cells.unverified_fields(F.col("cell")), ",").alias("fields"),
        text.first_authors(people).alias("authors"),
        text.dehyphenate(F.concat(F.lit("dual- positron a- b- c "), k.cast("string"))).alias("joined"),
    )
