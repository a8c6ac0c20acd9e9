"""Queries of records: abstracts, columns of unlike tables, bibliographic shapes, nested fields, derived fields, metrics, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import abstracts, ident
from ..operators import columns, derive, flatten, link, records, stats
from ..sources import log
from ..sources.store import fresh_path
from ..streaming import queue
from .catalog import query, table
from .rule_queries import _deal

# how a document's text is set, by its id: as it is; under a heading with a stop; under a stamp and two headings; spaced
# letters without a stop; too short behind its heading; in capitals
_SET = """case doc_id % 6 when 1 then 'Some title' || chr(10) || chr(10) || 'ABSTRACT:  ' || text || chr(10) || 'Keywords: a, b'
  when 2 then 'Please cite this article as: x' || chr(10) || 'Abstract' || chr(10) || 'of the stamp' || chr(10) || '1. Introduction of it' || chr(10) || chr(10) || 'Abstract - ' || text || chr(10) || chr(10) || 'i. introduction' || chr(10) || text
  when 3 then 'Title' || chr(10) || 'A B S T R A C T' || chr(10) || 'Index terms - ' || text
  when 4 then 'Summary' || chr(10) || 'too short' || chr(10) || 'Introduction ' || chr(10) || chr(10) || 'University of x, y' || text || chr(10) || ' ' || chr(10) || text
  when 5 then upper(text) || chr(10) || chr(10) || text || chr(10) || 'Methods' || chr(10) || 'x' else text end"""
# tags that end a block are two line feeds, other tags one blank
_RENDERED = r"regexp_replace(regexp_replace(html, '(?i)</(p|div|h[1-6]|li|tr|table|ul|ol|title|head)[ \t]*>', chr(10) || chr(10), 'g'), '<[^>]*>', ' ', 'g')"


@query(f"""
with given as (select 'd' || doc_id as id, {_SET} as text from documents union all select 'p' || page_id, {_RENDERED} from pages)
select id, how, length(abstract) as n_chars, md5(abstract) as digest from {abstracts.located_sql('given')}""")
def located_abstracts(spark, d):
    """Where the abstract of a document or of a page's text stands, and how it was found."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.expr(_SET).alias("text"))
    ends = F.regexp_replace("html", r"(?i)</(p|div|h[1-6]|li|tr|table|ul|ol|title|head)[ \t]*>", "\n\n")
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.regexp_replace(ends, "<[^>]*>", " ").alias("text"))
    out = docs.unionByName(pages).select("id", abstracts.located(F.col("text")).alias("a"))
    return out.select("id", "a.how", F.length("a.abstract").cast("long").alias("n_chars"), F.md5("a.abstract").alias("digest"))


_DOI_OF = {
    "customer": "case when c_custkey % 3 = 0 then 'https://doi.org/10.1000/C' || c_custkey when c_custkey % 3 = 1 then 'unavailable' end",
    "part": "case when p_partkey % 9 = 0 then ' doi: 10.2000/P' || p_partkey || ').' else 'none' end",
    "supplier": "'10.3000/s' || s_suppkey",
    "orders": "case when o_orderkey % 200 = 0 then '10.4000/o' else o_orderpriority end",
}
_WANTED = ["Title", "Authors", "PublicationYear", "Journal", "Keywords", "ManuscriptLink"]


def _unlike(spark, d):
    t = {n: table(spark, d, n) for n in _DOI_OF}
    x = lambda n: F.expr(_DOI_OF[n])
    return {
        # two columns whose names hold 'doi': shares are equal, the preferred name wins
        "customer": t["customer"].select(x("customer").alias("DOI"), x("customer").alias("DOI Link"), F.col("c_name").alias("Authors"), F.col("c_mktsegment").alias("Author Keywords"), F.col("c_name").alias("Author Full-Names")),
        # the identifier stands in a column of no telling name; title ties go to the first column
        "part": t["part"].select(F.col("p_name").alias("Article Title"), F.col("p_type").alias("Article_Title"), F.col("p_brand").alias("Source Title"), x("part").alias("note"), F.lit(None).cast("string").alias("DOI")),
        "supplier": t["supplier"].select(F.col("s_name").alias("title"), (F.col("s_suppkey") + 1900).alias("Year"), x("supplier").alias("Accession"), F.col("s_name").alias("Unnamed: title"), F.col("s_nationkey").alias("Journal Publisher")),
        # too few identifiers in any column
        "orders": t["orders"].select(x("orders").alias("what"), F.col("o_orderdate").alias("Publication-Year"), F.col("o_orderstatus").alias("PDF link"), F.col("o_orderpriority").alias("Record url")),
    }


_CANON = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce({}, '')), '(?i)^\s*https?://(dx\.)?doi\.org/\s*', ''), '(?i)^\s*doi\s*:\s*', ''), '^[ \t\r\n.,;)]+|[ \t\r\n.,;)]+$', '', 'g'), '^\(+', ''))"


@query(f"""
with s as (
  select 'customer' as origin, {_CANON.format(_DOI_OF['customer'])} as doi, '' as "Title", c_name as "Authors", '' as "PublicationYear", '' as "Journal", c_mktsegment as "Keywords", '' as "ManuscriptLink" from customer
  union all select 'part', {_CANON.format(_DOI_OF['part'])}, p_name, '', '', p_brand, '', '' from part
  union all select 'supplier', {_CANON.format(_DOI_OF['supplier'])}, s_name, '', cast(cast(s_suppkey + 1900 as bigint) as varchar), '', '', '' from supplier
  union all select 'orders', '', '', '', cast(o_orderdate as varchar), '', '', o_orderstatus from orders)
select origin, doi like '10.%' as found, count(*) as n, count(distinct doi) as dois, cast(sum(cast('0x' || substr(h, 1, 12) as bigint)) as bigint) as digest
from (select *, md5(concat_ws('|', doi, "Title", "Authors", "PublicationYear", "Journal", "Keywords", "ManuscriptLink")) as h from s) group by 1, 2""")
def standard_columns(spark, d):
    """Four tables of unlike columns in one schema, their identifiers found by what the columns hold."""
    out = None
    for origin, df in _unlike(spark, d).items():
        one = columns.standardised(df, _WANTED).select(F.lit(origin).alias("origin"), "*")
        out = one if out is None else out.unionByName(one)
    h = out.withColumn("h", F.md5(F.concat_ws("|", "doi", *_WANTED)))
    return h.groupBy("origin", F.col("doi").startswith("10.").alias("found")).agg(
        F.count("*").alias("n"), F.count_distinct("doi").alias("dois"), stats.wrapped_sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("long")).alias("digest")
    )


@query(r"""
with p as (select p_partkey as k, p_partkey % 5 as s, p_name, p_brand, p_type, p_size, p_partkey % 7 as v from part)
select k, ['csl', 'crossref', 'openalex', 'semanticscholar', 'unpaywall'][s + 1] as shape,
  case when s = 4 then '' else p_name end as "Title",
  case s when 0 then p_brand || ', A; Only' when 1 then p_brand || ', A; Solo' when 2 then p_brand when 3 then p_brand || '; B' else '' end as "Authors",
  case s when 1 then p_type || '; Lab' when 2 then p_type else '' end as "Affiliations",
  case s when 0 then p_type when 1 then p_brand when 2 then p_type when 3 then case when v < 4 then p_type else p_brand end else '' end as "Journal",
  case s when 0 then case v when 0 then '1999' when 1 then '2001' when 2 then '' else cast(1950 + p_size as varchar) end when 1 then case when v < 3 then cast(1960 + p_size as varchar) else '2010' end when 4 then '' else cast(1970 + p_size as varchar) end as "PublicationYear",
  case s when 0 then p_name || ' text' when 1 then p_name || ' & more' when 2 then 'the ' || p_brand || ' the' when 3 then 'short' else '' end as "Abstract",
  case s when 1 then 'Physics; ' || p_type when 2 then array_to_string(list_transform(range(1, 26), lambda i: 'concept ' || i), '; ') else '' end as "Keywords",
  case s when 0 then 'http://u/' || k when 1 then case when v < 3 then 'http://pdf/' || k else 'http://html/' || k end when 2 then 'http://oa/' || k when 3 then 'http://s2/' || k else case when v < 4 then 'http://best/' || k else 'http://other/' || k end end as "ManuscriptLink"
from p""")
def parsed_records(spark, d):
    """Records of five shapes, put together from parts, in one schema."""
    v, size = F.col("p_partkey") % 7, F.col("p_size")
    js = lambda **kw: F.to_json(F.struct(*[(c if hasattr(c, "alias") else F.lit(c)).alias(n) for n, c in kw.items()]))
    q = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    k, name, brand, kind = F.col("p_partkey").cast("string"), q(F.col("p_name")), q(F.col("p_brand")), q(F.col("p_type"))
    text = lambda c: c.cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    issued = F.when(v == 0, '{"date-parts":[["1999",1]]}').when(v == 1, "[[2001]]").when(v == 2, '{"date-parts":[[3000]]}').otherwise(cat('{"date-parts":[[', text(size + 1950), ",2]]}"))
    csl = cat('{"title":', name, ',"container-title":', F.when(v < 3, cat("[", kind, ',"x"]')).otherwise(kind), ',"issued":', issued, ',"author":[{"family":', brand, ',"given":"A"},{"given":"Only"},{"family":"only"},7],"URL":"http://u/', k, '","abstract":', q(F.concat("p_name", F.lit(" \n text"))), "}")
    dates = F.when(v < 3, cat('"published-online":{"date-parts":[[', text(size + 1960), ']]},"issued":{"date-parts":[[2010]]}')).otherwise('"published-print":{"date-parts":[]},"created":{"date-parts":[[2010,1,1]]}')
    links = cat('[{"URL":"http://html/', k, '","content-type":"text/html"}', F.when(v < 3, cat(',{"URL":"http://pdf/', k, '","content-type":"application/PDF"}')).otherwise(F.lit("")), "]")
    crossref = cat('{"message":{"title":[', name, '],"container-title":[', brand, '],"author":[{"family":', brand, ',"given":"A","affiliation":[{"name":', kind, '},{"name":"Lab"}]},{"family":"Solo","affiliation":[{"name":" lab "}]}],"subject":["Physics",', kind, ',"physics"],"abstract":', q(F.concat(F.lit("<jats:p>"), "p_name", F.lit(" &amp; more</jats:p>"))), ',"link":', links, ",", dates, "}}")
    concepts = F.lit(",".join('{"display_name":"concept %d"}' % i for i in range(1, 31)))
    openalex = cat('{"title":', name, ',"publication_year":', text(size + 1970), ',"primary_location":{"source":{"display_name":', kind, '}},"authorships":[{"author":{"display_name":', brand, '},"institutions":[{"display_name":', kind, '}]},3],"abstract_inverted_index":{"the":[0,2],', brand, ':[1]},"concepts":[', concepts, '],"best_oa_location":{"pdf_url":null,"landing_page_url":"http://oa/', k, '"}}')
    s2 = cat('{"title":', name, ',"year":', text(size + 1970), ',"journal":', F.when(v < 4, cat('{"name":', kind, "}")).otherwise("null"), ',"venue":', brand, ',"authors":[{"name":', brand, '},{"name":"B"},{"name":"b"}],"abstract":"short","openAccessPdf":null,"url":"http://s2/', k, '"}')
    unpaywall = cat('{"best_oa_location":', F.when(v < 4, cat('{"url_for_pdf":null,"url":"http://best/', k, '"}')).otherwise("null"), ',"oa_locations":[{"url":""},{"url_for_pdf":"http://other/', k, '"}]}')
    s = F.col("p_partkey") % 5
    record = F.when(s == 0, csl).when(s == 1, crossref).when(s == 2, openalex).when(s == 3, s2).otherwise(unpaywall)
    # a small file gives many records: they are dealt out before the work begins
    parts = table(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    df = parts.select(F.col("p_partkey").alias("k"), F.try_parse_json(record).alias("r"))
    return records.parsed(df, "r").drop("r")


@query("""
with p as (select p_partkey, p_name, p_brand, p_size, p_partkey % 6 as v from part)
select '10.5000/' || lower(p_brand) || '/' || p_partkey as doi,
  '@article{S10_5000_' || regexp_replace(lower(p_brand), '[^0-9a-z]', '_', 'g') || '_' || p_partkey || ',' || chr(10)
  || case when v = 5 then '' else '  author = {' || case v when 0 then replace(p_brand, '#', '\\#') || ', A and The Group' when 1 then 'Solo' else replace(p_brand, '#', '\\#') || ', A' end || '},' || chr(10) end
  || '  title = {' || p_name || ' \\& 5\\%},' || chr(10) || '  journal = {' || replace(p_brand, '#', '\\#') || '},' || chr(10)
  || case when v = 4 then '' else '  year = {' || cast(1950 + p_size as varchar) || '},' || chr(10) end || case when v = 3 then '  pages = {1-9},' || chr(10) else '  volume = {' || p_size || '},' || chr(10) end
  || '  doi = {10.5000/' || replace(lower(p_brand), '#', '\\#') || '/' || p_partkey || '}' || chr(10) || '}' || chr(10) as text from p""")
def bibtex_entries(spark, d):
    """BibTeX entries of CSL records."""
    v, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    q = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    brand = q(F.col("p_brand"))
    people = F.when(v == 0, cat('[{"family":', brand, ',"given":"A"},{"literal":"The Group"},{"given":"lost"}]')).when(v == 1, '[{"family":"Solo"}]').when(v == 5, "null").otherwise(cat('[{"family":', brand, ',"given":"A"}]'))
    date = F.when(v == 4, '"issued":{"date-parts":[[]]}').when(v == 2, cat('"published-online":{"date-parts":[[', (F.col("p_size") + 1950).cast("string"), "]]}")).otherwise(cat('"issued":{"date-parts":[["', (F.col("p_size") + 1950).cast("string"), '"]]}'))
    more = F.when(v == 3, '"page":" 1-9 "').otherwise(cat('"volume":"', size, '"'))
    record = cat('{"author":', people, ',"title":', q(F.concat("p_name", F.lit(" & 5%"))), ',"container-title":[', brand, "],", date, ",", more, "}")
    df = table(spark, d, "part").select(F.concat(F.lit("10.5000/"), F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("doi"), F.try_parse_json(record).alias("r"))
    e = records.entries(df, "doi", "r")
    return e.select("doi", "key").join(records.bibtex(e), "key").select("doi", "text")


_REGISTRY = [
    flatten.Field("priority", "A"),
    flatten.Field("lines", "A"),
    flatten.Field("big", "B", quote=False),
    flatten.Field("buyer", "B"),
    flatten.Field("impact", "", human=True),
    flatten.Field("tier", "", derived=True),
    flatten.Field("missing", "C"),
]


@query("""
select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority as priority, case when o_orderkey % 2 = 0 then 'said ' || o_orderstatus else '' end as priority_quote, coalesce(ls, '') as lines, coalesce(qs, '') as lines_quote,
  case when o_totalprice > 200000 then 'TRUE' else 'FALSE' end as big, case o_orderkey % 3 when 0 then 'C' || o_custkey || ', X' when 1 then 'C' || o_custkey else 'acc=' || o_custkey end as buyer, '' as buyer_quote, '' as missing, '' as missing_quote,
  '' as impact, '' as impact_justification, case when o_orderkey % 4 = 0 then '' else o_orderstatus end as "tier (derived)"
from orders left join (select l_orderkey, string_agg(case when l_linenumber % 2 = 1 then l_returnflag end, '; ' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ls, string_agg('q' || l_linenumber, ' | ' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as qs from lineitem group by 1) on l_orderkey = o_orderkey""")
def flattened_fields(spark, d):
    """Nested entries as the flat columns that a registry asks for."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag")).alias("value"), F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("quote"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["value"].alias("value"), x["quote"].alias("quote"))).alias("lines"))
    o = table(spark, d, "orders").join(li, "o_orderkey", "left")
    m = F.col("o_orderkey") % 3
    cust = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    buyer = F.when(m == 0, F.concat(F.lit('{"value":{"family":"'), cust, F.lit('","given":"X"}}'))).when(m == 1, F.concat(F.lit('{"value":{"family":"'), cust, F.lit('"}}'))).otherwise(F.concat(F.lit('{"value":{"metric_name":"acc","value":'), F.col("o_custkey").cast("string"), F.lit("}}")))
    text = lambda c: F.to_json(F.struct(c.alias("v")))
    priority = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.col("o_orderpriority").alias("value"), F.concat(F.lit("said "), "o_orderstatus").alias("quote")))).otherwise(F.regexp_extract(text(F.col("o_orderpriority")), r"^\{\"v\":(.*)\}$", 1))
    record = F.concat(
        F.lit('{"passes":{"A":{"priority":'), priority, F.lit(',"lines":'), F.coalesce(F.to_json("lines"), F.lit("null")), F.lit('},"B":{"big":'), (F.col("o_totalprice") > 200000).cast("string"), F.lit(',"buyer":'), buyer,
        F.lit('}},"derived":{"tier":{"value":'), F.when(F.col("o_orderkey") % 4 == 0, "null").otherwise(F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))), F.lit("}}}"),
    )
    return flatten.flattened(o.select("o_orderkey", F.try_parse_json(record).alias("r")), "r", ["o_orderkey"], _REGISTRY)


@query("""
select cast(o_orderkey as varchar) as k, 1 + o_orderkey % 3 as n_chunks_any, o_orderkey % 5 = 0 as rescued_any, array_to_string(list_filter([case when o_orderkey % 2 = 0 then 'A.grade' end, case when o_orderkey % 3 = 0 then 'B.grade' end], lambda x: x is not null), '; ') as grade_disagreement,
  case when o_orderkey % 4 = 1 then 'A.flag' else '' end as boolean_nonunanimity, case o_orderkey % 4 when 2 then 'A.list; A.list' when 3 then 'A.list' else '' end as quote_unverified, case when o_orderkey % 7 = 0 then 'B.figure' else '' end as image_only,
  case when o_orderkey % 6 = 0 then '[high] x vs y: ' || o_orderpriority || ' || [None] x vs None: None' else '' end as contradictions from orders""")
def audit_flag_scan(spark, d):
    """What there is to check of each record."""
    k = F.col("o_orderkey")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    when = lambda c, a, b: F.when(c, a).otherwise(b)
    a = cat('"A":{"_meta":{"n_chunks":', (1 + k % 3).cast("string"), '},"grade":{"value":1,"_grade_disagreement":', when(k % 2 == 0, "true", "false"), '},"flag":{"_boolean_unanimity":', when(k % 4 == 1, "false", "true"), '},"list":', when(k % 4 == 2, '[{"_quote_unverified":true},3,{"_quote_unverified":true}]', when(k % 4 == 3, '{"_quote_unverified":true}', '"plain"')), "}")
    b = cat('"B":{"_meta":{"_rescued":', when(k % 5 == 0, "true", "null"), '},"grade":[{"_grade_disagreement":', when(k % 3 == 0, "true", "null"), '}],"figure":{"_image_only":', when(k % 7 == 0, "true", "false"), "}}")
    e = cat('"E":{"contradictions":', when(k % 6 == 0, cat('[{"severity":"high","field_a":"x","field_b":"y","note":"', F.col("o_orderpriority"), '"},"no object",{"field_a":"x"}]'), F.lit("[]")), "}")
    df = table(spark, d, "orders").select(k.cast("string").alias("k"), F.try_parse_json(cat('{"passes":{', a, ",", b, ",", e, "}}")).alias("r"))
    return flatten.audit_flags(df, "r", "k", ["A", "B", "E"])


_GRADES = {
    "modality_primary": ["CT", "MRI", "other", None, "not_reported"],
    "modality_secondary": ["PET", None, "none", "MRI"],
    "baseline_rigour_grade": ["weak", "matched_data", None],
    "dataset_realism_grade": ["toy", "public_benchmark", "private_single_centre", "unheard", None],
    "error_mitigation_type": ["ZNE", "none_reported", None, "other"],
    "error_mitigation_strategy": [None, "x", "not_reported"],
    "qubit_count": ["4", None, "not_reported"],
    "circuit_depth": [None, "7"],
    "gate_count": ["none", "9", "1", "null", "2"],
    "shot_count": ["1024", "null", "1000", None, "8192", "1", ""],
}
_FLAGS = {n: f"case when p_partkey % {m} = {r} then true when p_partkey % {m} = {(r + 1) % m} then false end" for n, m, r in (
    ("code_release", 3, 0), ("data_release", 4, 1), ("weights_release", 5, 2), ("sample_size_justification_reported", 2, 0), ("external_validation_used", 3, 1), ("regulatory_pathway_addressed", 4, 2),
    ("prospective_clinical_present", 5, 3), ("statistical_testing_present", 2, 1), ("external_test_set", 6, 1), ("real_vs_sim_explicit", 3, 2))}
_INPUTS = {n: _deal("p_partkey", v) for n, v in _GRADES.items()} | _FLAGS
_NONE = "('', 'not_reported', 'none', 'not_applicable', 'null')"
_HAS = lambda c: f"({c} is not null and lower(trim({c})) not in {_NONE})"


@query(f"""
with i as (select p_partkey, {', '.join(f'{v} as {n}' for n, v in _INPUTS.items())} from part),
a as (select *, case when {_HAS('modality_primary')} or {_HAS('modality_secondary')} then coalesce(modality_primary in ('CT', 'PET', 'SPECT', 'X-ray'), false) or coalesce(modality_secondary in ('CT', 'PET', 'SPECT', 'X-ray'), false) end as ionising_flag, {_HAS('modality_secondary')} as multimodal,
  case when code_release and data_release and weights_release then 'code_plus_data_plus_weights' when code_release then 'code_only' when data_release then 'data_only' when weights_release then 'weights_or_circuit_params_only' else 'none' end as reproducibility_tier,
  {' + '.join(f'coalesce({c}, false)::int' for c in ('sample_size_justification_reported', 'external_validation_used', 'regulatory_pathway_addressed', 'prospective_clinical_present'))} as clinical_translation_readiness,
  {' + '.join(f'{_HAS(c)}::int' for c in ('qubit_count', 'circuit_depth', 'gate_count', 'shot_count'))} as quantum_resource_accounting_completeness,
  case when error_mitigation_type = 'ZNE' then 'high' when error_mitigation_type = 'none_reported' and not {_HAS('error_mitigation_strategy')} then 'none' else 'low' end as error_mitigation_clarity,
  case dataset_realism_grade when 'toy' then 'toy' when 'public_benchmark' then 'benchmark' when 'private_single_centre' then 'real_clinical' end as dataset_realism_rob from i),
b as (select *, coalesce(real_vs_sim_explicit, false) and quantum_resource_accounting_completeness >= 3 as honest_resource_reporting from a),
c as (select *, coalesce(baseline_rigour_grade in ('none', 'weak'), false)::int + coalesce(dataset_realism_rob = 'toy', false)::int + (quantum_resource_accounting_completeness < 2)::int + (not honest_resource_reporting)::int + (reproducibility_tier = 'none')::int
  + (not coalesce(statistical_testing_present, false))::int + (not (coalesce(external_validation_used, false) or coalesce(external_test_set, false)))::int as n from b)
select p_partkey, ionising_flag, multimodal, reproducibility_tier, clinical_translation_readiness, quantum_resource_accounting_completeness, error_mitigation_clarity, dataset_realism_rob, honest_resource_reporting,
  case when n <= 2 then 'low_concern' when n <= 4 then 'moderate_concern' else 'high_concern' end as summary_methodological_quality from c""")
def derived_fields(spark, d):
    """All graded fields of a record, each rule after those it needs."""
    df = table(spark, d, "part").select("p_partkey", *[F.expr(v).alias(n) for n, v in _INPUTS.items()])
    return derive.derived(df).select("p_partkey", *sorted(r.name for r in derive.RULES))


_METRICS = """
  select 'rows' as metric, 'p_type' as field, 'rows' as kind, '' as argument union all select 'brands', 'p_brand', 'distinct', null union all select 'small', 'p_size', 'in', '1|2|3|4|5' union all select 'other sizes', 'p_size', 'not_in', '1|2|3|4|5'
  union all select 'standard', 'p_type', 'prefix', 'STANDARD' union all select 'named', 'remark', 'reported', null union all select 'unnamed', 'remark', 'absent', null union all select 'blank', 'remark', 'empty', null union all select 'said', 'remark', 'nonempty', null
  union all select 'yes', 'flag', 'true', null union all select 'no', 'flag', 'false', null union all select 'no such', 'p_brand', 'eq', 'nothing' union all select 'not ring', 'labels', 'ne', 'ring'
  union all select distinct 'type ' || p_type, 'p_type', 'eq', p_type from part union all select distinct 'brand ' || p_brand, 'p_brand', 'eq', p_brand from part union all select distinct 'size ' || p_size, 'p_size', 'eq', cast(p_size as string) from part
  union all select distinct 'label ' || (p_size % 9), 'labels', 'label', 'l' || (p_size % 9) from part"""
_METRIC_ROWS = f"""select *, {_deal('p_partkey', [' x ', '', None, 'NR', 'n/a', 'y'])} as remark, {_deal('p_partkey', ['TRUE', 'false', 'True', None, 'yes'])} as flag,
  case when p_partkey % 50 = 0 then 'ring' else 'l' || (p_size % 9) || '; l' || (p_partkey % 9) || ';;l' || (p_size % 9) end as labels from part"""


@query(f"""
with m as ({_METRICS.replace('as string)', 'as varchar)')}), t as ({_METRIC_ROWS}),
c as (select p_retailprice < 1200 as cheap, unnest([{{'field': 'p_type', 'v': p_type}}, {{'field': 'p_brand', 'v': p_brand}}, {{'field': 'p_size', 'v': cast(p_size as varchar)}}, {{'field': 'remark', 'v': trim(coalesce(remark, ''))}}, {{'field': 'flag', 'v': coalesce(flag, '')}}, {{'field': 'labels', 'v': labels}}]) as x from t),
g as (select x.field as field, x.v as v, count(*) as n, count(*) filter (where cheap) as k from c group by 1, 2),
l as (select v, count(*) as n, count(*) filter (where cheap) as k from (select p_retailprice < 1200 as cheap, unnest(list_distinct(list_filter(list_transform(string_split(labels, ';'), lambda x: trim(x)), lambda x: x <> ''))) as v from t) group by 1),
h as (select metric, kind, n, k, case kind when 'rows' then true when 'distinct' then true when 'eq' then v = argument when 'ne' then v <> argument when 'in' then list_contains(string_split(argument, '|'), v) when 'not_in' then not list_contains(string_split(argument, '|'), v)
  when 'true' then lower(v) = 'true' when 'false' then lower(v) = 'false' when 'reported' then lower(v) not in ('', 'nr', 'n/a') when 'absent' then lower(v) in ('', 'nr', 'n/a') when 'nonempty' then v <> '' when 'empty' then v = '' when 'prefix' then starts_with(v, argument) end as hit from m join g on g.field = m.field where kind <> 'label'
  union all select metric, kind, n, k, true from m join l on l.v = m.argument where kind = 'label')
select metric, cast(case when any_value(kind) = 'distinct' then count(*) filter (where hit and n > 0) else coalesce(sum(n) filter (where hit), 0) end as bigint) as every,
  cast(case when any_value(kind) = 'distinct' then count(*) filter (where hit and k > 0) else coalesce(sum(k) filter (where hit), 0) end as bigint) as cheap, cheap - every as delta from h group by metric""")
def metrics_as_rows(spark, d):
    """Some hundred metrics that are rows of a table, in two populations, with their difference."""
    part = table(spark, d, "part")
    m, t = (spark.sql(x.replace("from part", "from {part}"), part=part) for x in (_METRICS, _METRIC_ROWS))
    return stats.metric_table(t, m, {"every": F.lit(True), "cheap": F.col("p_retailprice") < 1200}, ("every", "cheap"))


_HREFS = r"""list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g'))"""
# links of all forms that a page may hold, on folders of the page's own
_FORMS = ["''", "'#part'", "'?page=2'", "'x.html'", "'./x'", "'../x?q=1#f'", "'../../../x/..'", "'/a/./b/../c'", "'//other.org/a/../b'", "'mailto:a@b.c'", "'a/b/.'", "'..'", "'https://h.org/p/../q'", "'a;b/../c'"]


@query(rf"""
with p as (select page_id, url as base, list_concat({_HREFS}, [{", ".join(_FORMS)}]) as hs from pages),
l as (select page_id, base, unnest(hs) as link, generate_subscripts(hs, 1) as i from p),
x as (select *, regexp_extract(link, '(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) as a, regexp_extract(base, '(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) as b from l),
j as (select *, case when a.h <> '' or starts_with(a.p, '/') then a.p when a.p = '' then null else case when regexp_extract(b.p, '(?s)^(.*/)[^/]*$', 1) = '' then '/' else regexp_extract(b.p, '(?s)^(.*/)[^/]*$', 1) end || a.p end as joined from x),
d as (select *, case when joined is null or not contains(joined, '/.') then joined else
  (select case when len(o) = 1 then '/' else array_to_string(o, '/') end from (select list_concat(list_reduce(list_prepend([''], list_transform(string_split(joined, '/')[2:], lambda s: [s])), lambda acc, s: case when s = ['.'] then acc when s = ['..'] then acc[1:greatest(len(acc) - 1, 1)] else list_concat(acc, s) end),
    case when list_contains(['.', '..'], string_split(joined, '/')[-1]) then [''] else [] end) as o)) end as path from j)
select page_id, i as number, case when a.s <> '' then link when a.h <> '' then b.s || a.h || path || a.q || a.f else b.s || b.h || coalesce(path, b.p) || case when a.p = '' and a.q = '' then b.q else a.q end || a.f end as address from d""")
def resolved_links(spark, d):
    """The links of all pages, and some of each form on each page, as absolute addresses."""
    p = table(spark, d, "pages").withColumn("ls", F.concat(ident.hrefs(F.col("html")), F.array(*[F.expr(x) for x in _FORMS])))
    out = p.select("page_id", F.col("url").alias("base"), F.posexplode("ls").alias("number", "link"))
    return out.select("page_id", (F.col("number") + 1).cast("long").alias("number"), ident.absolute(F.col("link"), F.col("base")).alias("address"))


_TITLES = """select {k} as k, case when {k} % 4 = 0 then null when {k} % 4 = 1 then '10.6000/X' || ({k} % 500) else ' ' end as doi, case when {k} % 3 = 0 then 'Short: ' || ({k} % 40) else '  The {{Long}} title of a part, number ' || ({k} % 700) || '!' end as title"""


@query(f"""
with asked as ({_TITLES.format(k="p_partkey")}, p_name from part), entry as ({_TITLES.format(k="o_orderkey")}, o_custkey as item, o_orderdate as added from orders),
n as (select k, item, added, case when trim(coalesce(doi, '')) <> '' then lower(trim(doi)) end as doi, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as title from entry),
by_doi as (select doi, min({{'o': added, 'v': item}}) as e from n where doi is not null group by 1), by_title as (select title, min({{'o': added, 'v': item}}) as e from n where length(title) >= 30 group by 1)
select a.k, coalesce(coalesce(d.e, t.e).v, -1) as item, case when d.e is not null then 'doi' when t.e is not null then 'title' else '' end as matched_by
from asked a left join by_doi d on d.doi = lower(trim(a.doi)) left join by_title t on t.title = trim(regexp_replace(lower(a.title), '[^a-z0-9]+', ' ', 'g'))""")
def doi_or_title_match(spark, d):
    """Entries found by DOI, else by a title of thirty characters or more, the first by date."""
    parts, orders = table(spark, d, "part"), table(spark, d, "orders")
    asked = spark.sql(_TITLES.format(k="p_partkey").replace("{Long}", "{{Long}}") + " from {t}", t=parts)
    entries = spark.sql(_TITLES.format(k="o_orderkey").replace("{Long}", "{{Long}}") + ", o_custkey as item, o_orderdate as added from {t}", t=orders)
    return link.matched_by_doi_or_title(asked, entries, "doi", "title", "item", "added").select("k", F.coalesce("item", F.lit(-1).cast("long")).alias("item"), "matched_by")


@query("""
with e as (select *, event_type = 'purchase' and value > 20 as ok, {'t': ts, 'i': event_id} as o from events where user_id is not null),
f as (select user_id, min(o) filter (where ok) as first from e group by 1),
c as (select e.*, f.first from e join f on f.user_id = e.user_id where f.first is null or e.o <= f.first)
select user_id, count(*) as attempts, arg_max(event_type, o) as last_source, case when any_value(first) is null then arg_max(event_type, o) || ' failed' end as last_error, any_value(value) filter (where o = first) as value, any_value(first) is not null as done from c group by 1""")
def queue_progress(spark, d):
    """How far the work of each user has come after all events, which arrive in four parts and a repeated run."""
    home = fresh_path(spark, "queue")
    events = table(spark, d, "events")
    # parts in the order of time, as the events arrive; one file each
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = events.select(F.percentile_approx(time, [0.25, 0.5, 0.75]).alias("p")).first()["p"]
    part = sum((time > e).cast("int") for e in edges)
    for i in range(4):
        events.where(part == i).coalesce(1).write.mode("append").parquet(home + "/in")
        args = ("user_id", ["ts", "event_id"], "event_type", (F.col("event_type") == "purchase") & (F.col("value") > 20), "value", F.concat("event_type", F.lit(" failed")))
        queue.work(spark, home + "/in", events.schema, home + "/state", home + "/checkpoint", *args, files_per_batch=1)
    kind = queue.STATE.format(key="long", value="double")
    return queue.current(spark, home + "/state", kind).select(F.col("key").alias("user_id"), "attempts", "last_source", "last_error", "value", "done")


@query("""
select 'log' as what, cast(run as varchar) as name, count(*) as n, round(sum(o_totalprice), 2) as total from (select *, o_orderkey % 3 as run from orders) group by 2
union all select 'version', 'current', count(*), round(sum(o_totalprice), 2) from orders where o_orderkey % 2 = 0 union all select 'version', 'before', count(*), round(sum(o_totalprice), 2) from orders where o_orderkey % 2 = 1
union all select 'file', n_name || '.' || c_mktsegment, count(*), round(sum(c_acctbal), 2) from customer join nation on n_nationkey = c_nationkey group by 2""")
def logs_versions_files(spark, d):
    """What a log of three runs, a table of three versions and files for each key give when they are read back."""
    home, o = fresh_path(spark, "sinks"), table(spark, d, "orders")
    for r in (0, 1, 1, 2, 0):  # repeated runs add nothing
        log.append(o.where(F.col("o_orderkey") % 3 == r), home + "/log", str(r))
    for r in (2, 1, 0):
        log.publish(o.where(F.col("o_orderkey") % 2 == r), home + "/table")
    c = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    files = c.select("n_name", "c_mktsegment", "c_custkey", "c_acctbal")
    log.write_per_key(files, home + "/files", ["n_name", "c_mktsegment"])
    log.write_per_key(files.where("n_name < 'NATION_2'"), home + "/files", ["n_name", "c_mktsegment"])
    total = lambda df, what, name, x: df.groupBy(F.lit(what).alias("what"), name.alias("name")).agg(F.count("*").alias("n"), F.round(F.sum(x), 2).alias("total"))
    kept = log.read_per_key(spark, home + "/files", "c_custkey long, c_acctbal double, n_name string, c_mktsegment string")
    return (
        total(log.read(spark, home + "/log"), "log", F.col("run").cast("string"), "o_totalprice")
        .unionByName(total(log.published(spark, home + "/table"), "version", F.lit("current"), "o_totalprice"))
        .unionByName(total(log.published(spark, home + "/table", 1), "version", F.lit("before"), "o_totalprice"))
        .unionByName(total(kept, "file", F.concat_ws(".", "n_name", "c_mktsegment"), "c_acctbal"))
    )
