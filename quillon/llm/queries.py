"""The thin ``opN_*`` queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding, html, langid, license, linededup, lloyd, minhash, packing, pii, ppm, toxicity, variants
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedupe_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; the text model is fitted on documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.fit(langid.document_rows(docs))
    rest = ["lang", "posterior", "text_lang", "n_trigrams", "accepted"]
    a = langid.identify_documents(docs, model=model).select(F.lit("documents").alias("origin"), F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), *rest)
    b = langid.identify_pages(pages, model).select(F.lit("pages").alias("origin"), F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("page_id"), *rest)
    return a.unionByName(b)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_pii_bootstrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_line_dedup, op3_html_extraction, op4_packing, op5_license_scan, op6_language_id, op7_toxicity, op8_lm_scoring, op9_embedding_dedup, op10_decontamination, op11_pii_bootstrapping, op12_spelling_variants, op13_centroid_clustering)}

_COMPONENTS = """
reach as (
  select id, id as r from nodes
  union
  select l.b as id, reach.r from reach join both_ways l on l.a = reach.id),
component as (select id, min(r) as component from reach group by id)"""

_OP1 = rf"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingle as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
sized as (select doc_id, count(*) as n from shingle group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as both_n from shingle x join shingle y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from pairs join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * both_n >= 80 * (x.n + y.n - both_n)),
both_ways as (select a, b from links union select b, a from links),
nodes as (select distinct a as id from both_ways),
{_COMPONENTS}
select d.doc_id, coalesce(sized.n, 0) as n_shingles, coalesce(c.component, d.doc_id) as component_id, coalesce(c.component, d.doc_id) = d.doc_id as kept
from documents d left join sized on sized.doc_id = d.doc_id left join component c on c.id = d.doc_id"""

# white space of the lines' ends and between words, as Unicode has it (fixed value)
_BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_OP2 = rf"""
with recursive split as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents),
line as (
  select doc_id, i - 1 as number, regexp_replace(regexp_replace(ls[i], '^{_BLANKS}', ''), '{_BLANKS}$', '') as s
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from split)),
some_line as (select * from line where s <> ''),
kind as (
  select s, min(doc_id * 1000000 + number) as spot, length(s) as n, regexp_split_to_array(s, '{_BLANKS}') as w from some_line group by s),
small as (select * from kind where n >= {linededup.NEAR_CHARS} and len(w) <= {linededup.NEAR_WORDS}),
half as (
  select spot, s, n, w, substr(s, 1, cast(floor(n / 2) as bigint)) as front, substr(s, cast(floor(n / 2) as bigint) + 1) as back from small),
shorter as (
  select spot, s, w, n as m, front, back from half
  union all
  select spot, s, w, n - 1, substr(s, 1, cast(floor((n - 1) / 2) as bigint)), substr(s, cast(floor((n - 1) / 2) as bigint) + 2) from small),
candidate as (
  select x.spot as a, y.spot as b, x.s as s, y.s as t from half x join shorter y on x.n = y.m and x.front = y.front and x.spot <> y.spot where least(len(x.w), len(y.w)) < {linededup.NEAR_WORDS}
  union
  select x.spot, y.spot, x.s, y.s from half x join shorter y on x.n = y.m and x.back = y.back and x.spot <> y.spot where least(len(x.w), len(y.w)) < {linededup.NEAR_WORDS}),
big as (
  select spot, w, len(w) as n from kind where len(w) >= {linededup.NEAR_WORDS}),
budget as (
  select spot, w, n, m, least({linededup.MOST_WORD_EDITS}, m // {linededup.WORDS_PER_EDIT}) as k from (select spot, w, n, unnest(range(greatest({linededup.NEAR_WORDS}, n - {linededup.MOST_WORD_EDITS}), n + 1)) as m from big)),
part as (
  select spot, w, n, m, k, i, i * (m // (k + 1)) + greatest(0, i - (k + 1 - m % (k + 1))) as p, m // (k + 1) + case when i >= k + 1 - m % (k + 1) then 1 else 0 end as c
  from (select *, unnest(range(0, k + 1)) as i from budget where n - m <= k)),
segment as (select spot, n, k, i, array_to_string(w[p + 1:p + c], ' ') as word_run from part where n = m),
probe as (
  select spot, m, i, array_to_string(w[q + 1:q + c], ' ') as word_run from (select *, unnest(range(greatest(0, p - k), least(n - c, p + k) + 1)) as q from part)),
near(a, b, s, t, k) as (
  select distinct x.spot, y.spot, x.w, y.w, z.k from segment z join probe y0 on z.n = y0.m and z.i = y0.i and z.word_run = y0.word_run and z.spot <> y0.spot
    join big x on x.spot = z.spot join big y on y.spot = y0.spot
  union
  select a, b, case when g in (0, 2) then s[c + 2:] else s[c + 1:] end, case when g in (1, 2) then t[c + 2:] else t[c + 1:] end, k - 1
  from (select *, coalesce(list_position(list_transform(range(1, least(len(s), len(t)) + 1), lambda i: s[i] <> t[i]), true) - 1, least(len(s), len(t))) as c from near) q, (values (0), (1), (2)) v(g)
  where k > 0 and c < least(len(s), len(t))),
links as (
  select a, b from candidate where levenshtein(s, t) <= {linededup.CHAR_EDITS}
  union
  select a, b from near where abs(len(s) - len(t)) <= k and coalesce(list_position(list_transform(range(1, least(len(s), len(t)) + 1), lambda i: s[i] <> t[i]), true) - 1, least(len(s), len(t))) = least(len(s), len(t))),
both_ways as (select a, b from links union select b, a from links),
nodes as (select distinct a as id from both_ways),
{_COMPONENTS},
gone as (
  select l.doc_id, list(l.number) as numbers from some_line l join kind k on k.s = l.s left join component c on c.id = k.spot
  where coalesce(c.component, k.spot) <> l.doc_id * 1000000 + l.number group by l.doc_id)
select d.doc_id, coalesce(len(d.ls), 0) as n_lines, coalesce(len(g.numbers), 0) as n_removed,
  length(r.t) as n_chars_kept, md5(r.t) as text_md5
from split d left join gone g on g.doc_id = d.doc_id,
  lateral (select case when g.numbers is null then d.text else array_to_string(list_filter(d.ls, lambda x, i: not list_contains(g.numbers, i - 1)), chr(10)) end as t) r"""

_OP9 = rf"""
with recursive usable as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from usable),
links as (
  select x.vec_id as a, y.vec_id as b from normed x join normed y on x.label = y.label and x.vec_id < y.vec_id and len(x.e) = len(y.e)
  where list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98),
both_ways as (select a, b from links union select b, a from links),
nodes as (select distinct a as id from both_ways),
{_COMPONENTS}
select v.vec_id, (select count(*) from both_ways w where w.a = v.vec_id) as n_links, coalesce(c.component, v.vec_id) as component_id, coalesce(c.component, v.vec_id) = v.vec_id as kept
from embeddings v left join component c on c.id = v.vec_id"""

SQL = {"op1_minhash_dedup": _OP1, "op2_line_dedup": _OP2, "op5_license_scan": license.scan_sql(), "op9_embedding_dedup": _OP9, "op12_spelling_variants": variants.group_sql(), "op13_centroid_clustering": lloyd.cluster_sql()}
