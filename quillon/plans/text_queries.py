"""Queries over documents, benchmark, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ident, text, vocab
from ..operators import link, segment
from ..operators.validate import first_error
from .catalog import query, table

_SCORE = r"""
  case when length(s) > 0 then length(s) + 3 * len(regexp_extract_all(s, '[\p{L}\p{N}_]+')) + 0.5 * len(list_distinct(string_split(lower(s), '')))
    - 200 * (2.0 * len(regexp_extract_all(s, '[ÃÂâ€žœ™“”–]'))) / greatest(1, length(s)) else 0 end"""
_CLEAN = r"""case when lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'))) in ('', 'nan', 'none', 'n/a', 'na', 'null', '-') then '' else trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) end"""


@query(f"""
with scored as (select doc_id, lang, source, round({_SCORE}, 4) as score from (select doc_id, lang, source, {_CLEAN} as s from documents)),
ranked as (select *, row_number() over (partition by lang, source order by score desc, doc_id) as r from scored)
select lang, source, doc_id, score, doc_id in (select doc_id from labels) as found_in_any from ranked where r = 1""")
def text_quality_argmax(spark, d):
    """The best document of each language and source."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.round(text.quality_score(F.col("text")), 4).alias("score"))
    best = docs.groupBy("lang", "source").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b"))
    best = best.select("lang", "source", F.col("b.doc_id").alias("doc_id"), (-F.col("b.s")).alias("score"))
    return link.preserving_merge(best, table(spark, d, "labels").select("doc_id").distinct(), "doc_id")


@query(r"""
select kind, count(*) as n from (
  select case when n < 300 then 'likely_ocr_needed' when (n < 5000 or r < 0.55) and r < 0.35 then 'likely_ocr_needed' when n < 5000 or r < 0.55 then 'low_text_density' else 'ok' end as kind
  from (select length(t) as n, case when length(b) > 0 then len(regexp_extract_all(t, '\p{L}')) / length(b) else 0 end as r
    from (select coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', '', 'g') as b from documents))) group by kind""")
def text_quality_class(spark, d):
    """D11."""
    return table(spark, d, "documents").select(text.text_class(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def _split_abstract(spark, d):
    t = table(spark, d, "documents")
    at = F.locate("\n", F.col("text"))
    return t.select("doc_id", F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise("").alias("title"), F.when(at > 0, F.expr("substring(text, locate(chr(10), text) + 1)")).otherwise(F.col("text")).alias("body"))


_ABSTRACT = r"""
with part as (select doc_id, case when instr(text, chr(10)) > 0 then substr(text, 1, instr(text, chr(10)) - 1) else '' end as title,
  case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else text end as body from documents),
norm as (select doc_id, trim(regexp_replace(title, '[ \t\n\r]+', ' ', 'g')) as t, trim(regexp_replace(body, '[ \t\n\r]+', ' ', 'g')) as b from part),
tok as (select *, list_distinct(regexp_extract_all(lower(t), '{word}')) as tt, list_distinct(regexp_extract_all(lower(b), '{word}')) as bt, len(regexp_extract_all(b, '{word}')) as nw from norm),
sim as (select *, case when len(tt) > 0 and len(bt) > 0 then len(list_intersect(tt, bt)) / len(list_distinct(list_concat(tt, bt))) else 0 end as j from tok)
"""


@query(
    _ABSTRACT.format(word="[A-Za-z][A-Za-z\\x27\\-]+")
    + """select reason, count(*) as n from (select case when b = '' then 'empty' when length(b) < 250 then 'chars' when nw < 30 then 'words'
  when t <> '' and (contains(lower(t), lower(b)) or (contains(lower(b), lower(t)) and length(b) < 2 * length(t))) then 'abstract_is_title' when t <> '' and j >= 0.7 then 'title_jaccard' else 'ok' end as reason from sim) group by reason"""
)
def abstract_validity_v1(spark, d):
    """Only a short abstract may not hold its title."""
    word = r"[A-Za-z][A-Za-z\x27\-]+"
    a = _split_abstract(spark, d).select(*[F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")).alias(n) for c, n in (("title", "t"), ("body", "b"))])
    low_t, low_b = F.lower("t"), F.lower("b")
    rules = [
        ("empty", F.col("b") == ""),
        ("chars", F.length("b") < 250),
        ("words", F.regexp_count("b", F.lit(word)) < 30),
        ("abstract_is_title", (F.col("t") != "") & (F.contains(low_t, low_b) | (F.contains(low_b, low_t) & (F.length("b") < 2 * F.length("t"))))),
        ("title_jaccard", (F.col("t") != "") & (text.jaccard(F.col("t"), F.col("b"), word) >= 0.7)),
    ]
    return a.select(first_error(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    _ABSTRACT.format(word=r"[\p{L}\p{N}_]+".replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")
    + """select reason, count(*) as n from (select case when b = '' then 'empty' when length(b) < 250 then 'too_short_chars' when len(string_split(b, ' ')) < 30 then 'too_few_words'
  when t <> '' and contains(lower(b), lower(t)) then 'title_substring_of_abstract' when t <> '' and contains(lower(t), lower(b)) then 'abstract_substring_of_title' when t <> '' and j >= 0.7 then 'jaccard_too_high' else 'ok' end as reason from sim) group by reason"""
)
def abstract_validity_v2(spark, d):
    """No abstract may hold its title."""
    a = _split_abstract(spark, d).select(*[F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")).alias(n) for c, n in (("title", "t"), ("body", "b"))])
    some = F.col("t") != ""
    rules = [
        ("empty", F.col("b") == ""),
        ("too_short_chars", F.length("b") < 250),
        ("too_few_words", F.size(F.split("b", " ")) < 30),
        ("title_substring_of_abstract", some & F.contains(F.lower("b"), F.lower("t"))),
        ("abstract_substring_of_title", some & F.contains(F.lower("t"), F.lower("b"))),
        ("jaccard_too_high", some & (text.jaccard(F.col("t"), F.col("b")) >= 0.7)),
    ]
    return a.select(first_error(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _ground(spark, d, norm):
    docs = table(spark, d, "documents").select("doc_id", norm(F.col("text")).alias("t"))
    probes = table(spark, d, "benchmark").select("item_id", norm(F.col("text")).alias("p"))
    hits = link.contains_blocked(docs, probes, "doc_id", "t", "item_id", "p", 8)
    return hits.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(r"""
with t as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) || ' ' as t from documents),
p as (select item_id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) as p from benchmark)
select item_id, count(*) as n_docs, min(doc_id) as first_doc from t join p on contains(t.t, ' ' || p.p) where p.p <> '' group by item_id""")
def grounding_exact(spark, d):
    """Documents that hold the whole of a benchmark item."""
    return _ground(spark, d, lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r]+", " ")))


@query(r"""
with t as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from documents),
p as (select item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as p from benchmark)
select item_id, count(*) as n_docs, min(doc_id) as first_doc from t join p on contains(t.t, ' ' || p.p) where p.p <> '' group by item_id""")
def grounding_relaxed(spark, d):
    """The same on letters and digits only."""
    return _ground(spark, d, text.loose)


@query(r"""
with turns as (select conv_id, turn, role, text, lead(text) over w as reply, lead(role) over w as next_role from conversations where role <> 'system' window w as (partition by conv_id order by turn))
select status, count(*) as n from (select case when q <> '' and contains(r, q) then 'verbatim' when lq <> '' and contains(lr, lq) then 'loose' else 'not_found' end as status
  from (select trim(regexp_replace(split_part(text, '.', 1), '[ \t\n\r]+', ' ', 'g')) as q, trim(regexp_replace(reply, '[ \t\n\r]+', ' ', 'g')) as r,
    trim(regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9]+', ' ', 'g')) as lq, trim(regexp_replace(lower(reply), '[^a-z0-9]+', ' ', 'g')) as lr
    from turns where role = 'user' and next_role = 'assistant')) group by status""")
def quote_status_ladder(spark, d):
    """Whether a user's first sentence recurs in the reply."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").where("role <> 'system'").withColumn("reply", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    t = t.where("role = 'user' and next_role = 'assistant'").select(F.substring_index("text", ".", 1).alias("q"), "reply")
    flat = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))
    has = lambda f: (f(F.col("q")) != "") & F.contains(f(F.col("reply")), f(F.col("q")))
    return t.select(F.when(has(flat), "verbatim").when(has(text.loose), "loose").otherwise("not_found").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(r"""
select page_id, length(s) as n_chars, md5(s) as digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\$\$[^$]+\$\$', ' [formula] ', 'g'), '\\[a-zA-Z]+\{[^}]*\}', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[ \t\n\f\r\v]+', ' ', 'g')) as s from pages)""".replace(r"[ \t\n\f\r\v]", vocab.WHITE))
def sanitize_html(spark, d):
    """G7."""
    return table(spark, d, "pages").select("page_id", text.sanitize(F.col("html")).alias("s")).select("page_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


@query(r"""
select page_id, length(s) as n_chars, md5(s) as digest from (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\f\r\v]+', ' ', 'g')) as s from pages)""".replace(r"[ \t\n\f\r\v]", vocab.WHITE))
def html_strip(spark, d):
    """G9."""
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("s")).select("page_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


_LINKS = r"""
with raw as (select page_id, list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')) as hs from pages),
one as (select page_id, unnest(hs) as href, generate_subscripts(hs, 1) - 1 as pos from raw),
canon as (select page_id, pos, href, replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(href), '[).,;\]]+$', '')), '^https?://', ''), '^www\.', ''), '/+$', ''), 'dx.doi.org/', 'doi.org/') as loc from one)
"""


def _page_links(spark, d):
    p = table(spark, d, "pages").select("page_id", F.posexplode(ident.hrefs(F.col("html"))).alias("pos", "href"))
    return p.withColumn("loc", ident.canonical_url(F.col("href")))


@query(_LINKS + "select page_id, count(*) as n_links, cast(sum(length(href)) as bigint) as n_chars from one group by page_id")
def href_extract(spark, d):
    """G25."""
    return _page_links(spark, d).groupBy("page_id").agg(F.count("*").alias("n_links"), F.sum(F.length("href")).alias("n_chars"))


@query(_LINKS + "select loc, count(*) as n from canon group by loc")
def link_canonical(spark, d):
    """G19."""
    return _page_links(spark, d).groupBy("loc").agg(F.count("*").alias("n"))


@query(_LINKS + "select loc, arg_min(href, {'p': page_id, 'i': pos}) as href, count(*) as occurrences, string_agg(distinct page_id, ',' order by page_id) as sources, count(distinct page_id) as n_sources from canon group by loc")
def link_dedupe(spark, d):
    """By canonical locator; the first form stays, the pages that name it are gathered and counted."""
    return link.gathered(_page_links(spark, d), "loc", "page_id", "pos", "href")


@query(_LINKS + "select loc, page_id, count(*) as occurrences from canon group by loc, page_id")
def link_sources(spark, d):
    """the pages that name each locator, a row for each, as a link may stand on all pages."""
    return _page_links(spark, d).groupBy("loc", "page_id").agg(F.count("*").alias("occurrences"))


_CLASS = r"""case when regexp_matches(loc, 'github\.com|gitlab\.com|zenodo\.org|figshare\.com|osf\.io|huggingface\.co') then 'author_deposit' when regexp_matches(loc, 'kaggle\.com|physionet\.org|cancerimagingarchive\.net') then 'public_portal'
  when regexp_matches(loc, 'supplement|supporting') then 'si_reference' when regexp_matches(href, '(?i)https?://') or regexp_matches(href, '(?i)\b10\.[0-9]{4,9}/|doi\.org/') then 'other_url' else 'other' end"""


@query(_LINKS + f"""select tier, count(*) as n from (select page_id, case when bool_or(c = 'author_deposit') then 'T1' when bool_or(c in ('public_portal', 'article_doi')) then 'T2' when bool_or(c in ('si_reference', 'other_url')) then 'T3' else 'T4' end as tier
  from (select page_id, {_CLASS} as c from canon) group by page_id) group by tier""")
def link_class_tier(spark, d):
    """The tier of a page by its best class of link."""
    c = _page_links(spark, d).select("page_id", ident.link_class(F.col("href")).alias("c"))
    has = lambda *names: F.bool_or(F.col("c").isin(*names))
    tier = F.when(has("author_deposit"), "T1").when(has("public_portal", "article_doi"), "T2").when(has("si_reference", "other_url"), "T3").otherwise("T4")
    return c.groupBy("page_id").agg(tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query("""
select split_part(split_part(url, '://', 2), '/', 1) as host, min(url) filter (where s = m) as url, max(s) as score from (
  select url, s, max(s) over (partition by split_part(split_part(url, '://', 2), '/', 1)) as m from (
  select url, case when regexp_matches(lower(url), '^https?://') then 100.0 + length(url) + case when lower(url) like '%.pdf' then 500 else 0 end + case when contains(lower(url), 'stamp/stamp.jsp') then 400 else 0 end + case when contains(lower(url), 'pdf') then 100 else 0 end else 0 end as s from pages)) group by 1""")
def url_score_best(spark, d):
    """The best page address of a host; the smallest on ties."""
    p = table(spark, d, "pages").select(F.substring_index(F.substring_index("url", "://", -1), "/", 1).alias("host"), "url", ident.link_score(F.col("url")).alias("score"))
    return p.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "url")).alias("b")).select("host", F.col("b.url").alias("url"), (-F.col("b.s")).alias("score"))


@query("""
with r as (select d.doc_id, string_split(d.text, chr(10)) as own, string_split(coalesce(p.text, ''), chr(10)) as ref from documents d left join documents p on p.doc_id = d.doc_id - d.doc_id % 3),
n as (select doc_id, own, list_transform(ref, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) as ref from r)
select doc_id, len(own) as n_lines, len(k) as n_kept, md5(array_to_string(k, chr(10))) as digest from (select doc_id, own, list_filter(own, lambda x: not list_contains(ref, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))) as k from n)""")
def line_dedupe_vs_ref(spark, d):
    """Lines of a text that a reference text, here another document, has not already; letters and digits decide."""
    docs = table(spark, d, "documents")
    ref = docs.select(F.col("doc_id").alias("ref_id"), F.transform(F.split("text", "\n"), text.loose).alias("ref"))
    rows = docs.withColumn("ref_id", F.col("doc_id") - F.col("doc_id") % 3).join(ref, "ref_id", "left")
    own = F.split("text", "\n")
    kept = F.filter(own, lambda x: ~F.array_contains(F.coalesce("ref", F.array(F.lit("")).cast("array<string>")), text.loose(x)))
    return rows.select("doc_id", F.size(own).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("digest"))


@query("""
with ls as (select doc_id, string_split(text, chr(10)) as a, length(text) as total from documents),
l as (select doc_id, total, unnest(range(0, len(a))) as line_no, a from ls),
m as (select doc_id, total, line_no, a[line_no + 1] as line, coalesce(list_sum(list_transform(a[1:line_no], lambda x: length(x) + 1)), 0) as start from l),
h as (select doc_id, total, start from m where length(line) <= 80)
select doc_id, cast(start as bigint) as start, cast(coalesce(lead(start) over (partition by doc_id order by start), total) as bigint) as stop from h""")
def section_spans(spark, d):
    """Spans that begin at short lines; no document has the blank lines of the full rule."""
    docs = table(spark, d, "documents")
    marks = segment.lines(docs, "doc_id", "text").where(F.length("line") <= 80).join(docs.select("doc_id", F.length("text").alias("total")), "doc_id")
    return segment.spans(marks, "doc_id", "start", F.col("total")).select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("""
with p as (select doc_id, string_split(text, chr(10)) as a, length(text) as total from documents),
q as (select doc_id, total, a, unnest(range(0, len(a))) as i from p),
r as (select doc_id, i + 1 as page, coalesce(list_sum(list_transform(a[1:i], lambda x: length(x) + 1)), 0) as s, length(a[i + 1]) as n, total, i from q)
select doc_id, page, cast(s as bigint) as char_start, cast(least(s + n + 1, total) as bigint) as char_end from r where least(s + n + 1, total) - s > 1 or i = 0""")
def page_offsets(spark, d):
    """Pages, here lines, with their offsets."""
    out = segment.pages(table(spark, d, "documents"), "doc_id", "text", "\n")
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("""
select doc_id, i as chunk, cast(i * 800 as bigint) as start, length(substr(text, i * 800 + 1, 1000)) as n, md5(substr(text, i * 800 + 1, 1000)) as digest
from (select doc_id, text, unnest(range(0, cast(floor((length(text) - 1) / 800) as bigint) + 1)) as i from documents where length(text) > 0)""")
def sliding_chunks(spark, d):
    """P6."""
    w = segment.windows(table(spark, d, "documents"), "doc_id", "text", 1000, 200)
    return w.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("n"), F.md5("body").alias("digest"))


@query()
def pack_pages_budget(spark, d):
    """Pages of a document packed under a token ceiling."""
    return segment.plan_pages(segment.pages(table(spark, d, "documents"), "doc_id", "text", "\n"), "doc_id", 10000)


@query("""
select digest, min(doc_id) as doc_id, count(*) as copies from (select doc_id, sha1(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as digest from documents) group by digest""")
def text_dedupe_keep_first(spark, d):
    """Equal texts by letters and digits; the smallest id stays."""
    t = table(spark, d, "documents").select("doc_id", F.sha1(text.loose(F.col("text"))).alias("digest"))
    return t.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""
with b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from benchmark)
select x.item_id as a, y.item_id as b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) as j
from b x join b y on x.item_id < y.item_id where len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.1""")
def jaccard_pairs(spark, d):
    """Benchmark items whose words overlap, counted over shared words."""
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(text.words(F.lower("text")))).alias("w"))
    n = w.groupBy("item_id").agg(F.count("*").alias("n"))
    both = w.select(F.col("item_id").alias("a"), "w").join(w.select(F.col("item_id").alias("b"), "w"), "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    j = both.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return j.withColumn("j", F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).where("j >= 0.1").select("a", "b", F.round("j", 6).alias("j"))


@query("""
select doc_id, length(s) as n_chars, md5(s) as digest from (select doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) as s from documents)""")
def inverted_index_text(spark, d):
    """Texts rebuilt from maps of words to positions."""
    # dealt out by document before texts become words: the aggregates below then need no shuffle
    words = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")), " ")).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    t = segment.inverted_text(index, "doc_id", "index")
    return t.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("""
select field, state, count(*) as n from (
  select 'text' as field, case when text is null or trim(text) = '' then 'absent' else 'present' end as state from documents
  union all select 'lang', case when lang is null or lang = '' then 'absent' else 'present' end from documents
  union all select 'toxic', case when l.toxic is null then 'absent' else 'present' end from documents d left join labels l on l.doc_id = d.doc_id) group by field, state""")
def coverage_baseline(spark, d):
    """states of fields."""
    t = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic")), "doc_id", "left")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.when(F.coalesce(F.trim(c), F.lit("")) == "", "absent").otherwise("present").alias("state")) for c in ("text", "lang", "toxic")])
    return t.select(F.explode(cells).alias("c")).groupBy("c.field", "c.state").agg(F.count("*").alias("n"))


@query("""
with t as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn) - 1 as pos from conversations where role <> 'system'),
n as (select conv_id, count(*) filter (where role = 'user') as u, count(*) filter (where role = 'assistant') as a from t group by conv_id)
select u.conv_id, u.pos, length(u.text) as asked, length(a.text) as answered from t u join t a on u.conv_id = a.conv_id and u.pos = a.pos and u.role = 'user' and a.role = 'assistant' join n on n.conv_id = u.conv_id where n.u = n.a""")
def positional_join(spark, d):
    """Questions and answers by position where there are as many of both."""
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    t = table(spark, d, "conversations").where("role <> 'system'").withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    side = lambda role, name: t.where(F.col("role") == role).select("conv_id", "pos", F.length("text").cast("long").alias(name))
    return link.positional_join(side("user", "asked"), side("assistant", "answered"), "conv_id", "pos")
