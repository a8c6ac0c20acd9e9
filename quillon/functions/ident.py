"""Identifiers and links: DOIs, names for files, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def canonical_doi(value: Column) -> Column:
    """G1: no resolver, no 'doi:', no outer punctuation, lower case."""
    s = F.trim(F.coalesce(value, F.lit("")))
    s = F.regexp_replace(s, r"(?i)^\s*https?://(dx\.)?doi\.org/\s*", "")
    s = F.regexp_replace(s, r"(?i)^\s*doi\s*:\s*", "")
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"^[ \t\r\n.,;)]+|[ \t\r\n.,;)]+$", ""), r"^\(+", ""))


def is_doi_like(value: Column) -> Column:
    """D5."""
    return F.coalesce(value, F.lit("")).rlike(r"\b10\.\d{4,9}/\S+\b")


def dois_in(value: Column) -> Column:
    """Distinct DOIs of a text in order, trailing punctuation cut off."""
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"[.,;:)]+$", "")))


def stable_name(value: Column) -> Column:
    """Lower-case letters and digits, underscores between, at most 120."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(120))


def safe_file_name(value: Column) -> Column:
    """At most 160 characters, the tail of longer ones hashed."""
    s = F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.length(s) > 160, F.concat(F.left(s, F.lit(140)), F.lit("_"), F.left(F.sha2(value, 256), F.lit(16)))).otherwise(s)


def citation_key(value: Column) -> Column:
    """S and the DOI in lower case, an underscore for each character that is no letter or digit."""
    return F.concat(F.lit("S"), F.regexp_replace(F.lower(F.trim(value)), "[^0-9a-z]", "_"))


def doi_prefix(value: Column) -> Column:
    """G42."""
    return F.substring_index(value, "/", 1)


def canonical_url(value: Column) -> Column:
    """Without trailing punctuation, scheme, www and slash."""
    s = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[).,;\]]+$", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), r"^https?://", ""), r"^www\.", "")
    return F.replace(F.regexp_replace(s, r"/+$", ""), F.lit("dx.doi.org/"), F.lit("doi.org/"))


def link_score(value: Column) -> Column:
    """URLs by length, with a preference for PDFs."""
    u = F.trim(F.coalesce(value, F.lit("")))
    low = F.lower(u)
    score = 100.0 + F.length(u) + F.when(low.endswith(".pdf"), 500).otherwise(0) + F.when(F.contains(low, F.lit("stamp/stamp.jsp")), 400).otherwise(0) + F.when(F.contains(low, F.lit("pdf")), 100).otherwise(0)
    return F.when(low.rlike(r"^https?://"), score.cast("double")).otherwise(0.0)


def hrefs(html: Column, base: Column | None = None, hint: str | None = None) -> Column:
    """Targets of anchors in order, repeats included, quoted in either way or not at all.

    With ``hint`` only those that match it; with the page's address as ``base``
    made absolute, each once."""
    out = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    out = F.transform(out, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    if hint:
        out = F.filter(out, lambda x: x.rlike(hint))
    return out if base is None else F.array_distinct(F.transform(out, lambda x: absolute(x, base)))


def _parts(address: Column) -> dict[str, Column]:
    """Scheme with its colon, authority with its slashes, path, query with its mark, fragment with its mark."""
    part = lambda i: F.regexp_extract(address, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$", i)
    return dict(zip(("scheme", "host", "path", "query", "fragment"), map(part, range(1, 6)), strict=True))


def _no_dots(path: Column) -> Column:
    """A path without '.' and '..', folded over its segments with a stack; it cannot leave the root."""
    kept = lambda acc: F.greatest(F.size(acc) - 1, F.lit(1))
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, kept(acc))).otherwise(F.concat(acc, F.array(s)))
    segments = F.split(path, "/")
    out = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step)
    # a path that ends in dots is a folder
    whole = F.concat(out, F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return F.when(F.contains(path, F.lit("/.")), F.when(F.size(whole) == 1, "/").otherwise(F.array_join(whole, "/"))).otherwise(path)


def absolute(link: Column, base: Column) -> Column:
    """A link as seen from a page: '..' and '.' are resolved, '?q' and '#f' belong to the page itself, '' is the page.

    An address with a scheme stays as it is."""
    x, p = _parts(link), _parts(base)
    folder = F.regexp_extract(p["path"], r"(?s)^(.*/)[^/]*$", 1)
    joined = F.when(x["path"].startswith("/"), x["path"]).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), x["path"]))
    path = F.when(x["path"] == "", p["path"]).otherwise(_no_dots(joined))
    query = F.when((x["path"] == "") & (x["query"] == ""), p["query"]).otherwise(x["query"])
    return (
        F.when(x["scheme"] != "", link)
        .when(x["host"] != "", F.concat(p["scheme"], x["host"], _no_dots(x["path"]), x["query"], x["fragment"]))
        .otherwise(F.concat(p["scheme"], p["host"], path, query, x["fragment"]))
    )


def base_of(html: Column, url: Column) -> Column:
    """What the links of a page are relative to: its first ``<base href>``, as seen from its address, else that."""
    href = F.regexp_extract(html, r"""(?i)<base\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    href = F.regexp_replace(href, r"""^["']|["']$""", "")
    return F.when(href != "", absolute(href, url)).otherwise(url)


_DOI_IN = r"(?i)\b10\.\d{4,9}/|doi\.org/"


def link_class(url: Column, kind: Column | None = None, own_doi: Column | None = None) -> Column:
    """Ordered classes of a link by its host, the paper's own DOI and the link's type."""
    s = canonical_url(url)
    raw = F.coalesce(url, F.lit(""))
    own = F.lit(False) if own_doi is None else (canonical_doi(own_doi) != "") & F.contains(s, canonical_doi(own_doi))
    supplement = s.rlike(r"supplement|supporting") if kind is None else s.rlike(r"supplement|supporting") | F.coalesce(kind == "supplementary_material", F.lit(False))
    return (
        F.when(s.rlike(r"github\.com|gitlab\.com|zenodo\.org|figshare\.com|osf\.io|huggingface\.co"), "author_deposit")
        .when(s.rlike(r"kaggle\.com|physionet\.org|cancerimagingarchive\.net"), "public_portal")
        .when(own, "article_doi")
        .when(supplement, "si_reference")
        .when(raw.rlike(r"(?i)https?://") | raw.rlike(_DOI_IN), "other_url")
        .otherwise("other")
    )


def triage(field: Column, value: Column) -> Column:
    """``(kind, fetch, note)`` of a cell that names code or data; only what authors deposited is fetched."""
    s = F.coalesce(value, F.lit(""))
    url, doi = s.rlike(r"(?i)https?://"), s.rlike(_DOI_IN)
    out = lambda kind, fetch, note="": F.struct(F.lit(kind).alias("kind"), F.lit(fetch).alias("fetch"), F.lit(note).alias("note"))
    return (
        F.when(s.rlike(vocab.CODE_HOSTS), out("code_repository", True))
        .when(s.rlike(vocab.DATA_HOSTS) & doi & ~url, out("data_doi", True))
        .when(s.rlike(vocab.DATA_HOSTS), out("data_repository", True))
        .when((field == "code_url") & (url | doi), out("code_repository", True))
        .when(field == "code_url", out("code_repository", False, "locator_unresolved"))
        .when(doi & ~url, out("data_doi", True))
        .when(url, out("external_data_url", False, "review"))
        .otherwise(out("named_dataset_ref", False, "not_a_target"))
    )


def is_pdf_like(url: Column) -> Column:
    """G27."""
    u = F.lower(F.coalesce(url, F.lit("")))
    out = u.endswith(".pdf") | u.contains(".pdf?")
    for token in vocab.PDF_TOKENS:
        out = out | u.contains(token)
    return out


def pdf_links(html: Column, base: Column) -> Column:
    """Absolute targets of a page that look like PDFs."""
    return F.filter(hrefs(html, base), lambda x: is_pdf_like(x))


def pii(url: Column) -> Column:
    """The publisher's item number in an address."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)/pii/([A-Z0-9]+)", 1), F.lit(""))


def found_doi(value: Column) -> Column:
    """The first DOI anywhere in a text, its case kept, trailing marks cut off; else ''."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(value, F.lit("")), r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), r"[.,;:)]+$", "")


def publisher(doi: Column) -> Column:
    """The publisher of a DOI's prefix, else the prefix; '' if it is no DOI."""
    prefix = F.when(F.lower(doi).startswith("10."), F.substring_index(F.lower(doi), "/", 1)).otherwise("")
    table = F.create_map(*[F.lit(x) for kv in vocab.PUBLISHERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, prefix), prefix)


def safe_record_id(value: Column) -> Column:
    """The last part of an identifier as a file name, a hash behind a long one."""
    last = F.regexp_replace(F.substring_index(value, "/", -1), r"[^A-Za-z0-9_.-]", "_")
    tail = F.left(F.sha1(value), F.lit(10))
    return F.when(F.coalesce(value, F.lit("")) == "", "unknown").when(last == "", tail).when(F.length(last) > 40, F.concat(F.left(last, F.lit(30)), F.lit("_"), tail)).otherwise(last)


def prompt_hash(value: Column) -> Column:
    """G56."""
    return F.left(F.sha2(value, 256), F.lit(16))


def file_kind(name: Column) -> Column:
    """The kind of a file by its extension."""
    ext = F.regexp_extract(F.lower(name), r"(\.[^./\\]+)$", 1)
    table = F.create_map(*[F.lit(x) for kind, exts in vocab.FILE_KINDS.items() for e in exts for x in (e, kind)])
    return F.coalesce(F.try_element_at(table, ext), F.lit("other"))


def file_source(path: Column) -> Column:
    """Where a file comes from, by its folders."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    out = F.lit("other")
    for folder, source in reversed(vocab.FILE_SOURCES.items()):
        out = F.when(F.array_contains(parts, folder), source).otherwise(out)
    return out


def file_relevance(source: Column, kind: Column) -> Column:
    """What a file is good for."""
    return (
        F.when(source.isin("chrome_si", "si", "deposit") & kind.isin("pdf", "spreadsheet", "document", "data"), "si_enrichment")
        .when(kind == "code", "code")
        .when((source == "oa") & (kind == "pdf"), "full_text_redundant")
        .when((source == "oa") & (kind == "data"), "metadata")
        .when(kind.isin("image", "archive"), kind)
        .otherwise("other")
    )


def response_class(head: Column, content_type: Column, status: Column) -> Column:
    """What a response is, by its first bytes, its declared type and its status."""
    low, kind = F.lower(F.left(head, F.lit(4000))), F.lower(F.coalesce(content_type, F.lit("")))
    page = low.contains("<html") | low.contains("<!doctype html") | kind.contains("text/html")
    blocked = low.rlike(r"cf-chl|just a moment|attention required! \| cloudflare")
    paywall = low.rlike(r"purchase access|get access|institutional access|buy this article") | status.isin(401, 403)
    return (
        F.when(head.startswith("%PDF-"), "pdf")
        .when(head.startswith("PK\x03\x04"), "zip")
        .when(page & blocked, "cloudflare_block")
        .when(page & paywall, "paywall_html")
        .when(page, "landing_html")
        .when(kind.contains("json") | low.startswith("{") | low.startswith("["), "json")
        .when(kind.contains("xml") | low.startswith("<?xml"), "xml")
        .when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(kind.rlike("csv|excel|spreadsheet"), "data")
        .otherwise("binary")
    )
