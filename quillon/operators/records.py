"""Bibliographic records of five shapes, and BibTeX output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ident import citation_key
from ..functions.text import bib_escape, bound, strip_html
from ..sources.store import materialised

FIELDS = ("Title", "Authors", "Affiliations", "Journal", "PublicationYear", "Abstract", "Keywords", "ManuscriptLink")
SHAPES = ("csl", "crossref", "openalex", "semanticscholar", "unpaywall")
#: How many concepts count as keywords.
CONCEPTS = 25


def at(record: Column, path: str, kind: str = "string") -> Column:
    """A part of a VARIANT; null if it is missing or of another kind. Text stands as itself, numbers as text."""
    if kind != "string":
        return F.try_variant_get(record, path, kind)
    value = F.try_variant_get(record, path, "variant")
    # lists and objects would be written out as JSON
    return F.when(~F.schema_of_variant(value).rlike("^(ARRAY|OBJECT|VOID|BOOLEAN)"), F.try_variant_get(record, path, "string"))


def _items(record: Column, path: str) -> Column:
    return F.coalesce(at(record, path, "array<variant>"), F.array().cast("array<variant>"))


def flat(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)[\s\p{Cc}]+", " "))


def _first(*values: Column) -> Column:
    """The first value that is not blank, else ''."""
    return F.coalesce(*[F.nullif(flat(v), F.lit("")) for v in values], F.lit(""))


def _joined(values: Column) -> Column:
    """Values in order, each once whatever its case, by semicolons."""
    once = lambda some: bound(F.transform(some, lambda v: F.lower(v)), lambda folded: F.filter(some, lambda v, i: F.array_position(folded, F.get(folded, i)) == i + 1))
    return F.array_join(bound(F.filter(F.transform(values, flat), lambda v: v != ""), once), "; ")


def year_of(record: Column, *paths: str) -> Column:
    """The first year among dates, which are parts in lists (1500 to 2100 if a number, any digits if text)."""

    def one(path: str) -> list[Column]:
        out = []
        for parts in (f"{path}['date-parts'][0][0]", f"{path}[0][0]"):
            value = F.try_variant_get(record, parts, "variant")
            number, text = F.try_variant_get(record, parts, "long"), at(record, parts)
            kind = F.schema_of_variant(value)
            out.append(F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & number.between(1500, 2100), number.cast("string")).when((kind == "STRING") & text.rlike("^[0-9]+$"), text))
        return out

    return F.coalesce(*[c for p in paths for c in one(p)], F.lit(""))


def _person(a: Column) -> Column:
    family, given = flat(at(a, "$.family")), flat(at(a, "$.given"))
    return F.when((family != "") & (given != ""), F.concat(family, F.lit(", "), given)).otherwise(F.concat(family, given))


def _names(record: Column, path: str, name: str) -> Column:
    return F.transform(_items(record, path), lambda x: at(x, name))


def _csl(r: Column) -> dict[str, Column]:
    return {
        "Title": _first(at(r, "$.title")),
        "Authors": _joined(F.transform(_items(r, "$.author"), _person)),
        "Journal": _first(at(r, "$['container-title'][0]"), at(r, "$['container-title']")),
        "PublicationYear": year_of(r, "$.issued"),
        "Abstract": _first(at(r, "$.abstract")),
        "ManuscriptLink": _first(at(r, "$.URL")),
    }


def _crossref(r: Column) -> dict[str, Column]:
    links = F.filter(_items(r, "$.message.link"), lambda x: flat(at(x, "$.URL")) != "")
    pdf = F.filter(links, lambda x: F.contains(F.lower(F.coalesce(at(x, "$['content-type']"), F.lit(""))), F.lit("pdf")))
    url = lambda xs: at(F.try_element_at(xs, F.lit(1)), "$.URL")
    affiliations = F.flatten(F.transform(_items(r, "$.message.author"), lambda a: F.transform(_items(a, "$.affiliation"), lambda x: at(x, "$.name"))))
    return {
        "Title": _first(at(r, "$.message.title[0]")),
        "Authors": _joined(F.transform(_items(r, "$.message.author"), _person)),
        "Affiliations": _joined(affiliations),
        "Journal": _first(at(r, "$.message['container-title'][0]")),
        "PublicationYear": year_of(r, *[f"$.message['{k}']" for k in ("published-print", "published-online", "issued", "created")]),
        "Abstract": flat(strip_html(at(r, "$.message.abstract"))),
        "Keywords": _joined(F.transform(_items(r, "$.message.subject"), lambda x: at(x, "$"))),
        "ManuscriptLink": _first(url(pdf), url(links), at(r, "$.message.URL")),
    }


def _inverted(r: Column) -> Column:
    """The words of an index in the order of their places; of several words of one place the first stays, in the order of a VARIANT, which is that of the alphabet."""
    entries = F.map_entries(F.coalesce(at(r, "$.abstract_inverted_index", "map<string,array<int>>"), F.create_map().cast("map<string,array<int>>")))
    placed = F.flatten(F.transform(entries, lambda e, i: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    order = F.array_sort(F.filter(placed, lambda x: x["p"] >= 0))
    first = bound(order, lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["p"] != x["p"])))
    return flat(F.array_join(F.transform(first, lambda x: x["w"]), " "))


def _openalex(r: Column) -> dict[str, Column]:
    return {
        "Title": _first(at(r, "$.title")),
        "Authors": _joined(_names(r, "$.authorships", "$.author.display_name")),
        "Affiliations": _joined(F.flatten(F.transform(_items(r, "$.authorships"), lambda a: _names(a, "$.institutions", "$.display_name")))),
        "Journal": _first(at(r, "$.primary_location.source.display_name")),
        "PublicationYear": _first(at(r, "$.publication_year")),
        "Abstract": _inverted(r),
        "Keywords": _joined(F.slice(_names(r, "$.concepts", "$.display_name"), 1, CONCEPTS)),
        "ManuscriptLink": _first(*[at(r, p) for p in ("$.best_oa_location.pdf_url", "$.best_oa_location.landing_page_url", "$.open_access.oa_url", "$.primary_location.landing_page_url")]),
    }


def _semantic(r: Column) -> dict[str, Column]:
    return {
        "Title": _first(at(r, "$.title")),
        "Authors": _joined(_names(r, "$.authors", "$.name")),
        "Journal": _first(at(r, "$.journal.name"), at(r, "$.venue")),
        "PublicationYear": _first(at(r, "$.year")),
        "Abstract": _first(at(r, "$.abstract")),
        "ManuscriptLink": _first(at(r, "$.openAccessPdf.url"), at(r, "$.url")),
    }


def _unpaywall(r: Column) -> dict[str, Column]:
    others = F.filter(F.transform(_items(r, "$.oa_locations"), lambda x: _first(at(x, "$.url_for_pdf"), at(x, "$.url"))), lambda u: u != "")
    return {"ManuscriptLink": _first(at(r, "$.best_oa_location.url_for_pdf"), at(r, "$.best_oa_location.url"), F.try_element_at(others, F.lit(1)))}


_PARSERS = dict(zip(SHAPES, (_csl, _crossref, _openalex, _semantic, _unpaywall), strict=True))


def shape(record: Column) -> Column:
    """Which shape a record has, by the members that only it has; null if it is no object."""
    has = lambda *paths: reduce(lambda a, b: a | b, [F.try_variant_get(record, p, "variant").isNotNull() for p in paths])
    return (
        F.when(~F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False)), F.lit(None).cast("string"))
        .when(has("$.message"), "crossref")
        .when(has("$.authorships", "$.abstract_inverted_index", "$.publication_year"), "openalex")
        .when(has("$.oa_locations", "$.best_oa_location"), "unpaywall")
        .when(has("$.authors", "$.venue", "$.openAccessPdf", "$.paperId"), "semanticscholar")
        .otherwise("csl")
    )


def parsed(df: DataFrame, record: str, source: str | None = None) -> DataFrame:
    """``df`` with ``shape`` and the fields :data:`FIELDS` of its VARIANT records, '' for what is missing.

    A record is read by the parser of its shape, which is told by the column
    ``source`` or seen from the record. Titles and journals may be text or lists,
    people have names in parts, dates one of four forms."""
    r = F.col(record)
    out = df.withColumn("shape", F.col(source) if source else shape(r))
    parts = {s: parser(r) for s, parser in _PARSERS.items()}

    def field(name: str) -> Column:
        value = F.lit("")
        for s, fields in parts.items():
            if name in fields:
                value = F.when(F.col("shape") == s, fields[name]).otherwise(value)
        return value.alias(name)

    return out.select("*", *[field(n) for n in FIELDS])


def entries(df: DataFrame, doi: str, record: str) -> DataFrame:
    """C14: what a BibTeX entry needs of a CSL record: key, author, title, journal, year, volume, number, pages."""
    r = F.col(record)

    def person(a: Column) -> Column:
        family, given = flat(at(a, "$.family")), flat(at(a, "$.given"))
        return F.when((family != "") & (given != ""), F.concat(family, F.lit(", "), given)).when(family != "", family).otherwise(flat(at(a, "$.literal")))

    people = F.filter(F.transform(_items(r, "$.author"), person), lambda x: x != "")
    return df.select(
        F.col(doi).alias("doi"),
        citation_key(F.col(doi)).alias("key"),
        F.array_join(people, " and ").alias("author"),
        _first(at(r, "$.title[0]"), at(r, "$.title")).alias("title"),
        _first(at(r, "$['container-title'][0]"), at(r, "$['container-title']"), at(r, "$.journalAbbreviation[0]"), at(r, "$.journalAbbreviation")).alias("journal"),
        year_of(r, *[f"$['{k}']" for k in ("issued", "published-print", "published-online", "published")]).alias("year"),
        *[flat(at(r, f"$.{path}")).alias(name) for path, name in (("volume", "volume"), ("issue", "number"), ("page", "pages"))],
    )


def one_to_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values and values with several keys, with the count; empty if the two map one to one.

    Both counts are aggregates; nothing of a key is gathered."""
    pairs = df.select(F.col(key).alias("k"), F.col(value).alias("v")).distinct()
    count = lambda by, what: pairs.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(what).alias("side"), "name", "n")
    return count("k", key).unionByName(count("v", value))


def bibtex(entry: DataFrame) -> DataFrame:
    """``key, text``: one BibTeX entry per row; fields without a value are left out, title braces kept."""
    names = ("author", "title", "journal", "year", "volume", "number", "pages", "doi")
    fields = F.filter(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), bib_escape(F.col(n)), F.lit("}"))) for n in names]), lambda x: x.isNotNull())
    return entry.select("key", F.concat(F.lit("@article{"), F.col("key"), F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}\n")).alias("text"))


def write_bibtex(entry: DataFrame, path: str) -> DataFrame:
    """Entries as text files in the order of their keys, only if keys and DOIs map one to one.

    The whole table is checked before anything is written; repeated rows are
    written once. Nothing is overwritten."""
    once = materialised(entry.distinct(), "entries")
    clash = one_to_one(once, "key", "doi").limit(3).collect()
    if clash:
        raise ValueError("keys and DOIs do not map one to one: " + "; ".join(f"{r['side']} {r['name']} has {r['n']}" for r in clash))
    bibtex(once).repartitionByRange("key").sortWithinPartitions("key").select("text").write.mode("errorifexists").text(path)
    return once
