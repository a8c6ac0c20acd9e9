"""Columns of unlike tables: names, the one that holds identifiers, and standard fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ident import canonical_doi, is_doi_like
from ..functions.text import clean

# For each standard field the patterns of names that may and must
# not stand for it, and the points of names that are preferred.
FIELD_RULES = {
    "Title": ([r"^title$", r"^article title$", r"^document title$", r"article title", r"document title"], [r"source title", r"publication title", r"\bjournal\b"]),
    "Authors": ([r"^author full names$", r"^authors$", r"^author$", r"^book authors$", r"^book author full names$", r"^group authors$"], [r"keyword", r"affiliat", r"address", r"orcid", r"email", r"funding"]),
    "Affiliations": ([r"^author affiliations$", r"^affiliations$", r"affiliat", r"^addresses$", r"reprint addresses"], [r"email"]),
    "PublicationYear": ([r"^publication year$", r"^year$", r"published year", r"publication year"], [r"conference"]),
    "Abstract": ([r"^abstract$"], []),
    "Journal": ([r"^source title$", r"source title", r"^publication title$", r"publication title", r"\bjournal\b", r"journal title", r"container title"], [r"publisher", r"address", r"city"]),
    "DOI": ([r"^doi$"], [r"doi link", r"doi url"]),
    "DOILink": ([r"doi link", r"doi url"], []),
    "ManuscriptLink": ([r"pdf link", r"full text", r"\blink\b", r"\burl\b", r"record"], [r"doi link", r"doi url", r"orcid", r"email"]),
    "Keywords": ([r"^author keywords$", r"author keywords", r"keywords plus", r"^keywords$", r"ieee terms", r"mesh terms", r"index terms"], [r"^authors?$", r"affiliat", r"address"]),
}
PREFERRED = {
    "Title": {"article title": 30, "document title": 25, "title": 10},
    "Authors": {"author full names": 40, "authors": 25, "author": 10},
    "Affiliations": {"author affiliations": 35, "affiliations": 30, "addresses": 10},
    "PublicationYear": {"publication year": 30, "year": 15},
    "Journal": {"source title": 40},
    "Keywords": {"author keywords": 35},
    "DOILink": {"doi link": 30, "doi url": 25},
}
#: Points of names that hold a word, and not another one.
HOLDING = {"Journal": [("journal", "publisher", 15)], "Keywords": [("keywords plus", None, 20), ("ieee terms", None, 10)], "ManuscriptLink": [("pdf link", None, 30)]}
#: Preference among columns whose name holds 'doi', and the least shares of identifiers with and without such a name.
DOI_NAMES = {"doi": 3, "doi link": 1, "doi url": 1}
NAMED_SHARE, OTHER_SHARE = 0.01, 0.05
_UNNAMED, _LETTERS_A_POINT = 100, 60


def normal_name(name: object) -> str:
    """Lower-case letters and digits, one blank for white space, hyphens and underscores."""
    spaced = re.sub(r"[\s_-]+", " ", "" if name is None else str(name).strip().lower())
    return re.sub(r"[^a-z0-9 ]", "", spaced).strip()


def profile(df: DataFrame) -> dict[str, float]:
    """The share of values of each column that hold a DOI, among those that are not null, from one aggregate."""
    held = [F.struct(F.count(c).alias("n"), F.count_if(is_doi_like(canonical_doi(c.cast("string")))).alias("k")).alias(str(i)) for i, c in enumerate(df[f"`{x}`"] for x in df.columns)]
    row = df.agg(*held).first() if held else []
    return {c: (r["k"] / r["n"] if r["n"] else 0.0) for c, r in zip(df.columns, row, strict=True)}


def doi_column(shares: dict[str, float]) -> str | None:
    """Of the columns named so the one with the largest share, then the preferred name, then the first; else any column with a larger share."""
    named = [(s, DOI_NAMES.get(normal_name(c), 0), -i, c) for i, (c, s) in enumerate(shares.items()) if "doi" in normal_name(c)]
    if named and max(named)[0] > NAMED_SHARE:
        return max(named)[3]
    other = [(s, -i, c) for i, (c, s) in enumerate(shares.items())]
    return max(other)[2] if other and max(other)[0] > OTHER_SHARE else None


def _points(field: str, name: str) -> float:
    held = sum(p for word, never, p in HOLDING.get(field, ()) if word in name and (never is None or never not in name))
    return PREFERRED.get(field, {}).get(name, 0) + held - (_UNNAMED if name.startswith("unnamed") else 0) - len(name) / _LETTERS_A_POINT


def standard_fields(columns: list[str], rules: dict = FIELD_RULES) -> dict[str, str]:
    """The best column for each field; of equal ones the first.

    A name fits if an including pattern is found in it and no excluding one."""
    out = {}
    for field, (include, exclude) in rules.items():
        fits = [(_points(field, n), -i, c) for i, c in enumerate(columns) for n in [normal_name(c)] if any(re.search(p, n) for p in include) and not any(re.search(p, n) for p in exclude)]
        if fits:
            out[field] = max(fits)[2]
    return out


def standardised(df: DataFrame, fields: list[str] | None = None, default: str = "") -> DataFrame:
    """``doi`` in canonical form and all standard fields as strings, missing ones and nulls as ``default``.

    The plan depends on the data: one aggregate over the table tells which column
    holds identifiers."""
    found, doi = standard_fields(df.columns), doi_column(profile(df))
    text = lambda c: F.coalesce(df[f"`{c}`"].cast("string"), F.lit(default)) if c else F.lit(default)
    return df.select(canonical_doi(text(doi)).alias("doi"), *[text(found.get(f)).alias(f) for f in fields or FIELD_RULES])


def tasks(df: DataFrame, key: str, doi: str, title: str, abstract: str) -> DataFrame:
    """What a task needs of a record: id, canonical DOI, cleaned title and abstract."""
    return df.select(F.col(key).cast("string").alias("record_id"), canonical_doi(F.col(doi)).alias("doi"), clean(F.col(title)).alias("title"), clean(F.col(abstract)).alias("abstract"))
