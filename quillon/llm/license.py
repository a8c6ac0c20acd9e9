"""Licence recognition by sentence rules, in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences as patterns over a normalised sentence (lower
# case; a run of other characters than a-z 0-9 + . - is one blank), by family.
# Of a family the first pattern that matches names the sentence; a sentence may
# hold known text of several families.
SENTENCES = {
    "refusal": [("NotLicensed", r"\bnot (be )?(licen[sc]ed|released|distributed|available|offered|covered|provided) (under|by)\b")],
    "spdx": [("SpdxTag", r"spdx-license-identifier ")],
    "agpl": [
        ("AgplVersion3OrLater", r"\bgnu affero general public licen[sc]e.* version 3.*(any later version|or later)"),
        ("AgplVersion3", r"\bgnu affero general public licen[sc]e|\bagpl(-| )?v?3"),
    ],
    "lgpl": [
        ("LgplVersion3OrLater", r"\b(gnu )?lesser general public licen[sc]e.*\b(version|v) ?3.*(any later version|or later)"),
        ("LgplVersion3", r"\b(gnu )?lesser general public licen[sc]e.*\b(version |v)?3|\blgpl(-| )?v?3"),
        ("LgplVersion21OrLater", r"\b(gnu )?(lesser|library) general public licen[sc]e.*\b(version|v) ?2.*(any later version|or later)"),
        ("LgplVersion21", r"\b(gnu )?(lesser|library) general public licen[sc]e.*\b(version |v)?2|\blgpl(-| )?v?2"),
        ("LgplAny", r"\b(gnu )?(lesser|library) general public licen[sc]e|\bunder the lgpl\b"),
    ],
    "gpl": [
        ("GplVersion3OrLater", r"\bgnu general public licen[sc]e.*\b(version |v)3.*(any later version|or later)|\bgpl(-| )?v?3(.0)?(\+|-or-later| or later)"),
        ("GplVersion2OrLater", r"\bgnu general public licen[sc]e.*\b(version |v)2.*(any later version|or later)|\bgpl(-| )?v?2(.0)?(\+|-or-later| or later)"),
        ("GplVersion3", r"\bgnu general public licen[sc]e.*\b(version |v)3|\bgpl(-| )?v?3"),
        ("GplVersion2", r"\bgnu general public licen[sc]e.*\b(version |v)2|\bgpl(-| )?v?2"),
        ("GplAny", r"\bgnu general public licen[sc]e|\bunder the (terms of the )?(gnu )?gpl\b"),
    ],
    "fdl": [("GfdlAny", r"\bgnu free documentation licen[sc]e")],
    "apache": [
        ("Apache2", r"\bapache (software )?licen[sc]e[ a-z]* ?(version |v)?2|\bapache-2.0\b|\bapache 2.0\b"),
        ("ApacheUrl", r"\bapache.org licenses license-2.0"),
        ("ApacheCompliance", r"\byou may not use this file except in compliance with the licen[sc]e"),
        ("ApacheAsIs", r"\bsoftware distributed under the licen[sc]e is distributed on an as is basis"),
    ],
    "mit": [
        ("MitGrant", r"\bpermission is hereby granted free of charge to any person obtaining a copy"),
        ("MitNotice", r"\bcopyright notice and this permission notice shall be included"),
        ("AsIsWarranty", r"\bsoftware is provided as is.* without warranty of any kind"),
        ("MitShort", r"\b(mit|expat) licen[sc]e\b|\blicen[sc]ed under (the )?mit\b"),
    ],
    "isc": [
        ("IscGrant", r"\bpermission to use copy modify and.or distribute this software for any purpose with or without fee"),
        ("IscShort", r"\bisc licen[sc]e\b"),
    ],
    "bsd": [
        ("BsdGrant", r"\bredistribution and use in source and binary forms"),
        ("BsdSource", r"\bredistributions of source code must retain the above copyright"),
        ("BsdBinary", r"\bredistributions in binary form must reproduce the above copyright"),
        ("BsdEndorse", r"\bwithout specific prior written permission"),
        ("BsdShort3", r"\b(3-clause|three-clause|new|modified|revised) bsd licen[sc]e|\bbsd[ -]3-clause"),
        ("BsdShort2", r"\b(2-clause|two-clause|simplified|freebsd) (bsd )?licen[sc]e|\bbsd[ -]2-clause"),
        ("BsdAny", r"\bbsd licen[sc]e\b"),
    ],
    "mozilla": [("Mpl2", r"\bmozilla public licen[sc]e[ a-z]* ?(version |v. ?|v)?2|\bmpl[ -]?(v|version )?2"), ("MplAny", r"\bmozilla public licen[sc]e")],
    "eclipse": [("Epl2", r"\beclipse public licen[sc]e[ a-z-]* ?(version |v. ?|v)?2|\bepl[ -]2"), ("Epl1", r"\beclipse public licen[sc]e")],
    "boost": [("Boost", r"\bboost software licen[sc]e")],
    "zlib": [("ZlibGrant", r"\bthis software is provided as-is without any express or implied warranty"), ("ZlibShort", r"\bzlib licen[sc]e")],
    "artistic": [("Artistic2", r"\bartistic licen[sc]e[ a-z]* ?2"), ("ArtisticAny", r"\bartistic licen[sc]e")],
    "font": [("Ofl", r"\bsil open font licen[sc]e")],
    "union": [("Eupl", r"\beuropean union public licen[sc]e|\beupl\b")],
    "domain": [
        ("UnlicenseText", r"\bfree and unencumbered software released into the public domain"),
        ("UnlicenseShort", r"\bunder the unlicen[sc]e\b"),
        ("PublicDomain", r"\b(in|into|to) the public domain"),
    ],
    "wtfpl": [("Wtfpl", r"\bdo what the f[a-z]+ you want to public licen[sc]e|\bwtfpl\b")],
    "commons": [
        ("Cc0", r"\bcc0\b|\bcreative commons zero\b"),
        ("CcByNcSa", r"\bcc[ -]by-nc-sa\b|\bcreative commons.*\battribution[ -]noncommercial[ -]sharealike"),
        ("CcByNcNd", r"\bcc[ -]by-nc-nd\b|\bcreative commons.*\battribution[ -]noncommercial[ -]noderiv"),
        ("CcByNc", r"\bcc[ -]by-nc\b|\bcreative commons.*\battribution[ -]noncommercial"),
        ("CcBySa", r"\bcc[ -]by-sa\b|\bcreative commons.*\battribution[ -]sharealike"),
        ("CcByNd", r"\bcc[ -]by-nd\b|\bcreative commons.*\battribution[ -]noderiv"),
        ("CcBy", r"\bcc[ -]by\b|\bcreative commons.*\battribution\b"),
    ],
    "rights": [("AllRights", r"\ball rights reserved"), ("Proprietary", r"\bproprietary (and confidential|licen[sc]e)"), ("Copyright", r"^copyright\b.*[0-9]{4}")],
    "general": [("SeeLicense", r"\bsee the (accompanying )?licen[sc]e"), ("UnknownLicense", r"\blicen[sc]ed under|\breleased under .*licen[sc]e|\bunder the terms of .*licen[sc]e")],
}
# Licences in order of precedence, each with alternatives. An
# alternative names sentences that stand in this order in a text, with anything
# between them; after an exclamation mark, one that must not follow the last.
RULES = [
    ("AGPL-3.0-or-later", ["AgplVersion3OrLater"]),
    ("AGPL-3.0-only", ["AgplVersion3"]),
    ("LGPL-3.0-or-later", ["LgplVersion3OrLater"]),
    ("LGPL-3.0-only", ["LgplVersion3"]),
    ("LGPL-2.1-or-later", ["LgplVersion21OrLater"]),
    ("LGPL-2.1-only", ["LgplVersion21"]),
    ("LGPL", ["LgplAny"]),
    ("GPL-3.0-or-later", ["GplVersion3OrLater"]),
    ("GPL-2.0-or-later", ["GplVersion2OrLater"]),
    ("GPL-3.0-only", ["GplVersion3"]),
    ("GPL-2.0-only", ["GplVersion2"]),
    ("GPL", ["GplAny"]),
    ("GFDL", ["GfdlAny"]),
    ("Apache-2.0", ["Apache2", "ApacheCompliance ApacheAsIs", "ApacheUrl ApacheAsIs"]),
    ("MIT", ["MitGrant MitNotice", "MitShort"]),
    ("ISC", ["IscGrant", "IscShort"]),
    ("BSD-3-Clause", ["BsdGrant BsdSource BsdBinary BsdEndorse", "BsdShort3"]),
    ("BSD-2-Clause", ["BsdGrant BsdSource BsdBinary !BsdEndorse", "BsdShort2"]),
    ("BSD", ["BsdAny"]),
    ("MPL-2.0", ["Mpl2"]),
    ("MPL", ["MplAny"]),
    ("EPL-2.0", ["Epl2"]),
    ("EPL-1.0", ["Epl1"]),
    ("BSL-1.0", ["Boost"]),
    ("Zlib", ["ZlibGrant", "ZlibShort"]),
    ("Artistic-2.0", ["Artistic2"]),
    ("Artistic-1.0", ["ArtisticAny"]),
    ("OFL-1.1", ["Ofl"]),
    ("EUPL", ["Eupl"]),
    ("Unlicense", ["UnlicenseText", "UnlicenseShort"]),
    ("WTFPL", ["Wtfpl"]),
    ("CC0-1.0", ["Cc0"]),
    ("CC-BY-NC-SA", ["CcByNcSa"]),
    ("CC-BY-NC-ND", ["CcByNcNd"]),
    ("CC-BY-NC", ["CcByNc"]),
    ("CC-BY-SA", ["CcBySa"]),
    ("CC-BY-ND", ["CcByNd"]),
    ("CC-BY", ["CcBy"]),
    ("Public-Domain", ["PublicDomain"]),
    ("Proprietary", ["Proprietary", "AllRights"]),
]
#: Rules that only count where no other one holds.
WEAK = ["Proprietary"]
#: A sentence that matches any pattern holds one of these; other texts need no patterns.
GATE = ["licen", "copyright", "permission", "warranty", "redistribution", "public domain", "cc0", "cc by", "cc-by", "creative commons", "bsd", "gpl", "apache", "rights reserved", "wtfpl", "eupl", "mpl"]

# Abbreviations whose full stop ends no sentence.
_ABBREVIATION = r"\b(v|ver|vers|no|inc|corp|ltd|co|e\.g|i\.e|et al|art|sec|copr|www)\.([ \t\r\n])"
#: How a text becomes paragraphs of one line: an SPDX tag, a line drawn of signs and an empty line stand alone, signs of comments go, other line feeds are blanks.
_STEPS = [
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+|\||rem |dnl )[ \t]?", ""),
    (r"(spdx-license-identifier:[^\n]*)", "\n\n$1\n\n"),
    (r"\n[ \t]*(?:[^a-z0-9 \t\n]*[ \t]*\n[ \t\n]*)", "\x01"),
    (r"\n", " "),
    (_ABBREVIATION, "$1$2"),
    (r"[.!?][\"')\]]*[ \t]+", "\x01"),
]


def _matches(s: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(w) for w in words])


def _sentences(low: Column) -> Column:
    out = low
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.filter(F.transform(F.split(out, "\x01"), lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9+.\-]+", " "))), lambda s: s != "")


def _linear(pattern: str) -> str:
    """The pattern for a backtracking matcher: what stands before ``.*`` is met at its first place and not tried again.

    ``a.*b`` holds if and only if b stands after the first a, so the answer is the same."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append(pattern[at:i])
            at = i + 1
    parts.append(pattern[at:])
    return "|".join("^" + "".join(f"(?>.*?{x})" for x in p.split(".*")) if ".*" in p and p[0] != "^" else p for p in parts)


def _names(sentence: Column) -> Column:
    """The names of the known text in a sentence, at most one of each family; a refusal has no other."""
    found = []
    for family in SENTENCES.values():
        name = F.lit(None).cast("string")
        for n, pattern in reversed(family):
            name = F.when(sentence.rlike(_linear(pattern)), F.lit(n)).otherwise(name)
        found.append(name)
    all_names = F.array_compact(F.array(*found))
    return F.when(~_matches(sentence, GATE), F.array().cast("array<string>")).when(found[0].isNotNull(), F.array(found[0])).otherwise(all_names)


def _holds(ids: Column, alternatives: list[str]) -> Column:
    """Whether one of the alternatives of a rule holds for a sequence of names.

    Single names are looked up; longer ones are followed through the sequence by
    a fold whose state is the number of names met, so that time and depth do not
    depend on what stands between them."""

    def after(steps: list[str], never: str):
        def step(at: Column, name: Column) -> Column:
            out = F.when(name == F.get(F.array(*map(F.lit, steps)), at), at + 1)
            return (out.when((at == len(steps)) & (name == never), at - 1) if never else out).otherwise(at)

        return step

    singles = [a for a in alternatives if " " not in a]
    tests = [F.arrays_overlap(ids, F.array(*map(F.lit, singles)))] if singles else []
    for a in alternatives:
        if a in singles:
            continue
        steps, never = [x for x in a.split() if x[0] != "!"], a.partition("!")[2]

        every = reduce(lambda x, y: x & y, [F.array_contains(ids, x) for x in steps])
        tests.append(every & (F.aggregate(ids, F.lit(0), after(steps, never)) == len(steps)))
    return reduce(lambda x, y: x | y, tests)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, licenses, n_sentences, n_unmatched`` per row.

    A text becomes sentences: signs of comments go, wrapped lines are joined, an
    empty line or a full stop ends a sentence, a semicolon or an abbreviation
    does not. ``sentence_ids`` is the blank-separated sequence of the names of
    known sentences in order (null if there is none); the identifiers of an SPDX
    tag are ``Spdx:`` and the identifier in lower case. ``licenses`` lists, by
    commas, the licences whose rules the sequence meets in order of precedence,
    then those of SPDX tags (``WITH`` exceptions are left out); ``Proprietary``
    and ``Unknown`` are named only where no other rule holds. ``n_sentences``
    counts the names, ``n_unmatched`` the sentences that hold a word of licences
    but no known text.

    Edge cases: null and empty texts have no sentences, so nulls and 0. Ids may
    be null or repeat. Very long texts are scanned whole. An empty table gives no
    rows. Only built-in functions run; nothing is shuffled. Other columns are
    ignored.
    """
    low = F.lower(F.col("text"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.select("doc_id", F.when(_matches(low, GATE), _sentences(low)).alias("s"))

    def one(s: Column) -> Column:
        tagged = F.regexp_extract(s, r"spdx-license-identifier ([a-z0-9+.\- ]+)", 1)
        parts = F.filter(F.split(F.regexp_replace(tagged, r"\bwith [a-z0-9.\-]+", ""), r" +(?:and |or )?"), lambda x: x != "")
        return F.when(tagged != "", F.transform(parts, lambda x: F.concat(F.lit("Spdx:"), x))).otherwise(_names(s))

    named = base.select("doc_id", F.transform("s", lambda s: F.struct(one(s).alias("n"), _matches(s, GATE).alias("gate"))).alias("s"))
    named = named.select("doc_id", F.flatten(F.transform("s", lambda x: x["n"])).alias("ids"), F.size(F.filter("s", lambda x: x["gate"] & (F.size(x["n"]) == 0))).alias("unmatched"))
    sequence = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    strong = F.array_compact(F.array(*[F.when(_holds(F.col("ids"), held), F.lit(name)) for name, held in RULES if name not in WEAK]))
    tags = F.array_distinct(F.transform(F.filter("ids", lambda x: x.startswith("Spdx:")), lambda x: _canonical(F.substring(x, 6, 200))))
    known = F.array_distinct(F.concat(strong, tags))
    weak = F.when(_holds(F.col("ids"), dict(RULES)["Proprietary"]), "Proprietary").when(_holds(F.col("ids"), ["UnknownLicense", "SeeLicense"]), "Unknown")
    return (
        named.withColumn("sequence", F.when(F.size("ids") > 0, sequence))
        .withColumn("licenses", F.when(F.size(known) > 0, F.array_join(known, ",")).otherwise(weak))
        .select(
            "doc_id",
            F.trim("sequence").alias("sentence_ids"),
            F.when(F.col("sequence").isNotNull(), F.col("licenses")).alias("licenses"),
            F.when(F.size("ids") > 0, F.size("ids")).otherwise(0).cast("long").alias("n_sentences"),
            F.greatest(F.coalesce("unmatched", F.lit(0)), F.lit(0)).cast("long").alias("n_unmatched"),
        )
    )


# Identifiers of the SPDX list, as it writes them.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause
BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC
LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1
PostgreSQL PSF-2.0 Python-2.0 Unicode-3.0 Unlicense WTFPL X11 Zlib""".split()


def _canonical(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n in SPDX for x in (n.lower(), n)])
    return F.coalesce(F.try_element_at(table, name), name)


def scan_sql() -> str:
    """The same for DuckDB over ``documents``; tests hold both against the standard notices."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    gate = lambda s: " or ".join(f"contains({s}, {quote(w)})" for w in GATE)
    text = "lower(text)"
    for pattern, by in _STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
    family = lambda f: "case " + " ".join(f"when regexp_matches(s, {quote(p)}) then {quote(n)}" for n, p in f) + " end"
    refusal, rest = family(SENTENCES["refusal"]), ", ".join(family(f) for k, f in SENTENCES.items() if k != "refusal")

    def holds(alternative: str) -> str:
        order, _, never = alternative.partition(" !")
        out = f"regexp_matches(sequence, {quote(' ' + ' .*'.join(order.split()) + ' ')})"
        return out + (f" and not contains(regexp_extract(sequence, {quote('.* ' + order.split()[-1] + ' (.*)')}, 1), {quote(never)})" if never else "")

    rule = lambda held: " or ".join(f"({holds(a)})" for a in held)
    rules = ", ".join(f"case when {rule(held)} then {quote(n)} end" for n, held in RULES if n not in WEAK)
    spdx = "map {" + ", ".join(f"{quote(n.lower())}: {quote(n)}" for n in SPDX) + "}"
    return f"""
with broken as (
  select doc_id, case when {gate('lower(text)')} then list_filter(list_transform(string_split({text}, chr(1)), lambda s: trim(regexp_replace(s, '[^a-z0-9+.\\-]+', ' ', 'g'))), lambda s: s <> '') end as sentences
  from documents),
one as (select doc_id, unnest(sentences) as s, generate_subscripts(sentences, 1) as i from broken),
named as (
  select doc_id, i, {gate('s')} as gate, case
    when contains(s, 'spdx-license-identifier ') and regexp_extract(s, 'spdx-license-identifier ([a-z0-9+.\\- ]+)', 1) <> '' then list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(s, 'spdx-license-identifier ([a-z0-9+.\\- ]+)', 1), '\\bwith [a-z0-9.\\-]+', '', 'g'), ' +(?:and |or )?'), lambda x: x <> ''), lambda x: 'Spdx:' || x)
    when not ({gate('s')}) then []
    when {refusal} is not null then [{refusal}]
    else list_filter([{rest}], lambda x: x is not null) end as n from one),
joined as (
  select doc_id, flatten(list(n order by i)) as ids, count(*) filter (where gate and len(n) = 0) as unmatched from named group by doc_id),
ruled as (
  select doc_id, ids, unmatched, case when len(ids) > 0 then ' ' || array_to_string(ids, ' ') || ' ' end as sequence from joined),
known as (
  select *, list_concat(list_filter([{rules}], lambda x: x is not null), list_transform(list_filter(ids, lambda x: starts_with(x, 'Spdx:')), lambda x: coalesce({spdx}[substr(x, 6)], substr(x, 6)))) as ls from ruled)
select d.doc_id, trim(sequence) as sentence_ids,
  case when sequence is null then null when len(ls) > 0 then (select string_agg(l, ',' order by first) from (select l, min(p) as first from (select unnest(ls) as l, generate_subscripts(ls, 1) as p) group by l))
    when {rule(dict(RULES)['Proprietary'])} then 'Proprietary' when {rule(['UnknownLicense', 'SeeLicense'])} then 'Unknown' end as licenses,
  cast(coalesce(len(ids), 0) as bigint) as n_sentences, cast(coalesce(unmatched, 0) as bigint) as n_unmatched
from documents d left join known k on k.doc_id = d.doc_id"""
