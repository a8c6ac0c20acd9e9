"""Where a text's abstract stands (G32), in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

BLANK = vocab.WHITE
_LETTER = r"[\p{L}\p{N}_]"
#: Characters of an abstract behind a heading, of a text without a stop, of a paragraph that may serve, and of what is taken of it.
LEAST, MOST, OPEN_END, PARAGRAPH, TAKEN = 150, 6000, 4000, 250, 3000
#: Characters behind a heading in which no stop counts.
SAFE = 10
#: Most places of a text are no blank; one range of characters tells so, the class of all blanks takes many steps.
_AT_BLANK = "(?![!-~])"

# Headings that begin and end an abstract, stamps of repositories, and what marks a block of authors.
_BEGIN = "|".join(["{b}*".join("abstract"), "summary", "background"])
_WORDS = ["introduction", r"i\.{b}+introduction", "keywords?", "index{b}+terms", "methods", "materials{b}+and{b}+methods", "results", "conclusions?", r"corresponding{b}+author", r"article{b}+history", "references"]
_NUMBERED = ["introduction", "background", "methods", "materials{b}+and{b}+methods", "results", "conclusions?"]
_CRUFT = [
    "citation{b}+for{b}+published{b}+version", "please{b}+cite{b}+(this{b}+article{b}+)?as", "document{b}+version", "publication{b}+date", "link{b}+to{b}+publication",
    "this{b}+is{b}+(the{b}+)?(author|accepted|peer)", "take-down{b}+policy", "licens(e|ed){b}+under", "©{b}*[0-9]{{4}}",
]
_AUTHORS = ["department{b}+of", "university", "institute{b}+of", "college{b}+of", "faculty{b}+of", "school{b}+of", "corresponding{b}+author", "{w}@({w}|[.])", "[0-9]{{5}}{b}*,{b}*[a-z]+{b}*,?{b}*[a-z]+"]
# Lower-case words of which each part of the patterns above holds one; parts of numbers are known by five digits.
_CRUFT_WORDS = ["citation", "please", "document", "publication", "this", "take-down", "licens", "©"]
_AUTHOR_WORDS = ["department", "university", "institute", "college", "faculty", "school", "corresponding", "@"]


def _any(parts: list[str]) -> str:
    return "(?i)(?:" + "|".join(p.format(b=BLANK, w=_LETTER) for p in parts) + ")"


def begins(backtracking: bool) -> str:
    """A heading after a line feed, two blanks or nothing.

    For a backtracking matcher blanks are taken whole and only from their first one, so that long runs take linear time."""
    lead = f"(?:^{BLANK}*+|{_AT_BLANK}(?<!{BLANK})(?:{BLANK}{{2,}}+|\\n))" if backtracking else f"(?:^{BLANK}*|{BLANK}{{2,}}|\\n)"
    return f"(?i){lead}(?:{_BEGIN.format(b=BLANK)})(?:{BLANK}|[:.—–-])*"


def stops(backtracking: bool) -> str:
    lead = f"{_AT_BLANK}(?<!{BLANK})(?:{BLANK}{{2,}}+|\\n)" if backtracking else f"(?:{BLANK}{{2,}}|\\n)"
    words = "|".join([*_WORDS, rf"[0-9]+\.?{{b}}*(?:{'|'.join(_NUMBERED)})"]).format(b=BLANK)
    return f"(?i){lead}(?:(?:{words})(?:[^\\p{{L}}\\p{{N}}_]|$)|(?:©{BLANK}*|doi:|received:){_LETTER})"


CRUFT, AUTHORS = _any(_CRUFT), _any(_AUTHORS)
KEYWORDS = rf"(?i)^(keywords?|index{BLANK}+terms){BLANK}*[:—–-]{BLANK}*"


def _flat(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, "-\n", ""), _AT_BLANK + BLANK + "+", " "))


def located(value: Column) -> Column:
    """The abstract of a text and how it was found: heading, later_heading, paragraph or none.

    The text behind the first heading counts, or behind the last if a
    repository's stamp stands before the first; it ends at the next heading that
    stops it. What is then too short or too long is given up for the first
    paragraph that reads like one. Null is none, as is an empty text."""
    # arrays of one element bind a value once for all that use it
    bound = lambda c, f: F.transform(F.array(c), f)[0]
    text = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\r\n", "\n"), "\f", "\n")
    text = F.regexp_replace(text, "\n[ \t]+\n", "\n\n")

    def behind(parts: Column) -> Column:
        later = (F.size(parts) > 2) & parts[0].rlike(CRUFT)
        return F.struct(F.when(later, F.element_at(parts, -1)).otherwise(parts[1]).alias("rest"), F.when(later, "later_heading").otherwise("heading").alias("how"))

    def ended(t: Column, parts: Column, found: Column) -> Column:
        # behind the first of several headings the text goes on beyond the next one
        rest = F.when(found["how"] == "later_heading", found["rest"]).otherwise(F.substring(t, F.length(t) - F.length(F.try_element_at(F.split(t, begins(True), 2), F.lit(2))) + 1, F.length(t)))

        def cut(r: Column) -> Column:
            pieces = F.split(F.substring(r, F.lit(SAFE + 1), F.length(r)), stops(True), 2)
            return F.when(F.size(pieces) > 1, F.concat(F.left(r, F.lit(SAFE)), pieces[0])).otherwise(F.left(r, F.lit(OPEN_END)))

        out = bound(rest, lambda r: F.regexp_replace(_flat(cut(r)), KEYWORDS, ""))
        return bound(out, lambda o: F.when(F.length(o).between(LEAST, MOST), F.struct(o.alias("abstract"), found["how"].alias("how"))))

    def headed(t: Column) -> Column:
        return bound(F.split(t, begins(True)), lambda parts: F.when(F.size(parts) > 1, bound(behind(parts), lambda f: ended(t, parts, f))))

    def held(low: Column, words: list[str]) -> Column:
        return reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words])

    def readable(p: Column) -> Column:
        commas, stops_ = F.regexp_count(p, F.lit(",")), F.regexp_count(p, F.lit(r"\."))
        shouted = (F.upper(p) == p) & (F.lower(p) != p)
        # patterns are tried only where a word stands that each of their parts holds
        marked = bound(F.lower(p), lambda low: (held(low, _AUTHOR_WORDS) | p.rlike("[0-9]{5}")) & p.rlike(AUTHORS) | held(low, _CRUFT_WORDS) & p.rlike(CRUFT))
        return (F.length(p) >= PARAGRAPH) & F.contains(p, F.lit(".")) & ~shouted & ~((commas > 8) & (stops_ < 3)) & ~marked

    def paragraph(t: Column) -> Column:
        # once one is found, no other is looked at
        first = F.aggregate(F.split(t, f"\n{BLANK}*\n"), F.lit(None).cast("string"), lambda a, p: F.when(a.isNotNull(), a).otherwise(bound(_flat(p), lambda f: F.when(readable(f), f))))
        return bound(first, lambda f: F.when(f.isNotNull(), F.struct(F.left(f, F.lit(TAKEN)).alias("abstract"), F.lit("paragraph").alias("how"))))

    none = F.struct(F.lit("").alias("abstract"), F.lit("none").alias("how"))
    return bound(text, lambda t: F.coalesce(headed(t), paragraph(t), none))


def located_sql(text: str) -> str:
    """A FROM clause for DuckDB with ``id, abstract, how`` of a table ``given(id, text)``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    begin, stop = q(begins(False)), q(stops(False))
    whole = lambda p: "'(?s)^(.*?)(?:" + p[1:-1] + ")(.*)$'"
    flat = lambda c: f"trim(regexp_replace(regexp_replace({c}, '-\\n', '', 'g'), {q(BLANK + '+')}, ' ', 'g'))"
    return f"""(
with t as (select id, regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(12), chr(10)), '\\n[ \\t]+\\n', chr(10) || chr(10), 'g') as t from {text}),
h as (select id, t, regexp_split_to_array(t, {begin}) as parts from t),
f as (select *, len(parts) > 2 and regexp_matches(parts[1], {q(CRUFT)}) as later from h),
r as (select *, case when len(parts) < 2 then null when later then parts[len(parts)] else regexp_extract(t, {whole(begin)}, 2) end as rest from f),
s as (select *, substr(rest, {SAFE + 1}) as after from r),
c as (select *, case when regexp_matches(after, {stop}) then substr(rest, 1, {SAFE}) || regexp_extract(after, {whole(stop)}, 1) else substr(rest, 1, {OPEN_END}) end as cut from s),
o as (select *, regexp_replace({flat('cut')}, {q(KEYWORDS)}, '') as headed,
  list_filter(list_transform(regexp_split_to_array(t, {q(chr(92) + 'n' + BLANK + '*' + chr(92) + 'n')}), lambda p: {flat('p')}), lambda p: length(p) >= {PARAGRAPH} and contains(p, '.') and not (upper(p) = p and lower(p) <> p) and not regexp_matches(p, {q(AUTHORS)}) and not regexp_matches(p, {q(CRUFT)})
    and not (length(p) - length(replace(p, ',', '')) > 8 and length(p) - length(replace(p, '.', '')) < 3)) as readable from c)
select id, case when length(headed) between {LEAST} and {MOST} then headed when len(readable) > 0 then substr(readable[1], 1, {TAKEN}) else '' end as abstract,
  case when length(headed) between {LEAST} and {MOST} then case when later then 'later_heading' else 'heading' end when len(readable) > 0 then 'paragraph' else 'none' end as how from o)"""
