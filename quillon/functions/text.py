"""Text expressions: Column in, Column out, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Words: letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"


def is_absent(value: Column, stage: str) -> Column:
    """Whether a value counts as absent at a stage."""
    return F.coalesce(F.lower(F.trim(value)).isin(*vocab.ABSENCE[stage]), F.lit(True))


def clean(value: Column) -> Column:
    """One blank for white space; the metadata stage's absent values become ''."""
    flat = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.lower(flat).isin(*vocab.ABSENCE["metadata"]), "").otherwise(flat)


def words(value: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(0))


#: Characters that most texts hold, looked for one by one where distinct ones are counted.
_COMMON = "abcdefghijklmnopqrstuvwxyz0123456789 .,"


def _variety(low: Column) -> Column:
    """How many distinct characters: the common ones are looked for, only the others are split apart."""
    common = F.lit(0)
    for c in _COMMON:
        common = common + F.contains(low, F.lit(c)).cast("int")
    rest = F.translate(low, _COMMON, "")
    return common + F.when(rest == "", 0).otherwise(F.size(F.array_distinct(F.split(rest, ""))))


def quality_score(value: Column) -> Column:
    """Length, words and variety, less a penalty for damaged characters."""
    damaged = r"[ÃÂâ€žœ™“”–\x{fffd}]"

    def of(s: Column) -> Column:
        count = lambda p: F.regexp_count(s, F.lit(p))
        weird = count(r"\x{fffd}") * 10 + count(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") * 5 + count(damaged) * 2
        variety = F.transform(F.array(F.lower(s)), _variety)[0]
        score = F.length(s) + 3 * F.regexp_count(s, F.lit(WORD)) + 0.5 * variety - 200 * weird / F.greatest(F.length(s), F.lit(1))
        return F.when(F.length(s) > 0, score.cast("double")).otherwise(0.0)

    # an array of one element binds the cleaned text once for all parts of the score
    return F.transform(F.array(clean(value)), of)[0]


def text_class(value: Column, ok: int = 5000, ocr: int = 300, alpha: float = 0.55) -> Column:
    """Ok, low_text_density or likely_ocr_needed by length and share of letters."""
    s = F.coalesce(value, F.lit(""))
    dense = F.length(F.regexp_replace(s, r"(?U)\s+", ""))
    ratio = F.when(dense > 0, F.regexp_count(s, F.lit(r"\p{L}")) / dense).otherwise(0.0)
    poor = (F.length(s) < ok) | (ratio < alpha)
    return F.when(F.length(s) < ocr, "likely_ocr_needed").when(poor & (ratio < 0.35), "likely_ocr_needed").when(poor, "low_text_density").otherwise("ok")


def sanitize(value: Column) -> Column:
    """Tags, display formulas, commands and entities go."""
    out = F.coalesce(value, F.lit(""))
    for pattern, by in ((r"<[^>]+>", " "), (r"\$\$[^$]+\$\$", " [formula] "), (r"\\[a-zA-Z]+\{[^}]*\}", " "), (r"&[a-z]+;", " "), (vocab.WHITE + "+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def strip_html(value: Column) -> Column:
    """Tags go, five entities are resolved."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"<[^>]+>", " ")
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(by))
    return F.trim(F.regexp_replace(out, vocab.WHITE + "+", " "))


def strict(value: Column) -> Column:
    """G11 without compatibility folding: quotes, dashes, line-end hyphens, white space, case."""
    return _folded(_ascii_signs(F.coalesce(value, F.lit(""))))


def _ascii_signs(t: Column) -> Column:
    """Invisible signs go, quotes and dashes are those of ASCII."""
    t = F.regexp_replace(t, r"[\x{200b}-\x{200f}\x{feff}\x{00ad}\x{2060}]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\x{2018}-\x{201b}]", "'"), r"[\x{201c}-\x{201f}]", '"')
    return F.regexp_replace(t, r"[\x{2010}-\x{2015}\x{2212}]", "-")


def _folded(t: Column) -> Column:
    t = F.regexp_replace(t, r"-\s*\n\s*", "")
    return F.trim(F.regexp_replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def relaxed(value: Column) -> Column:
    """The strict form's letters a-z, digits and blanks."""
    return _letters(strict(value))


def _letters(value: Column) -> Column:
    """What the relaxed form keeps of the strict one."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[^a-z0-9 ]", ""), r" +", " "))


def bound(value: Column, function) -> Column:
    """``function`` of a value that is worked out once, by an array of one element, for all that use it."""
    return F.transform(F.array(value), function)[0]


def loose(value: Column) -> Column:
    """Every run of other characters than a-z and 0-9 is one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^a-z0-9]+", " "))


def quote_status(quote: Column, label: Column, title: Column, body: Column) -> Column:
    """Where a quote is found, verbatim before relaxed, its own field before the other."""
    own, other = F.when(label == "title", title).otherwise(body), F.when(label == "title", body).otherwise(title)
    has = lambda f, s: (f(quote) != "") & F.contains(f(s), f(quote))
    return (
        F.when(has(strict, own), "verbatim").when(has(strict, other), "verbatim_other_field").when(has(relaxed, own), "relaxed").when(has(relaxed, other), "relaxed_other_field").otherwise("not_found")
    )


def rescue_level(quote: Column, source: Column) -> Column:
    """R1 rejoins hyphenation, R2 drops outer punctuation, R3 keeps letters and digits only."""
    rejoined = F.regexp_replace(source, r"-\s*\n\s*", "-")
    bare = F.regexp_replace(quote, r"^\p{P}+|\p{P}+$", "")
    bare_of = lambda s: F.regexp_replace(s, r"[^a-z0-9]+", "")
    has = lambda s, q: (q != "") & F.contains(s, q)

    # the strict form; a text of ASCII alone has no signs to replace
    def form(value: Column) -> Column:
        return bound(F.coalesce(value, F.lit("")), lambda t: _folded(F.when(F.octet_length(t) == F.char_length(t), t).otherwise(_ascii_signs(t))))

    # each form is worked out once, and only where the levels before it fail
    def letters(p: Column) -> Column:
        return F.when(has(p["s"], p["q"]), "R3").otherwise("unverified")

    def later(r: Column, q: Column) -> Column:
        return F.when(has(r, q), "R1").when(bound(form(bare), lambda b: has(r, b)), "R2").otherwise(bound(F.struct(bare_of(r).alias("s"), bare_of(q).alias("q")), letters))

    return bound(form(quote), lambda q: F.when(has(form(source), q), "R0").otherwise(bound(form(rejoined), lambda r: later(r, q))))


def jaccard(a: Column, b: Column, pattern: str = WORD) -> Column:
    """Overlap of the token sets; 0 if either is empty."""
    tokens = lambda c: F.array_distinct(words(F.lower(c), pattern))

    def of(p: Column) -> Column:
        both = F.size(F.array_intersect(p["x"], p["y"]))
        return F.when((F.size(p["x"]) > 0) & (F.size(p["y"]) > 0), both / (F.size(p["x"]) + F.size(p["y"]) - both)).otherwise(0.0)

    # an array of one element binds both sets once
    return F.transform(F.array(F.struct(tokens(a).alias("x"), tokens(b).alias("y"))), of)[0]


def first_int(value: Column) -> Column:
    """The first integer, thousands separators dropped."""
    return F.expr("cast(null as bigint)") if value is None else F.replace(F.regexp_extract(value, r"\d[\d,]*", 0), F.lit(","), F.lit("")).try_cast("bigint")


def token_estimate(pages: Column, chars: Column) -> Column:
    """1600 for a page image and a quarter for a character."""
    return F.floor(pages * 1600 + chars * 0.25).cast("bigint")


def half_up(value: Column) -> Column:
    """rounds .5 upwards."""
    return F.floor(value + 0.5).cast("bigint")


def header(line: Column) -> Column:
    """The section that a short heading line names, else null; lines of prose are no headings.

    A number of one or two levels, a Roman one or a letter up to H goes first; only the letter needs a mark."""
    bare = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", ""))
    prose = bare.rlike(r"\.\s+[a-z]") | bare.rlike(r":\s+\S{3,}")
    t = F.regexp_replace(F.lower(bare), r"^(?:[0-9]{1,2}(?:\.[0-9]{1,2})?\s*[.)]?|[ivxlc]{1,5}\s*[.)]?|[a-h]\s*[.)])\s+", "")
    t = F.trim(F.regexp_replace(F.trim(t), r"[:.;]+$", ""))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(vocab.SECTIONS):
        out = F.when(t.rlike(rf"^(?:{pattern})$"), name).otherwise(out)
    return F.when((F.length(bare) <= 80) & ~prose, out)


def relaxed_unicode(value: Column) -> Column:
    """G13 without compatibility folding: dashes, quotes, blanks and invisible characters folded, lower case."""
    t = F.coalesce(value, F.lit(""))
    for characters, by in ((vocab.DASHES, "-"), (vocab.SINGLE_QUOTES, "'"), (vocab.DOUBLE_QUOTES, '"'), (vocab.BLANKS, " "), (vocab.NOTHING, "")):
        t = F.regexp_replace(t, f"[{characters}]", by)
    t = F.replace(t, F.lit("\u2026"), F.lit("..."))
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def garbled(value: Column, least: int = 30) -> Column:
    """Whether a text looks damaged: replacement marks, wrongly decoded runs, unprintable or too few characters."""
    t = F.coalesce(value, F.lit(""))
    n = F.length(t)
    marks = F.regexp_count(t, F.lit("\ufffd"))
    runs = F.regexp_count(t, F.lit("Ã|â€™|â€“|â€œ|â€\x9d"))
    hidden = F.regexp_count(t, F.lit(r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}"))
    return (n == 0) | (marks >= 2) | (runs >= 2) | (hidden > 0.05 * n) | (n < least)


def grounded_link(quote: Column, source: Column) -> Column:
    """Found with white space and case folded, or, from 15 letters and digits on, by these alone."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), vocab.WHITE + "+", " ")))
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "")
    return ((flat(quote) != "") & F.contains(flat(source), flat(quote))) | ((F.length(bare(quote)) >= 15) & F.contains(bare(source), bare(quote)))


def longest_fragment(quote: Column, source: Column) -> Column:
    """The longest run of a quote's words that the source holds, the first of equal ones; both are compared relaxed.

    For each first word the run grows as long as it is found, so a quote of n
    words takes at most 2n tests: the next start keeps the length reached."""
    return bound(F.struct(relaxed(quote).alias("q"), relaxed(source).alias("s")), lambda x: _fragment(x["q"], x["s"]))


def _fragment(quote: Column, source: Column) -> Column:
    """:func:`longest_fragment` of relaxed forms."""

    def grow(words: Column, s: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("best"))

        def step(state: Column, _: Column) -> Column:
            # try the run from i with one word more than the best so far
            fits = F.contains(s, F.array_join(F.slice(words, state["i"] + 1, state["best"] + 1), " ")) & (state["i"] + state["best"] + 1 <= F.size(words))
            return F.when(
                fits, F.struct(state["i"].alias("i"), state["n"].alias("n"), state["i"].alias("at"), (state["best"] + 1).alias("best"))
            ).otherwise(F.struct((state["i"] + 1).alias("i"), state["n"].alias("n"), state["at"].alias("at"), state["best"].alias("best")))

        end = F.aggregate(F.sequence(F.lit(1), 2 * F.size(words) + 1), start, step)
        return F.array_join(F.slice(words, end["at"] + 1, end["best"]), " ")

    return bound(F.filter(F.split(quote, " "), lambda w: w != ""), lambda words: grow(words, source))


def rescue_quote(value: Column, quote: Column, source: Column) -> Column:
    """``(quote, kind)`` of a quote that is not found whole: its longest run of at least five words and twenty
    characters, else the value itself from four characters on, or from twelve without blanks; else null."""
    named = ~is_absent(value, "refill")
    pair = lambda q, kind: F.struct(q.alias("quote"), F.lit(kind).alias("kind"))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))

    def found(x: Column, run: Column) -> Column:
        return (
            F.when((F.size(F.split(run, " ")) >= 5) & (F.length(run) >= 20), pair(run, "fragment"))
            .when(named & (F.length(x["v"]) >= 4) & F.contains(x["s"], x["v"]), pair(value, "value_token"))
            .when(named & (F.length(bare(x["v"])) >= 12) & F.contains(bare(x["s"]), bare(x["v"])), pair(value, "value_token_nospace"))
        )

    forms = F.struct(relaxed(quote).alias("q"), relaxed(source).alias("s"), relaxed(value).alias("v"))
    return bound(forms, lambda x: bound(_fragment(x["q"], x["s"]), lambda run: found(x, run)))


def holds_integer(value: Column, number: Column) -> Column:
    """An integer that is no part of a longer one."""
    return F.regexp_like(F.coalesce(value, F.lit("")), F.concat(F.lit(r"(?<![\d,])"), number.cast("string"), F.lit(r"(?![\d,])")))


def venue_name(value: Column) -> Column:
    """Lower case, letters and digits, one blank."""
    return loose(value)


def first_authors(authors: Column, n: int = 3) -> Column:
    """C16: 'Family, G.' of the first authors ``(family, given, literal)``, then et al."""
    name = lambda a: F.when((F.coalesce(a["family"], F.lit("")) != "") & (F.coalesce(a["given"], F.lit("")) != ""), F.concat(a["family"], F.lit(", "), F.left(a["given"], F.lit(1)), F.lit("."))).otherwise(F.coalesce(F.nullif(a["family"], F.lit("")), a["literal"]))
    return F.concat(F.array_join(F.array_compact(F.transform(F.slice(authors, 1, n), name)), ", "), F.when(F.size(authors) > n, ", et al.").otherwise(""))


def year_of_parts(parts: Column) -> Column:
    """The year of CSL date parts, if it is one from 1500 to 2100."""
    year = F.try_element_at(F.try_element_at(parts, F.lit(1)), F.lit(1)).try_cast("int")
    return F.when(year.between(1500, 2100), year)


def unfenced_json(value: Column) -> Column:
    """The JSON object inside a fenced or chatty reply."""
    bare = F.regexp_replace(F.trim(value), r"^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def dehyphenate(value: Column) -> Column:
    """G35: 'dual- positron' becomes 'dual-positron'; twice, for overlapping matches."""
    once = F.regexp_replace(value, r"([A-Za-z])-\s+([A-Za-z])", "$1-$2")
    return F.regexp_replace(once, r"([A-Za-z])-\s+([A-Za-z])", "$1-$2")


def bib_escape(value: Column) -> Column:
    """Tags, braces and backslashes go, signs of TeX are escaped, a tilde and runs of white space are one blank."""
    out = F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("&amp;"), F.lit("&")), r"<[^>]+>|[\\{}]", "")
    out = F.regexp_replace(out, r"([&%$#_])", r"\\$1")
    return F.trim(F.regexp_replace(out, r"(?U)[\s~]+", " "))


def said_yes(value: Column) -> Column:
    """Whether an answer starts with yes; never null."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).startswith("yes")


def joined(values: Column, sep: str = " ; ") -> Column:
    """All values that are not null."""
    return F.array_join(F.filter(values, lambda x: x.isNotNull()), sep)


def snap_quote(quote: Column, source: Column) -> Column:
    """A quote that begins or ends within a word, widened to whole words of its source."""
    exact, folded = F.position(quote, source), F.position(F.lower(quote), F.lower(source))
    at = F.when(exact > 0, exact).otherwise(folded)
    before, after = F.substring(source, F.lit(1), at - 1), F.substring(source, at + F.length(quote), F.length(source))
    head, rest = F.regexp_extract(before, r"[\p{L}\p{N}]*$", 0), F.regexp_extract(after, r"^[\p{L}\p{N}]*", 0)
    wider = F.concat(head, F.substring(source, at, F.length(quote)), rest)
    return F.when((at > 0) & (quote != "") & (F.length(wider) > F.length(quote)), wider).otherwise(quote)


_STRING = r'"((?:[^"\\]++|\\.)*+)'


def json_string(value: Column, name: str) -> Column:
    """A string member of a JSON text that may be cut off, even within that string."""
    whole, cut = (F.regexp_extract_all(value, F.lit(rf'(?s)"{name}"\s*:\s*{_STRING}{end}'), F.lit(1)) for end in ('"', "$"))
    raw = F.coalesce(F.try_element_at(whole, F.lit(1)), F.try_element_at(cut, F.lit(1)))
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "v string")["v"], raw)


def json_part(value: Column, name: str) -> Column:
    """The flat object of a member, up to its brace or the end of a text that is cut off."""
    pattern = rf'(?s)"{name}"\s*:\s*(\{{(?:[^"{{}}]++|{_STRING}(?:"|$))*+)'
    return F.try_element_at(F.regexp_extract_all(value, F.lit(pattern), F.lit(1)), F.lit(1))


def repair_verdict(value: Column) -> Column:
    """A verdict out of a JSON text that is cut off; null without an id or a first category."""

    def category(name: str) -> Column:
        part = json_part(value, name)
        field = json_string(part, "evidence_field")
        quote = F.coalesce(F.nullif(json_string(part, "evidence_quote"), F.lit("")), F.lit("(truncated)"))
        whole = F.struct(json_string(part, "category").alias("category"), quote.alias("evidence_quote"), F.when(field.isin("title", "abstract"), field).otherwise("abstract").alias("evidence_field"))
        return F.when(F.coalesce(json_string(part, "category"), F.lit("")) != "", whole)

    none = F.coalesce(value.rlike(r'"secondary"\s*:\s*null'), F.lit(False))
    text_or = lambda name, default: F.coalesce(F.nullif(json_string(value, name), F.lit("")), F.lit(default)).alias(name)
    out = F.struct(
        json_string(value, "record_id").alias("record_id"),
        text_or("doi", ""),
        category("primary").alias("primary"),
        F.when(~none, category("secondary")).alias("secondary"),
        text_or("confidence", "high"),
        text_or("reasoning", "(reasoning truncated during emit)"),
    )
    return F.when((F.coalesce(json_string(value, "record_id"), F.lit("")) != "") & category("primary").isNotNull(), out)


def notebook_text(value: Column) -> Column:
    """P10: the cells and plain outputs of a notebook; null for a text that is no JSON."""
    book = F.try_parse_json(value)
    many = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    lines = lambda v, path: F.coalesce(F.array_join(F.try_variant_get(v, path, "array<string>"), ""), F.try_variant_get(v, path, "string"), F.lit(""))

    def parts(cell: Column) -> Column:
        kind, body = F.try_variant_get(cell, "$.cell_type", "string"), lines(cell, "$.source")
        own = F.when(kind.isin("markdown", "code") & (F.trim(F.regexp_replace(body, r"\s+", " ")) != ""), F.concat(F.lit("["), kind, F.lit(" cell]\n"), body))
        shown = F.transform(many(cell, "$.outputs"), lambda o: F.concat(F.lit("[output]\n"), F.nullif(lines(o, "$.data['text/plain']"), F.lit(""))))
        return F.array_compact(F.concat(F.array(own), shown))

    return F.when(book.isNotNull(), F.array_join(F.flatten(F.transform(many(book, "$.cells"), parts)), "\n\n"))
