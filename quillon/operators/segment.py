"""Segmentation of texts and packing of pages."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound, header


#: Running sums copy the list so far for each item; longer lists are summed block by block.
_BLOCK = 256


def _running(values: Column) -> Column:
    """What a list sums up to before each item, ``out``, and in all, ``at``."""
    start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(values, start, lambda s, x: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + x).alias("at")))


def _offsets(lengths: Column) -> Column:
    """Where each part begins if each is followed by one more character; running sums inside the row."""

    def joined(blocks: Column) -> Column:
        bases = _running(F.transform(blocks, lambda b: b["at"]))["out"]
        return bound(bases, lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda x: x + base[i]))))

    def summed(xs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_BLOCK))
        return F.when(F.size(xs) <= _BLOCK, _running(xs)["out"]).otherwise(bound(F.transform(firsts, lambda i: _running(F.slice(xs, i, _BLOCK))), joined))

    return bound(F.transform(lengths, lambda n: n + 1), summed)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with their number, character offset and whether a blank line or nothing comes before; no shuffle."""
    split = df.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("__l"))
    before = F.concat(F.array(F.lit("")), F.slice("__l", 1, F.greatest(F.size("__l") - 1, F.lit(0))))
    zipped = F.arrays_zip(F.col("__l").alias("line"), _offsets(F.transform("__l", F.length)).alias("start"), before.alias("before"))
    out = split.select(key, F.posexplode(zipped).alias("line_no", "x"))
    return out.select(key, "line_no", "x.line", "x.start", (F.trim(F.regexp_replace("x.before", r"\s+", " ")) == "").alias("before_blank"))


def spans(marks: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """Each mark ends where the next begins, the last at ``end``."""
    return marks.withColumn("stop", F.coalesce(F.lead(start).over(W.partitionBy(key).orderBy(start)), end))


def sections(df: DataFrame, key: str, text: str, after_blank: bool = True) -> DataFrame:
    """Sections of a text; a heading follows a blank line unless that rule is off.

    Of several abstracts the last one before the first introduction stays, or the
    last of all. All of it happens inside a document's row."""
    at = lines(df, key, text).withColumn("section", header(F.col("line"))).where("section is not null")
    if after_blank:
        at = at.where("before_blank")
    w = W.partitionBy(key)
    intro = F.min(F.when(F.col("section") == "introduction", F.col("line_no"))).over(w)
    at = at.withColumn("__intro", intro)
    abstract = F.when(F.col("section") == "abstract", F.col("line_no"))
    early = F.max(F.when(F.col("__intro").isNull() | (F.col("line_no") < F.col("__intro")), abstract)).over(w)
    at = at.withColumn("__keep", F.coalesce(early, F.max(abstract).over(w))).where("section <> 'abstract' or line_no = __keep")
    total = df.select(key, F.length(text).alias("__total"))
    return spans(at.join(total, key), key, "start", F.col("__total")).select(key, "section", "start", "stop")


def pages(df: DataFrame, key: str, text: str, mark: str = "\f") -> DataFrame:
    """Pages with offsets; the mark belongs to the page before it; a last page of at most one character goes."""
    # lengths alone leave the row; a text has one part at least, so that the outer form only keeps Spark from working the list out again to test it
    parts = df.where(F.col(text).isNotNull()).select(key, F.length(text).alias("total"), F.transform(F.split(text, mark), F.length).alias("__n"))
    out = parts.select(key, "total", F.posexplode_outer(F.arrays_zip(F.col("__n").alias("n"), _offsets(F.col("__n")).alias("at"))).alias("page", "x")).select(key, "total", "page", F.col("x.at").alias("char_start"), F.col("x.n").alias("n"))
    out = out.withColumn("char_end", F.least(F.col("char_start") + F.col("n") + 1, F.col("total")))
    return out.where((F.col("char_end") - F.col("char_start") > 1) | (F.col("page") == 0)).select(key, (F.col("page") + 1).alias("page"), "char_start", "char_end")


def windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of fixed width."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    return df.where(n > 0).select(key, F.posexplode(starts).alias("chunk", "start"), F.col(text).alias("__t")).select(key, "chunk", "start", F.substring(F.col("__t"), F.col("start") + 1, F.lit(size)).alias("body"))


def plan_pages(page_rows: DataFrame, key: str, ceiling: int, overlap: int = 1, sections: DataFrame | None = None, tail: float = 0.1) -> DataFrame:
    """Greedy runs of pages under a token ceiling with an overlap of pages.

    ``page_rows(key, page, char_start, char_end)``; a page counts 1600 tokens and a
    quarter for each character. With ``sections(key, start)``, a run ends before the
    page of the last section that begins in its final ``tail``, be it the last run.
    A document that fits into one run is not cut."""

    snap = sections is not None

    def planned(pages: list, first: list, last: list, breaks: list) -> list[tuple]:
        n = len(pages)
        cost = lambda a, b: int(1600 * (b - a + 1) + 0.25 * (last[b] - first[a]))

        def end_of(i: int) -> int:
            j = i
            while j + 1 < n and cost(i, j + 1) <= ceiling:
                j += 1
            at = bisect_right(breaks, last[j]) - 1
            if j == i or at < 0 or breaks[at] < last[j] - tail * (last[j] - first[i]) or (i == 0 and cost(0, n - 1) <= ceiling):
                return j
            home = next((k for k in range(i, j + 1) if first[k] <= breaks[at] < last[k]), j + 1)
            return max(i, home - 1)

        out, i = [], 0
        while i < n:
            j = end_of(i)
            out.append((len(out), pages[i], pages[j], cost(i, j)))
            i = n if j + 1 >= n else max(i + 1, j + 1 - overlap)
        return out

    def run(batches):
        for batch in batches:
            # flat lists are turned into Python's numbers at once, not list by list
            given = [(c.offsets.to_pylist(), c.values.to_pylist()) for c in map(batch.column, ("page", "char_start", "char_end", "breaks"))]
            keys, out = [], []
            for k in range(batch.num_rows):
                pages, first, last, breaks = [values[at[k] : at[k + 1]] for at, values in given]
                rows = planned(pages, first, last, breaks)
                keys += [k] * len(rows)
                out += rows
            numbers = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), *[pa.array(x, pa.int64()) for x in numbers]], names=[key, "chunk", "page_start", "page_end", "est_tokens"])

    # one row for each document: tasks take many of them at once, not group by group
    part = lambda c: F.transform("__pages", lambda x: x[c].cast("long")).alias(c)
    docs = page_rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", "char_start", "char_end"))).alias("__pages"))
    if snap:
        docs = docs.join(sections.groupBy(key).agg(F.array_sort(F.collect_list(F.col("start").cast("long"))).alias("breaks")), key, "left")
    else:
        docs = docs.withColumn("breaks", F.lit(None).cast("array<long>"))
    docs = docs.select(F.col(key).cast("long").alias("key"), part("page"), part("char_start"), part("char_end"), "breaks")
    return docs.mapInArrow(run, f"{key} long, chunk long, page_start long, page_end long, est_tokens long")


def pack_units(units: DataFrame, key: str, order: str, source: str, text: str, images: str, image_limit: int, char_limit: int, overlap: int = 2000) -> DataFrame:
    """Files of a paper in runs of bounded images and characters.

    A file beyond a bound is cut into runs of its own, whose texts overlap by
    ``overlap`` characters or half a run at most. Each file begins with a line
    that names it; a null text is empty, a null list of images too."""
    step = max(1, char_limit - min(overlap, char_limit // 2))
    cut = lambda xs, size, by: [xs[i : i + size] for i in range(0, len(xs), by)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, texts, shots = [], [], []
        for u in pdf.sort_values(order).itertuples(index=False):
            body = f"===== FILE: {getattr(u, source)} =====\n" + (getattr(u, text) or "")
            found = getattr(u, images)
            found = [] if found is None else list(found)
            big = len(body) > char_limit or len(found) > image_limit
            if (texts or shots) and (big or sum(map(len, texts)) + len(body) > char_limit or len(shots) + len(found) > image_limit):
                out.append((texts, shots))
                texts, shots = [], []
            if big:
                a, b = cut(body, char_limit, step), cut(found, image_limit, image_limit)
                out += [(a[k : k + 1], b[k] if k < len(b) else []) for k in range(max(len(a), len(b)))]
            else:
                texts, shots = [*texts, body], [*shots, *found]
        if texts or shots:
            out.append((texts, shots))
        return pd.DataFrame([(pdf[key][0], i, t, s) for i, (t, s) in enumerate(out)], columns=[key, "chunk", "texts", "images"])

    kind = units.schema[key].dataType.simpleString()
    return units.select(key, order, source, text, images).groupBy(key).applyInPandas(run, f"{key} {kind}, chunk long, texts array<string>, images array<string>")


def rebuild(df: DataFrame, key: str, order: str, body: str, sep: str = "\f") -> DataFrame:
    """Bodies joined in order."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda x: x[body]), sep).alias("text"))


def inverted_text(df: DataFrame, key: str, index: str, last_wins: bool = False) -> DataFrame:
    """The text of a map from words to positions; where two words claim a position the first or the last of the map stays.

    All of it happens inside a map's row, without a shuffle; an empty or null map gives no row."""
    # arrays of one element bind a value once for all that use it
    entries = F.transform(F.map_entries(index), lambda e, i: F.transform(F.coalesce(e["value"], F.array()), lambda p: F.struct(p.alias("p"), (-i if last_wins else i).alias("i"), e["key"].alias("w"))))
    text = F.transform(F.array(F.sort_array(F.flatten(entries))), lambda xs: F.array_join(F.transform(F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["p"] != x["p"])), lambda x: x["w"]), " "))[0]
    return df.where(F.cardinality(index) > 0).select(key, text.alias("text"))
