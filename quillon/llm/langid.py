"""Language identification by fusing text, markup, address and host evidence."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, written

LANGUAGES = ("en", "fr", "de", "es")
#: Labelled rows, chosen by a hash of their id, that the text model is fitted on.
FIT_ROWS = 4000
#: Hashed byte trigrams.
BUCKETS = 1 << 16
#: What no model of a language explains better than chance: other languages, other scripts, noise.
OTHER = "other"
#: Weight of a trigram's log-likelihood: each byte stands in three trigrams.
EVIDENCE = 1 / 3
#: How often a declared language and an address suffix tell the true one.
DECLARED, ADDRESS = 0.9, 0.7
#: Pseudo-counts with which a host leans on its domain, that on its suffix, that on all rows.
SMOOTH = 5.0
MIN_POSTERIOR = 0.5

# Country suffixes by main language.
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}

_HIDDEN = re.compile(r"(?i)<(script|style|noscript|template)\b")
_CLOSES = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style", "noscript", "template")}


def visible(html: str) -> str:
    """The text between tags: comments and hidden elements with their contents are one blank each, as are tags.

    Whatever never ends is text, but for its tag; that it has no end is looked
    up once, so that time grows with the length only.
    """
    out, at, endless = [], 0, set()

    def end_of(name: str, begin: int) -> int:
        if name in endless:
            return -1
        if name in _CLOSES:
            m = _CLOSES[name].search(html, begin)
            end = m.end() if m else -1
        else:
            end = html.find(name, begin)
            end += len(name) if end >= 0 else 0
        if end < 0:
            endless.add(name)
        return end

    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end = -1
        if m := _HIDDEN.match(html, i):
            end = end_of(m[1].lower(), m.end())
        elif html.startswith("<!--", i):
            end = end_of("-->", i + 4)
        if end < 0:
            end = end_of(">", i + 1)
        out.append("<" if end < 0 else " ")
        at = i + 1 if end < 0 else end
    out.append(html[at:])
    return "".join(out)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams that hold a letter, and each one's place."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    letter = (b >= 128) | ((b >= 97) & (b <= 122))
    b = np.where(letter, b, 32)
    at = np.flatnonzero(letter[:-2] | letter[1:-1] | letter[2:])
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[at]
    return (code * np.uint32(2654435761)) >> np.uint32(16), at


def _joined(texts: list):
    """Chunks of lower-cased texts, joined by blanks, with the byte bounds of each."""
    for begin, end in chunks(texts):
        parts = [("" if t is None else t).lower() for t in texts[begin:end]]
        # blanks on both sides, so that no trigram reaches into the next text
        lengths = np.array([len(p.encode("utf-8", "replace")) + 4 for p in parts])
        yield "".join(f"  {p}  " for p in parts), np.concatenate([[0], np.cumsum(lengths)]), begin, end


def _count(languages: tuple):
    place = {x: i for i, x in enumerate(languages)}

    def run(batch: pa.RecordBatch):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        langs = batch.column("declared").to_pylist()
        texts = batch.column("text").to_pylist()
        for text, lang in zip(texts, langs, strict=True):
            if lang in place and text:
                total[place[lang]] += np.bincount(trigrams(text.lower())[0], minlength=BUCKETS)
        l, k = np.nonzero(total)
        yield l.astype(np.int32), k.astype(np.int32), total[l, k]

    return run


def fit(rows: DataFrame, languages: tuple = LANGUAGES, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Log-probabilities (language, bucket) from ``rows(id, text, declared)``.

    Fitted on at most ``fit_rows`` rows with one of the languages declared, the
    ones with the smallest hashes of their ids; their whole texts are counted on
    the executors, so that at most one table of counts reaches the driver. The
    last row is the background of :data:`OTHER`: half the mean of the languages,
    half all buckets alike. Text of a language beats it by far, as its own model
    expects its trigrams more often than the mean does; text whose trigrams no
    model expects loses against it.
    """
    chosen = rows.where(F.col("declared").isin(*languages) & F.col("id").isNotNull()).select("id", F.xxhash64("id").alias("h")).distinct().orderBy("h", "id").limit(fit_rows).select("id")
    sample = rows.join(F.broadcast(chosen), "id", "left_semi").select("text", "declared")
    counted = arrow_map(sample, _count(languages), "l int, k int, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[counted["l"].to_numpy(int), counted["k"].to_numpy(int)] = counted["n"].to_numpy(float)
    counts += 0.5
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(np.vstack([shares, shares.mean(axis=0) / 2 + 0.5 / BUCKETS])).astype(np.float32)


def _score(shared, markup: bool):
    def run(batch: pa.RecordBatch):
        model = shared.value
        texts = batch.column("text").to_pylist()
        if markup:
            from html import unescape

            texts = [None if t is None else unescape(visible(t)) for t in texts]
        out = np.zeros((len(texts), len(model)))
        n = np.zeros(len(texts), np.int64)
        for text, bounds, begin, end in _joined(texts):
            code, at = trigrams(text)
            edges = np.searchsorted(at, bounds)
            n[begin:end] = np.diff(edges)
            for l in range(len(model)):
                total = np.concatenate([[0.0], np.cumsum(model[l][code], dtype=np.float64)])
                out[begin:end, l] = np.diff(total[edges])
        yield batch.column("id"), n, pa.array(list(out), pa.list_(pa.float64()))

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels, or three where the last but one is a short generic one."""
    return F.regexp_extract(host, r"((?:[^.]+\.(?:com|co|org|net|ac|gov)\.[a-z]{2})|(?:[^.]+\.[^.]+)|[^.]+)$", 1)


def fuse(rows: DataFrame, model: np.ndarray, languages: tuple = LANGUAGES, markup: bool = False, accept: tuple | None = None, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Posterior language of ``rows(id, text, declared, host, address)``.

    ``markup`` tells that texts are HTML. Returns ``id, lang, posterior,
    text_lang, n_trigrams, accepted``; a language is one of ``languages`` or
    :data:`OTHER`, which is never accepted. The evidence is multiplied: the
    text's trigrams, each with the weight :data:`EVIDENCE`; the declared language
    and the address, each right with a fixed probability (a declared language
    that has no model speaks for ``OTHER``); and the prior of the row's host, the
    share of each language among the *other* rows of the host, judged by text
    alone, smoothed by the domain's, that by the suffix's and that by all rows'.

    Rows are counted by host, hosts by domain and by suffix; the counts of a host
    with those above it form one table, which is joined once. Rows without a host
    take no part in that join.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    classes = (*languages, OTHER)
    L = len(classes)
    keep = rows.select(F.struct("id", "declared", "host", "address").alias("id"), "text")
    kind = keep.schema["id"].dataType.simpleString()
    e = arrow_map(keep, _score(shared, markup), f"id {kind}, n long, ll array<double>").select("id.*", "n", "ll")
    e = written(
        e.withColumn("ll", F.transform("ll", lambda x: x * F.lit(EVIDENCE))).withColumn("best", F.when(F.col("n") > 0, F.array_position("ll", F.array_max("ll"))).otherwise(F.lit(0)).cast("int")),
        "evidence",
    )
    names = [f"c{i}" for i in range(L)]
    count = [F.sum((F.col("best") == i + 1).cast("long")).alias(c) for i, c in enumerate(names)]
    total_of = [F.sum(c).alias(c) for c in names]
    as_array = lambda name: F.array(*names).alias(name)
    everything = e.agg(*count).first()
    grand = [float(everything[i] or 0) for i in range(L)]
    hosts = written(e.where("host is not null").groupBy("host").agg(*count).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)), "hosts")
    table = hosts.select("host", "domain", "suffix", as_array("h"))
    for key, name in (("domain", "d"), ("suffix", "s")):
        table = table.join(written(hosts.groupBy(key).agg(*total_of).select(key, as_array(name)), key), key)
    table = written(table.select("host", "h", "d", "s"), "priors")
    none = F.lit(None).cast("array<long>")
    out = e.where("host is not null").join(table, "host").unionByName(e.where("host is null").withColumns({"h": none, "d": none, "s": none}))
    # arrays over the classes, so that the plan stays small
    label = F.array(*map(F.lit, classes))
    own = F.transform(F.sequence(F.lit(1), F.lit(L)), lambda i: (F.col("best") == i).cast("double"))
    rest = F.lit(sum(grand)) - (F.col("best") > 0).cast("double") + F.lit(float(L))
    out = out.withColumn("own", own).withColumn("prior", F.zip_with(F.array(*map(F.lit, grand)), "own", lambda g, o: (g - o + 1.0) / rest))
    for name in ("s", "d", "h"):
        others = F.when(F.col(name).isNotNull(), F.zip_with(name, "own", lambda c, o: c - o)).otherwise(F.array(*[F.lit(0.0)] * L))
        total = F.aggregate(name, F.lit(0.0), lambda x, y: x + y)
        out = out.withColumn(name, others).withColumn("prior", _smoothed(name, total))

    def said(column: str, trust: float) -> Column:
        told = F.when(F.col(column).isin(*languages), F.col(column)).when(F.coalesce(F.col(column), F.lit("")) != "", OTHER)
        wrong = float(np.log((1 - trust) / (L - 1)))
        return F.transform(label, lambda x: F.when(told == x, float(np.log(trust))).when(told.isNotNull(), wrong).otherwise(0.0))

    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    logs = add(add(F.zip_with("ll", "prior", lambda l, p: l + F.log(p)), said("declared", DECLARED)), said("address", ADDRESS))
    wanted = accept or languages
    return (
        out.withColumn("logs", logs)
        .withColumn("top", F.array_max("logs"))
        .withColumn("posterior", 1.0 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
        .withColumn("lang", label[(F.array_position("logs", F.col("top")) - 1).cast("int")])
        .withColumn("text_lang", F.when(F.col("best") > 0, label[F.col("best") - 1]))
        .withColumn("accepted", (F.col("n") > 0) & (F.col("posterior") >= min_posterior) & F.col("lang").isin(*wanted))
        .select("id", "lang", F.round("posterior", 6).alias("posterior"), "text_lang", F.col("n").alias("n_trigrams"), "accepted")
    )


def _smoothed(name: str, total: Column) -> Column:
    """Counts of a level, leaning on the prior of the level above."""
    return F.zip_with(name, "prior", lambda c, p: (c + SMOOTH * p) / (total + SMOOTH))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source") -> DataFrame:
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text(text_col).alias("text"), F.lower(text(lang_col)).alias("declared"), F.lower(text(source_col)).alias("host"), F.lit(None).cast("string").alias("address"))


def page_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Declared language: the ``lang`` of the html tag; address: the host's country suffix, else a language folder at the path's start."""
    host = host_of(F.col(url_col))
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    folder = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z]+://[^/]+/([A-Za-z]{2})(?:[/?#\-]|$)", 1))
    return pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(html_col).cast("string").alias("text"),
        F.lower(F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)).alias("declared"),
        host.alias("host"),
        F.coalesce(F.try_element_at(table, suffix), F.nullif(folder, F.lit(""))).alias("address"),
    )


def identify_documents(docs: DataFrame, languages: tuple = LANGUAGES, model: np.ndarray | None = None, **options) -> DataFrame:
    """Language of documents ``(doc_id, text, lang, source)``: see :func:`fuse`.

    The source stands for the host and ``lang`` for the declared language.

    Edge cases: a text without letters (null, empty, digits) has no evidence of
    its own: its language follows from the declaration and the host, and it is
    not accepted. Null language, source or id are allowed; a null id cannot be
    drawn for fitting. Repeated rows come back as often as they came in. An
    empty table gives no rows; without labelled rows all languages are alike.
    Very long texts are weighed whole. Other columns are ignored.
    """
    rows = document_rows(docs)
    return fuse(rows, fit(rows, languages) if model is None else model, languages, **options)


def identify_pages(pages: DataFrame, model: np.ndarray, languages: tuple = LANGUAGES, **options) -> DataFrame:
    """Language of pages ``(page_id, url, html)``; edge cases as for documents. A page without a host has no host prior."""
    return fuse(page_rows(pages).withColumn("host", F.nullif(F.col("host"), F.lit(""))), model, languages, markup=True, **options)


def keep_identified(docs: DataFrame, accept: tuple | None = None, languages: tuple = LANGUAGES, row_col: str | None = None) -> DataFrame:
    """``docs`` without the rows whose language is not accepted, all columns kept.

    Rows are told apart by ``row_col``, a column of ``docs`` that is unique, not
    null and the same at every reading, or else by a number that is written with
    them. So ids may be null or repeat: a rejected row takes no other row with
    it. Texts move by that number only, never by host.
    """
    source = docs.withColumn("__row", F.col(row_col)) if row_col else written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    model = fit(document_rows(source), languages)
    gone = fuse(document_rows(source, id_col="__row"), model, languages, accept=accept).where("not accepted").select(F.col("id").alias("__gone"))
    return source.join(gone, source["__row"] == gone["__gone"], "left_anti").drop("__row")
