"""Abstracts, columns, records, nested fields, derived fields, metrics, links, logs and queues: cases beyond the queries."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from conftest import SF
from quillon.functions import abstracts, ident, text
from quillon.operators import columns, derive, flatten, link, records, stats, validate
from quillon.sources import log
from quillon.streaming import queue


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(2)
    return [r["x"] for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


BODY = "This work studies a thing that matters. " * 6


def test_abstract_cases(spark):
    cases = [
        (f"Title\n\nAbstract\n{BODY}\nKeywords: a", "heading", BODY.strip()),
        (f"Title  A B S T R A C T — {BODY}\n\n1. Introduction\nx", "heading", BODY.strip()),
        # a repository's stamp before the first heading: the last heading counts
        (f"Please cite this article as: x\nAbstract\nof the stamp\nAbstract\n{BODY}\nReferences\n", "later_heading", BODY.strip()),
        # without a stamp the first one does, over the second
        (f"Abstract\n{BODY}\nSummary {BODY}\nResults\n", "heading", f"{BODY}Summary {BODY}".strip()),
        (f"Abstract\nkeywords: {BODY}\nMethods\n", "heading", BODY.strip()),
        ("hyphen-\nated " + BODY * 2, "paragraph", ("hyphenated " + BODY * 2).strip()),
        (f"Abstract\nwhat is too short\nIntroduction\n\nUniversity of {BODY}{BODY}\n\n{BODY}{BODY}\n", "paragraph", f"{BODY}{BODY}".strip()),
        ((BODY * 2).upper(), "none", ""),
        ("a, b, " * 60 + "c.", "none", ""),
        (None, "none", ""),
        ("", "none", ""),
        # no stop: what follows is cut
        ("Abstract\n" + "word " * 3000, "heading", ("word " * 800).strip()),
    ]
    got = column(spark, [c[0] for c in cases], abstracts.located)
    for (given, how, want), r in zip(cases, got, strict=True):
        assert (r["how"], r["abstract"]) == (how, want), given


def test_abstract_of_long_texts_is_linear(spark):
    import time

    began = time.time()
    column(spark, [" " * 300_000, "\n" * 300_000, "abstract\n" * 40_000, "a b s t r " * 40_000, " \t" * 100_000 + "x", "word@ " * 60_000], abstracts.located)
    assert time.time() - began < 60


def test_doi_column_by_share_preference_and_place(spark):
    assert [columns.normal_name(x) for x in (" DOI_Link ", None, "Author Full-Names", "Année (x)")] == ["doi link", "", "author full names", "anne x"]
    shares = {"DOI Link": 0.5, "DOI": 0.5, "doi": 0.5, "x": 0.9}
    assert columns.doi_column(shares) == "DOI"
    assert columns.doi_column({"DOI": 0.005, "note": 0.06, "other": 0.06}) == "note"
    assert columns.doi_column({"DOI": 0.01, "note": 0.05}) is None and columns.doi_column({}) is None
    df = spark.createDataFrame([("10.1000/a", None, 1), ("x", "https://doi.org/10.1/b", 2), (None, None, 3), ("y", None, 4)], "`a.b` string, c string, n int")
    assert columns.profile(df) == {"a.b": pytest.approx(1 / 3), "c": 0.0, "n": 0.0}
    assert columns.profile(df.limit(0)) == {"a.b": 0.0, "c": 0.0, "n": 0.0}
    out = columns.standardised(df, ["Title"]).collect()
    assert sorted(r["doi"] for r in out) == ["", "10.1000/a", "x", "y"]


def test_standard_fields_rank_and_exclude():
    found = columns.standard_fields(["Source Title", "Title", "Article Title", "Author Keywords", "Authors", "Book Authors", "Journal Publisher", "DOI Link", "Publication Year", "Conference Year", "Email Addresses", "Reprint Addresses", "Keywords Plus", "Unnamed: 3 journal"])
    assert found == {"Title": "Article Title", "Authors": "Authors", "Affiliations": "Reprint Addresses", "PublicationYear": "Publication Year", "Journal": "Source Title", "DOILink": "DOI Link", "Keywords": "Author Keywords"}
    assert columns.standard_fields(["Year", "year"])["PublicationYear"] == "Year"
    assert columns.standard_fields([]) == {}


def test_records_of_odd_shapes(spark):
    cases = [
        ({"title": "T", "container-title": [], "issued": {"date-parts": [["20x"]]}, "author": "none"}, "csl", {"Title": "T", "Journal": "", "PublicationYear": "", "Authors": ""}),
        ({"title": ["in a list"], "issued": {"date-parts": [["1066"]]}}, "csl", {"Title": "", "PublicationYear": "1066"}),
        ({"message": {"title": "not a list", "author": [{"given": " G "}, {"family": "F", "given": ""}, {}], "published-print": {"date-parts": [[1200]]}, "issued": {"date-parts": [[2020, 1]]}, "link": [{"URL": " "}], "URL": "u"}}, "crossref", {"Title": "", "Authors": "G; F", "PublicationYear": "2020", "ManuscriptLink": "u"}),
        ({"publication_year": 2021, "authorships": [{"author": {"display_name": "A  B"}}, {"author": None}, {"author": {"display_name": "a b"}}], "abstract_inverted_index": {"b": [1, 3], "a": [0, 1], "c": [7]}, "open_access": {"oa_url": "o"}}, "openalex", {"Authors": "A B", "Abstract": "a a b c", "PublicationYear": "2021", "ManuscriptLink": "o"}),
        ({"paperId": "1", "authors": None, "venue": "V", "journal": {"name": ""}, "year": None}, "semanticscholar", {"Journal": "V", "PublicationYear": "", "Authors": ""}),
        ({"best_oa_location": None, "oa_locations": [5, {"url": "x"}]}, "unpaywall", {"ManuscriptLink": "x", "Title": ""}),
        ([1], None, {"Title": "", "ManuscriptLink": ""}),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(99, "no json"), (98, None)], "i int, t string").select("i", F.try_parse_json("t").alias("r"))
    got = {r["i"]: r for r in records.parsed(df, "r").drop("r").collect()}
    for i, (given, shape, want) in enumerate(cases):
        assert got[i]["shape"] == shape, given
        for field, value in want.items():
            if value is not None:
                assert got[i][field] == value, (given, field)
    assert got[98]["Title"] == got[99]["Title"] == ""


def test_bibtex_needs_one_key_for_one_doi(spark, tmp_path):
    rec = F.parse_json(F.lit('{"title":["A_b {c} \\\\d ~ e"],"author":[{"family":"F"}]}'))
    df = spark.createDataFrame([("10.1/A-b",), ("10.1/c",), ("10.1/c",)], "doi string").withColumn("r", rec)
    path = str(tmp_path / "bib")
    assert records.write_bibtex(records.entries(df, "doi", "r"), path).count() == 2
    lines = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert "@article{S10_1_a_b," in lines and "title = {A\\_b c d e}" in lines and "year" not in lines
    clash = spark.createDataFrame([("10.1/A-b",), ("10.1/a_b",)], "doi string").withColumn("r", rec)
    with pytest.raises(ValueError, match="S10_1_a_b has 2"):
        records.write_bibtex(records.entries(clash, "doi", "r"), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_nested_values(spark):
    entries = ['{"value":[1,2],"quote":"q"}', '[{"value":true,"quote":""},"x",null,{"value":null},{"quote":"z"}]', "null", '"t"', "3.5", '{"value":{"family":"F"}}', '{"value":{"a":1}}', "[]", '[" Ab ",{"value":"aB"}]']
    v = lambda f: column(spark, entries, lambda c: f(F.try_parse_json(c)))
    assert v(lambda e: flatten.value_and_quote(e)[0]) == ["[1,2]", "TRUE; x", "", "t", "3.5", "F", '{"a":1}', "", " Ab ; aB"]
    assert v(lambda e: flatten.value_and_quote(e)[1]) == ["q", "z", "", "", "", "", "", "", ""]
    assert v(flatten.first_scalar) == ["[1,2]", "true", "", "t", "3.5", "f", '{"a":1}', "", "ab"]
    assert v(flatten.value_set)[-1] == ["ab"] and v(flatten.all_values)[1] == "TRUE ; x"
    assert flatten.value_columns(["id", "a", "a_quote", "b", "a", None]) == {"id": 0, "a": 1, "b": 3}
    spec = flatten.column_spec(["id"], [flatten.Field("d", "", derived=True), flatten.Field("h", "", human=True), flatten.Field("a", "A")])
    assert [c for _, c, _ in spec] == ["id", "a", "a_quote", "h", "h_justification", "d (derived)"]


def test_rules_are_ordered_by_what_they_need(spark):
    steps = [sorted(r.name for r in s) for s in derive.layers(derive.RULES, ["modality_primary", *{n for r in derive.RULES for n in r.needs} - {r.name for r in derive.RULES}])]
    assert [len(s) for s in steps] == [7, 1, 1] and steps[-1] == ["summary_methodological_quality"]
    rule = lambda name, *needs: derive.Rule(name, needs, lambda *c: F.lit(1))
    for rules, message in (([rule("a", "b"), rule("b", "a"), rule("c", "x")], "wait for each other"), ([rule("a", "a")], "wait for each other"), ([rule("a", "zz")], "zz"), ([rule("a", "x"), rule("a", "x")], "several")):
        with pytest.raises(ValueError, match=message):
            derive.layers(rules, ["x"])
    df = spark.createDataFrame([(2,)], "x int")
    plus = [derive.Rule("c", ("b", "a"), lambda b, a: a * b), derive.Rule("b", ("a",), lambda a: a + 1), derive.Rule("a", ("x",), lambda x: x * 10)]
    assert tuple(derive.derived(df, plus).first()) == (2, 20, 21, 420)
    assert derive.derived(df, []).columns == ["x"]


def test_metrics_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([("a; b; a", None), (" TRUE ", "n/a")], "f string, g string")
    rows = lambda *m: spark.createDataFrame(list(m), "metric string, field string, kind string, argument string")
    got = {r["metric"]: r["all"] for r in stats.metric_table(df, rows(("l", "f", "label", "a"), ("t", "f", "true", None), ("d", "g", "distinct", None), ("r", "g", "reported", None), ("e", "g", "eq", "zz")), {"all": F.lit(True)}).collect()}
    assert got == {"l": 1, "t": 1, "d": 2, "r": 0, "e": 0}
    for bad in (("x", "no", "eq", "1"), ("x", "f", "odd", "1")):
        with pytest.raises(ValueError):
            stats.metric_table(df, rows(bad), {"all": F.lit(True)})
    assert stats.metric_table(df.limit(0), rows(("t", "f", "true", None)), {"all": F.lit(True)}).collect()[0]["all"] == 0


def test_addresses_like_a_plain_resolver(spark):
    bases = ["http://h.org/a/b/c.html?q=1#f", "https://h.org", "http://h.org/", "http://h.org/a/../b/x"]
    links = ["", "#x", "?y=2", "?", "x", "./x", "../x", "../../x", "../../../../x", "/x/./y/../z", "/..", "/.", ".", "..", "../", "a/b/../../..", "//o.org/p", "x?u=../..#../..", "mailto:x@y.z", "http://z.org/a/../b", "x/.hidden/y", "..x", "x..", ".../x"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, l string")
    for r in df.select("b", "l", ident.absolute(F.col("l"), F.col("b")).alias("u")).collect():
        if r["l"] == "?":
            continue  # an empty query is kept here and dropped there
        want = urljoin(r["b"], r["l"]) if r["l"] else r["b"].partition("#")[0]
        if r["b"] == "https://h.org" and r["l"] in ("", "#x", "?y=2"):
            assert r["u"] == r["b"] + r["l"]
        else:
            assert r["u"] == want, (r["b"], r["l"])
    html = """<a HREF='../y'>1</a><base href="/z/"><a href=x>2</a>"""
    page = spark.createDataFrame([(html, "http://h.org/a/b"), ("<p>", "http://h.org/a/b")], "h string, u string")
    got = page.select(ident.base_of(F.col("h"), F.col("u")).alias("b"), ident.hrefs(F.col("h"), ident.base_of(F.col("h"), F.col("u"))).alias("l")).collect()
    assert [r["b"] for r in got] == ["http://h.org/z/", "http://h.org/a/b"] and got[0]["l"] == ["http://h.org/y", "http://h.org/z/x"]


def test_headings_and_extracted_texts(spark):
    got = column(spark, ["IV Results", "results", "II) Methods", "2.1 methods:", "A. Methods", "methods", "A Methods", "k. Methods"], text.header)
    assert got[0] == got[1] and got[1] and got[2] == got[3] == got[4] == got[5] and got[5] and got[6:] == [None, None]
    reasons = column(spark, [None, "No abstract", "short", "x " * 200, BODY + BODY], lambda c: validate.extracted_text(c, F.lit("a title of its own")))
    assert reasons == ["empty", "placeholder", "chars<250", "words<30", "ok"]
    assert column(spark, [BODY * 2], lambda c: validate.extracted_text(c, F.lit("This work studies a thing that matters"))) == ["abstract_is_title"]
    assert column(spark, ["x" * 300, "a b " * 70, None], validate.long_enough) == [False, True, None]


def test_log_runs_once_and_refuses_while_pending(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.range(10)
    assert log.append(rows, path, "a") and not log.append(rows, path, "a")
    log.announce(spark, path, "b")
    with pytest.raises(log.Pending):
        log.append(rows, path, "c")
    # the rows of a run that failed before its commit are not seen, and written anew
    spark.range(5).write.parquet(f"{path}/run=b")
    assert log.read(spark, path).count() == 10 and log.stale(spark, path).count() == 5
    assert log.append(spark.range(3), path, "b") and log.append(rows, path, "c")
    assert log.runs(spark, path) == {"a": 10, "b": 3, "c": 10} and log.read(spark, path).count() == 23
    with pytest.raises(FileNotFoundError):
        log.read(spark, str(tmp_path / "none"))


def test_versions_are_swapped(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        assert log.publish(spark.range(n), path) == n
    # a version that was never pointed to is not read, and overwritten
    spark.range(99).write.parquet(f"{path}/version=4")
    assert log.published(spark, path).count() == 3 and log.published(spark, path, 1).count() == 2
    assert log.publish(log.published(spark, path).limit(2), path) == 4 and log.published(spark, path).count() == 2
    assert not (tmp_path / "t" / "version=1").exists()


def test_queue_goes_on_and_repeats_nothing(spark, tmp_path):
    rows = [(i, i % 7, ["a", "b", "c"][i % 3], (i * 37 % 11) / 10) for i in range(200)] + [(200, None, "a", 5.0)]
    schema = "i long, k long, s string, v double"
    kind = spark.createDataFrame([], schema).schema
    state, args = str(tmp_path / "state"), ("k", ["i"], "s", F.col("v") >= 1.0, "v", F.concat("s", F.lit("!")))
    go = lambda: queue.work(spark, str(tmp_path / "in"), kind, state, str(tmp_path / "cp"), *args, files_per_batch=1)
    want = {}
    for i, k, s, v in rows:
        if k is not None:
            n, _, _, found, done = want.get(k, (0, None, None, None, False))
            if not done:
                want[k] = (n + 1, s, None if v >= 1 else s + "!", v if v >= 1 else None, v >= 1)
    for part in (rows[:50], rows[50:51], rows[51:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        go()
    go()
    layout = queue.STATE.format(key="bigint", value="double")
    read = lambda: {r["key"]: (r["attempts"], r["last_source"], r["last_error"], r["value"], r["done"]) for r in queue.current(spark, state, layout).collect()}
    assert read() == want
    # a batch that is run again writes what it wrote
    before = queue.current(spark, state, layout, 2)
    again = queue.advance(before, spark.createDataFrame(rows[51:], schema), *args)
    old = sorted(tuple(r)[:6] for r in spark.read.parquet(f"{state}/batch=2").select("key", "attempts", "last_source", "last_error", "value", "done").collect())
    assert sorted(tuple(r) for r in again.collect()) == old


def test_title_match_edges(spark):
    table = spark.createDataFrame([("10.1/A", "t", 2, "late"), ("https://doi.org/10.1/a", "t", 1, "early"), (None, "A very long title, of thirty characters", 1, "by title"), ("", "short", 0, "no")], "doi string, title string, o int, v string")
    rows = spark.createDataFrame([(1, " 10.1/a ", "x"), (2, None, "a VERY long title of: thirty characters!"), (3, "", "short"), (4, None, None)], "i int, doi string, title string")
    got = {r["i"]: (r["v"], r["matched_by"]) for r in link.matched_by_doi_or_title(rows, table, "doi", "title", "v", "o").collect()}
    assert got == {1: ("early", "doi"), 2: ("by title", "title"), 3: (None, ""), 4: (None, "")}


def test_located_abstracts_of_pages_have_no_markup(spark):
    from quillon.plans import catalog

    assert catalog.QUERIES["located_abstracts"](spark, SF).where("how <> 'none' and n_chars < 150").isEmpty()


def test_ragged_lines_and_first_identifiers(spark, tmp_path):
    from quillon.sources import readers

    (tmp_path / "r.csv").write_text('http://a, Name \nhttp://b,"B, C",b.c.,more\n\nhttp://d\n')
    got = [tuple(r) for r in readers.read_ragged(spark, str(tmp_path / "r.csv"), ["url", "name", "abbr"]).collect()]
    assert got == [("http://a", "Name", ""), ("http://b", "B, C", "b.c."), ("http://d", "", "")]
    rows = spark.createDataFrame([(" ", "unavailable", "https://doi.org/10.1/A"), (None, None, "Unavailable"), ("10.2/b", "x", None)], "a string, b string, c string")
    assert [r[0] for r in rows.select(readers.first_identifier(*map(F.col, "abc"))).collect()] == ["10.1/a", None, "10.2/b"]


def test_labels_of_rated_pairs(spark):
    from quillon.operators import cells

    empty = [cells.EMPTY]
    df = spark.createDataFrame([(0, ["b", "a"], ["b"]), (1, ["c"], ["b", "a"]), (2, empty, ["x", "d"]), (3, empty, empty), (4, ["z"], empty)], "i int, h array<string>, o array<string>")
    pairs = lambda lenient, side: [r[0] and tuple(r[0]) for r in df.orderBy("i").select(cells.rating_pair(F.col("h"), F.col("o"), lenient, side)).collect()]
    assert pairs(True, "exclude") == [(True, "b", "b"), (False, "c", "a"), None, (True, "∅", "∅"), None]
    assert pairs(False, "agree") == [(False, "a", "b"), (False, "c", "a"), (True, "d", "d"), (True, "∅", "∅"), (True, "z", "z")]
    assert pairs(False, "disagree")[2] == (False, "∅", "d")
    with pytest.raises(ValueError):
        cells.rating_pair(F.col("h"), F.col("o"), True, "else")


def test_digest_sums_wrap(spark):
    for values in ([5, -7], [2**63 - 1, 1], [-(2**63), -1], [2**47] * 70_000, [-(2**63)] * 3):
        got = spark.createDataFrame([(v,) for v in values], "v long").agg(stats.wrapped_sum(F.col("v"))).first()[0]
        assert got == (sum(values) + 2**63) % 2**64 - 2**63
    assert spark.createDataFrame([(None,)], "v long").agg(stats.wrapped_sum(F.col("v"))).first()[0] is None
