"""Work that must not grow faster than the input: how rows are dealt out, and what is worked out once."""

import random

from pyspark.sql import functions as F

from conftest import SF
from quillon.functions import abstracts, text
from quillon.operators import corpus, flatten, records, segment, verdicts
from quillon.plans import catalog


def _plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_cells_are_not_dealt_out_by_field(spark):
    cells = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 2, "b", None)], "k int, c int, field string, v string")
    kinds = spark.createDataFrame([("a", "list"), ("b", "bool")], "field string, kind string")
    got = corpus.merge_by_kind(cells, ["k"], "field", "c", "v", kinds, [])
    assert "hashpartitioning(field" not in _plan(got)
    assert [tuple(r) for r in got.select("k", "field", "v", "chunk_id").collect()] == [(1, "a", "x; y", "merged")]


def test_paragraphs_are_judged_until_one_is_found(spark):
    plain = "Plain words of a paragraph, one after the other. " * 8
    texts = [plain + "\n\n" + plain.upper(), "University of x\n" + plain + "\n \n" + plain, "a@b " + plain, "12345 , ab cd " + plain, "this  is the accepted " + plain, "this is it " + plain]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", abstracts.located(F.col("t")).alias("a"))
    assert "filter(transform(split" not in _plan(df, "analyzed")
    got = {r["i"]: (r["a"]["how"], r["a"]["abstract"][:7]) for r in df.collect()}
    assert got == {0: ("paragraph", "Plain w"), 1: ("paragraph", "Plain w"), 2: ("none", ""), 3: ("none", ""), 4: ("none", ""), 5: ("paragraph", "this is")}


def test_runs_with_sections_are_planned_in_batches(spark):
    df = catalog.QUERIES["pack_pages_sections"](spark, SF)
    assert "InPandas" not in _plan(df) and "MapInArrow" in _plan(df)
    pages = spark.createDataFrame([(d, p, p * 10, p * 10 + 10) for d in (1, None) for p in range(1, 5)], "doc long, page int, char_start int, char_end int")
    got = segment.plan_pages(pages, "doc", 5000, sections=spark.createDataFrame([(1, 38)], "doc long, start long")).where("doc = 1").orderBy("chunk").collect()
    assert [(r["page_start"], r["page_end"]) for r in got] == [(1, 2), (2, 4)]


def test_runs_are_planned_in_batches(spark):
    assert "InPandas" not in _plan(catalog.QUERIES["pack_pages_budget"](spark, SF))
    pages = spark.createDataFrame([(d, p, p * 10, p * 10 + 10) for d in (1, None) for p in range(1, 5)], "doc long, page int, char_start int, char_end int")
    got = {(r["doc"], r["chunk"], r["page_start"], r["page_end"]) for r in segment.plan_pages(pages, "doc", 5000).collect()}
    assert got == {(d, *run) for d in (1, None) for run in ((0, 1, 3), (1, 3, 4))}


def test_offsets_of_long_texts_are_summed_in_blocks(spark):
    for n in (1, 255, 256, 257, 1000):
        parts = ["x" * (k % 7 + 2) for k in range(n)]
        docs = spark.createDataFrame([(1, "\n".join(parts)), (2, None)], "d long, t string")
        pages, lines = segment.pages(docs, "d", "t", "\n"), segment.lines(docs, "d", "t")
        want = [sum(len(p) + 1 for p in parts[:k]) for k in range(n)]
        assert [r["char_start"] for r in pages.orderBy("page").collect()] == want
        assert [r["start"] for r in lines.orderBy("line_no").collect()] == want
    assert "slice(" in _plan(pages, "optimizedPlan")
    assert [_plan(df, "optimizedPlan").count("split(t#") for df in (pages, lines)] == [1, 1]


def test_texts_are_shuffled_once(spark):
    assert _plan(catalog.QUERIES["inverted_index_text"](spark, SF)).count("Exchange ") == 1
    maps = spark.createDataFrame([(1, {"a": [2, 0], "b": [1, 2]}), (2, {}), (3, None)], "d int, m map<string,array<int>>")
    assert "Exchange" not in _plan(segment.inverted_text(maps, "d", "m"))
    assert [tuple(r) for r in segment.inverted_text(maps, "d", "m").collect()] == [(1, "a b a")]


def test_values_are_folded_once(spark):
    df = spark.createDataFrame([(["A", "b ", None, "a", "B", "", "c"],)], "xs array<string>").select(records._joined(F.col("xs")).alias("j"))
    assert _plan(df, "analyzed").count("regexp_replace") == 1
    assert df.first()["j"] == "A; b; c"


def test_sources_are_relaxed_once(spark):
    q = "one two three four five six"
    df = spark.createDataFrame([("v", "zz " + q, "so " + q + "!"), ("Long Value", "zz", "a long-value"), ("nr", "zz", "nr")], "v string, q string, s string")
    out = df.select(text.rescue_quote(F.col("v"), F.col("q"), F.col("s")).alias("r"))
    assert _plan(out, "analyzed").count("coalesce(s#") == 1
    assert [r["r"] and tuple(r["r"]) for r in out.collect()] == [(q, "fragment"), None, None]
    cells, sources = spark.createDataFrame([(1, "f", "q")], "k int, field string, quote string"), spark.createDataFrame([(1, "q")], "k int, text string")
    cells = cells.withColumn("value", F.parse_json(F.lit('"x"'))).withColumn("image_only", F.lit(False))
    registry = spark.createDataFrame([("f", "text", None, None, None, True, False)], "field string, kind string, allowed array<string>, low long, high long, requires_quote boolean, derived boolean")
    assert "hashpartitioning(field" not in _plan(verdicts.cell_errors(cells, registry, sources, "k"))


def test_verdicts_are_parsed_once(spark):
    assert _plan(catalog.QUERIES["subscreen_verdicts"](spark, SF), "optimizedPlan").count("parseJson") == 1


def test_kinds_of_values_are_read_once(spark):
    df = spark.sql("select parse_json('{\"a\": 1}') as v").select(flatten.scalar_text(F.col("v")).alias("t"))
    assert _plan(df, "analyzed").count("schema_of_variant") == 1
    assert df.first()["t"] == '{"a":1}'


def test_forms_of_a_quote_are_worked_out_once(spark):
    rows = [("ab", "x ab"), ("a-b", "a-\nb"), ('"a-b"', "a-\nb"), ("a / b", "a b"), ("q", "a"), ("", "a"), (None, None)]
    df = spark.createDataFrame(rows, "q string, s string").select(text.rescue_level(F.col("q"), F.col("s")).alias("l"))
    assert _plan(df, "analyzed").count("coalesce(q#") == 1
    assert [r["l"] for r in df.collect()] == ["R0", "R1", "R2", "R3", "unverified", "unverified", "unverified"]


def test_signs_of_a_quote_are_replaced_only_where_there_are_any(spark):
    deal = random.Random(5)
    some = lambda n: "".join(deal.choice("aB1 -\n.\"'/ß’“‐−​­ İé") if deal.random() < 0.4 else deal.choice("ab -\n.") for _ in range(n))
    rows = [(some(deal.randint(0, 5)), some(deal.randint(0, 40))) for _ in range(3000)] + [("a", None), (None, "a")]
    q, s = F.col("q"), F.col("s")
    rejoined, bare = F.regexp_replace(s, r"-\s*\n\s*", "-"), F.regexp_replace(q, r"^\p{P}+|\p{P}+$", "")
    has = lambda f, s, q: (f(q) != "") & F.contains(f(s), f(q))
    solid = lambda x: F.replace(text.relaxed(x), F.lit(" "), F.lit(""))
    plain = F.when(has(text.strict, s, q), "R0").when(has(text.strict, rejoined, q), "R1").when(has(text.strict, rejoined, bare), "R2").when(has(solid, rejoined, q), "R3").otherwise("unverified")
    df = spark.createDataFrame(rows, "q string, s string").select("q", "s", plain.alias("want"), text.rescue_level(q, s).alias("got"))
    got = df.collect()
    assert [r for r in got if r["want"] != r["got"]] == []
    assert {r["got"] for r in got} == {"R0", "R1", "R2", "R3", "unverified"}
    plan = _plan(df.select("got"), "optimizedPlan")
    assert "octet_length" in plan and "[^a-z0-9 ]" not in plan
