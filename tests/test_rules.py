import json
import random

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import cells, link, segment


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_unverified_fields_and_flags(spark):
    assert one(spark, cells.unverified_fields(F.lit("C.code_url; D.a.b,code_url,"))) == ["code_url", "a.b"]
    assert one(spark, cells.unverified_fields(F.lit(None).cast("string"))) == []
    assert one(spark, cells.rater_flag(F.lit("Yes, upon request"), human_release=True)) is False
    assert one(spark, cells.rater_flag(F.lit(None).cast("string"))) is False


def test_validation_label(spark):
    got = [one(spark, cells.validation_label(F.lit(v)))[0] for v in ("5-fold CV", "80/20", "Not reported here", "", "LOO")]
    assert got == ["k_fold", "holdout", cells.EMPTY, cells.EMPTY, "loo"]


def test_snap_quote(spark):
    source = "high accuracy, sensitivity of a novel PET system"
    for quote, want in (("tivity of a novel PET sys", "sensitivity of a novel PET system"), ("HIGH ACCUR", "high accuracy"), ("absent", "absent"), ("", "")):
        assert one(spark, text.snap_quote(F.lit(quote), F.lit(source))) == want


def test_repair_verdict(spark):
    whole = json.dumps({"record_id": "r1", "doi": "10.1/x", "primary": {"category": "A", "evidence_quote": 'q "x" }{', "evidence_field": "title"}, "secondary": {"category": "B", "evidence_quote": "z", "evidence_field": "abstract"}, "confidence": "low", "reasoning": "because\nso"})
    got = one(spark, text.repair_verdict(F.lit(whole)))
    assert (got.record_id, got.primary.evidence_quote, got.secondary.category, got.reasoning) == ("r1", 'q "x" }{', "B", "because\nso")
    cut = one(spark, text.repair_verdict(F.lit(whole[: whole.index("q \\") + 1])))
    assert (cut.primary.evidence_quote, cut.primary.evidence_field, cut.secondary, cut.confidence) == ("q", "abstract", None, "high")
    assert one(spark, text.repair_verdict(F.lit(whole[:20]))) is None
    assert one(spark, text.repair_verdict(F.lit(None).cast("string"))) is None


def test_notebook_text(spark):
    book = {"cells": [{"cell_type": "code", "source": ["a = 1\n", "a"], "outputs": [{"data": {"text/plain": ["1", "2"]}}, {}]}, {"cell_type": "raw", "source": "no"}, {"cell_type": "markdown", "source": "[x]"}, {"cell_type": "code", "source": " "}]}
    assert one(spark, text.notebook_text(F.lit(json.dumps(book)))) == "[code cell]\na = 1\na\n\n[output]\n12\n\n[markdown cell]\n[x]"
    assert one(spark, text.notebook_text(F.lit("{"))) is None
    assert one(spark, text.notebook_text(F.lit("{}"))) == ""


def test_pack_units(spark):
    rows = [(1, 0, "a", "x" * 30, ["i1"]), (1, 1, "b", None, None), (1, 2, "c", "y" * 200, []), (1, 3, "d", "z", ["i2", "i3", "i4"]), (2, 0, "e", "", [])]
    df = spark.createDataFrame(rows, "sn long, ord int, src string, body string, shots array<string>")
    got = segment.pack_units(df, "sn", "ord", "src", "body", "shots", 2, 100, overlap=20).orderBy("sn", "chunk").collect()
    ones = [r for r in got if r.sn == 1]
    assert [len(r.texts) for r in ones[:1]] == [2] and ones[0].images == ["i1"]
    assert all(len("".join(r.texts)) <= 100 and len(r.images) <= 2 for r in got)
    long = [r.texts[0] for r in ones[1:-2]]
    joined = long[0] + "".join(p[20:] for p in long[1:])
    assert joined == "===== FILE: c =====\n" + "y" * 200
    assert [r.images for r in ones[-2:]] == [["i2", "i3"], ["i4"]] and [len(r.texts) for r in ones[-2:]] == [1, 0]
    assert [r.texts for r in got if r.sn == 2] == [["===== FILE: e =====\n"]]


def test_plan_pages_with_sections(spark):
    """Runs hold the ceiling, cover all pages in order, and end before a section near their end."""
    deal = random.Random(7)
    rows, marks, at = [], [], {}
    for doc in range(6):
        at = 0
        for page in range(1, deal.randint(2, 30)):
            size = deal.randint(1, 4000)
            rows.append((doc, page, at, at + size))
            if deal.random() < 0.3:
                marks.append((doc, at))
            at += size
    pages = spark.createDataFrame(rows, "doc long, page long, char_start long, char_end long")
    sections = spark.createDataFrame(marks, "doc long, start long")
    ends = {(d, p): (a, b) for d, p, a, b in rows}
    for cut in (None, sections):
        got = segment.plan_pages(pages, "doc", 12000, sections=cut).orderBy("doc", "chunk").collect()
        for doc in range(6):
            runs = [r for r in got if r.doc == doc]
            n = max(p for d, p, *_ in rows if d == doc)
            assert runs[0].page_start == 1 and runs[-1].page_end == n
            assert all(b.page_start in (a.page_end, a.page_end + 1) for a, b in zip(runs, runs[1:]))
            assert all(r.est_tokens <= 12000 for r in runs)
            if cut is not None and len(runs) > 1:
                starts = {s for d, s in marks if d == doc}
                for r in runs:
                    lo, hi = ends[doc, r.page_start][0], ends[doc, r.page_end][1]
                    full = r.page_end == n or int(1600 * (r.page_end + 2 - r.page_start) + 0.25 * (ends[doc, r.page_end + 1][1] - lo)) > 12000
                    assert full or hi in starts


def test_union_first(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "w")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, link.union_first([a, b], "k").select("k", "stream", "v").collect())) == [(1, 0, "w"), (2, 1, "b")]


def test_ingest_again(spark, tmp_path):
    """A second run over new files sees the first one's keys; a batch that is written again changes nothing."""
    from quillon.streaming.ingest import ingest

    source, table, bad, mark = (str(tmp_path / x) for x in ("in", "table", "bad", "mark"))
    first = spark.createDataFrame([(1, 1), (2, 2)], "id long, ord long")
    check = lambda df: df.withColumn("errors", F.array().cast("array<string>"))
    run = lambda: ingest(spark, source, first.schema, check, "id", "ord", table, bad, mark)
    first.write.parquet(source)
    run()
    spark.createDataFrame([(2, 3), (3, 4)], "id long, ord long").write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3]
    assert [r.id for r in spark.read.parquet(bad).where("route = 'duplicate'").collect()] == [2]
    commit = max((tmp_path / "mark" / "commits").glob("[0-9]*"))
    commit.unlink()
    (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3]
