from pyspark.sql import functions as F

from quillon.functions import ident, text, unicode
from quillon.operators import derive, fold, segment


def one(spark, expr, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(expr).first()[0]


def test_absence_vocabularies_differ(spark):
    got = {s: one(spark, text.is_absent(F.col("v"), s), v="none_reported") for s in ("validator", "refill", "hardware", "axis", "targets", "statistics")}
    assert got == {"validator": False, "refill": True, "hardware": True, "axis": False, "targets": True, "statistics": False}
    assert one(spark, text.is_absent(F.col("v"), "validator"), v=None)


def test_doi_and_url(spark):
    assert one(spark, ident.canonical_doi(F.col("v")), v=" https://doi.org/10.1000/ABC.;) ") == "10.1000/abc"
    assert one(spark, ident.canonical_url(F.col("v")), v="https://www.Example.org/a/).") == "example.org/a"
    assert one(spark, ident.dois_in(F.col("v")), v="see 10.1000/x1, and 10.1000/X1.") == ["10.1000/x1"]
    assert len(one(spark, ident.safe_file_name(F.col("v")), v="a" * 200)) == 157


def test_rescue_ladder(spark):
    source = "a hybrid quantum-\nclassical model with 4 qubits (with depth 3) here"
    level = lambda q: one(spark, text.rescue_level(F.col("q"), F.col("s")), q=q, s=source)
    assert level("hybrid quantum-classical model") == "R1"
    assert level("4 qubits (with depth 3)!!!") in ("R2", "R3")
    assert level("quantum / classical / model") == "R3"
    assert level("no such phrase") == "unverified"


def test_text_small(spark):
    assert one(spark, text.dehyphenate(F.col("v")), v="dual- positron a- b- c") == "dual-positron a-b-c"
    assert one(spark, text.first_int(F.col("v")), v="about 1,234 of 9") == 1234
    assert one(spark, text.header(F.col("v")), v="2.1 Related Work:") == "background"
    assert one(spark, text.header(F.col("v")), v="these methods are old") is None
    assert one(spark, text.strict(F.col("v")), v="“Straße”  x") == '"strasse" x'
    assert one(spark, unicode.casefold(F.col("v")), v="Straße") == "strasse"
    assert one(spark, unicode.ascii_fold(F.col("v")), v="é") == "e"
    assert one(spark, text.unfenced_json(F.col("v")).cast("string"), v='```json\n{"a": 1}\n```') == '{"a":1}'


def test_clarity_needs_null_strategy(spark):
    c = lambda k, s: one(spark, derive.mitigation_clarity(F.col("k"), F.col("s")), k=k, s=s)
    assert c("none_reported", None) == "none" and c("none_reported", "none_reported") == "low" and c("ZNE", None) == "high"
    assert one(spark, derive.modality_family(F.col("v")), v="oct") == "unspecified"


def test_append_is_ordered_and_case_blind(spark):
    df = spark.createDataFrame([("OASIS", ["adni", "ADNI", "oasis", "MNIST"]), (None, ["x"])], "c string, d array<string>")
    assert [r[0] for r in df.select(fold.append_distinct(F.col("c"), F.col("d"))).collect()] == ["OASIS; adni; MNIST", "x"]


def test_folds_of_one_chunk(spark):
    df = spark.createDataFrame([(1, 0, "weak"), (2, 0, "odd"), (2, 1, "strong"), (2, 2, "strong")], "k int, c int, v string")
    got = {r["k"]: (r["grade"], r["disagreement"]) for r in fold.fold_grade(df, ["k"], "c", "v", ["none", "weak", "strong"]).collect()}
    assert got == {1: ("weak", False), 2: ("strong", False)}


def test_sections_and_pages(spark):
    df = spark.createDataFrame([(1, "Title\n\nAbstract\nwords\n\n1. Introduction\nmethods are\n")], "d long, t string")
    assert [r["section"] for r in segment.sections(df, "d", "t").orderBy("start").collect()] == ["abstract", "introduction"]
    p = segment.pages(spark.createDataFrame([(1, "ab\fcd\f")], "d long, t string"), "d", "t").orderBy("page").collect()
    assert [(r["char_start"], r["char_end"]) for r in p] == [(0, 3), (3, 6)]


def test_inverted_index_clash(spark):
    df = spark.createDataFrame([(1, {"b": [1], "a": [0, 1]})], "d long, m map<string, array<int>>")
    words = {w: segment.inverted_text(df, "d", "m", w).first()["text"].split()[0] for w in (False, True)}
    assert words == {False: "a", True: "a"}


def test_sources(spark, tmp_path):
    import zipfile

    from quillon.sources import readers

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    rows = readers.read_json_lines(spark, str(tmp_path / "a.jsonl")).select("parse_error").collect()
    assert sorted(str(r[0]) for r in rows) == ["None", '{"a": ']
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>doi</t></is></c><c r="B1"><f>HYPERLINK("http://x/a%20b+c","t")</f><v>t</v></c></row></sheetData></worksheet>')
    cells = readers.read_xlsx(spark, str(tmp_path / "w.xlsx")).withColumn("u", readers.hyperlink_target(F.coalesce("formula", F.lit("")))).orderBy("col").collect()
    assert [(c["col"], c["value"], c["u"]) for c in cells] == [("A", "doi", ""), ("B", "t", "http://x/a b+c")]
    readers.replace_table(spark.range(2), str(tmp_path / "t"))
    readers.replace_table(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
