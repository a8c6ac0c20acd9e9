"""Sources and sinks beyond Spark's plain readers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ident import canonical_doi


def read_csv_text(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """A1, A2, C4: every column a string, blanks as '', missing columns added."""
    df = spark.read.csv(path, sep=sep, header=True, nullValue="\0", emptyValue="")
    out = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]
    return df.select(*out, *[F.lit("").alias(c) for c in columns if c not in df.columns])


def read_ragged(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """A3: lines without a header and with more or fewer values than names; missing values are '', others trimmed, surplus ones go. Blank lines give no row."""
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, sep=sep, header=False, mode="PERMISSIVE")
    return rows.select(*[F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) for n in names])


def first_identifier(*values: Column) -> Column:
    """A4: the canonical form of the first value that is neither blank nor 'unavailable'; null if there is none."""
    known = [F.when(~F.lower(F.trim(v)).isin("", "unavailable"), canonical_doi(v)) for v in values]
    return F.coalesce(*known)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``value`` parsed as VARIANT; a bad line gives its first 300 characters as ``parse_error``."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    return rows.select(parsed.alias("record"), F.when(parsed.isNull(), F.left("value", F.lit(300))).alias("parse_error"), F.col("_metadata.file_path").alias("file"))


def read_json_lines_strict(spark: SparkSession, path: str) -> DataFrame:
    """Bad lines are dropped."""
    return read_json_lines(spark, path).where("record is not null").drop("parse_error")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A7, A8."""
    return spark.read.option("multiLine", True).json(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files with size; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def workbook_cells(content: bytes) -> list[tuple]:
    """(sheet, row, column letters, value, formula) of an .xlsx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(_CELL + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_CELL + "sheet"):
            target = rels[sheet.get(_REL + "id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
            for c in root.iter(_CELL + "c"):
                letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                v, f, kind = c.find(_CELL + "v"), c.find(_CELL + "f"), c.get("t")
                value = "".join(t.text or "" for t in c.iter(_CELL + "t")) if kind == "inlineStr" else v.text if v is not None else None
                value = strings[int(value)] if kind == "s" and value is not None else value
                out.append((sheet.get("name"), int(row), letters, value, f.text if f is not None else None))
        return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All cells of all sheets as ``(file, sheet, row, col, value, formula)``."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *cell) for p, c in zip(pdf["path"], pdf["content"], strict=True) for cell in workbook_cells(c)]
            yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "value", "formula"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, sheet string, row long, col string, value string, formula string")


def hyperlink_target(formula):
    """The decoded target of a HYPERLINK formula; a plus sign stays."""
    return F.url_decode(F.replace(F.regexp_extract(formula, r'(?i)HYPERLINK\("([^"]+)"', 1), F.lit("+"), F.lit("%2B")))


def write_csv_text(df: DataFrame, path: str, sep: str = ";") -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").csv(path, sep=sep, header=True)


def replace_table(df: DataFrame, path: str) -> None:
    """Written beside, then renamed over the old one, which stays as .bak."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old, bak = (jvm.org.apache.hadoop.fs.Path(path + x) for x in (".new", "", ".bak"))
    fs = old.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(old):
        fs.delete(bak, True)
        fs.rename(old, bak)
    fs.rename(new, old)
