"""From raw documents to packed token sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, langid, linededup, minhash, packing
from quillon.llm.common import ship_code, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """``docs`` with a key of each row, if they are read from files: the hash of file and place in it."""
    try:
        return docs.withColumn("__key", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))), "__key"
    except AnalysisException:
        return docs, None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and accepted.

    Texts without letters (null, empty, digits) go; rows are judged one by one,
    whatever their ids."""
    ship_code(spark)
    docs, key = _rows(docs)
    return langid.keep_identified(docs, row_col=key).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had text and has none left goes too.

    Rows with a null id pass unchanged; rows that share an id lose the same
    line numbers."""
    ship_code(spark)
    out = linededup.dedupe_lines(docs)
    blank = F.coalesce(F.length(F.trim(F.regexp_replace("text", r"\s+", ""))) == 0, F.lit(True))
    return out.where(~(blank & (F.col("n_removed") > 0))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    The measure is that of op1's contract: distinct two-word shingles, 0.8 of
    their union or more. Rows are judged one by one, whatever their ids; rows
    without words stay."""
    ship_code(spark)
    docs, key = _rows(docs)
    return minhash.drop_near_duplicates(docs, row_col=key, size=2, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each row by its own text."""
    docs, key = _rows(docs)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), row_col=key).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full token sequences."""
    import public_tokenizers

    ship_code(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Stages 1, 4 and 5 are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
