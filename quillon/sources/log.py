"""Append-only logs, guards, versions and one file per key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Pending(Exception):
    """A run was announced that has not ended."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside, then renamed over."""
    fs, target = _fs(spark, path)
    _, new = _fs(spark, path + ".new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(new, target, how)


def _text(spark: SparkSession, path: str) -> str | None:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def announce(spark: SparkSession, path: str, run: str) -> None:
    """Mark a run as pending; refused while another one is."""
    other = _text(spark, f"{path}/_pending")
    if other is not None and other != run:
        raise Pending(f"run {other} of {path} is pending")
    _put(spark, f"{path}/_pending", run)


def runs(spark: SparkSession, path: str) -> dict[str, int]:
    """The committed runs of a log and their numbers of rows, in the order of their commits."""
    text = _text(spark, f"{path}/_manifest")
    return json.loads(text) if text else {}


def append(df: DataFrame, path: str, run: str) -> bool:
    """B2: ``df`` added to the log as a run of its own; False if that run is in it already.

    The rows are written first, then the manifest that names the run is swapped
    as one file, so that readers see all of a run or nothing. A run that failed
    before is written anew. B5: refused while another run is pending; this run is
    pending until it is committed."""
    spark = df.sparkSession
    announce(spark, path, run)
    done = runs(spark, path)
    if run not in done:
        home = f"{path}/run={run}"
        df.write.mode("overwrite").parquet(home)
        _put(spark, f"{path}/_manifest", json.dumps(done | {run: spark.read.parquet(home).count()}))
    fs, mark = _fs(spark, f"{path}/_pending")
    fs.delete(mark, False)
    return run not in done


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All rows of the committed runs with the run they came with."""
    homes = [f"{path}/run={r}" for r in runs(spark, path)]
    if not homes:
        raise FileNotFoundError(f"{path} has no committed run")
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*homes)


def publish(df: DataFrame, path: str) -> int:
    """A new version of a table; readers see the old one until a pointer is swapped, and then the new one.

    Returns its number. The version before stays as a backup, older ones go."""
    spark = df.sparkSession
    now = current_version(spark, path)
    number = (now or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    _put(spark, f"{path}/_current", str(number))
    fs, old = _fs(spark, f"{path}/version={number - 2}")
    if fs.exists(old):
        fs.delete(old, True)
    return number


def current_version(spark: SparkSession, path: str) -> int | None:
    text = _text(spark, f"{path}/_current")
    return int(text) if text else None


def published(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The current version of a table, or the one before with ``back=1``."""
    number = current_version(spark, path)
    if number is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(f"{path}/version={number - back}")


def write_per_key(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder with one JSON file for each combination of keys, the rest of the columns as objects in it.

    Only the combinations in ``df`` are replaced, so that a run may be repeated
    or cover some keys only. The rows of a combination go to one file, as the
    file is what is asked for; they are written as they come, not gathered."""
    spark = df.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*keys).json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def read_per_key(spark: SparkSession, path: str, schema) -> DataFrame:
    """What :func:`write_per_key` wrote; keys come from the names of the folders."""
    return spark.read.schema(schema).json(path)


def stale(spark: SparkSession, path: str) -> DataFrame:
    """Rows of runs that were never committed, with their run: what a failure left."""
    known = list(runs(spark, path))
    rows = spark.read.parquet(path)
    return rows.where(~F.col("run").cast("string").isin(known) if known else F.lit(True))
