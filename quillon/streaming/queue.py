"""A work queue that goes on where it stopped, as keyed state over micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import _exists

STATE = "key {key}, attempts long, last_source string, last_error string, value {value}, done boolean, batch long"


def advance(before: DataFrame, attempts: DataFrame, key: str, order: list[str], source: str, ok: Column, value: str, error: Column) -> DataFrame:
    """The state of the keys of a batch after its attempts: ``key, attempts, last_source, last_error, value, done``.

    ``before`` has the same columns. Attempts of a key count in ``order`` up to
    the first that is ``ok``, which gives its value; what comes for a key that is
    done does not count. All of it is grouped by key, so a key of very many
    attempts is never gathered."""
    seen = attempts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*order).alias("o"), F.col(source).alias("s"), F.coalesce(ok, F.lit(False)).alias("ok"), F.col(value).alias("v"), error.alias("e"))
    old = before.select("key", *[F.col(c).alias(f"old_{c}") for c in ("attempts", "last_source", "last_error", "value", "done")])
    open_ = seen.join(old.where("old_done").select("key"), "key", "left_anti")
    first = open_.where("ok").groupBy("key").agg(F.min("o").alias("first"))
    counted = open_.join(first, "key", "left").where(F.col("first").isNull() | (F.col("o") <= F.col("first")))
    new = counted.groupBy("key").agg(
        F.count("*").alias("n"),
        F.max(F.struct("o", "s", F.when(~F.col("ok"), F.col("e")).alias("e"))).alias("last"),
        F.min(F.when(F.col("ok"), F.struct("o", "v"))).alias("hit"),
    )
    return new.join(old, "key", "left").select(
        "key",
        (F.coalesce("old_attempts", F.lit(0)) + F.col("n")).alias("attempts"),
        F.col("last.s").alias("last_source"),
        F.col("last.e").alias("last_error"),
        F.col("hit.v").alias("value"),
        F.col("hit").isNotNull().alias("done"),
    )


def current(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The latest state of every key, of batches before a number if one is given."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    rest = [c for c in rows.columns if c not in ("key", "batch")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "batch").alias("s"), F.max("batch").alias("batch")).select("key", "s.*", "batch")


def work(spark: SparkSession, folder: str, schema, state: str, checkpoint: str, key: str, order: list[str], source: str, ok: Column, value: str, error: Column, files_per_batch: int | None = None) -> None:
    """Takes the new attempts in the files of ``folder`` into the state under ``state``.

    Each micro-batch writes the keys it changed into a folder of its own and
    reads only earlier ones; run again after a failure it overwrites the same
    folder with the same rows. A later run goes on behind the last batch."""
    columns = {f.name: f.dataType.simpleString() for f in schema}
    kind = STATE.format(key=columns[key], value=columns[value])

    def step(batch: DataFrame, number: int) -> None:
        before = current(spark, state, kind, number).join(batch.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
        advance(before, batch, key, order, source, ok, value, error).write.mode("overwrite").parquet(f"{state}/batch={number}")

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    reader.parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
