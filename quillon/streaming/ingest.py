"""Append-only ingest as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.validate import route


def ingest(spark: SparkSession, folder: str, schema, validate: Callable[[DataFrame], DataFrame], key: str, order: str, table: str, quarantine: str, checkpoint: str) -> None:
    """Reads new files of ``folder``, validates, keeps rows with new keys in ``table``.

    Keys are never forgotten: each micro-batch is joined with the table itself.
    Each batch overwrites a folder of its own and sees only earlier ones, so that
    a batch that is run again after a failure writes the same rows again."""

    def step(batch: DataFrame, number: int) -> None:
        checked = validate(batch)
        history = spark.read.schema(StructType([*checked.schema, StructField("batch", LongType())])).parquet(table).where(F.col("batch") < number) if _exists(spark, table) else checked.limit(0)
        routed = route(checked, history, key, order=order)
        routed.where("route = 'keep'").write.mode("overwrite").parquet(f"{table}/batch={number}")
        routed.where("route <> 'keep'").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
