"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Upper bound, in code points, of the text that one NumPy step works on.
CHUNK_CHARS = 250_000
#: Upper bound, in bytes, of the Arrow batches sent to Python workers.
BATCH_BYTES = 4_000_000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers and bound their batches.

    The package goes as an archive through Spark's own file service, so that
    hosts need share no folder with the driver."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if BATCH_BYTES < int(spark.conf.get(size).rstrip("bB")):
        spark.conf.set(size, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_quillon_sent", False):
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quillon-")), "quillon.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "quillon")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, _ROOT))
    sc.addPyFile(archive)
    sc._quillon_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary one is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        found = sc.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a point that survives the loss of any executor.
    The folder goes when the session ends, or with :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`written` wrote; only for frames that nothing unwritten reads any more."""
    for df in frames:
        path = getattr(df, "_quillon_path", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: What forgets the cache of a module, by the module's name.
CACHES: dict = {}


def forget_others(module: str) -> None:
    """Workers live on and serve one operator after the other: only the one at work keeps its cache."""
    for name, forget in CACHES.items():
        if name != module:
            forget()
    release()


def release() -> None:
    """Give freed memory of this worker back; it serves later stages, too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over batches; ``function`` maps one batch to batches."""
    out = to_arrow(df.sparkSession, schema)

    def run(batches):
        forget_others(function.__module__)
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out
                )
        release()

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def chunks(texts: list, most: int = CHUNK_CHARS):
    """Index ranges of ``texts`` whose lengths add up to about ``most``."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)
