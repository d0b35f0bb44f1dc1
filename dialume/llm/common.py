"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session; only where that is unset and driver and executors are one
    process (tests), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="dialume-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/dialume-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands texts to Python a few MB at a time."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(4 << 20))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    the rows outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Exchanges whose results have been written, and that nothing refers to any
    more, leave the disk now: Spark removes them when the driver collects garbage,
    which may be long after the next exchange."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which a task hands freed memory back to the system: Python
    workers live on through stages that need none."""

    def through(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return through


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def salt_of(col: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(salts)).cast("int")


def documents_view(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, under names of its own;
    whatever else the table holds cannot clash. A null text counts as empty."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def mark(text: Column) -> Column:
    """The first 8 bytes of the SHA-256 of a text (null counts as empty): with the
    identifier, a name for a row."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 8)


def row_key(id_: Column, text: Column) -> Column:
    return F.struct(id_.alias("id"), mark(text).alias("mark"))


#: Names of rows that may go to every executor (some 50 bytes each).
FEW_IDS = 250_000


def without(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows named in ``rows`` (column ``_key``, see
    ``row_key``): rows of that identifier, null or not, with that text. A counted,
    short list goes to every executor and the texts stay where they are; a longer
    one is joined by exchange."""
    gone = materialize(rows.select("_key.id", "_key.mark").distinct(), "gone")
    named = gone.select(F.col("id").alias("_gone_id"), F.col("mark").alias("_gone_mark"))
    named = F.broadcast(named) if gone.count() <= FEW_IDS else named
    same = docs[id_col].eqNullSafe(F.col("_gone_id")) & (mark(docs[text_col]) == F.col("_gone_mark"))
    return docs.join(named, same, "left_anti")
