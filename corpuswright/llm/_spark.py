"""What the operators share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; an id of null counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, spark.checkpoint.dir.

    Where it is unset a local session, as in tests, gets a folder of its own under
    /tmp; on a cluster that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return "/tmp/corpuswright-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, as a Parquet table of the shared folder, of which later steps read only what they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now: it does once the driver has collected
    their last references, which a driver with memory to spare may put off for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slim() -> None:
    """Gives the system back what this Python worker has freed; kept, it would stand beside the executor's heap until the worker ends."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function for mapInArrow, after which its worker is slim."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            slim()

    return kept


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(*taken: list[str]) -> str:
    """A column name that no input column has."""
    return f"_cw_{uuid.uuid4().hex[:12]}"
