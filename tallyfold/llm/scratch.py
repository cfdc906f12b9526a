"""Shared-folder tables that cut lineage between the steps of an operator."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.written import shared_folder

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of texts that go to a Python worker at a time.
BATCH = 2 << 20


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Within it, a finished job's shuffle files go at once, not at some later GC."""
    before = spark.conf.get(_CLEAN, None)
    if before is not None:
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_CLEAN, before)


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, texts go to Python workers by about BATCH bytes, so that neither they nor the JVM hold 10,000 at once."""
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)


def materialize(df: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder, in folders by partition if given, and read it back.

    Unlike a cache it survives lost executors, and unlike recomputation it makes
    later reads cheap. The table has a fresh name, so retries never meet.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyfold-{uuid.uuid4().hex}"
    with shuffle_files_dropped(spark):
        (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame, part: str = "") -> None:
    """Delete a table made by materialize, or a folder of it, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{df.scratch_path}/{part}" if part else df.scratch_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
