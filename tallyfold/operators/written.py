"""Intermediate tables in the cluster's shared folder, for what several steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and Spark runs in this process alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back, so that later steps neither compute it anew nor depend on an executor."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, seen: Observation) -> tuple[DataFrame, dict]:
    """written(df), and what seen observed below it on the way."""
    out = written(df)
    return out, seen.get
