"""Stored tables with one row a key: upserts and deletes that are whole or not there.

Rows lie in buckets by a hash of their key. A change writes the buckets it touches into a
folder of a new version; a manifest that names each bucket's version is written last, beside
the old ones, by a rename. Readers follow the newest manifest, so a job that is killed before
the rename leaves the table as it was, and what it wrote is overwritten by the next change. A
manifest remembers the batch it came from, so that a stream's repeated batch changes nothing.
One writer at a time, as a stream's sink is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .answers import public


def _files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return sc, p, p.getFileSystem(sc._jsc.hadoopConfiguration())


class KeyedTable:
    """The table of rows below path, by key; the latest by (at, tie) of a key's rows stays."""

    def __init__(self, spark: SparkSession, path: str, key: str, at: str, tie: str, buckets: int = 32):
        self.spark, self.path, self.key, self.at, self.tie, self.buckets = spark, path.rstrip("/"), key, at, tie, buckets

    def manifest(self) -> dict | None:
        """The newest whole version: version, batch, schema, buckets (number of versions by bucket); None before the first."""
        _, folder, fs = _files(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return None
        names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
        whole = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_")]
        if not whole:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{max(whole):012d}.json", wholetext=True).first()[0])

    def exists(self) -> bool:
        return self.manifest() is not None

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no table below {self.path}")
        return self._buckets(m, m["buckets"])

    def _buckets(self, m: dict, which) -> DataFrame:
        paths = [f"{self.path}/versions/{m['buckets'][b]}/bucket={b}" for b in which]
        kept = [p for p in paths if self._there(p)]
        if not kept:
            return self.spark.createDataFrame([], m["schema"])
        return self.spark.read.schema(m["schema"]).parquet(*kept)

    def _there(self, path: str) -> bool:
        _, p, fs = _files(self.spark, path)
        return fs.exists(p)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> None:
        """Put rows in place of older ones of their keys; columns that begin as private ones are left out."""
        self._change(public(rows), batch, lambda old, new: self._latest(old.unionByName(new)))

    def delete(self, keys: DataFrame, batch: int | None = None) -> None:
        """Take the rows of keys out."""
        self._change(keys.select(self.key).distinct(), batch, lambda old, gone: old.join(gone, self.key, "left_anti"))

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upserts every batch once."""
        return lambda rows, batch: self.upsert(rows, batch)

    def _latest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(self.key).orderBy(F.desc(self.at), F.desc(self.tie))
        return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

    def _change(self, rows: DataFrame, batch: int | None, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        m = self.manifest()
        if m and batch is not None and m["batch"] is not None and batch <= m["batch"]:
            return
        if m is None:
            m = {"version": 0, "batch": None, "schema": rows.schema.simpleString().removeprefix("struct<").removesuffix(">"), "count": self.buckets, "buckets": {}}
            m["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(m["count"])).cast("int")
        new = rows.withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most as many as there are buckets
            if not touched:
                return
            old = self._buckets(m, [str(b) for b in touched if str(b) in m["buckets"]])
            version = m["version"] + 1
            out = merged(old, new.drop("bucket")).withColumn("bucket", bucket)
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/versions/{version}")
        finally:
            new.unpersist()
        m |= {"version": version, "batch": m["batch"] if batch is None else batch, "buckets": m["buckets"] | {str(b): version for b in touched}}
        self._swap(m)

    def _swap(self, m: dict) -> None:
        sc, target, fs = _files(self.spark, f"{self.path}/manifests/{m['version']:012d}.json")
        draft = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/_{m['version']:012d}.draft")
        with_stream = fs.create(draft, True)
        with_stream.write(bytearray(json.dumps(m).encode()))
        with_stream.close()
        if not fs.rename(draft, target):
            raise RuntimeError(f"version {m['version']} of {self.path} is there already: another writer was faster")

    def vacuum(self) -> int:
        """Delete the files of buckets that the newest version does not name, and older manifests; how many folders went."""
        m = self.manifest()
        if m is None:
            return 0
        live, gone = {f"{v}/bucket={b}" for b, v in m["buckets"].items()}, 0
        _, root, fs = _files(self.spark, f"{self.path}/versions")
        for version in fs.listStatus(root):
            name = str(version.getPath().getName())
            for bucket in fs.listStatus(version.getPath()):
                own = str(bucket.getPath().getName())
                if own.startswith("bucket=") and f"{name}/{own}" not in live:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        _, root, fs = _files(self.spark, f"{self.path}/manifests")
        for f in fs.listStatus(root):
            if str(f.getPath().getName()) != f"{m['version']:012d}.json":
                fs.delete(f.getPath(), True)
        return gone
