"""A stored vector index: cells around k-means centres, visited by bound and left exactly.

Vectors are compared by cosine, so they are scaled to length one. A cell knows its centre and
the largest distance of its vectors from it; by the triangle inequality none of them is nearer
to a query than the distance to the centre less that radius, and cells that cannot reach the
kth score are not read.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bounded import FIRST, SECOND, searched
from .retrieval import POOL
from .written import written

#: Most cells, and rows that centres are fitted on; every row is stored in its nearest cell.
CELLS, SAMPLE = 1024, 100_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _unit(v: Column) -> Column:
    """v at length one; null where it has none."""
    norm = F.sqrt(_dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def store_vectors(vectors: DataFrame, key: str, path: str, cells: int | None = None, seed: int = 1) -> None:
    """Write vectors (key, embedding, other columns) by cell below path; replaces what is there.

    Without cells their number is the root of the rows, at most CELLS. Vectors that are null
    or zero, which have no direction, get a cell of their own.
    """
    rows = written(vectors.withColumn("unit", _unit(F.col("embedding"))))
    n = rows.where("unit is not null").count()
    wanted = max(1, min(CELLS, cells or math.isqrt(n)))
    out = rows.withColumn("cell", F.lit(-1))
    if n:
        usable = rows.where("unit is not null").withColumn("features", array_to_vector("unit"))
        fitted = KMeans(k=wanted, seed=seed, maxIter=10, tol=1e-3).fit(usable.sample(min(1.0, SAMPLE / n), seed).select("features"))
        centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())], "cell int, centre array<double>")
        out = fitted.setPredictionCol("cell").transform(usable).drop("features").unionByName(out.where("unit is null"))
        far = F.sqrt(F.greatest(F.lit(0.0), _dot(F.col("unit"), F.col("unit")) - 2 * _dot(F.col("unit"), F.col("centre")) + _dot(F.col("centre"), F.col("centre"))))
        out = written(out)
        known = out.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.first("centre").alias("centre"), F.max(far).alias("radius"), F.count("*").alias("n"))
        rest = out.where("cell = -1").groupBy("cell").agg(F.lit(None).cast("array<double>").alias("centre"), F.lit(0.0).alias("radius"), F.count("*").alias("n"))
        table = known.unionByName(rest)
    else:
        table = out.groupBy("cell").agg(F.lit(None).cast("array<double>").alias("centre"), F.lit(0.0).alias("radius"), F.count("*").alias("n"))
    table.withColumn("key", F.lit(key)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    out.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def collection_size(spark: SparkSession, path: str) -> int | None:
    """The number of vectors stored below path; None if there is no collection."""
    try:
        return spark.read.parquet(f"{path}/cells").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def search_counted(queries: DataFrame, path: str, k: int = POOL, where: Column | None = None, first: int = FIRST, second: int = SECOND) -> tuple[DataFrame, dict[str, int]]:
    """search_vectors, and how many pairs of query and cell there are and how many were read."""
    spark = queries.sparkSession
    cells, vectors = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/vectors")
    key = (cells.first() or {"key": "key"})["key"]
    asked = written(queries.select("question_id", F.col("embedding").alias("asked"), _unit(F.col("embedding")).alias("direction")))
    apart = F.sqrt(F.greatest(F.lit(0.0), 1 - 2 * _dot(F.col("direction"), F.col("centre")) + _dot(F.col("centre"), F.col("centre"))))
    near = F.greatest(F.lit(0.0), apart - F.col("radius"))
    bound = F.greatest(F.lit(0.0), F.coalesce(1 - near * near / 2, F.lit(0.0)))
    bounds = asked.crossJoin(F.broadcast(cells)).select("question_id", F.col("cell").alias("block"), bound.alias("bound"))  # at most CELLS + 1 cells
    rows = vectors if where is None else vectors.where(where)

    def score(pairs: DataFrame) -> DataFrame:
        met = rows.withColumnRenamed("cell", "block").select(key, "block", F.col("embedding").alias("stored")).join(pairs.join(asked, "question_id"), "block")
        norm = lambda v: F.sqrt(_dot(v, v))
        own = F.try_divide(_dot(F.col("asked"), F.col("stored")), norm(F.col("asked")) * norm(F.col("stored")))
        return met.select("question_id", key, F.round(F.greatest(F.lit(0.0), own), 6).alias("score"))

    return searched(bounds, score, key, k, first, second)


def search_vectors(queries: DataFrame, path: str, k: int = POOL, where: Column | None = None) -> DataFrame:
    """cosine() over a stored collection, or over its rows that fit where; queries: question_id, embedding."""
    return search_counted(queries, path, k, where)[0]
