"""Vectors in blocks of bounded size, for searches of a query set against all rows."""

from __future__ import annotations

import io
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

QUERY_BLOCK = 1024


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, embedding) with finite components; zero: whether zero vectors take part.

    A vec_id names one vector: of repeated ids the least vector stays. Null ids go.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    if not zero:
        v = v.where("exists(embedding, x -> x <> 0)")
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def matrix(rows: list, width: int | None = None) -> np.ndarray:
    """Shorter vectors are continued with zeros."""
    lens = [len(r) for r in rows]
    width = width or max([1, *lens])
    if lens and min(lens) == max(lens) == width:
        return np.array(list(rows), dtype=np.float64)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def packed(vectors: DataFrame, size: int, make: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """(block, keys, blob): rows dealt by a hash of vec_id into blocks of about size rows, with their ids."""
    n = vectors.count()
    blocks = max(1, math.ceil(n / size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "keys": [pdf.vec_id.to_numpy(np.int64)], "blob": [make(pdf.vec_id.to_numpy(np.int64), matrix(list(pdf.embedding)))]})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, "block int, keys array<long>, blob binary")


#: The first wave has one of so many blocks; no more are needed to bound the kth scores well.
FIRST = 16


def search(index: DataFrame, asked: DataFrame, k: int, find: Callable[[dict, dict], tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best that find gives over all blocks of index for all blocks of asked.

    Every block of queries meets every block of the index; what meets is two rows. After
    a first wave of blocks, each query's kth score so far goes with it (as kth).
    """
    spark = index.sparkSession
    ask = asked.select(F.col("block").alias("group"), F.col("blob").alias("ask"))
    n = index.agg(F.max("block")).first()[0]
    last = -1 if n is None else n
    parts = spark.sparkContext.defaultParallelism
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = f"query_id long, vec_id long, score {kind}"

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                group = load(row.ask)
                if row.ids is not None:
                    at = dict(zip(row.ids, row.scores, strict=True))
                    group["kth"] = np.array([at.get(i, -np.inf) for i in group["ids"].tolist()], np.float64)
                q, i, s = find(group, load(row.blob))
                yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    def wave(blocks: str, known: DataFrame | None) -> DataFrame:
        if known is None:
            to = ask.withColumn("ids", F.lit(None).cast("array<long>")).withColumn("scores", F.lit(None).cast("array<double>"))
        else:
            to = ask.join(known, "group", "left")
        pairs = to.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(max(last, 0))), lambda b: b % FIRST == 0 if blocks == "first" else b % FIRST != 0)))
        met = pairs.repartition(max(parts, 1), "block").join(index, "block")
        found = met.select("ask", "ids", "scores", "blob").mapInPandas(run, result)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = wave("first", None)
    if last < 1:
        return first
    first = materialize(first)
    ids = asked.select(F.col("block").alias("group"), "keys").withColumn("query_id", F.explode("keys")).select("group", "query_id")
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth")).join(ids, "query_id")
    known = kth.groupBy("group").agg(F.collect_list("query_id").alias("ids"), F.collect_list("kth").alias("scores"))  # QUERY_BLOCK of each at most
    both = first.drop("rank").unionByName(wave("rest", known).drop("rank"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


__all__ = ["best", "dump", "load", "materialize", "matrix", "packed", "search", "usable"]
