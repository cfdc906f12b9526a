"""Shapley attributions of forests, exactly, from their stored nodes.

What a tree says when only some features are known is the mean over its branches, weighted by
the training rows that took them. For each leaf that is a product with one factor per feature
on its path: whether the row fits the path's conditions on it, if it is known, else the share
of training rows that do. So a leaf's part of each feature's Shapley value follows from the
coefficients of a polynomial of the other features' factors, worked out in numpy for all rows
of a batch at once; nothing is enumerated and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .written import scratch_path


class Leaf:
    """A leaf's value and, by feature, its range of the path's conditions and the share of training rows within it."""

    def __init__(self, value: float, conditions: dict[int, tuple[float, float, float]]) -> None:
        self.value = value
        self.features = list(conditions)
        self.low, self.high, self.share = (np.array(x) for x in zip(*conditions.values(), strict=True)) if conditions else (np.zeros(0),) * 3


def leaves(nodes: dict[int, Row], value) -> list[Leaf]:
    """The leaves of a tree of stored nodes (continuous splits), their values by value(node)."""
    out, todo = [], [(0, {})]
    while todo:
        at, known = todo.pop()
        n = nodes[at]
        if n.leftChild < 0:
            out.append(Leaf(value(n), known))
            continue
        if n.split.numCategories >= 0:
            raise ValueError("splits on categories are not supported")
        f, cut = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
        low, high, share = known.get(f, (-np.inf, np.inf, 1.0))
        whole = nodes[n.leftChild].rawCount + nodes[n.rightChild].rawCount
        todo.append((n.leftChild, known | {f: (low, min(high, cut), share * nodes[n.leftChild].rawCount / whole)}))
        todo.append((n.rightChild, known | {f: (max(low, cut), high, share * nodes[n.rightChild].rawCount / whole)}))
    return out


def forest(model, label: int = 1) -> list[tuple[float, list[Leaf]]]:
    """(weight, leaves) of the trees of a stored forest: shares of class label, values, or a boosted sum's steps."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark)
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()  # as large as the forest, whatever the rows
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    kind = type(model).__name__
    shares = kind == "RandomForestClassificationModel"
    value = (lambda n: n.impurityStats[label] / sum(n.impurityStats)) if shares else (lambda n: n.prediction)
    trees: dict[int, dict[int, Row]] = {}
    for r in rows:
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    part = 1 / len(trees) if kind.startswith("RandomForest") else None
    return [(part or weights[t], leaves(nodes, value)) for t, nodes in sorted(trees.items())]


def shapley(trees: list[tuple[float, list[Leaf]]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(attributions of each row and feature, the base that they add up from)."""
    out, base = np.zeros(x.shape), 0.0
    for weight, tree in trees:
        for leaf in tree:
            m = len(leaf.features)
            base += weight * leaf.value * np.prod(leaf.share)
            if not m:
                continue
            own = x[:, leaf.features]
            fits = ((own > leaf.low) & (own <= leaf.high)).astype(float)
            size = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            for i in range(m):
                poly = np.zeros((len(x), m))
                poly[:, 0] = 1.0
                for j in range(m):
                    if j != i:
                        poly[:, 1:] = poly[:, 1:] * leaf.share[j] + poly[:, :-1] * fits[:, j : j + 1]
                        poly[:, 0] *= leaf.share[j]
                out[:, leaf.features[i]] += weight * leaf.value * (fits[:, i] - leaf.share[i]) * (poly @ size)
    return out, base


def attributions(model, rows: DataFrame, key: str, names: list[str], label: int = 1) -> DataFrame:
    """key, base and an attribution for each of names, the places of rows' vector "features"; they add up to the forest's value."""
    trees = forest(model, label)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, base = shapley(trees, np.stack(pdf["__x"].to_numpy()) if len(pdf) else np.zeros((0, len(names))))
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame({"base": np.full(len(pdf), base)}), pd.DataFrame(values, columns=names)], axis=1)

    return rows.select(key, vector_to_array("features").alias("__x")).mapInPandas(run, f"{key} {kind}, base double, " + ", ".join(f"`{n}` double" for n in names))


def mean_attributions(model, rows: DataFrame, key: str, names: list[str], top: int = 10, label: int = 1) -> DataFrame:
    """feature, importance (mean size of its attributions), rank of the top features; ties by name."""
    means = attributions(model, rows, key, names, label).agg(*(F.avg(F.abs(f"`{n}`")).alias(n) for n in names))
    listed = means.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.round(F.coalesce(f"`{n}`", F.lit(0.0)), 9).alias("importance")) for n in names))).alias("f")).select("f.*")
    place = F.struct((-F.col("importance")).alias("i"), "feature")
    ranked = listed.agg(F.array_sort(F.collect_list(place)).alias("all")).select(F.posexplode("all").alias("p", "f"))  # a row for each feature
    return ranked.select("f.feature", (-F.col("f.i")).alias("importance"), (F.col("p") + 1).cast("int").alias("rank")).where(F.col("rank") <= top)
