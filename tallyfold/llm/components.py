"""Connected components by alternating large-star and small-star steps.

Every step is one grouped minimum and one join, in which nodes with very many
neighbours are broadcast, so that no component, however large, is ever gathered in a
task or on the driver. The steps end once the edges are stars apart from each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_keys import join_groups
from .scratch import drop, materialize


def _large(e: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest one; n: the number of edges."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")).select("u", "n", F.least("u", "m").alias("m"))
    return join_groups(both.where("v > u"), least, "u", "n", 2 * n).select(F.col("v").alias("b"), F.col("m").alias("a"))


def _small(e: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    tied = join_groups(down, least, "u", "n", n).where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return tied.union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))


def _shape(e: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars apart: ends of several edges, or of one and a centre."""
    ends = e.select(F.col("b").alias("u"), F.lit(1).alias("end")).union(e.select("a", F.lit(0)))
    each = ends.groupBy("u").agg(F.sum("end").alias("ends"), F.min("end").alias("least"))
    seen = each.agg(F.sum("ends"), F.count_if((F.col("ends") > 1) | (F.col("ends") > F.col("least")))).first()
    return seen[0] or 0, seen[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component: its smallest node.

    Loops, repeated and reversed edges do no harm; an empty table gives no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = materialize(e)
    n, odd = now.count(), 1
    while n and odd:
        stars = _small(_large(now, n), n).select("a", "b").distinct()
        new = materialize(stars)
        n, odd = _shape(new)
        drop(now)
        now = new
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(now.select("a", "a").distinct())


def mains(p: DataFrame, key: str) -> DataFrame:
    """key, main, n, out: the component that most rows of a key have, the number of rows, and how many have another; keys of several components."""
    each = p.groupBy(key, "comp").agg(F.count("*").alias("n"))
    most = each.groupBy(key).agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("comps"))
    return most.where("comps > 1").select(key, F.col("m.comp").alias("main"), "n", (F.col("n") - F.col("m.n")).alias("out"))
