"""Exact order statistics of any number of values, without gathering them.

The values of a key are cut at pivots from a quantile sketch; the values of each range are
counted, and only the range that holds the wanted rank is looked at again, until it is a
single value or small enough to be sorted in a task. A range between pivots has about 1/CUTS
of the values, and values equal to a pivot are a range of their own, so that every round
shrinks what is left. Each round is one count with partial counts in the tasks; between
rounds a few rows per key and rank are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import written

#: Ranges of a round, values that one task may sort, and brackets that are broadcast at most.
CUTS, SMALL, BROADCAST = 32, 1 << 16, 1 << 12


def _met(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """values within the brackets (k, lo, hi, ...) of their key; null is a key like others."""
    b = brackets.withColumnRenamed("k", "own")
    if brackets.count() <= BROADCAST:
        b = F.broadcast(b)
    return values.join(b, F.col("k").eqNullSafe(F.col("own")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("own")


def at_ranks(values: DataFrame, key: str, value: str, ranks: dict[str, Column], small: int = SMALL) -> DataFrame:
    """key, n and, for each name of ranks, the value at that place of the key's sorted values.

    A rank counts from 0 and is an expression over n, the number of the key's values that are
    not null; a place outside them gives null. Keys without values give no row.
    """
    v = written(values.select(F.col(f"`{key}`").alias("k"), F.col(f"`{value}`").cast("double").alias("v")).where("v is not null"))
    whole = written(v.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    wants = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()))).alias("w")
    state = whole.select("k", "lo", "hi", "n", wants).select("k", "lo", "hi", "n", "w.*").where("rank between 0 and n - 1")
    while True:
        state = written(state)
        large = state.where(f"n > {small} and lo < hi")
        spans = large.select("k", "lo", "hi").distinct()
        if spans.isEmpty():
            break
        grid = F.array(*(F.lit(i / CUTS) for i in range(1, CUTS)))
        pivots = written(_met(v, spans).groupBy("k", "lo", "hi").agg(F.array_distinct(F.percentile_approx("v", grid, F.lit(10 * CUTS))).alias("pivots")))
        place = 2 * F.size(F.filter("pivots", lambda p: p < F.col("v"))) + F.array_contains("pivots", F.col("v")).cast("int")
        cut = _met(v, pivots).groupBy("k", "lo", "hi", place.alias("place")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("c").over(Window.partitionBy("k", "lo", "hi").orderBy("place")) - F.col("c")
        cut = cut.withColumn("before", before).select(F.col("k").alias("own"), F.col("lo").alias("from"), F.col("hi").alias("to"), "c", "least", "most", "before")
        hit = F.col("k").eqNullSafe(F.col("own")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
        new = large.join(cut, hit).select("k", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("c").alias("n"), "name", (F.col("rank") - F.col("before")).alias("rank"))
        state = state.where(f"not (n > {small} and lo < hi)").unionByName(new)
    few = state.where("lo < hi")
    placed = F.row_number().over(Window.partitionBy("k", "lo", "hi").orderBy("v")) - 1
    sorted_ = _met(v, few.select("k", "lo", "hi").distinct()).withColumn("at", placed).select(F.col("k").alias("own"), F.col("lo").alias("from"), F.col("hi").alias("to"), "at", "v")
    hit = F.col("k").eqNullSafe(F.col("own")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to")) & (F.col("rank") == F.col("at"))
    found = few.join(sorted_, hit).select("k", "name", "v").unionByName(state.where("lo = hi").select("k", "name", F.col("lo").alias("v")))
    wide = found.groupBy("k").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    out = whole.select(F.col("k").alias("own"), "n").join(wide, F.col("own").eqNullSafe(F.col("k")), "left")
    return out.select(F.col("own").alias(key), "n", *ranks)


def percentiles(values: DataFrame, key: str, value: str, parts: dict[str, float], small: int = SMALL) -> DataFrame:
    """key, n and, for each name of parts, the linear percentile between the two values next to its place."""
    n = F.col("n")
    ranks = {}
    for name, p in parts.items():
        ranks |= {f"{name}_low": F.floor(p * (n - 1)), f"{name}_high": F.ceil(p * (n - 1))}
    got = at_ranks(values, key, value, ranks, small)
    between = lambda name, p: F.col(f"{name}_low") + (p * (n - 1) - F.floor(p * (n - 1))) * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    return got.select(key, "n", *(between(name, p).alias(name) for name, p in parts.items()))
