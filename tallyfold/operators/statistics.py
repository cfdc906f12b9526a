"""Forensic and quantitative statistics over values grouped by a key."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import garch as G
from .selection import percentiles
from .written import written

# Weights and full-scale marks of the risk score.
RISK = {"live": ((50.0, 40.0), (5.0, 35.0), (0.30, 25.0))}
SEVERITY = {"live": (70, 40), "alt": (60, 30)}


def chi_square_tail(x: Column) -> Column:
    """P(chi-square with 8 degrees of freedom > x), in closed form."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def benford(values: DataFrame, key: str, least: int = 10) -> DataFrame:
    """key, n, chi2, p_value, anomaly of first digits; keys with fewer digits than least go."""
    digits = values.select(key, T.first_digit(F.col("value")).alias("d")).where("d is not null")
    counts = digits.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(1, 10))).where(F.col("n") >= least)
    parts = [(F.col(f"d{k}") - F.col("n") * math.log10(1 + 1 / k)) ** 2 / (F.col("n") * math.log10(1 + 1 / k)) for k in range(1, 10)]
    out = counts.withColumn("chi2", sum(parts[1:], parts[0]))
    out = out.withColumn("p_value", chi_square_tail(F.col("chi2")))
    return out.select(key, "n", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"), (F.col("p_value") < 0.05).alias("anomaly"))


def benford_contingency(values: DataFrame, key: str, least: int = 10) -> DataFrame:
    """The 2 x 9 table of observed against expected digits (each at least 0.5), with a score by tier."""
    digits = values.select(key, T.first_digit(F.col("value")).alias("d")).where("d is not null")
    counts = digits.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(1, 10))).where(F.col("n") >= least)
    seen = [F.greatest(F.col(f"d{k}").cast("double"), F.lit(0.5)) for k in range(1, 10)]
    due = [F.greatest(F.col("n") * math.log10(1 + 1 / k), F.lit(0.5)) for k in range(1, 10)]
    s, d = sum(seen[1:], seen[0]), sum(due[1:], due[0])
    out = counts.withColumn("s", s).withColumn("d", d)
    total = F.col("s") + F.col("d")
    cell = lambda v, row, col: (v - row * col / total) ** 2 / (row * col / total)
    parts = [cell(a, F.col("s"), a + b) + cell(b, F.col("d"), a + b) for a, b in zip(seen, due, strict=True)]
    out = out.withColumn("chi2", sum(parts[1:], parts[0])).withColumn("p", chi_square_tail(F.col("chi2")))
    score = F.when(F.col("p") < 0.01, 80).when(F.col("p") < 0.05, 50).when(F.col("p") < 0.10, 20).otherwise(0)
    return out.select(key, "n", F.round("chi2", 6).alias("chi2"), F.round("p", 6).alias("p_value"), score.alias("score"))


def returns(series: DataFrame, key: str, order: str) -> DataFrame:
    """series with ret: the change from the previous value over its magnitude; null without one."""
    before = F.lag("value").over(Window.partitionBy(key).orderBy(order))
    return series.withColumn("ret", F.when(before != 0, (F.col("value") - before) / F.abs(before)))


def value_at_risk(rets: DataFrame, key: str) -> DataFrame:
    """key, n, var_95, var_99, mean_return: linear percentiles 5 and 1 of at least two returns."""
    r = written(rets.where("ret is not null").select(key, "ret"))
    mean = r.groupBy(F.col(key).alias("__k")).agg(F.avg("ret").alias("m"))
    out = percentiles(r, key, "ret", {"p5": 0.05, "p1": 0.01}).where("n >= 2").join(mean, F.col(key).eqNullSafe(F.col("__k")))
    return out.select(key, "n", F.round("p5", 6).alias("var_95"), F.round("p1", 6).alias("var_99"), F.round("m", 6).alias("mean_return"))


def volatility(rets: DataFrame, key: str) -> DataFrame:
    """key, volatility: the population deviation of returns, where no model is fitted."""
    return rets.where("ret is not null").groupBy(key).agg(F.round(F.stddev_pop("ret"), 6).alias("volatility"))


def garch(rets: DataFrame, key: str, order: str, schema: str) -> DataFrame:
    """key, cond_vol, omega, alpha, beta, n, converged: GARCH(1,1) by maximum likelihood, many series at a time.

    A key is one price series, which is one row of an array here, as the model runs along it;
    schema names its type. Fewer than ten returns give the population deviation and converged
    false.
    """
    rows = rets.where("ret is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ret").cast("double").alias("r")))).alias("rows"))

    def run(batches):
        for pdf in batches:
            fitted = pd.DataFrame(G.fit([np.asarray(r, float) for r in pdf["series"]]))
            yield pd.concat([pdf[[key]].reset_index(drop=True), fitted], axis=1)

    return rows.select(key, F.col("rows.r").alias("series")).mapInPandas(run, f"{key} {schema}, cond_vol double, omega double, alpha double, beta double, n int, converged boolean")


def monte_carlo(bases: DataFrame, key: str, n: int = 10_000, mean: float = 0.05, deviation: float = 0.15, seed: int = 42) -> DataFrame:
    """key, n, mean, std, p5, p95 of base * (1 + N(mean, deviation)), seeded by seed and the draw's number.

    Normal numbers come from pairs of hashed uniforms, so that results do not depend on
    partitioning.
    """
    draws = bases.select(key, "base", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.col("i"), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    z = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))
    sim = draws.withColumn("v", F.col("base") * (1 + F.lit(mean) + F.lit(deviation) * z))
    out = sim.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    return out.select(key, "n", F.col("m").alias("mean"), F.col("s").alias("std"), F.col("p")[0].alias("p5"), F.col("p")[1].alias("p95"))


def ratio_consistency(values: DataFrame, key: str) -> DataFrame:
    """key, n, round_share, extreme, score: more than half round numbers 30, values beyond ten times the median 15."""
    v = values.where("value > 0")
    share = v.groupBy(key).agg(F.avg((F.col("value") % 1000 == 0).cast("int")).alias("r"))
    mid = percentiles(v, key, "value", {"mid": 0.5}).join(share, key)
    odd = v.join(mid, key).groupBy(key).agg(F.first("n").alias("n"), F.first("r").alias("r"), F.count_if((F.col("value") > 10 * F.col("mid")) | (F.col("value") < 0.1 * F.col("mid"))).alias("extreme"))
    return odd.select(key, "n", F.round("r", 6).alias("round_share"), "extreme", (F.when(F.col("r") > 0.5, 30).otherwise(0) + F.when(F.col("extreme") > 0, 15).otherwise(0)).alias("score"))


def risk_score(chi2: Column, share: Column, vol: Column, variant: str = "live") -> Column:
    (a, x), (b, y), (c, z) = RISK[variant]
    one = F.lit(1.0)
    return F.least(F.least(chi2 / a, one) * x + F.least(share * b, one) * y + F.least(vol / c, one) * z, F.lit(100.0))


def severity(score: Column, variant: str = "live") -> Column:
    high, medium = SEVERITY[variant]
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def forensics(values: DataFrame, rets: DataFrame, key: str) -> DataFrame:
    """key, chi2, p_value, volatility, risk_score, severity, flags, anomaly: digits and volatility together."""
    met = benford(values, key).join(volatility(rets, key), key, "full_outer")
    chi = F.when(F.coalesce("anomaly", F.lit(False)), F.col("chi2")).otherwise(0.0)
    vol = F.coalesce("volatility", F.lit(0.0))
    score = F.round(risk_score(chi, F.lit(0.0), vol), 6)
    flags = F.array_compact(F.array(F.when(F.coalesce("anomaly", F.lit(False)), "BENFORD"), F.when(vol > 0.30, "VOLATILITY")))
    return met.select(key, F.coalesce("chi2", F.lit(0.0)).alias("chi2"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"), vol.alias("volatility"), score.alias("risk_score"), severity(score).alias("severity"), F.concat_ws(",", flags).alias("flags"), ((score > 0) | (F.size(flags) > 0)).alias("anomaly"))


def _grown(values: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over single values as a step function: cuts, and the score of what lies before, between and after them.

    Every tree is a partition of the line, so the forest's mean depth is constant between
    neighbouring cuts of all trees; scoring is one search among them.
    """
    c = lambda n: 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
    values, rng = np.sort(values), np.random.default_rng(seed)
    limit, cuts, steps, first = max(1, math.ceil(math.log2(max(len(values), 2)))), [], [], 0.0
    for _ in range(trees):
        todo, leaves = [(-math.inf, 0, len(values), 0)], []
        while todo:
            start, lo, hi, d = todo.pop()
            if d >= limit or hi - lo < 2 or values[lo] == values[hi - 1]:
                leaves.append((start, d + c(hi - lo)))
                continue
            at = rng.uniform(values[lo], values[hi - 1])
            mid = int(np.searchsorted(values, at))
            todo += [(start, lo, mid, d + 1), (at, mid, hi, d + 1)]
        leaves.sort()
        first += leaves[0][1]
        cuts += [s for s, _ in leaves[1:]]
        steps += [b[1] - a[1] for a, b in zip(leaves[:-1], leaves[1:], strict=True)]
    order = np.argsort(cuts, kind="stable")
    depth = first + np.concatenate([[0.0], np.cumsum(np.array(steps)[order])]) if cuts else np.array([first])
    return np.array(cuts)[order] if cuts else np.zeros(0), 2.0 ** (-(depth / trees) / max(c(len(values)), 1e-9))


def isolation_forest(values: DataFrame, key: str, schema: str, trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42, part: int = 1 << 20) -> DataFrame:
    """key, id, value, score, outlier: isolation depth of single values against per-key random trees.

    Trees are grown once a key, on a seeded sample of the least hashes of (seed, id), as the
    method says, and kept as a step function of at most trees * (sample - 1) cuts. Every value
    is scored, in groups of about part values of a key, each of which gets its key's function.
    """
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    known = values.where("value is not null").select(key, "id", F.col("value").cast("double").alias("value"))
    picked = known.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= sample).select(key, "value")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts, scores = _grown(pdf["value"].to_numpy(float), trees, seed)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "cuts": [cuts], "scores": [scores]})

    def score(pdf: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({key: [], "id": [], "value": [], "score": []})
        at = np.searchsorted(np.asarray(forest["cuts"].iloc[0], float), pdf["value"].to_numpy(float), side="right")
        return pd.DataFrame({key: pdf[key], "id": pdf["id"], "value": pdf["value"], "score": np.asarray(forest["scores"].iloc[0], float)[at]})

    parts = written(known.groupBy(key).agg(F.ceil(F.count("*") / part).cast("int").alias("parts")))
    forests = picked.groupBy(key).applyInPandas(grow, f"{key} {schema}, cuts array<double>, scores array<double>")
    forests = written(forests.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    dealt = known.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    got = written(dealt.groupBy(key, "part").cogroup(forests.groupBy(key, "part")).applyInPandas(score, f"{key} {schema}, id long, value double, score double"))
    mark = percentiles(got, key, "score", {"__mark": 1 - contamination})
    return got.join(mark, key).select(key, "id", "value", "score", (F.col("score") > F.col("__mark")).alias("outlier"))
