"""Order statistics, step-function forests and GARCH against numpy and simulated series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import garch as G
from tallyfold.operators import selection, statistics


def table(spark):
    rng = np.random.default_rng(2)
    parts = {
        "normal": rng.normal(size=3000),
        "heavy": np.exp(40 * rng.normal(size=2500)),
        "ties": np.where(rng.random(2000) < 0.97, 5.0, rng.normal(size=2000) + 6),
        "one": np.array([7.0]),
        "two": np.array([-1.0, 3.0]),
        "same": np.full(900, 2.5),
        None: rng.integers(0, 4, 700).astype(float),
    }
    rows = [(k, float(x), 1) for k, v in parts.items() for x in v] + [("normal", None, 1), ("empty", None, 1)]
    return spark.createDataFrame(rows, "k string, v double, n int"), {k: np.sort(v) for k, v in parts.items()}


@pytest.mark.parametrize("small", [20, 1 << 16])
def test_ranks(spark, small):
    d, parts = table(spark)
    n = F.col("n")
    got = selection.at_ranks(d, "k", "v", {"first": F.lit(0), "mid": F.floor(n / 2), "late": F.floor(n * 0.95) - 1, "last": n - 1, "beyond": n}, small)
    assert got.columns == ["k", "n", "first", "mid", "late", "last", "beyond"]
    rows = {r.k: r for r in got.collect()}
    assert set(rows) == set(parts)
    for k, v in parts.items():
        late = math.floor(len(v) * 0.95) - 1
        assert (rows[k].n, rows[k].first, rows[k].mid, rows[k].late, rows[k].last, rows[k].beyond) == (len(v), v[0], v[len(v) // 2], v[late] if late >= 0 else None, v[-1], None)


@pytest.mark.parametrize("small, broadcast", [(20, 1 << 12), (20, 0)])
def test_percentiles(spark, monkeypatch, small, broadcast):
    monkeypatch.setattr(selection, "BROADCAST", broadcast)
    d, parts = table(spark)
    rows = {r.k: r for r in selection.percentiles(d, "k", "v", {"a": 0.05, "b": 0.5, "c": 1.0}, small).collect()}
    for k, v in parts.items():
        assert [rows[k].a, rows[k].b, rows[k].c] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 1.0])))
    assert selection.percentiles(d.limit(0), "k", "v", {"a": 0.5}).count() == 0


def test_forest_does_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(x)) for k in ("a", "b") for i, x in enumerate(np.r_[rng.normal(size=500), [40.0, -30.0]])] + [("c", 1, 3.0), ("c", 2, None)]
    d = spark.createDataFrame(rows, "k string, id long, value double")
    first, again = ({(r.k, r.id): r.score for r in statistics.isolation_forest(x, "k", "string", part=p).collect()} for x, p in ((d, 1 << 20), (d.repartition(7), 90)))
    assert first == again and len(first) == 1005
    assert sorted(sorted((i for k, i in first if k == "a"), key=lambda i: -first["a", i])[:2]) == [500, 501]


def walked(values, trees, seed, x):
    """The score of x by walking each tree anew."""
    c = lambda n: 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
    rng, values, total = np.random.default_rng(seed), np.sort(values), 0.0
    limit = max(1, math.ceil(math.log2(max(len(values), 2))))
    for _ in range(trees):
        todo = [(True, values, 0)]
        while todo:
            mine, own, d = todo.pop()
            if d >= limit or len(own) < 2 or own[0] == own[-1]:
                total += mine * (d + c(len(own)))
                continue
            at = rng.uniform(own[0], own[-1])
            todo += [(mine and x < at, own[own < at], d + 1), (mine and x >= at, own[own >= at], d + 1)]
    return 2.0 ** (-(total / trees) / max(c(len(values)), 1e-9))


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0], [1.0, 2.0, 2.0, 9.0], list(np.random.default_rng(1).normal(size=60))])
def test_step_function_is_the_forest(values):
    cuts, scores = statistics._grown(np.array(values), 9, 3)
    for x in [*values, -100.0, 100.0, 1.5]:
        assert scores[np.searchsorted(cuts, x, side="right")] == pytest.approx(walked(np.array(values), 9, 3, x))


def simulated(omega, alpha, beta, n, seed):
    rng, h, out = np.random.default_rng(seed), omega / (1 - alpha - beta), []
    for z in rng.normal(size=n):
        out.append(math.sqrt(h) * z)
        h = omega + alpha * out[-1] ** 2 + beta * h
    return np.array(out)


def test_garch_recovers_simulated_series():
    """Standard errors of 6,000 returns are about 0.02 for alpha and beta here; three of them are allowed."""
    true = [(0.1, 0.10, 0.80), (0.02, 0.05, 0.90), (1e-5, 0.20, 0.60)]
    for got, (omega, alpha, beta) in zip(G.fit([simulated(*p, 6000 + 50 * k, k) for k, p in enumerate(true)]), true, strict=True):
        assert got["converged"] and abs(got["alpha"] - alpha) < 0.06 and abs(got["beta"] - beta) < 0.08
        assert got["omega"] / (1 - got["alpha"] - got["beta"]) == pytest.approx(omega / (1 - alpha - beta), rel=0.25)


def test_garch_gradient_and_likelihood():
    series = [simulated(0.1, 0.1, 0.8, n, n) for n in (12, 80, 300)] + [np.random.default_rng(0).standard_t(3, 200)]
    t = max(map(len, series))
    e2 = np.stack([np.r_[np.zeros(t - len(r)), (r - r.mean()) ** 2] for r in series])
    live = np.stack([np.arange(t) >= t - len(r) for r in series])
    var = e2.sum(axis=1) / live.sum(axis=1)
    z = np.random.default_rng(3).normal(size=(4, 3))
    slope = np.stack([(G.loss(z + d, e2, live, var)[0] - G.loss(z - d, e2, live, var)[0]) / 2e-6 for d in 1e-6 * np.eye(3)], 1)
    assert G.loss(z, e2, live, var)[1] == pytest.approx(slope, rel=1e-4, abs=1e-6)
    fitted = G.fit(series)
    alone = [G.fit([r])[0] for r in series]
    for k, (a, b, r) in enumerate(zip(fitted, alone, series, strict=True)):
        assert a == pytest.approx(b, rel=1e-6)
        p = a["alpha"] + a["beta"]
        long_run = a["omega"] / (1 - p) / var[k]
        own = np.array([[G._logit(p / G.LIMIT), G._logit(min(max(a["alpha"] / p, 1e-6), 1 - 1e-6)), math.log(long_run)]])
        best = G.loss(own, e2[k : k + 1], live[k : k + 1], var[k : k + 1])[0][0]
        for a0 in np.arange(0.02, 0.31, 0.04):
            for b0 in np.arange(0.50, 0.97, 0.04):
                if a0 + b0 < 0.999:
                    grid = np.array([[G._logit((a0 + b0) / G.LIMIT), G._logit(a0 / (a0 + b0)), 0.0]])
                    assert best <= G.loss(grid, e2[k : k + 1], live[k : k + 1], var[k : k + 1])[0][0] + 1e-9


def test_short_and_flat_series():
    got = G.fit([np.zeros(0), np.array([1.0, 2.0]), np.full(40, 3.0)])
    assert [g["converged"] for g in got] == [False] * 3 and [g["n"] for g in got] == [0, 2, 40] and got[1]["cond_vol"] == 0.5


def test_garch_over_rows(spark):
    rows = [("a", i, float(x)) for i, x in enumerate(simulated(0.1, 0.1, 0.8, 500, 1))] + [("b", 0, 1.0), ("b", 1, None)]
    d = spark.createDataFrame(rows, "k string, t int, ret double").repartition(5)
    got = {r.k: r for r in statistics.garch(d, "k", "t", "string").collect()}
    want = G.fit([np.array([r[2] for r in rows if r[0] == "a"])])[0]
    assert got["a"].alpha == pytest.approx(want["alpha"]) and got["a"].n == 500 and not got["b"].converged and got["b"].n == 1
