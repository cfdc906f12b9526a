"""Attributions against the sum over all sets of features, and the ranker on held-out questions."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tallyfold.operators import attributions as S
from tallyfold.operators import routing as G
from tallyfold.plans import answers

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    data = [(i, *map(float, r), float(r[0] + r[1] * r[2] > 0.2)) for i, r in enumerate(x)]
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(spark.createDataFrame(data, "id long, a double, b double, c double, d double, label double"))


def told(nodes, value, x, known, at=0):
    """What a tree says of x if only the features of known are known."""
    n = nodes[at]
    if n.leftChild < 0:
        return value(n)
    left, right = nodes[n.leftChild].rawCount, nodes[n.rightChild].rawCount
    if n.split.featureIndex in known:
        return told(nodes, value, x, known, n.leftChild if x[n.split.featureIndex] <= n.split.leftCategoriesOrThreshold[0] else n.rightChild)
    return (left * told(nodes, value, x, known, n.leftChild) + right * told(nodes, value, x, known, n.rightChild)) / (left + right)


@pytest.mark.parametrize("learner", [lambda: RandomForestClassifier(numTrees=3, maxDepth=3, seed=1), lambda: RandomForestRegressor(numTrees=2, maxDepth=3, seed=2), lambda: GBTClassifier(maxIter=3, maxDepth=3, seed=3)])
def test_attributions_equal_the_sum_over_all_sets(spark, rows, tmp_path, learner):
    learner = learner()
    model = learner.fit(rows)
    model.write().save(str(tmp_path / "m"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "m" / "data")).collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    forest = isinstance(learner, RandomForestClassifier)
    weights = {t: 1 / len(trees) for t in trees} if not isinstance(learner, GBTClassifier) else dict(enumerate(model.treeWeights))
    value = (lambda n: n.impurityStats[1] / sum(n.impurityStats)) if forest else (lambda n: n.prediction)
    some = rows.where("id < 12")
    got = {r.id: r for r in S.attributions(model, some, "id", NAMES).collect()}
    for r in some.collect():
        x = r.features.toArray()
        says = lambda known: sum(weights[t] * told(nodes, value, x, known) for t, nodes in trees.items())
        for i, name in enumerate(NAMES):
            rest = [j for j in range(4) if j != i]
            want = sum(factorial(k) * factorial(3 - k) / factorial(4) * (says({*s, i}) - says(set(s))) for k in range(4) for s in combinations(rest, k))
            assert got[r.id][name] == pytest.approx(want, abs=1e-12)
        assert got[r.id].base == pytest.approx(says(set())) and got[r.id].base + sum(got[r.id][n] for n in NAMES) == pytest.approx(says({0, 1, 2, 3}))
    if forest:
        p = {r.id: r.p for r in model.transform(some).select("id", vector_to_array("probability")[1].alias("p")).collect()}
        assert all(got[i].base + sum(got[i][n] for n in NAMES) == pytest.approx(p[i]) for i in p)


def test_mean_attributions(rows):
    got = G.feature_importance(rows.drop("features"), "id", NAMES, top=3).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3] and got[0].feature == "a" and "d" not in {r.feature for r in got}


def test_ranker_orders_held_out_questions_better_than_confidence(spark, tmp_path):
    random.seed(5)
    data = []
    for q in range(300):
        for pod in range(3):
            conf, overlap = random.random(), random.random()
            data.append((q, pod, conf, overlap, 3 * overlap + 0.5 * conf + random.gauss(0, 0.2)))
    data += [(900, 0, 0.5, None, 1.0)]
    d = spark.createDataFrame(data, "q int, pod int, f_confidence double, f_overlap double, grade double")
    fs, path = ["f_confidence", "f_overlap"], str(tmp_path / "ranker")
    G.save_ranker(G.train_ranker(d.where("q < 200"), "q", "grade", fs, rounds=10), path)
    got = G.ranked(G.load_ranker(path), d.where("q >= 200"), "q", "pod", fs)
    best = {r.q: r.pod for r in d.where("q >= 200").groupBy("q").agg(F.max_by("pod", "grade").alias("pod")).collect()}
    ours = {r.q: r.pod for r in got.where("rank = 1").collect()}
    sure = {r.q: r.pod for r in d.where("q >= 200").groupBy("q").agg(F.max_by("pod", "f_confidence").alias("pod")).collect()}
    right = lambda x: sum(x[q] == best[q] for q in best)
    assert right(ours) > right(sure) + 20 and right(ours) > 75 and ours[900] == 0


def test_training_holds_equal_pairs_once_and_bounded_parts(spark, monkeypatch):
    seen, dealt = [], G._dealt

    def spied(rows, by):
        out = dealt(rows, by)
        seen.append((rows.count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(G, "_dealt", spied)
    monkeypatch.setattr(G, "DEALT", 100)
    d = spark.range(1200).selectExpr("id div 3 as q", "id % 3 as pod", "(id % 3) / 2.0D as f", "id % 3 as grade")
    got = G.ranked(G.train_ranker(d, "q", "grade", ["f"], rounds=2), d, "q", "pod", ["f"])
    assert seen == [(2, 1)]  # every pair differs by 0.5: one row for the won ones, one for the lost
    assert got.where("rank = 1").select("pod").distinct().collect() == [(2,)]
    forest = d.selectExpr("q * 3 + pod as id", "cast(f as double) as f", "cast(pod = 2 as double) as label")
    assert G.feature_importance(forest, "id", ["f"]).count() == 1
    assert seen[1] == (1200, 12)


def test_ranker_learns_from_every_pair_of_different_grades(spark, monkeypatch):
    seen, dealt = [], G._dealt

    def spied(rows, by):
        seen.append(sorted(tuple(r) for r in rows.select("f", "__n", "label").collect()))
        return dealt(rows, by)

    monkeypatch.setattr(G, "_dealt", spied)
    # per question: 2 above 1 (twice) above 0, so two pairs 2-1, one 2-0, two 1-0
    d = spark.createDataFrame([(q, f, g) for q in range(3) for f, g in ((4.0, 2), (3.0, 1), (3.0, 1), (None, 0))], "q int, f double, grade int")
    G.train_ranker(d, "q", "grade", ["f"], rounds=1, every=True)
    won = [(1.0, 6.0), (3.0, 6.0), (4.0, 3.0)]
    assert seen == [sorted([(f, n, 1.0) for f, n in won] + [(-f, n, 0.0) for f, n in won])]


def test_answer_ranker_trains_on_every_pair(spark, sf, monkeypatch):
    weights, dealt = [], G._dealt

    def spied(rows, by):
        weights.append(rows.agg(F.sum("__n")).first()[0])
        return dealt(rows, by)

    monkeypatch.setattr(G, "_dealt", spied)
    answers.answer_ranker(spark, sf)
    rows = answers._graded_features(spark, sf).where("pmod(xxhash64(question_id), 5) > 0").select("question_id", "total")
    pairs = rows.join(rows.select("question_id", F.col("total").alias("low")), "question_id").where("total > low").count()
    assert weights == [2 * pairs]
