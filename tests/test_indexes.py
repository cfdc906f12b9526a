"""Stored text and vector indexes against the operators that compare everything."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import block_index as I
from tallyfold.operators import retrieval as R
from tallyfold.operators import vector_index as V


def rows(df):
    return sorted(map(tuple, df.collect()))


def texts(spark, n=600):
    random.seed(8)
    words, weights = [f"w{k}" for k in range(300)], [1 / (k + 1) for k in range(300)]
    out = [(i, " ".join(random.choices(words, weights, k=random.choice([3, 8, 30, 90])))) for i in range(n)]
    out += [(n, "needle haystack needle"), (n + 1, "haystack w0"), (n + 2, ""), (n + 3, None), (n + 4, "needle haystack needle")]
    q = [(1, "needle in the haystack"), (2, "w250 w251 w3"), (3, "w0 w1 w2"), (4, "nothing matches zebra"), (5, ""), (6, "w7")]
    return spark.createDataFrame(out, "id int, text string"), spark.createDataFrame(q, "question_id int, question string")


@pytest.mark.parametrize("first, second", [(8, 64), (1, 2)])
def test_index_in_parts_answers_like_the_texts(spark, tmp_path, first, second):
    chunks, q = texts(spark)
    path = str(tmp_path / "index")
    assert I.index_size(spark, path) is None
    I.store_index(chunks.where("id % 3 = 0"), "id", path, parts=4, docs=5)
    I.append_index(chunks.where("id % 3 = 1"), path, docs=5)
    I.append_index(chunks.where("id % 3 = 2"), path, docs=5)
    assert I.index_size(spark, path) == chunks.count()
    got, seen = I.search_counted(q, path, 4, first, second)
    assert rows(got) == rows(R.bm25(q, chunks, "id", 4))
    assert seen["read"] < seen["blocks"]
    assert rows(I.search_index(q.limit(0), path)) == []


def test_index_is_replaced(spark, tmp_path):
    path = str(tmp_path / "index")
    for text in ("old words", "new words"):
        I.store_index(spark.createDataFrame([("a", text)], "id string, text string"), "id", path, parts=2)
    q = spark.createDataFrame([(1, "old"), (2, "new")], "question_id int, question string")
    assert [(r.question_id, r.id) for r in I.search_index(q, path).collect()] == [(2, "a")]


def clusters(spark, n=900, dim=8):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim)) * 0.05 + rng.normal(size=(12, dim))[rng.integers(0, 12, n)]
    data = [(i, [float(v) for v in r], f"c{i % 3}") for i, r in enumerate(x)] + [(n, [0.0] * dim, "c0"), (n + 1, None, "c0"), (n + 2, [float(v) for v in x[0]], "c0")]
    ask = [(i, [float(v) for v in x[i * 50 % n] + 0.01]) for i in range(10)] + [(99, [0.0] * dim)]
    return spark.createDataFrame(data, "id int, embedding array<double>, company string"), spark.createDataFrame(ask, "question_id int, embedding array<double>")


@pytest.mark.parametrize("first, second", [(8, 64), (1, 3)])
def test_vector_index_finds_what_comparing_all_finds(spark, tmp_path, first, second):
    vectors, q = clusters(spark)
    path = str(tmp_path / "vectors")
    assert V.collection_size(spark, path) is None
    V.store_vectors(vectors, "id", path)
    assert V.collection_size(spark, path) == 903
    real = q.where("question_id <> 99")
    got, seen = V.search_counted(real, path, 6, first=first, second=second)
    assert rows(got) == rows(R.cosine(real, vectors.where("embedding is not null"), "id", 6))
    assert seen["read"] < seen["blocks"] / 2
    only = V.search_vectors(real, path, 6, F.col("company") == "c1")
    assert rows(only) == rows(R.cosine(real, vectors.where("company = 'c1'"), "id", 6))
    assert V.search_vectors(q.where("question_id = 99"), path, 3).count() == 3


def test_empty_collections(spark, tmp_path):
    vectors, q = clusters(spark, 30)
    path = str(tmp_path / "vectors")
    V.store_vectors(vectors.limit(0), "id", path)
    assert V.collection_size(spark, path) == 0
    V.store_vectors(vectors.where("id = 31"), "id", path)
    assert V.collection_size(spark, path) == 1


def test_many_queries_meet_blocks(spark, monkeypatch):
    vectors, q = clusters(spark, 200)
    want = rows(R.cosine(q, vectors, "id", 5))
    monkeypatch.setattr(R, "FEW", 3)
    monkeypatch.setattr(R, "BLOCK", 50)
    assert rows(R.cosine(q, vectors, "id", 5)) == want


def test_ranks_are_limited_before_the_shuffle(spark):
    scores = spark.createDataFrame([(1, 2, 0.5)], "question_id int, id int, score double").repartition(3)
    hits = scores.withColumn("rank", F.lit(1))
    for df in (R.top(scores, "id", 5), R.fuse([hits, hits], "id", 5)):
        assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("asked, dealt, pairs", [(1 << 18, 1 << 12, 1 << 19), (1 << 18, 50, 20), (0, 50, 20)])
def test_pairs_are_added_up_where_they_arise(spark, monkeypatch, asked, dealt, pairs):
    chunks, q = texts(spark, 200)
    want = [rows(f(q, chunks, "id", 4)) for f in (R.bm25, R.word_overlap)]
    monkeypatch.setattr(R, "ASKED", asked)
    monkeypatch.setattr(R, "DEALT", dealt)
    monkeypatch.setattr(R, "PAIRS", pairs)
    for f, same in zip((R.bm25, R.word_overlap), want, strict=True):
        got = f(q, chunks, "id", 4)
        dealt_by_pair = re.search(r"hashpartitioning\(question_id#\d+, id#", got._jdf.queryExecution().executedPlan().toString())
        assert bool(dealt_by_pair) == (asked == 0)
        assert rows(got) == same


@pytest.mark.parametrize("asked", [1 << 18, 20, 0])
def test_index_adds_up_pairs_where_their_block_lies(spark, tmp_path, monkeypatch, asked):
    chunks, q = texts(spark, 200)
    more = [(7, "w250 w7 w7"), (7, "w1 " * 40), (201, "needle " * 70), (7, "w7 haystack")]  # texts of one key are one chunk
    chunks = chunks.unionByName(spark.createDataFrame(more, chunks.schema))
    q = q.unionByName(spark.createDataFrame([(6, "w7 w8"), (None, "w1")], q.schema))
    want = rows(R.bm25(q.where("question_id is not null"), chunks, "id", 4))
    path, plans, searched = str(tmp_path / "index"), [], I.searched

    def spied(bounds, score, *rest):
        every = bounds.select("question_id", "block")
        plans.append(R.top(score(every), "id", 4)._jdf.queryExecution().executedPlan().toString())
        return searched(bounds, score, *rest)

    monkeypatch.setattr(I, "searched", spied)
    monkeypatch.setattr(R, "ASKED", asked)
    I.store_index(chunks.where("id % 3 > 0"), "id", path, parts=4, docs=5)
    I.append_index(chunks.where("id % 3 = 0"), path, docs=5)
    assert rows(I.search_index(q, path, 4)) == want
    by_pair = re.search(r"hashpartitioning\(question_id#\d+, block#\d+L?, (key|id|_groupingexpression)#", plans[0])
    assert bool(by_pair) == (asked != 20)  # few pairs are dealt by pair, more by block
