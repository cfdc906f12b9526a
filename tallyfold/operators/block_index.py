"""A stored inverted index whose postings lie in blocks with bounds, to which parts can be added.

A block holds about DOCS chunks of like length. For every term and block the index has the
number of postings, the highest count and the least length, from which the highest weight
follows whatever the corpus grows to; so a search adds up the bounds of a question's terms
per block and reads the postings of those blocks only that can still hold one of the k best.

Texts are dealt by block, so that their words are counted, and in a search the weights of a
question and chunk added up, where a block lies; only the best of each partition are shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import retrieval as R
from .bounded import FIRST, SECOND, searched
from .retrieval import POOL, B, K1, asked_terms, tokens
from .written import written, written_with

DOCS = 64
#: Texts whose words a task counts.
TEXTS = 1 << 13


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _weight(tf: Column, length: Column, avg: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / avg))


def store_index(chunks: DataFrame, key: str, path: str, parts: int = 16, docs: int = DOCS) -> None:
    """Write the index of chunks (key, text) below path; replaces one that is there."""
    _add(chunks, key, path, parts, docs, "overwrite")


def append_index(chunks: DataFrame, path: str, docs: int = DOCS) -> None:
    """Add chunks whose keys the index does not have yet; what is there is neither read nor written."""
    corpus = chunks.sparkSession.read.parquet(f"{path}/corpus").first()
    _add(chunks, corpus["key"], path, corpus["parts"], docs, "append")


def _add(chunks: DataFrame, key: str, path: str, parts: int, docs: int, mode: str) -> None:
    seen, own = Observation(), f"a{uuid.uuid4().hex}"
    measured = chunks.select(F.col(key).alias("key"), tokens(F.col("text")).alias("ts")).withColumn("len", F.size("ts"))
    measured, got = written_with(measured.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")), seen)
    placed = measured.withColumn("longest", F.col("len"))
    again = written(measured.groupBy("key").agg(F.count("*").alias("rows"), F.max("len").alias("most")).where("rows > 1").drop("rows"))
    if not again.isEmpty():  # all texts of a key are in one block
        placed = placed.join(again, "key", "left").withColumn("longest", F.coalesce("most", "longest")).drop("most")
    placed = placed.withColumn("level", F.floor(4 * F.log2(F.col("longest") + 1)).cast("int"))
    slots = placed.groupBy("level").agg(F.ceil(F.count("*") / docs).alias("slots"))  # a row for each level, under 130
    block = F.xxhash64(F.lit(own), "level", F.pmod(F.xxhash64("key"), "slots"))  # blocks of one hash are one larger block
    dealt = placed.join(F.broadcast(slots), "level").select("key", "len", "ts", block.alias("block"))
    words = dealt.repartition(R._parts(chunks, got["n"], TEXTS), "block").select("block", "key", "len", F.explode("ts").alias("term"))
    postings = words.groupBy("block", "key", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    _store(postings.withColumn("part", _part(F.col("term"), parts)), f"{path}/postings", own, mode)
    postings = chunks.sparkSession.read.parquet(f"{path}/postings").where(F.col("added") == own)
    bounds = postings.groupBy("part", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("len").alias("len"))
    _store(bounds, f"{path}/bounds", own, mode)
    corpus = chunks.sparkSession.createDataFrame([(key, got["n"], got["total"] or 0, parts)], "key string, n long, total long, parts int")
    corpus.coalesce(1).write.mode(mode).parquet(f"{path}/corpus")


def _store(rows: DataFrame, path: str, own: str, mode: str) -> None:
    rows.withColumn("added", F.lit(own)).sortWithinPartitions("part", "term", "block").write.mode(mode).partitionBy("added", "part").parquet(path)


def index_size(spark: SparkSession, path: str) -> int | None:
    """The number of chunks of a stored index; None if there is none."""
    try:
        return spark.read.parquet(f"{path}/corpus").agg(F.sum("n").alias("n")).first()["n"]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def search_counted(questions: DataFrame, path: str, k: int = POOL, first: int = FIRST, second: int = SECOND) -> tuple[DataFrame, dict[str, int]]:
    """search_index, and how many blocks the questions' terms are in and how many of them were read."""
    spark = questions.sparkSession
    key, parts, n, total = spark.read.parquet(f"{path}/corpus").groupBy("key", "parts").agg(F.sum("n"), F.sum("total")).first()
    avg = total / max(n, 1) or 1.0
    asked = written(asked_terms(questions))
    terms = R._asked(asked, "term").withColumn("part", _part(F.col("term"), parts))
    bounds = written(spark.read.parquet(f"{path}/bounds").join(terms, ["part", "term"], "left_semi").drop("added"))
    df = bounds.groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    postings = spark.read.parquet(f"{path}/postings").drop("added")
    weight = F.col("idf") * _weight(F.col("tf"), F.col("len"), avg)
    counted = asked.agg(F.count("*").alias("rows"), F.count_distinct("question_id").alias("questions")).first()
    if counted["rows"] > R.ASKED:
        met = written(asked.join(idf, "term").join(bounds, "term").select("question_id", "part", "term", "block", "idf", weight.alias("bound")))
        best = met.groupBy("question_id", "block").agg(F.sum("bound").alias("bound"))

        def rows_of(pairs: DataFrame) -> DataFrame:
            wanted = met.join(pairs, ["question_id", "block"]).select("question_id", "part", "term", "block", "idf")
            return wanted.join(postings, ["part", "term", "block"])
    else:
        times = asked.where("question_id is not null").groupBy("question_id", "term").agg(F.count("*").alias("times"))
        askers = times.groupBy("term", "times").agg(F.collect_list("question_id").alias("askers"))
        askers = F.broadcast(written(askers.join(idf, "term").select("term", "askers", (F.col("idf") * F.col("times")).alias("idf"))))  # under ASKED questions in all
        parts_ = R._parts(questions, n * counted["questions"], R.PAIRS)
        best = bounds.repartition(parts_, "block").join(askers, "term").select("block", F.explode("askers").alias("question_id"), weight.alias("bound"))
        best = best.groupBy("question_id", "block").agg(F.sum("bound").alias("bound"))
        used = written(postings.join(terms, ["part", "term"], "left_semi").drop("part"))

        def rows_of(pairs: DataFrame) -> DataFrame:
            wanted = pairs.groupBy("block").agg(F.collect_list("question_id").alias("wanted"))
            if pairs.count() <= R.ASKED:
                met = used.join(F.broadcast(wanted), "block")
            else:
                met = used.repartition(parts_, "block").join(wanted.repartition(parts_, "block"), "block")
            return met.join(askers, "term").withColumn("question_id", F.explode(F.array_intersect("wanted", "askers"))).select("question_id", "block", "key", "tf", "len", "idf")

    def score(pairs: DataFrame) -> DataFrame:
        scores = rows_of(pairs).groupBy("question_id", "block", F.col("key").alias(key)).agg(F.round(F.sum(weight), 6).alias("score"))
        return scores.where("score > 0").select("question_id", key, "score")

    return searched(best, score, key, k, first, second)


def search_index(questions: DataFrame, path: str, k: int = POOL) -> DataFrame:
    """bm25() of a stored index, whatever it was added in; only blocks that may hold a hit are read."""
    return search_counted(questions, path, k)[0]
