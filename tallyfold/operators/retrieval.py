"""Ranked retrieval: BM25, word overlap, cosine, fusion and gates, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .written import written, written_with

# BM25's parameters, the fusion constant and list lengths.
K1, B, RRF, POOL, FINAL = 1.5, 0.75, 60, 10, 3
MISS, WEAK = "INSUFFICIENT_DATA", 0.3
# Words of sections that weigh most, and second most.
STATEMENTS = ["income", "financial", "balance", "cash"]
DISCUSSION = ["md&a", "management", "operations"]
#: Query sets up to this many vectors are broadcast; larger ones meet blocks of so many rows.
FEW, BLOCK = 1000, 1 << 14
#: Question-term rows up to this many are broadcast. Chunks whose words one task counts, and pairs of questions and chunks that one adds up.
ASKED, DEALT, PAIRS = 1 << 18, 1 << 12, 1 << 19


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or more without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(L.SEARCH_STOPS))


def _measured(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.select(key, tokens(F.col("text")).alias("ts")).withColumn("len", F.size("ts"))


def _counted(words: DataFrame, key: str) -> DataFrame:
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def postings(chunks: DataFrame, key: str) -> DataFrame:
    """key, term, tf, len: the inverted index of chunks (key, text)."""
    return _counted(_measured(chunks, key).select(key, "len", F.explode("ts").alias("term")), key)


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def bm25(questions: DataFrame, chunks: DataFrame, key: str, k: int = POOL) -> DataFrame:
    """question_id, key, score, norm, rank of the k best chunks of each question; zero scores are left out.

    The texts are read once, dealt by key in parts of about DEALT chunks, so that neither what a
    task holds nor the number of shuffles grows with them. Only words that a question asks for
    are kept, and the number of chunks and their mean length are observed on the way.
    """
    asked, seen = written(asked_terms(questions)), Observation()
    dealt = chunks.repartition(_parts(chunks, chunks.count(), DEALT), key)
    words = _measured(dealt, key).observe(seen, F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).select(key, "len", F.explode("ts").alias("term"))
    used = words.join(_asked(asked, "term"), "term", "left_semi")
    index, got = written_with(_counted(used, key), seen)
    return _scores(asked, index, got["n"], (got["total"] or 0) / max(got["n"], 1) or 1.0, key, k)


def _parts(df: DataFrame, rows: int, most: int) -> int:
    """So many partitions that one has about most of rows, and that all cores have one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most))


def _asked(asked: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column of asked, a written table; to be broadcast if it is small."""
    out = asked.select(col).distinct()
    return F.broadcast(out) if asked.count() <= ASKED else out


def _scores(asked: DataFrame, index: DataFrame, n: int, avg: float, key: str, k: int) -> DataFrame:
    df = index.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    met = _met(asked.join(df.select("term", "idf"), "term"), asked, index, n, key)
    scores = met.groupBy("question_id", key).agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")
    return top(scores, key, k)


def _met(terms: DataFrame, asked: DataFrame, index: DataFrame, n: int, key: str) -> DataFrame:
    """terms (of asked, a written table) and index joined by term, all rows of a chunk in one partition.

    So pairs of questions and chunks are added up where they arise, and only the best of each
    partition are shuffled. Partitions are so many that one has about PAIRS pairs. Terms of
    too many questions to broadcast are joined by a shuffle, and the pairs by another.
    """
    counted = asked.agg(F.count("*").alias("rows"), F.count_distinct("question_id").alias("questions")).first()
    if counted["rows"] > ASKED:
        return index.join(terms, "term")
    return index.repartition(_parts(index, n * counted["questions"], PAIRS), key).join(F.broadcast(terms), "term")


def encoded(chunks: DataFrame, encode: Callable, prefix: str = "passage: ") -> DataFrame:
    """chunks with embedding by encode, a pandas UDF from text to array<float>; vector_index stores them."""
    return chunks.withColumn("embedding", encode(F.concat(F.lit(prefix), "text")))


def metadata(chunks: DataFrame) -> DataFrame:
    """The fields that hits carry, with their kinds and defaults."""
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c)
    return chunks.select("chunk_id", text("text", ""), text("company", "UNKNOWN"), text("doc_type", "UNKNOWN"), text("fiscal_year", "UNKNOWN"), text("section", "DOCUMENT"), F.coalesce(F.col("page").try_cast("int"), F.lit(0)).alias("page"))


def retrieval_features(section: Column, page: Column, text: Column, fiscal_year: Column, company: Column, asked_year: Column, asked_company: Column, bm25_score: Column, cosine_score: Column) -> dict[str, Column]:
    """Eight numbers that tell why a chunk was retrieved; missing scores and pages count as one half."""
    low, half = F.lower(F.coalesce(section, F.lit(""))), F.lit(0.5)
    at = F.trim(page.cast("string")).try_cast("double")
    has = lambda words: T.contains_any(low, words)
    meets = lambda a, b: F.coalesce(((a != "") & b.contains(a)).cast("double"), F.lit(0.0))
    return {
        "f_bm25": F.coalesce(bm25_score, half),
        "f_cosine": F.coalesce(cosine_score, half),
        "f_section": F.when(has(STATEMENTS), 1.0).when(has(DISCUSSION), 0.8).otherwise(0.5),
        "f_page": F.when(at.isNull(), half).otherwise(F.least(at / 300.0, F.lit(1.0))),
        "f_length": F.least(F.length(text) / 1000.0, F.lit(1.0)),
        "f_table": F.coalesce(text.rlike(r"[$%|\t]").cast("double"), F.lit(0.0)),
        "f_year": meets(asked_year, fiscal_year),
        "f_company": meets(F.lower(asked_company), F.lower(company)),
    }


def top(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of (question_id, key, score), with norm (share of the best) and rank; ties by key."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), key)
    return _limited(scores, w, k).select("question_id", key, "score", "norm", "rank")


def _limited(scores: DataFrame, w: Window, k: int) -> DataFrame:
    """The first k rows of w with rank and norm. The limit comes first, so that it also holds before the shuffle."""
    few = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy("question_id"))
    return few.withColumn("norm", F.round(F.col("score") / F.when(best > 0, best).otherwise(1.0), 6))


def word_overlap(questions: DataFrame, chunks: DataFrame, key: str, k: int = POOL) -> DataFrame:
    """The k chunks that share most different words with each question."""
    split = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))).alias("term")
    seen = Observation()
    q = written(questions.select("question_id", split(F.col("question"))))
    c = chunks.observe(seen, F.count(F.lit(1)).alias("n")).select(key, split(F.col("text")))
    used, got = written_with(c.join(_asked(q, "term"), "term", "left_semi"), seen)
    return top(_met(q, q, used, got["n"], key).groupBy("question_id", key).agg(F.count("*").cast("double").alias("score")), key, k)


def cosine(queries: DataFrame, vectors: DataFrame, key: str, k: int = POOL) -> DataFrame:
    """question_id, key, score (max(0, cosine)), norm, rank; queries: question_id, embedding.

    Exact: every query is compared with every vector. Up to FEW queries are broadcast, each
    once; more meet the vectors in blocks of BLOCK rows. vector_index finds the same rows
    without comparing all.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(dot(a, a))
    q = queries.select("question_id", F.col("embedding").alias("__q"), norm(F.col("embedding")).alias("__qn"))
    v = vectors.select(key, F.col("embedding").alias("__v"), norm(F.col("embedding")).alias("__vn"))
    if queries.limit(FEW + 1).count() <= FEW:
        met = v.crossJoin(F.broadcast(q))
    else:
        blocks = max(1, -(-vectors.count() // BLOCK))
        q = q.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = v.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).join(q, "__b")
    score = F.greatest(F.lit(0.0), F.try_divide(dot(F.col("__q"), F.col("__v")), F.col("__qn") * F.col("__vn")))
    return top(met.select("question_id", key, F.round(score, 6).alias("score")), key, k)


def fuse(lists: list[DataFrame], key: str, k: int = POOL, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion: question_id, key, score, norm, rank. Ties keep the order of first sight."""
    every = None
    for i, hits in enumerate(lists):
        rows = hits.select("question_id", key, "rank", F.lit(i).alias("list"))
        every = rows if every is None else every.unionByName(rows)
    fused = every.groupBy("question_id", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "seen", key)
    return _limited(fused, w, k).select("question_id", key, "score", "norm", "rank")


def rerank(hits: DataFrame, texts: DataFrame, key: str, score: Callable[[Column, Column], Column] | None = None, k: int = FINAL) -> DataFrame:
    """The pool in the order of score(question, text), renumbered; without a score in its own order.

    texts: question_id, key, question, text of the pool.
    """
    if score is None:
        return hits.where(F.col("rank") <= k).select("question_id", key, "score", F.col("score").alias("reranker_score"), "rank")
    w = Window.partitionBy("question_id").orderBy(F.desc("reranker_score"), F.col("__old"), key)
    met = hits.withColumnRenamed("rank", "__old").join(texts, ["question_id", key]).withColumn("reranker_score", score(F.col("question"), F.col("text")))
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", key, "score", "reranker_score", "rank")


def gate(questions: DataFrame, sparse: DataFrame, dense: DataFrame, final: DataFrame) -> DataFrame:
    """question_id, n_sparse, n_dense, n_final, best, signal: whether retrieval found enough to answer from."""
    n = lambda d, name: d.groupBy("question_id").agg(F.count("*").alias(name))
    met = questions.select("question_id").join(n(sparse, "a"), "question_id", "left").join(n(dense, "b"), "question_id", "left").join(final.groupBy("question_id").agg(F.count("*").alias("c"), F.max("reranker_score").alias("best")), "question_id", "left").na.fill(0, ["a", "b", "c"])
    none = (F.col("a") + F.col("b") + F.col("c")) == 0
    weak = (F.col("a") == 0) & (F.col("c") > 0) & (F.coalesce("best", F.lit(0.0)) < WEAK)
    return met.select("question_id", F.col("a").alias("n_sparse"), F.col("b").alias("n_dense"), F.col("c").alias("n_final"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"), (~(none | weak)).alias("signal"))


def early_exit(gated: DataFrame, previews: DataFrame, llm: bool) -> DataFrame:
    """question_id, answer, confidence of questions that end here: no signal, or no model to answer them.

    previews: question_id, text of the best chunk.
    """
    met = gated.join(previews, "question_id", "left")
    answer = F.when(~F.col("signal"), F.lit(MISS)).otherwise(F.concat(F.lit("LLM_UNAVAILABLE: "), F.substring(F.coalesce("text", F.lit("")), 1, 300)))
    out = met.select("question_id", answer.alias("answer"), F.when(F.col("signal"), 0.30).otherwise(0.0).alias("confidence"), "signal")
    return out.where(~F.col("signal")).drop("signal") if llm else out.drop("signal")
