"""Exact top-k over blocks of rows with an upper bound each: best blocks first, until no bound reaches the kth score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top
from .written import written

#: Blocks of a question in the first and the second pass; scores are rounded to six digits, so bounds within SLACK count.
FIRST, SECOND, SLACK = 8, 64, 2e-6


def searched(bounds: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, k: int, first: int = FIRST, second: int = SECOND) -> tuple[DataFrame, dict[str, int]]:
    """(question_id, key, score, norm, rank; blocks in all and blocks read) of the k best rows of each question.

    bounds: question_id, block, bound, where no row of the block scores higher than bound;
    score gives question_id, key, score of the rows of (question_id, block). Each pass reads
    blocks whose bound reaches the kth score so far, the third all that are left of them.
    """
    bounds, best, done = written(bounds), None, None
    read = 0
    for most in (first, second, None):
        todo = bounds if done is None else bounds.join(done, ["question_id", "block"], "left_anti")
        if best is not None:
            least = best.where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
            todo = todo.join(least, "question_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least")
        if most:
            w = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
            todo = todo.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
        now = written(todo.select("question_id", "block"))
        n = now.count()
        if not n:
            break
        read += n
        found = score(now)
        if best is not None:
            found = found.unionByName(best.select("question_id", key, "score"))
        best = written(top(found, key, k))
        done = now if done is None else done.unionByName(now)
    if best is None:
        best = top(score(bounds.select("question_id", "block")), key, k)
    return best, {"blocks": bounds.count(), "read": read}
