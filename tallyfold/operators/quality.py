"""Checks of chunks and figures before they are answered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shortest useful chunk, tolerances, words of a failed fetch.
LEAST, FAR, APART = 10, 0.20, 0.05
FAILURES = ["error:", "failed:", "exception:"]


def useful(chunks: DataFrame) -> DataFrame:
    """chunks of LEAST characters or more that report no failure."""
    return chunks.where((F.length(F.trim("text")) >= LEAST) & ~F.lower("text").rlike("|".join(FAILURES)))


def far_off(value: Column, reference: Column, tolerance: float = FAR) -> Column:
    """Whether value is further from reference than tolerance of it; never from a reference of 0."""
    return F.when(reference == 0, False).otherwise(F.abs(value - reference) / F.abs(reference) > tolerance)


def apart(a: Column, b: Column, tolerance: float = APART) -> Column:
    """Whether two sources' figures differ by more than tolerance of the larger; never if one is 0."""
    return F.when((a == 0) | (b == 0), False).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) > tolerance)


def conflicts(figures: DataFrame, key: str, tolerance: float = APART) -> DataFrame:
    """key, source, other, conflict for each two sources of a key; figures: key, source, value."""
    b = figures.select(key, F.col("source").alias("other"), F.col("value").alias("__w"))
    met = figures.join(b, key).where("source < other")
    return met.select(key, "source", "other", apart(F.col("value"), F.col("__w"), tolerance).alias("conflict"))
