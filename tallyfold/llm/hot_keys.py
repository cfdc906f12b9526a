"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this part of all rows, so there are fewer hot keys than this.
SHARE, SMALL = 128, 1 << 14
#: Parts of the keys' hashes that rows are counted by, to tell where hot keys may be.
BINS = 1 << 16


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = SHARE) -> DataFrame:
    """rows inner joined with groups, which has one row per key and the number of its rows as size.

    Hot keys' groups, fewer than share, are broadcast, so that their rows stay where
    they are; all others are joined as usual. total: the number of rows; up to SMALL of
    them, which one task can hold, need no such care.
    """
    if total <= SMALL:
        return rows.join(groups, key)
    most = total // share
    hot = F.broadcast(groups.where(F.col(size) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= most), key)
    return rows.join(hot, key).unionByName(cold)


def hot_counts(rows: DataFrame, key: str, size: str, total: int, share: int = SHARE) -> DataFrame | None:
    """The fewer than share keys with more than 1/share of all rows, and the number of their rows as size; None for small tables.

    Rows are counted by BINS parts of the keys' hashes first, so only the keys of parts with that many rows are counted one by one.
    """
    if total <= SMALL:
        return None
    most, bins = total // share, F.pmod(F.xxhash64(key), F.lit(BINS)).alias("__bin")
    full = rows.groupBy(bins).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("__bin")
    met = rows.select(key, bins).join(F.broadcast(full), "__bin", "left_semi")
    return met.groupBy(key).agg(F.count("*").alias(size)).where(F.col(size) > most)
