"""Live data: cached rows with time limits, freshness, validation and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def live_rows(rows: DataFrame, key: str, kind: str, at: str, tie: str, now: Column) -> DataFrame:
    """The latest row of each key that is not older than its kind allows at the time now."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return latest(rows, key, at, tie).where(age <= T.ttl(F.col(kind)))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def stats(rows: DataFrame, kind: str) -> DataFrame:
    """kind, n; the row without a kind is the total."""
    return rows.rollup(kind).agg(F.count("*").alias("n"))


def fetched(requests: DataFrame, cache: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """requests with value, source and freshness: the cache first (tagged by its kind's limit), then the live source."""
    met = requests.join(cache.select(key, F.col("value").alias("__c")), key, "left").join(live.select(key, F.col("value").alias("__l")), key, "left")
    source = F.when(F.col("__c").isNotNull(), "cache").when(F.col("__l").isNotNull(), "live").otherwise("none")
    fresh = F.when(source == "cache", T.freshness_by_ttl(F.col("kind"))).when(source == "live", "LIVE_VERIFIED").otherwise("UNVERIFIED")
    return met.select(*requests.columns, F.coalesce("__c", "__l").alias("value"), source.alias("source"), fresh.alias("freshness"))


def written_back(cache: DataFrame, results: DataFrame, key: str, now: Column) -> DataFrame:
    """The cache's rows (key, kind, value, ts) with those that results took from a live source in place of older ones."""
    new = results.where(F.col("source") == "live").select(key, "kind", "value", now.cast("timestamp").alias("ts"))
    return cache.select(key, "kind", "value", "ts").join(new.select(key), key, "left_anti").unionByName(new)


def summary_text(results: DataFrame, key: str) -> str:
    """One line for each kind of request: how many came, and from where; the keys that failed are named, ten at most."""
    w = Window.partitionBy("kind").orderBy(key)
    lost = results.where("source = 'none'").withColumn("__r", F.row_number().over(w)).where("__r <= 10").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("__r", F.col(key).cast("string").alias("k")))).alias("lost"))
    lines = []
    for r in summary(results).join(lost, "kind", "left").orderBy("kind").collect():  # one row a kind
        named = ", ".join(x.k for x in r["lost"] or [])
        lines.append(f"{r['kind']}: {r['success']} of {r['n']} ({r['cached']} cached, {r['live']} live)" + (f"; without: {named}" if named else ""))
    return "\n".join(lines)


def summary(results: DataFrame) -> DataFrame:
    """source counts of a fetch."""
    return results.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("source") != "none").alias("success"), F.count_if(F.col("source") == "cache").alias("cached"), F.count_if(F.col("source") == "live").alias("live"))


def missing_fields(kind: Column, fields: Column) -> Column:
    """Required fields of a kind that a map of fields lacks or holds empty."""
    need = F.create_map(*(x for k, v in L.REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    return F.filter(F.coalesce(need[kind], need[F.lit("default")]), lambda f: F.coalesce(fields[f], F.lit("")) == "")


def guard(chunks: DataFrame, blocked: bool) -> DataFrame:
    """Nothing passes while material non-public information is at hand."""
    return chunks.where(F.lit(not blocked))


def latest_observations(series: DataFrame, key: str, n: int) -> DataFrame:
    """The n newest rows of each series, newest first, with rank."""
    w = Window.partitionBy(key).orderBy(F.desc("date"))
    return series.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def inversion(latest_values: DataFrame, short: str = "treasury_2y", long: str = "treasury_10y") -> DataFrame:
    """One row, inverted: the short rate above the long one; false if either is unknown."""
    v = lambda k: F.max(F.when(F.col("series") == k, F.col("value")))
    return latest_values.agg(F.coalesce(v(short) > v(long), F.lit(False)).alias("inverted"))


def snapshot(info: DataFrame) -> DataFrame:
    """Price, size and name of a market row, with fallbacks that also pass over zero."""
    some = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit(0.0)) for c in cs))
    return info.select("ticker", some("currentPrice", "previousClose").alias("price"), F.round(some("marketCap") / 1e9, 2).alias("cap_billions"), some("trailingPE", "forwardPE").alias("pe"), F.round(some("totalRevenue") / 1e9, 2).alias("revenue_billions"), T.first_of(F.col("shortName"), F.col("longName"), F.col("ticker")).alias("name"))
