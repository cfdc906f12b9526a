"""Queries over events as live feeds: caches, freshness, windows, macro series and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import cache as K
from ..operators import routing as R
from ..operators.written import written
from ..sources import feeds as S
from ..sources import files as X
from ..streaming import streams as W
from .finance import q

KINDS = list(L.TTL)
SERIES = list(L.MACRO_SERIES)
NOW = "2024-01-30 00:00:00"


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values, col):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(col), F.lit(len(values))) + 1).cast("int"))


def _list(values):
    return "[" + ", ".join(map(q, values)) + "]"


def _events(spark, sf):
    """Events as cache rows: a key for each user and kind."""
    e = _t(spark, sf, "events").withColumn("kind", _pick(KINDS, "event_id"))
    return e.withColumn("key", F.concat(F.col("user_id").cast("string"), F.lit(":"), "kind"))


_EV = f"ev AS (SELECT *, {_list(KINDS)}[event_id % {len(KINDS)} + 1] AS kind, user_id || ':' || {_list(KINDS)}[event_id % {len(KINDS)} + 1] AS key FROM events)"
_TTL = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.TTL.items()) + " END"
_AGE = f"(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)))"
_FRESH = "CASE WHEN {0} <= 900 THEN 'LIVE_VERIFIED' WHEN {0} <= 86400 THEN 'RECENT_24H' WHEN {0} <= 604800 THEN 'STALE_7D' ELSE 'OLD' END"


def cache_key(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", T.cache_key(F.col("event_type"), F.col("props")).alias("cache_key"))


def freshness(spark, sf):
    e = W.fresh(_events(spark, sf), "kind", F.lit(NOW).cast("timestamp"))
    return e.select("event_id", "freshness", "kind_freshness")


def cache_live_rows(spark, sf):
    return K.live_rows(_events(spark, sf), "key", "kind", "ts", "event_id", F.lit(NOW).cast("timestamp")).select("key", "event_id", "value")


def cache_stats(spark, sf):
    return K.stats(_events(spark, sf), "kind")


def _fetch(spark, sf):
    e = _events(spark, sf)
    req = e.select("key", "kind").distinct()
    cached = K.latest(e.where("event_type = 'click'"), "key", "ts", "event_id").select("key", "value")
    live = K.latest(e.where("event_type = 'view'"), "key", "ts", "event_id").select("key", "value")
    return K.fetched(req, cached, live, "key")


def fetch_freshness(spark, sf):
    return _fetch(spark, sf)


def fetch_summary(spark, sf):
    return K.summary(_fetch(spark, sf))


def schema_validate(spark, sf):
    e = _events(spark, sf)
    fields = F.create_map(F.lit("ticker"), F.col("event_type"), F.lit("price"), F.when(F.col("value") > 50, F.col("value").cast("string")), F.lit("series_id"), F.lit("X"), F.lit("cik"), F.lit(""), F.lit("form_type"), F.lit("10-K"), F.lit("value"), F.col("value").cast("string"), F.lit("title"), F.lit("t"))
    return e.select("event_id", F.concat_ws(",", K.missing_fields(F.col("kind"), fields)).alias("missing"))


def _macro(spark, sf):
    """Events as macro observations: a series for each user modulo 15, one value a day."""
    e = _t(spark, sf, "events").withColumn("series", _pick(SERIES, "user_id"))
    return e.groupBy("series", F.to_date("ts").alias("date")).agg(F.max("value").alias("value"))


_MACRO = f"macro AS (SELECT {_list(SERIES)}[user_id % {len(SERIES)} + 1] AS series, ts::DATE AS date, max(value) AS value FROM events GROUP BY ALL)"


def macro_latest(spark, sf):
    return K.latest_observations(_macro(spark, sf), "series", 3)


def yield_inversion(spark, sf):
    return K.inversion(K.latest_observations(_macro(spark, sf), "series", 1))


def market_snapshot(spark, sf):
    """Customers as market rows; every fourth lacks a price."""
    c = _t(spark, sf, "customer")
    lack = F.col("c_custkey") % 4 == 0
    info = c.select(F.col("c_name").alias("ticker"), F.when(lack, 0.0).otherwise(F.col("c_acctbal")).alias("currentPrice"), (F.col("c_nationkey") * 1.5).alias("previousClose"), (F.floor(F.abs("c_acctbal")) * 1e7).alias("marketCap"), F.when(lack, F.lit(None).cast("double")).otherwise(10.0).alias("trailingPE"), F.lit(12.0).alias("forwardPE"), (F.col("c_nationkey") * 1e9).alias("totalRevenue"), F.when(lack, "").otherwise(F.col("c_mktsegment")).alias("shortName"), F.concat(F.col("c_mktsegment"), F.lit(" Inc")).alias("longName"))
    return K.snapshot(info)


def infer_fy(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", S.infer_year(F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("fiscal_year"))


def cik_lookup(spark, sf):
    """A ticker for every supplier, some unknown, in mixed case."""
    return _t(spark, sf, "supplier").select("s_suppkey", S.cik(_pick([*map(str.lower, L.CIKS), "XXXX"], "s_suppkey")).alias("cik"))


def edgar_flatten(spark, sf):
    """Each customer's orders as one search reply, flattened."""
    hit = F.struct(F.col("o_orderkey").cast("string").alias("_id"), F.struct(F.array(F.col("o_custkey").cast("string")).alias("ciks"), F.col("o_orderpriority").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"), F.concat(F.lit("A-"), F.col("o_orderkey").cast("string")).alias("adsh")).alias("_source"))
    r = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(hit).alias("hits")).alias("hits"))).alias("reply"))
    return S.flatten_search(r)


def vision_cells(spark, sf):
    """Parts as replies of a vision model about a chart, some decorative or empty."""
    p = _t(spark, sf, "part")
    body = F.to_json(F.struct((F.col("p_size") % 5 == 0).alias("decorative"), F.array(F.struct(F.col("p_name").alias("label"), F.col("p_size").cast("string").alias("value"), F.lit("cm").alias("unit")), F.struct(F.lit("").alias("label"), F.lit("9").alias("value"), F.lit("").alias("unit"))).alias("data")))
    return X.vision_cells(p.select("p_partkey", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply")), "p_partkey")


def events_tumbling(spark, sf):
    return W.tumbling(_t(spark, sf, "events"))


def events_sliding(spark, sf):
    return W.sliding(_t(spark, sf, "events"))


def events_session(spark, sf):
    return W.sessions(_t(spark, sf, "events"))


def _labelled(spark, sf):
    """Questions by rule: the metrics' words make a kind, their length a difficulty."""
    from . import finance

    d = finance.questions(spark, sf)
    p = F.regexp_extract("question_id", r"#(\d+)$", 1).cast("int")
    kind = F.when(p <= 2, "numerical").when(p <= 6, "ratio").when(p <= 11, "multi_doc").when(p <= 14, "text").otherwise("forensic")
    hard = F.when(F.length("question") < 45, "easy").when(F.length("question") < 55, "medium").otherwise("hard")
    return written(d.select("question_id", "question", kind.alias("label"), hard.alias("difficulty")))  # each step of training reads them


def query_router(spark, sf):
    d = _labelled(spark, sf)
    return R.classify(R.train_router(d.select("question", "label")), d.select("question_id", "question"), "text")


def query_difficulty(spark, sf):
    d = _labelled(spark, sf)
    return R.classify(R.train_difficulty(d.select("question", F.col("difficulty").alias("label"))), d.select("question_id", "question"), "medium")


QUERIES = {f.__name__: f for f in (cache_key, freshness, cache_live_rows, cache_stats, fetch_freshness, fetch_summary, schema_validate, macro_latest, yield_inversion, market_snapshot, infer_fy, cik_lookup, edgar_flatten, vision_cells, events_tumbling, events_sliding, events_session, query_router, query_difficulty)}

_FETCH = f"{_EV}, req AS (SELECT DISTINCT key, kind FROM ev), c AS (SELECT key, value FROM ev WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1), l AS (SELECT key, value FROM ev WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1), f AS (SELECT req.key, kind, coalesce(c.value, l.value) AS value, CASE WHEN c.value IS NOT NULL THEN 'cache' WHEN l.value IS NOT NULL THEN 'live' ELSE 'none' END AS source, CASE WHEN c.value IS NOT NULL THEN {_FRESH.format(_TTL)} WHEN l.value IS NOT NULL THEN 'LIVE_VERIFIED' ELSE 'UNVERIFIED' END AS freshness FROM req LEFT JOIN c USING (key) LEFT JOIN l USING (key))"
_HAS = {"ticker": "true", "price": "value > 50", "series_id": "true", "cik": "false", "form_type": "true", "value": "true", "title": "true"}
_MISS = "CASE kind " + " ".join(f"WHEN {q(k)} THEN concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({_HAS.get(f, 'false')}, false) THEN {q(f)} END" for f in v) + ")" for k, v in L.REQUIRED.items() if v) + " ELSE '' END"

ORACLES = {
    "cache_key": "SELECT event_id, substr(sha256(event_type || ':' || props), 1, 32) AS cache_key FROM events",
    "freshness": f"WITH {_EV} SELECT event_id, {_FRESH.format(_AGE)} AS freshness, {_FRESH.format(_TTL)} AS kind_freshness FROM ev",
    "cache_live_rows": f"WITH {_EV}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1) SELECT key, event_id, value FROM l WHERE {_AGE} <= {_TTL}",
    "cache_stats": f"WITH {_EV} SELECT kind, count(*) AS n FROM ev GROUP BY ROLLUP (kind)",
    "fetch_freshness": f"WITH {_FETCH} SELECT * FROM f",
    "fetch_summary": f"WITH {_FETCH} SELECT kind, count(*) AS n, count(*) FILTER (source <> 'none') AS success, count(*) FILTER (source = 'cache') AS cached, count(*) FILTER (source = 'live') AS live FROM f GROUP BY kind",
    "schema_validate": f"WITH {_EV} SELECT event_id, {_MISS} AS missing FROM ev",
    "macro_latest": f"WITH {_MACRO} SELECT *, (row_number() OVER (PARTITION BY series ORDER BY date DESC))::INT AS rank FROM macro QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) <= 3",
    "yield_inversion": f"WITH {_MACRO}, l AS (SELECT * FROM macro QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) = 1) SELECT coalesce(max(value) FILTER (series = 'treasury_2y') > max(value) FILTER (series = 'treasury_10y'), false) AS inverted FROM l",
    "market_snapshot": "SELECT c_name AS ticker, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE nullif(c_acctbal, 0.0) END, nullif(c_nationkey * 1.5::DOUBLE, 0.0)) AS price, round(nullif(floor(abs(c_acctbal)) * 1e7, 0.0) / 1e9, 2) AS cap_billions, CASE WHEN c_custkey % 4 = 0 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS pe, round(nullif(c_nationkey * 1e9, 0.0) / 1e9, 2) AS revenue_billions, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' Inc' ELSE c_mktsegment END AS name FROM customer",
    "infer_fy": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN 'FY' || year(o_orderdate) END AS fiscal_year FROM orders",
    "cik_lookup": f"SELECT s_suppkey, {_list([*L.CIKS.values()])}[s_suppkey % {len(L.CIKS) + 1} + 1] AS cik FROM supplier",
    "edgar_flatten": "SELECT o_custkey::VARCHAR AS cik, o_orderpriority AS form_type, strftime(o_orderdate, '%Y-%m-%d') AS filed_date, 'A-' || o_orderkey AS accession_number, o_orderkey::VARCHAR AS document_url FROM orders",
    "vision_cells": "SELECT p_partkey, p_name AS row_header, p_size::VARCHAR AS value, 'cm' AS unit FROM part WHERE p_size % 5 <> 0",
    "events_tumbling": "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL",
    "events_sliding": "SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL",
    "events_session": "WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, g",
}
