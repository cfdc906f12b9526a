"""Cached feeds of filings, markets and macro series, read from folders of JSON lines."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from ..functions import lexicon as L

TRIES = 3
FORMS = ["10-K", "10-Q", "8-K", "20-F", "6-K", "S-1", "DEF 14A"]
FILING = "cik string, form_type string, filed_date string, accession_number string, document_url string"


def infer_year(filed: Column) -> Column:
    """FY and the year of a filing date; null for anything else."""
    y = F.substring(filed, 1, 4)
    return F.when(y.rlike(r"^\d{4}$"), F.concat(F.lit("FY"), y))


def cik(ticker: Column) -> Column:
    """The registry number of a known ticker; null for others."""
    known = F.create_map(*(F.lit(x) for pair in L.CIKS.items() for x in pair))
    return known[F.upper(ticker)]


def filings(spark: SparkSession, folder: str, ticker: str, form: str, limit: int = 10) -> DataFrame:
    """A ticker's newest cached filings of a form, with their fiscal year; the form must be a known one."""
    if form not in FORMS:
        raise ValueError(f"unknown form {form}")
    d = spark.read.schema(FILING).json(folder).where((F.col("cik") == L.CIKS.get(ticker.upper(), "")) & (F.col("form_type") == form))
    return d.withColumn("fiscal_year", infer_year(F.col("filed_date"))).orderBy(F.desc("filed_date"), "accession_number").limit(limit)


def flatten_search(replies: DataFrame) -> DataFrame:
    """Filing rows of search replies (reply: JSON text with hits.hits[]._source)."""
    schema = "hits struct<hits: array<struct<_id: string, _source: struct<ciks: array<string>, form: string, file_date: string, adsh: string, url: string>>>>"
    h = replies.select(F.explode(F.from_json("reply", schema)["hits"]["hits"]).alias("h")).select("h._id", "h._source.*")
    return h.select(F.col("ciks")[0].alias("cik"), F.col("form").alias("form_type"), F.col("file_date").alias("filed_date"), F.col("adsh").alias("accession_number"), F.coalesce("url", "_id").alias("document_url"))


def macro_series(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """series, series_id, date, value of cached observations of known series."""
    known = spark.createDataFrame(list(L.MACRO_SERIES.items()), "series string, series_id string")
    d = spark.read.schema("series_id string, date date, value double").json(folder).join(F.broadcast(known), "series_id")
    return d if names is None else d.where(F.col("series").isin(names))


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, date, close, volume of cached price histories."""
    return spark.read.schema("ticker string, date date, close double, volume long").json(folder)


def benchmark_questions(spark: SparkSession, questions: str, documents: str) -> DataFrame:
    """question_id, doc_name, question, gold_answer, company_name, doc_type, fiscal_year of a benchmark's JSON lines.

    A document that the second file lacks is of an unknown company, a 10-K, of year FY0; a
    missing answer is empty.
    """
    q = spark.read.schema("financebench_id string, doc_name string, question string, answer string").json(questions)
    d = spark.read.schema("doc_name string, company string, doc_type string, doc_period string").json(documents).dropDuplicates(["doc_name"])
    met = q.join(d, "doc_name", "left")
    or_else = lambda c, default: F.coalesce(c, F.lit(default))
    return met.select(F.col("financebench_id").alias("question_id"), "doc_name", "question", or_else("answer", "").alias("gold_answer"), or_else("company", "UNKNOWN").alias("company_name"), or_else("doc_type", "10-K").alias("doc_type"), F.concat(F.lit("FY"), or_else("doc_period", "0")).alias("fiscal_year"))


def within(seconds: float, call: Callable[[], Any]) -> Any:
    """call(), or TimeoutError after so many seconds; its thread is left behind and ends with the worker."""
    out: dict[str, Any] = {}

    def run() -> None:
        try:
            out["value"] = call()
        except BaseException as e:  # told to the caller below
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError
    if "error" in out:
        raise out["error"]
    return out["value"]


def tried(call: Callable[[], Any], pause: float, deadline: float) -> tuple[Any, str, int]:
    """(value, status, tries) of up to TRIES calls, each with the deadline, with pauses that double."""
    status = ""
    for k in range(TRIES):
        try:
            value = within(deadline, call)
            return value, "empty" if value is None else "ok", k + 1
        except TimeoutError:
            status = "failed: timeout"
        except Exception as e:  # a source that is down must not end the other keys' fetches
            status = f"failed: {type(e).__name__}"
        if k + 1 < TRIES:
            time.sleep(pause * 2**k)
    return None, status, TRIES


class _Options:
    """Options that both kinds of sources have: keys (comma separated), pause and deadline in seconds."""

    def __init__(self, options: dict) -> None:
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.pause, self.deadline = float(options.get("pause", "1")), float(options.get("deadline", "60"))


class FetchSource(DataSource):
    """Rows (key, value, status, tries) that a fetcher returns, one partition for every key of option "keys".

    Subclasses give fetch(key) and a name. A key is tried up to three times, with pauses of
    option "pause" seconds (1 by default), then twice that; a try that takes longer than
    option "deadline" (60) is given up. Every key gives a row: its value, or null and in status
    what went wrong. With option "pushdown" true, filters on key (=, in) decide which keys are
    fetched at all; that needs spark.sql.python.filterPushdown.enabled, and a load() for each
    query, as Spark keeps what was pushed down with the loaded table.
    """

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "key string, value string, status string, tries int"

    def fetch(self, key: str) -> str | None:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredReader if self.options.get("pushdown") == "true" else _FetchReader)(self)


class _FetchReader(DataSourceReader):
    def __init__(self, source: FetchSource) -> None:
        self.source, self.options = source, _Options(source.options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.options.keys]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        value, status, tries = tried(lambda: self.source.fetch(partition.value), self.options.pause, self.options.deadline)
        yield partition.value, value, status, tries


class _FilteredReader(_FetchReader):
    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self.options.keys = [k for k in self.options.keys if k == f.value]
            elif isinstance(f, In) and f.attribute == ("key",):
                self.options.keys = [k for k in self.options.keys if k in f.value]
            else:
                yield f


class FeedStream(DataSource):
    """A stream of (key, seq, upto, value, status, tries): the items of each key of a feed that numbers them.

    Subclasses give newest(), the number of items so far, and between(key, start, end), the
    items (seq, value) of that range. Offsets are those numbers, so that a stream that starts
    again from its checkpoint reads on where its last whole batch ended. A range that cannot
    be fetched in three tries, each within the deadline, is one row with its first and last
    number and what went wrong; refetch() asks for such ranges again. Options as for FetchSource,
    and "start" for the first number.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "key string, seq long, upto long, value string, status string, tries int"

    def newest(self) -> int:
        raise NotImplementedError

    def between(self, key: str, start: int, end: int) -> list[tuple[int, str]]:
        raise NotImplementedError

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedReader(self)


class _Range(InputPartition):
    def __init__(self, key: str, start: int, end: int) -> None:
        self.key, self.start, self.end = key, start, end


class _FeedReader(DataSourceStreamReader):
    def __init__(self, source: FeedStream) -> None:
        self.source, self.options = source, _Options(source.options)

    def initialOffset(self) -> dict:
        return {"next": int(self.source.options.get("start", "0"))}

    def latestOffset(self) -> dict:
        return {"next": int(within(self.options.deadline, self.source.newest))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(k, start["next"], end["next"]) for k in self.options.keys if start["next"] < end["next"]]

    def read(self, partition: _Range) -> Iterator[tuple]:
        p = partition
        items, status, tries = tried(lambda: list(self.source.between(p.key, p.start, p.end)), self.options.pause, self.options.deadline)
        if items is None:
            yield p.key, p.start, p.end - 1, None, status, tries
        for seq, value in items or []:
            yield p.key, seq, seq, value, "ok", tries


def refetch(source: FeedStream, failed: DataFrame) -> DataFrame:
    """The rows of ranges that failed before (key, seq, upto), asked for again in tasks, in the stream's own columns."""
    options = _Options(source.options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reader = _FeedReader(source)
            rows = [r for f in pdf.itertuples(index=False) for r in reader.read(_Range(f.key, int(f.seq), int(f.upto) + 1))]
            yield pd.DataFrame(rows, columns=["key", "seq", "upto", "value", "status", "tries"])

    return failed.where(F.col("status").startswith("failed") & F.col("key").isin(options.keys)).select("key", "seq", "upto").mapInPandas(run, source.schema())
