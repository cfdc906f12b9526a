"""Streams: new files of a folder, event windows, and cached values with time limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.files import file_format

# Extensions that are watched.
WATCHED = ["pdf", "docx", "xlsx", "csv", "pptx", "html", "txt", "json"]


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, format, size_bytes, detected_at of new files; the checkpoint remembers those seen.

    Empty files are left out for good, so files should be moved into the folder when they
    are whole; stable_files() waits for those that are written in place.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return _named(raw.where("length > 0"))


def _named(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(ext.isin(WATCHED)).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), file_format(F.col("path")).alias("format"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("detected_at"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of a folder's files, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def stable_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """The watched files that two listings of a folder show with the same size, above 0, and time: nobody is writing them."""
    same = now.join(before.select("path", F.col("length").alias("__l"), F.col("modificationTime").alias("__t")), "path").where("length > 0 and length = __l and modificationTime = __t")
    return _named(same)


def each_new_file(spark: SparkSession, folder: str, checkpoint: str, callback: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Call callback(files, batch) on what is new: once with all there is, or for ever every five seconds."""
    w = watch(spark, folder).writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark (on ts as an instant); a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, total of events (ts, event_type, value) by window; the same on a stream, with a watermark."""
    e = _timed(events, late)
    g = e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select("event_type", F.col("window.start").alias("start"), "n", "cents")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = _timed(events, late)
    return e.groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop, n: a user's events without a pause of gap between them."""
    e = _timed(events, late)
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def latest_values(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark: a stream's cache of what was seen."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def fresh(rows: DataFrame, kind: str, now) -> DataFrame:
    """rows with freshness by age at the time now."""
    return rows.withColumn("freshness", T.freshness_by_age(F.unix_timestamp(now) - F.unix_timestamp("ts"))).withColumn("kind_freshness", T.freshness_by_ttl(F.col(kind)))
