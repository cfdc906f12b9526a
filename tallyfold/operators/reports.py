"""Sinks: tables, caches and reports. Everything written passes the privacy guard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .answers import public


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    out = public(df).write.mode(mode)
    (out.partitionBy(*partition) if partition else out).parquet(path)


def write_cache(df: DataFrame, path: str, partition: list[str]) -> None:
    """JSON lines below one folder for each partition value."""
    public(df).write.mode("overwrite").partitionBy(*partition).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results of a run so far; unfinished() tells what a later run has to do."""
    public(df).write.mode("append").parquet(path)


def unfinished(questions: DataFrame, path: str, key: str) -> DataFrame:
    done = questions.sparkSession.read.parquet(path).select(key).distinct()
    return questions.join(done, key, "left_anti")


def markdown(df: DataFrame, title: str, limit: int = 50) -> str:
    """A report table of the first rows of a summary."""
    d = public(df)
    lines = [f"# {title}", "", "| " + " | ".join(d.columns) + " |", "|" + " --- |" * len(d.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in d.limit(limit).collect()])
