"""Readers, guards and lookups that no query runs."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import cache as K
from tallyfold.operators import debate as D
from tallyfold.operators import retrieval as R
from tallyfold.plans import registry
from tallyfold.sources import feeds, files


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Metric,"FY\n1"\n\nSales,"5\nand more"\nCost,"7"\n')
    (tmp_path / "b.csv").write_text('Metric,FY1\n"Sa ""x""",5\n')
    got = {(r.path[-5:], r.row_header, r.col_header, r.value) for r in files.csv_cells(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", "Sales", "FY\n1", "5\nand more"), ("a.csv", "Cost", "FY\n1", "7"), ("b.csv", 'Sa "x"', "FY1", "5")}


def test_benchmark_questions_have_defaults(spark, tmp_path):
    q = [{"financebench_id": "1", "doc_name": "A", "question": "q", "answer": "5"}, {"financebench_id": "2", "doc_name": "B", "question": "r", "answer": 7}, {"financebench_id": "3", "doc_name": "C", "question": "s"}]
    d = [{"doc_name": "A", "company": "Acme", "doc_type": "10-Q", "doc_period": 2021}, {"doc_name": "A", "company": "Acme", "doc_type": "10-Q", "doc_period": 2021}, {"doc_name": "B", "company": "Bee"}]
    for name, rows in (("q", q), ("d", d)):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    got = {r.question_id: tuple(r)[3:] for r in feeds.benchmark_questions(spark, str(tmp_path / "q"), str(tmp_path / "d")).collect()}
    assert got == {"1": ("5", "Acme", "10-Q", "FY2021"), "2": ("7", "Bee", "10-K", "FY0"), "3": ("", "UNKNOWN", "10-K", "FY0")}


def test_lookups_compile(spark, sf):
    """Generated code of the flagship stays below the limit of a method; with the fallback off an error would be raised."""
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("sniper_lookup", "score_candidates"):
            assert registry.queries()[name](spark, sf).count() > 0
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_guard_and_deletion(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    assert K.guard(rows, True).count() == 0 and K.guard(rows, False).count() == 2
    assert [r.key for r in K.delete(rows, rows.where("n = 1"), "key").collect()] == ["b"]


def test_failed_keys_are_named(spark):
    rows = [("k", f"x{i:02d}", "none") for i in range(15)] + [("k", "y", "live"), ("m", "z", "cache")]
    text = K.summary_text(spark.createDataFrame(rows, "kind string, key string, source string"), "key")
    assert text == "k: 1 of 16 (0 cached, 1 live); without: " + ", ".join(f"x{i:02d}" for i in range(10)) + "\nm: 1 of 1 (1 cached, 0 live)"


def test_an_auditor_sees_its_own_rows(spark):
    c = spark.createDataFrame([("q", "p1", "a"), ("q", "p2", "b")], "question_id string, pod_name string, answer string")
    assert [r.answer for r in D.blind_context(c, "p2").collect()] == ["b"]


def test_metadata_has_kinds_and_defaults(spark):
    d = spark.createDataFrame([("1", None, None, "10-K", None, None, "x"), ("2", "t", "A", None, "FY1", "S", "7")], "chunk_id string, text string, company string, doc_type string, fiscal_year string, section string, page string")
    assert sorted(map(tuple, R.metadata(d).collect())) == [("1", "", "UNKNOWN", "10-K", "UNKNOWN", "DOCUMENT", 0), ("2", "t", "A", "UNKNOWN", "FY1", "S", 7)]


@pytest.mark.parametrize("text, year", [("revenue in FY 2023?", "FY2023"), ("fiscal year 2019", "FY2019"), ("fy'21 sales", "FY2021"), ("nothing", None), (None, None)])
def test_years_of_questions(spark, text, year):
    from tallyfold.functions import text as T

    assert spark.createDataFrame([(text,)], "t string").select(T.query_year(F.col("t"))).first()[0] == year
