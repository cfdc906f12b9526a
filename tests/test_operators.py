"""Operators on small fixtures with known results."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators import answers as A
from tallyfold.operators import cache as K
from tallyfold.operators import cells as C
from tallyfold.operators import debate as D
from tallyfold.operators import reports as P
from tallyfold.operators import retrieval as R
from tallyfold.operators import routing as G
from tallyfold.operators import sections as S
from tallyfold.operators import statistics as Q
from tallyfold.operators import transcripts as X
from tallyfold.sources import feeds, files, html
from tallyfold.streaming import streams as W

CELL = "doc_id string, ord int, row_header string, col_header string, value string, unit string, page int, section string, company string, doc_type string, fiscal_year string"


def cell(k, name, value, year="FY2022", col="FY2022"):
    return ("d", k, name, col, value, "millions", 94, "INCOME", "APPLE", "10-K", year)


@pytest.fixture(scope="module")
def filing(spark):
    rows = [cell(1, "Total net sales", "365,817", "FY2021", "FY2021"), cell(2, "Total net sales", "394,328"), cell(3, "Net income", "99,803"), cell(4, "Loss", "(1,200)")]
    return spark.createDataFrame(rows, CELL)


def test_lookup_prefers_the_asked_year(spark, filing):
    q = spark.createDataFrame([("a", "d", "What was total net sales FY2022?"), ("b", "d", "Who is the CEO?"), ("c", "d", None)], "question_id string, doc_id string, question string")
    got = {r.question_id: r for r in C.lookup(q, filing).collect()}
    assert got["a"].hit and got["a"].value == "394,328" and got["a"].confidence >= 0.95
    assert got["a"].citation == "APPLE/10-K/FY2022/INCOME/94"
    assert not got["b"].hit and got["b"].confidence == 0 and not got["c"].hit


def test_derived_metric_needs_both(spark):
    rows = [cell(1, "us-gaap:NetCashProvidedByUsedInOperatingActivities", "1,000"), cell(2, "us-gaap:PaymentsToAcquireProductiveAssets", "(300)")]
    q = spark.createDataFrame([("a", "d", "free cash flow?")], "question_id string, doc_id string, question string")
    assert C.lookup(q, spark.createDataFrame(rows, CELL)).first().value == "700"
    assert not C.lookup(q, spark.createDataFrame(rows[:1], CELL)).first().hit


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("text", "number"), [("(50,672)", -50672), ("42.5%", 42.5), ("-2,000", -2000), ("N/A", None), ("", None), ("nan", None), ("5d", None), ("$ 7", 7)])
def test_parse_numeric(spark, text, number):
    assert one(spark, T.parse_numeric(F.col("t")), t=text) == number


@pytest.mark.parametrize(("text", "year"), [("sales FY22", "FY2022"), ("sales in 2021", "FY2021"), ("sales", None), ("fiscal year 2019", "FY2019")])
def test_query_year(spark, text, year):
    assert one(spark, T.query_year(F.col("t")), t=text) == year


def test_core_answer_stops_at_a_point(spark):
    assert one(spark, T.core_answer(F.col("t")), t="EPS was 6.13 [X/P1]") == "6"


def test_first_digits(spark):
    v = spark.createDataFrame([(x,) for x in (0.0049, -900.0, 1.0, 0.0, 99.99, 1e12)], "v double")
    assert [r[0] for r in v.select(T.first_digit(F.col("v"))).collect()] == [4, 9, 1, None, 9, 1]


def test_benford_golden(spark):
    values = [394328.0, 394328.0, 24.0, 99803.0, 93736.0, 5.0, 38.0, 31.0, 3.0, 1.0]
    d = spark.createDataFrame([("k", v) for v in values], "k string, value double")
    r = Q.benford(d, "k").first()
    assert r.chi2 == pytest.approx(20.9146, abs=1e-3) and r.p_value == pytest.approx(0.007378, abs=1e-5) and r.anomaly


def test_value_at_risk_golden(spark):
    d = spark.createDataFrame([("k", x) for x in (-0.016521, -0.045833)], "k string, ret double")
    r = Q.value_at_risk(d, "k").first()
    assert r.var_95 == pytest.approx(-0.044367, abs=1e-5) and r.var_99 == pytest.approx(-0.045540, abs=1e-5)


def test_monte_carlo_is_seeded_and_near_theory(spark):
    d = spark.createDataFrame([("k", 100.0)], "k string, base double")
    a, b = Q.monte_carlo(d, "k").first(), Q.monte_carlo(d.repartition(3), "k").first()
    assert a == b and a["mean"] == pytest.approx(105, abs=0.6) and a["std"] == pytest.approx(15, abs=0.5)


def test_isolation_finds_the_far_value(spark):
    d = spark.createDataFrame([("k", i, float(i % 7)) for i in range(60)] + [("k", 99, 1e6)], "k string, id long, value double")
    got = Q.isolation_forest(d, "k", "string")
    assert got.orderBy(F.desc("score")).first().id == 99 and got.where("outlier").count() <= 7


@pytest.mark.parametrize(("answers", "status", "winner", "confidence"), [(["$100 m", "$100.2 m", "100"], "unanimous", "p1", 0.95), (["100", "200", "100"], "majority", "p1", 0.95), (["100", "200", "300"], "fallback", "p1", 0.76), (["", "200", None], "unanimous", "p2", 0.8)])
def test_mediation(spark, answers, status, winner, confidence):
    d = spark.createDataFrame([("q", i, f"p{i}", a, c) for i, (a, c) in enumerate(zip(answers, (0.95, 0.8, 0.7), strict=True), 1)], "question_id string, pod_order int, pod_name string, answer string, confidence double")
    r = A.mediate(d).first()
    assert (r.status, r.winner, r.confidence) == (status, winner, confidence)


def test_fusion_golden(spark):
    a = spark.createDataFrame([("q", c, i) for i, c in enumerate("ABCDE", 1)], "question_id string, id string, rank int")
    b = spark.createDataFrame([("q", c, i) for i, c in enumerate("BACFG", 1)], "question_id string, id string, rank int")
    got = R.fuse([a, b], "id").orderBy("rank").collect()
    assert [r.id for r in got[:3]] == ["A", "B", "C"] and got[0].score == pytest.approx(0.032522, abs=1e-6) and got[2].score == pytest.approx(0.031746, abs=1e-6)


def packed_by_hand(text, size, overlap, least):
    import re

    text = text.strip()
    if len(text) <= size:
        return [text] if len(text) >= least else []
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(cur) + len(s) > size and cur:
            out += [cur] if len(cur) >= least else []
            cur = cur[-overlap:] + " " + s
        else:
            cur = (cur + " " + s).strip()
    return out + ([cur] if len(cur) >= least else [])


def test_sentence_packing(spark):
    texts = ["", "short.", "A sentence here. " * 40, "x" * 500, "One. Two! Three? " * 30 + "tail"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", S.packed_sentences(F.col("t"), 120, 20, 10).alias("c")).collect():
        assert r.c == packed_by_hand(r.t, 120, 20, 10)


def test_table_cells_and_styled_headings(spark):
    page = '<table><tr><th>Metric</th><th>FY2023</th></tr><tr><td>Sales</td><td>$ 5</td></tr><tr><td>Cost</td><td>-</td></tr></table><span style="font-size:14pt; font-weight:bold">Item 1. Business</span><span>Item 1A.</span><span>item 1a.</span>'
    d = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [(r.row_header, r.col_header, r.value) for r in html.table_cells(d).collect()] == [("Sales", "FY2023", "$ 5")]
    assert [r.text for r in html.styled_headings(d).collect()] == ["Item 1. Business"]
    assert [r.text for r in html.section_markers(d).collect()] == ["Item 1A."]


def test_fact_metadata(spark):
    page = '<ix:nonNumeric name="dei:EntityRegistrantName" contextRef="c-1"> Apple Inc. </ix:nonNumeric><ix:nonNumeric name="dei:DocumentType">10-K</ix:nonNumeric><ix:nonNumeric name="dei:DocumentFiscalYearFocus">2023</ix:nonNumeric>'
    r = html.fact_metadata(html.text_facts(spark.createDataFrame([(1, page)], "page_id long, html string"))).first()
    assert (r.company, r.doc_type, r.fiscal_year) == ("Apple Inc.", "10-K", "FY2023")


def zipped(**parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return raw.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    (tmp_path / "a.docx").write_bytes(zipped(word__document=f'<w:d {w}><w:p><w:pPr><w:pStyle w:val="Heading 1"/></w:pPr><w:r><w:t>Risk</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>M</w:t></w:p></w:tc><w:tc><w:p><w:t>FY1</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>Sales</w:t></w:p></w:tc><w:tc><w:p><w:t>7</w:t></w:p></w:tc></w:tr></w:tbl></w:d>'))
    (tmp_path / "b.xlsx").write_bytes(zipped(xl__workbook='<w><sheets><sheet name="S1"/></sheets></w>', xl__sharedStrings="<s><si><t>M</t></si><si><t>FY2</t></si><si><t>Cost</t></si></s>", xl__worksheets__sheet1='<w><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>9</v></c></row></w>'))
    (tmp_path / "c.pptx").write_bytes(zipped(ppt__slides__slide1='<a><p><r><rPr sz="2400" b="1"/><t>Title</t></r></p><p><r><rPr sz="1000"/><t>small</t></r></p></a>'))
    (tmp_path / "d.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "e.txt").write_bytes(b"caf\xe9")
    (tmp_path / "f.csv").write_text("Metric,FY3\nSales,5\nCost,\n")
    f = str(tmp_path)
    assert [r.text for r in files.docx_headings(files.files(spark, f, "docx")).collect()] == ["Risk"]
    assert [(r.row_header, r.col_header, r.value) for r in files.docx_cells(files.files(spark, f, "docx")).collect()] == [("Sales", "FY1", "7")]
    assert "Body" in files.docx_texts(files.files(spark, f, "docx")).first().text
    assert [(r.row_header, r.col_header, r.value, r.section) for r in files.xlsx_cells(files.files(spark, f, "xlsx")).collect()] == [("Cost", "FY2", "9", "S1")]
    assert [r.text for r in files.pptx_headings(files.files(spark, f, "pptx")).collect()] == ["Title"]
    assert '"a": 1' in files.json_texts(files.files(spark, f, "json")).first().text
    assert files.texts(files.files(spark, f, "txt")).first().text == "caf�"
    assert [(r.row_header, r.col_header, r.value) for r in files.csv_cells(spark, f"{f}/f.csv").collect()] == [("Sales", "FY3", "5")]


def test_segments(spark):
    d = spark.createDataFrame([(1, "lost\nOperator: Hello.\nTim Cook - CEO: We expect growth.\nMore.\n\nA: no\nLuca - CFO: Risk is low.")], "id int, text string")
    got = X.segments(d, "id").orderBy("position").collect()
    assert [(r.position, r.role) for r in got] == [(0, "Operator"), (1, "CEO"), (2, "CFO")] and got[1].text == "We expect growth. More. A: no"


def fake(prompt, temperature):
    if "Write a plan" in prompt:
        return "PLAN: read"
    if "Check the ANSWER" in prompt:
        return "V1_SCOPE Result: PASS\nV2_UNITS Result: FAIL\nREJECT_REASONS: unit" if "bad" in prompt else "V1_SCOPE Result: PASS"
    if "boom" in prompt:
        raise ValueError("down")
    return "ANSWER: bad 5\nCONFIDENCE: 0.9" if "hard" in prompt else "ANSWER: 5 million\nCONFIDENCE: 0.9"


def test_debate(spark):
    q = spark.createDataFrame([("a", "easy", "c"), ("b", "hard", "c"), ("c", "boom", "c")], "question_id string, question string, context string")
    got = {r.question_id: r for r in D.debate(q, fake).collect()}
    assert got["a"].verdict == "PASS" and got["a"].confidence == pytest.approx(0.9) and got["a"].attempts == 1
    assert got["b"].verdict == "EXHAUSTED" and got["b"].attempts == 4 and got["b"].low_confidence
    assert got["c"].verdict == "ERROR ValueError"
    assert D.attempt("q", "it was $5 million", None)[0] == "$5 million"


def test_private_columns_never_leave(spark, tmp_path):
    d = spark.createDataFrame([(1, 2)], "a int, _rlef_grade int")
    P.write_table(d, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["a"] and "_rlef" not in P.markdown(d, "x")
    P.append_results(d, str(tmp_path / "r"))
    assert P.unfinished(spark.createDataFrame([(1,), (2,)], "a int"), str(tmp_path / "r"), "a").first().a == 2


def test_chi_square_of_accuracy():
    chi, p = A.chi_square_accuracy(0, 3)
    assert 0 <= p <= 1 and A.chi_square_accuracy(60, 100)[1] > 0.9


def test_watch_sees_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    (folder / "b.exe").write_text("x")
    for _ in range(2):
        W.each_new_file(spark, str(folder), str(tmp_path / "cp"), lambda d, n: seen.extend(r.filename for r in d.collect())).awaitTermination()
    assert seen == ["a.txt"]


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    W.tumbling(s).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, spark.table("win").collect())) == sorted(map(str, W.tumbling(e).collect()))


def test_feeds(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"cik": "0000320193", "form_type": "10-K", "filed_date": "2023-11-03", "accession_number": "1", "document_url": "u"}\n')
    assert feeds.filings(spark, str(tmp_path), "aapl", "10-K").first().fiscal_year == "FY2023"
    with pytest.raises(ValueError, match="unknown form"):
        feeds.filings(spark, str(tmp_path), "aapl", "X")


def test_csv_files_have_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Metric,FY1,"FY 2"\nSales,5,"1,000"\n')
    (tmp_path / "b.csv").write_text("Item,FY9\n\nCost,7\n,3\nTax, \n")
    got = {(r.path[-5:], r.row_header, r.col_header, r.value) for r in files.csv_cells(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", "Sales", "FY1", "5"), ("a.csv", "Sales", "FY 2", "1,000"), ("b.csv", "Cost", "FY9", "7")}


def test_only_files_at_rest_are_stable(spark, tmp_path):
    (tmp_path / "a.txt").write_text("whole")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.txt").write_text("")
    before = spark.createDataFrame(W.listed(spark, str(tmp_path)).collect(), "path string, length long, modificationTime timestamp")
    (tmp_path / "b.txt").write_text("x and more")
    (tmp_path / "d.txt").write_text("new")
    assert [r.filename for r in W.stable_files(before, W.listed(spark, str(tmp_path))).collect()] == ["a.txt"]


class Flaky(feeds.FetchSource):
    @classmethod
    def name(cls):
        return "flaky"

    def fetch(self, key):
        if key == "down":
            raise OSError
        return None if key == "none" else key.upper()


def test_every_key_of_a_fetch_has_a_status(spark):
    spark.dataSource.register(Flaky)
    got = {r.key: (r.value, r.status, r.tries) for r in spark.read.format("flaky").option("keys", "a,down,none").option("pause", "0").load().collect()}
    assert got == {"a": ("A", "ok", 1), "down": (None, "failed: OSError", 3), "none": (None, "empty", 1)}


def test_cache_takes_live_rows(spark):
    cache = spark.createDataFrame([("a", "k", "old", 1), ("b", "k", "own", 1)], "key string, kind string, value string, t int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = K.fetched(spark.createDataFrame([("a", "k"), ("c", "k"), ("d", "k")], "key string, kind string"), cache.where("key = 'b'"), spark.createDataFrame([("a", "new"), ("c", "see")], "key string, value string"), "key")
    assert {(r.key, r.value) for r in K.written_back(cache, got, "key", F.timestamp_seconds(F.lit(9))).collect()} == {("a", "new"), ("b", "own"), ("c", "see")}
    assert K.summary_text(got, "key") == "k: 2 of 3 (0 cached, 2 live); without: d"


def test_gate_without_hits_is_a_miss(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    hits = "question_id int, id int, score double, rank int"
    sparse, dense = spark.createDataFrame([(1, 5, 2.0, 1)], hits), spark.createDataFrame([(2, 5, 0.1, 1)], hits)
    final = spark.createDataFrame([(1, 0.9), (2, 0.1)], "question_id int, reranker_score double")
    g = R.gate(q, sparse, dense, final)
    assert {r.question_id: r.signal for r in g.collect()} == {1: True, 2: False, 3: False}
    out = {r.question_id: r.answer for r in R.early_exit(g, spark.createDataFrame([(1, "text")], "question_id int, text string"), llm=False).collect()}
    assert out == {1: "LLM_UNAVAILABLE: text", 2: "INSUFFICIENT_DATA", 3: "INSUFFICIENT_DATA"}


def test_chunks_by_section_then_paragraph_then_whole(spark):
    body = "This section tells of many things at length, so that it is a chunk. " * 2
    docs = spark.createDataFrame([(1, f"Risks\n{body}\nCredit risk\n{body}\nResults\n{body}"), (2, f"{body}\n\n{body}"), (3, "short")], "id int, text string")
    heads = spark.createDataFrame([(1, 0, "Risks", None), (1, 1, "Credit risk", 0), (1, 2, "Results", None)], "id int, ord int, text string, parent int")
    got = [(r.id, r.chunk_id, r.section) for r in S.chunk_documents(docs, "id", heads).orderBy("id", "chunk_id").collect()]
    assert got == [(1, "chunk_0000", "Risks"), (1, "chunk_0001", "Credit risk"), (1, "chunk_0002", "Results"), (2, "chunk_0000", "DOCUMENT"), (2, "chunk_0001", "DOCUMENT"), (3, "chunk_0000", "DOCUMENT")]
    credit = {r.section: r.text for r in S.section_chunks(heads, docs, "id").collect()}["Credit risk"]
    assert credit.startswith("Credit risk") and "Results" not in credit and S.chunk_documents(docs, "id", heads, cap=1).count() == 3


def test_facts_with_nested_tags_and_single_quotes(spark):
    page = "<ix:nonFraction name='us-gaap:Assets' contextRef=\"c-1\" unitRef='USD' scale='3'><span>1,</span>200</ix:nonFraction>"
    r = html.facts(spark.createDataFrame([(1, page)], "page_id int, html string")).first()
    assert (r.name, r.context, r.scaled) == ("us-gaap:Assets", "c-1", 1200000.0)


def test_checks_of_a_validator():
    assert D.checked("V1_SCOPE Result: PASS") == (True, "") == D.checked("")
    passed, why = D.checked("V3_SIGN: wrong. Result: FAIL\nREJECT_REASONS: sign\nRETRY_INSTRUCTIONS: again")
    assert not passed and why == "V3_SIGN sign again"


def test_router_on_questions_it_was_not_trained_on(spark):
    kinds = {"numeric": ["what was total revenue in {}", "how much net income in {}", "what were the assets in {}"], "text": ["who wrote the report of {}", "why did the board change in {}", "describe the risks of {}"]}
    rows = [(f"{k}{y}{i}", q.format(y), k) for k, qs in kinds.items() for y in range(2000, 2012) for i, q in enumerate(qs)]
    d = spark.createDataFrame(rows, "question_id string, question string, label string")
    model = G.train_router(d.where("question not like '%2010' and question not like '%2011'"))
    new = d.where("question like '%2010' or question like '%2011'")
    got = G.classify(model, new.select("question_id", "question"), "numeric").join(new, "question_id")
    assert got.where("predicted = label").count() >= 0.8 * got.count()
    assert G.classify(model, spark.createDataFrame([("x", "")], "question_id string, question string"), "numeric").first().predicted == "numeric"
