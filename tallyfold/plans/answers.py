"""Queries over candidate answers, grades, evaluations and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import answers as A
from ..operators import routing as G
from ..operators import transcripts as R
from ..operators.keyed_table import KeyedTable
from ..operators.written import scratch_path, written
from .finance import q


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _candidates(spark, sf):
    """Three pods' answers to each order's total: its price, its lines' sum in thousands, and its customer's words."""
    o = _t(spark, sf, "orders")
    dollars = F.format_number(F.floor("o_totalprice"), 0)
    near = F.format_number(F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1.004).when(F.col("o_orderkey") % 3 == 1, 1.3).otherwise(1.0)), 0)
    year = F.year("o_orderdate").cast("string")
    answers = F.array(
        F.struct(F.lit(1).alias("pod_order"), F.lit("LeadAnalyst").alias("pod_name"), F.concat(F.lit("The total was $"), dollars, F.lit(" [ORDERS/P"), (F.col("o_orderkey") % 90).cast("string"), F.lit("] in FY"), year).alias("answer"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit(2).alias("pod_order"), F.lit("QuantPod").alias("pod_name"), F.concat(F.lit("$"), near, F.lit(" million in "), year, F.when(F.col("o_orderkey") % 5 == 0, F.lit(" (12)")).otherwise("")).alias("answer"), ((F.col("o_orderkey") % 7 + 60) / 100.0).alias("confidence")),
        F.struct(F.lit(3).alias("pod_order"), F.lit("AuditorPod").alias("pod_name"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Revenue "), near)).otherwise(F.concat(F.lit("However the gross profit of status "), "o_orderstatus", F.lit(" is not shown"))).alias("answer"), F.lit(0.7).alias("confidence")),
    )
    return o.select(F.col("o_orderkey").alias("question_id"), F.inline(answers))


_D = "format('{:,}', floor(o_totalprice)::BIGINT)"
_NEAR = "format('{:,}', floor(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1.004::DOUBLE WHEN 1 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)::BIGINT)"
_CAND = f"""cand AS (SELECT o_orderkey AS question_id, 1 AS pod_order, 'LeadAnalyst' AS pod_name, 'The total was $' || {_D} || ' [ORDERS/P' || (o_orderkey % 90) || '] in FY' || year(o_orderdate) AS answer, 0.9::DOUBLE AS confidence FROM orders
 UNION ALL SELECT o_orderkey, 2, 'QuantPod', '$' || {_NEAR} || ' million in ' || year(o_orderdate) || CASE WHEN o_orderkey % 5 = 0 THEN ' (12)' ELSE '' END, (o_orderkey % 7 + 60) / 100.0::DOUBLE FROM orders
 UNION ALL SELECT o_orderkey, 3, 'AuditorPod', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Revenue ' || {_NEAR} ELSE 'However the gross profit of status ' || o_orderstatus || ' is not shown' END, 0.7::DOUBLE FROM orders)"""
_CORE = r"(SELECT CASE WHEN regexp_matches(c, '[\d,]') THEN regexp_replace(regexp_extract(c, '\$?[\d,]+(?:\.\d+)?'), '[$,]', '', 'g') ELSE trim(lower(substr(c, 1, 100))) END FROM (SELECT trim(regexp_split_to_array(regexp_replace({0}, '\[.*?\]', '', 'g'), '[.!?]')[1]) AS c))"
_NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _agree(a: str, b: str) -> str:
    return f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN false WHEN regexp_matches({a}, {_NUM}) AND regexp_matches({b}, {_NUM}) THEN CASE WHEN {a}::DOUBLE = 0 AND {b}::DOUBLE = 0 THEN true WHEN {a}::DOUBLE = 0 OR {b}::DOUBLE = 0 THEN false ELSE abs({a}::DOUBLE - {b}::DOUBLE) / greatest(abs({a}::DOUBLE), abs({b}::DOUBLE)) < 0.01 END ELSE trim(lower(substr({a}, 1, 50))) = trim(lower(substr({b}, 1, 50))) END)"


def core_answer(spark, sf):
    return _candidates(spark, sf).select("question_id", "pod_order", T.core_answer(F.col("answer")).alias("core"))


def _two(spark, sf):
    c = _candidates(spark, sf)
    a = c.where("pod_order = 1").select("question_id", F.col("answer").alias("a"))
    return a.join(c.where("pod_order = 2").select("question_id", F.col("answer").alias("b")), "question_id")


_TWO = f"{_CAND}, two AS (SELECT x.question_id, x.answer AS a, y.answer AS b FROM cand x JOIN cand y ON x.question_id = y.question_id AND x.pod_order = 1 AND y.pod_order = 2)"


def answers_agree(spark, sf):
    return _two(spark, sf).select("question_id", T.answers_agree_loose(F.col("a"), F.col("b")).alias("agree"))


def majority_vote(spark, sf):
    return A.pairs(_candidates(spark, sf))


def mediate(spark, sf):
    return A.mediate(_candidates(spark, sf))


def answer_contradictions(spark, sf):
    return _two(spark, sf).select("question_id", F.concat_ws(",", A.contradictions(F.col("a"), F.col("b"))).alias("contradictions"))


def contradiction_lines(spark, sf):
    return A.contradiction_lines(_t(spark, sf, "documents").select("doc_id", F.concat(F.lit("However it differs from page "), F.col("n_chars").cast("string"), F.lit("\n"), "text").alias("answer")), "doc_id")


def word_overlap(spark, sf):
    """Of each benchmark item with the previous one."""
    b = _t(spark, sf, "benchmark")
    prev = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("context"))
    return b.join(prev, "item_id").select("item_id", F.round(T.word_overlap(F.col("text"), F.col("context")), 6).alias("overlap"))


def candidate_features(spark, sf):
    c = _candidates(spark, sf)
    f = A.features(F.col("answer"), F.col("confidence"), F.size(F.regexp_extract_all("answer", F.lit(r"\[[^\]]*\]"), F.lit(0))), F.lit("The total gross profit was million"), F.col("pod_order"), F.col("confidence") < 0.65)
    return c.select("question_id", "pod_order", *(F.round(v, 6).alias(k) for k, v in f.items()))


def _graded_features(spark, sf):
    """Candidates with their seven numbers and their grade against the order's price."""
    return candidate_features(spark, sf).join(_graded(spark, sf).select("question_id", "pod_order", "total"), ["question_id", "pod_order"])


FEATURES = ["f_confidence", "f_citations", "f_length", "f_numeric", "f_overlap", "f_attempts", "f_sure"]


def answer_ranker(spark, sf):
    """Every candidate's place by a ranker that is trained on all pairs of different grades of four fifths of the questions."""
    rows = written(_graded_features(spark, sf))
    model = G.train_ranker(rows.where(F.pmod(F.xxhash64("question_id"), F.lit(5)) > 0), "question_id", "total", FEATURES, rounds=10, every=True)
    return G.ranked(model, rows, "question_id", "pod_order", FEATURES)


def mean_attributions(spark, sf):
    """What a forest that tells good grades from others goes by."""
    rows = written(_graded_features(spark, sf).withColumn("label", (F.col("total") >= 8).cast("double")).withColumn("id", F.col("question_id") * 10 + F.col("pod_order")))
    return G.feature_importance(rows, "id", FEATURES)


def arbiter_fallback(spark, sf):
    return A.arbiter(_candidates(spark, sf)).select("question_id", "pod_name", "arbiter_score")


def numbers_in_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.concat_ws(",", F.transform(T.numbers(F.col("text")), lambda x: F.when(x < 1e9, F.round(x * 100).cast("long")).otherwise(-1).cast("string"))).alias("numbers"))


def numbers_distinct(spark, sf):
    found = F.filter(T.numbers(F.col("text"), cap=None), lambda x: x < 1e15)
    return _t(spark, sf, "documents").select("doc_id", F.size(F.slice(F.array_distinct(found), 1, 500)).alias("n"))


_NUMS = r"list_filter(list_transform(regexp_extract_all({0}, '\$?([\d,]+(?:\.\d+)?)', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x > 0)"


def context_first(spark, sf):
    """Whether each document's first benchmark-like word stands before its last."""
    b = _t(spark, sf, "benchmark")
    p = F.concat(F.when(F.col("item_id") % 3 == 0, F.lit("QUESTION: ?\nCONTEXT: ")).otherwise(F.lit("CONTEXT: ")), "text", F.lit("\nQUESTION: what?"))
    return b.select("item_id", A.context_first(p).alias("ok"))


def dag_nodes(spark, sf):
    return _candidates(spark, sf).select("question_id", "pod_order", F.concat_ws(",", A.cause_nodes(F.col("answer"))).alias("nodes"))


def dag_levels(spark, sf):
    """Causal levels of line items, with how many answers speak of each."""
    edges = spark.createDataFrame(L.CAUSES, "cause string, effect string")
    starts = sorted({c for c, _ in L.CAUSES} - {e for _, e in L.CAUSES})
    n = _candidates(spark, sf).select(F.explode(A.cause_nodes(F.col("answer"))).alias("node")).groupBy("node").agg(F.count("*").alias("answers"))
    return A.reachable(edges, starts).join(n, "node", "left").select("node", "level", F.coalesce("answers", F.lit(0)).cast("long").alias("answers"))


def dag_values(spark, sf):
    return _candidates(spark, sf).select("question_id", "pod_order", F.inline(A.cause_values(F.col("answer"))))


def labels(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", A.confidence_label(F.abs("c_acctbal") / 10000).alias("confidence"), A.risk_label(F.abs("c_acctbal") / 100).alias("risk"))


def final_answer(spark, sf):
    c = _candidates(spark, sf).where("pod_order = 3").select("question_id", F.col("answer").alias("ranked"))
    p = _candidates(spark, sf).where("pod_order = 1").select("question_id", F.col("answer").alias("plain"))
    return c.join(p, "question_id").select("question_id", A.final_answer(F.col("ranked"), F.col("plain")).alias("final_answer"))


def report_view(spark, sf):
    """A report's rows: answer, label and excerpt, without private columns."""
    m = A.mediate(_candidates(spark, sf)).withColumn("_rlef_grade", F.lit(1))
    return A.public(m).select("question_id", "status", A.confidence_label(F.col("confidence")).alias("label"), F.substring("answer", 1, 350).alias("excerpt"))


def prompt(spark, sf):
    """Each conversation's first turns as context of its second user turn."""
    c = _t(spark, sf, "conversations")
    chunks = c.where("role = 'assistant'").select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).cast("int").alias("rank"), "text")
    questions = c.where("role = 'user'").groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"))
    return A.prompt(chunks, questions)


def parse_llm(spark, sf):
    c = _candidates(spark, sf)
    reply = F.concat(F.lit("ANSWER: "), "answer", F.lit("\nCONFIDENCE: "), F.col("confidence").cast("string"), F.lit("\nCITATIONS: [A/P1], [B/P2]\n"))
    got = A.parse_reply(reply)
    return c.select("question_id", "pod_order", got["answer"].alias("reply_answer"), got["confidence"].alias("reply_confidence"), F.size(got["citations"]).alias("n_citations"))


def _replies(spark, sf):
    """Replies of the three kinds of call, made of each order's answers."""
    c = _candidates(spark, sf)
    plan = F.concat(F.lit("CURIOSITY_Q1: why\nCURIOSITY_Q2: how "), "pod_name", F.when(F.col("pod_order") == 1, F.concat(F.lit("\nANALYSIS_PLAN: look up "), "answer")).otherwise(""), F.lit("\nRETRIEVAL_HINTS: total, , tax\nVALIDATION_CRITERIA: cite"))
    answer = F.when((F.col("pod_order") == 3) & (F.col("question_id") % 4 == 0), F.lit("RETRIEVAL_MISS: the table of prices")).otherwise(F.concat(F.lit("ANSWER: "), "answer", F.lit("\nCOMPUTATION: none\nCONFIDENCE: "), F.col("confidence").cast("string"), F.lit("\nCITATIONS: [A/P1]")))
    verdict = F.concat(F.lit("V1_SCOPE Result: PASS\nV3_SIGN Result: "), F.when(F.col("question_id") % 3 == 0, "FAIL").otherwise("PASS"), F.lit("\nREJECT_REASONS: 1. sign is off\n2. no unit\nRETRY_INSTRUCTIONS: read again"))
    return c.select("question_id", "pod_order", plan.alias("plan_reply"), answer.alias("answer_reply"), verdict.alias("verdict_reply"))


def parse_plan(spark, sf):
    got = A.parse_plan(F.col("plan_reply"), F.col("question_id").cast("string"))
    return _replies(spark, sf).select("question_id", "pod_order", got["plan"].alias("plan"), F.concat_ws("|", got["hints"]).alias("hints"), got["criteria"].alias("criteria"), F.concat_ws("|", got["curiosity"]).alias("curiosity"))


def parse_answer(spark, sf):
    got = A.parse_answer(F.col("answer_reply"), F.col("pod_order"))
    return _replies(spark, sf).select("question_id", "pod_order", got["answer"].alias("reply_answer"), got["computation"].alias("computation"), got["confidence"].alias("reply_confidence"), F.size(got["citations"]).alias("n_citations"), got["needed"].alias("needed"))


def parse_verdict(spark, sf):
    got = A.parse_verdict(F.col("verdict_reply"))
    return _replies(spark, sf).select("question_id", "pod_order", got["passed"].alias("passed"), F.concat_ws("|", got["reasons"]).alias("reasons"), got["instructions"].alias("instructions"), got["checks"]["V3_SIGN"].alias("sign"), got["checks"]["V8_GROUNDING"].alias("grounding"))


def parse_json(spark, sf):
    """Events' properties as a model would quote them, in a code fence for half of them."""
    e = _t(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("n"))).alias("j"))
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.col("j"))
    return e.select("event_id", F.inline(F.array(A.parse_json(reply, "kind string, n long"))))


def prompt_templates(spark, sf):
    """Each customer's question in every template, with the length of what is rendered."""
    c = _t(spark, sf, "customer")
    parts = {"context": F.col("c_name"), "question": F.concat(F.lit("balance of "), "c_name"), "plan": F.col("c_mktsegment"), "rejected": F.lit(""), "answer": F.round("c_acctbal").cast("long"), "answers": F.col("c_mktsegment"), "checks": F.lit(", ".join(A.CHECKS))}
    rows = F.array(*(F.struct(F.lit(t).alias("template"), A.rendered(t, **parts).alias("text")) for t in A.TEMPLATES))
    d = c.select("c_custkey", F.inline(rows))
    return d.select("c_custkey", "template", F.md5("text").alias("md5"), A.context_first(F.col("text")).alias("ok"))


def arbiter_gate(spark, sf):
    return A.arbiter_gate(dpo_pairs(spark, sf), False)


def offline_answer(spark, sf):
    return _candidates(spark, sf).select("question_id", "pod_order", A.offline_answer(F.col("answer")).alias("amount"))


def _graded(spark, sf):
    c = _candidates(spark, sf)
    g = A.grade(F.col("answer"), F.when(F.col("question_id") % 2 == 0, "What was the total?").otherwise("Who wrote it?"), F.size(F.regexp_extract_all("answer", F.lit(r"\[[^\]]*\]"), F.lit(0))), F.when(F.col("question_id") % 6 == 0, F.lit("12")).otherwise(""))
    return c.select("question_id", "pod_order", *(v.alias(k) for k, v in g.items()))


def grade(spark, sf):
    return _graded(spark, sf)


def grade_distribution(spark, sf):
    return _graded(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


def grade_upsert(spark, sf):
    """One stored grade for each customer: the latest order's first pod."""
    g = _graded(spark, sf).where("pod_order = 1")
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), "o_custkey", "o_orderdate")
    return A.upsert(g.join(o, "question_id"), "o_custkey", "o_orderdate", "question_id").select("o_custkey", "question_id", "total", "label")


def grade_store(spark, sf):
    """The same from a stored table, which orders reach in four batches, the second one twice."""
    g = _graded(spark, sf).where("pod_order = 1").select("question_id", "total", "label")
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), "o_custkey", "o_orderdate")
    rows = written(g.join(o, "question_id").withColumn("batch", F.pmod(F.xxhash64("question_id"), F.lit(4)).cast("int")))
    table = KeyedTable(spark, scratch_path(spark), "o_custkey", "o_orderdate", "question_id", buckets=8)
    for batch in (0, 1, 1, 2, 3):
        table.upsert(rows.where(F.col("batch") == batch).drop("batch"), batch)
    return table.read().select("o_custkey", "question_id", "total", "label")


def dpo_pairs(spark, sf):
    """Of all pods' answers, so that good and bad ones meet."""
    g = _graded(spark, sf)
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderpriority", F.col("o_orderdate").alias("ts"))
    rows = g.join(o, "question_id").withColumn("session_id", F.col("question_id") * 10 + F.col("pod_order"))
    return A.preference_pairs(rows, "o_orderpriority", 3)


def _results(spark, sf):
    c = _candidates(spark, sf).where("pod_order = 2")
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("company"), F.col("o_totalprice").alias("total"), F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)).alias("expected"))
    m = A.eval_match(F.col("answer"), F.col("expected"))
    return c.join(o, "question_id").select("question_id", "company", "answer", "expected", *(v.alias(k) for k, v in m.items()), (F.col("question_id") % 11 == 0).alias("error"), "confidence", (F.floor("total") / 1000).alias("latency"), (F.col("confidence") > 0.63).alias("hit"))


def eval_match(spark, sf):
    return _results(spark, sf).select("question_id", "exact", "numeric")


def eval_summary(spark, sf):
    return A.eval_summary(_results(spark, sf).withColumn("run", F.lit("all")), ["run"])


def eval_by_company(spark, sf):
    return A.eval_summary(_results(spark, sf), ["company"])


def fb_score(spark, sf):
    r = _results(spark, sf)
    return r.select("question_id", *(v.alias(k) for k, v in A.gold_score(F.col("answer"), F.col("expected")).items()))


def gates(spark, sf):
    return A.gates(eval_summary(spark, sf))


def eval_resume_anti(spark, sf):
    """Questions that an interrupted run has still to answer."""
    r = _results(spark, sf)
    return r.select("question_id").join(r.where("error").select("question_id"), "question_id", "left_anti")


def questions_with_meta(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("company"), F.col("lang").alias("doc_period"))
    b = _t(spark, sf, "benchmark").join(d, "item_id", "left")
    return b.select("item_id", "text", F.coalesce("company", F.lit("UNKNOWN")).alias("company"), F.coalesce("doc_period", F.lit("UNKNOWN")).alias("doc_period"))


def _calls(spark, sf):
    """Conversations written as calls, each turn a speaker's line and one more."""
    c = _t(spark, sf, "conversations")
    who = F.when(F.col("role") == "user", "Jane Doe - Analyst").when(F.col("turn") % 4 == 1, "Tim Poe - CEO").when(F.col("turn") % 4 == 3, "Luca May - CFO").otherwise("Operator")
    line = F.concat(who, F.lit(": We expect strong growth, no risk. "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n it was weak and lower"))
    return c.groupBy("conv_id").agg(F.concat(F.lit("lost line\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n")).alias("text"))


def segments(spark, sf):
    return R.segments(_calls(spark, sf), "conv_id")


def role(spark, sf):
    return R.segments(_calls(spark, sf), "conv_id").groupBy("role").agg(F.count("*").alias("n"))


def sentiment(spark, sf):
    t = _t(spark, sf, "conversations").withColumn("text", F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(" strong growth beat")).otherwise(F.lit(" weak decline"))))
    return t.select("conv_id", "turn", *(v.alias(k) for k, v in R.sentiment(F.col("text")).items()))


def transcript_analysis(spark, sf):
    a = R.analysis(R.segments(_calls(spark, sf), "conv_id"), "conv_id")
    return a.select("conv_id", "net", "ceo_net", "cfo_net", F.size("guidance").alias("n_guidance"), F.size("risks").alias("n_risks"), F.concat_ws("|", "speakers").alias("speakers"))


QUERIES = {f.__name__: f for f in (core_answer, answers_agree, majority_vote, mediate, answer_contradictions, contradiction_lines, word_overlap, candidate_features, answer_ranker, mean_attributions, arbiter_fallback, numbers_in_text, numbers_distinct, context_first, dag_nodes, dag_levels, dag_values, labels, final_answer, report_view, prompt, parse_llm, parse_plan, parse_answer, parse_verdict, parse_json, prompt_templates, arbiter_gate, offline_answer, grade, grade_distribution, grade_upsert, grade_store, dpo_pairs, eval_match, eval_summary, eval_by_company, fb_score, gates, eval_resume_anti, questions_with_meta, segments, role, sentiment, transcript_analysis)}

_MED = f"""{_CAND}, c AS (SELECT *, {_CORE.format('answer')} AS core, row_number() OVER (PARTITION BY question_id ORDER BY pod_order) AS n FROM cand WHERE trim(answer) <> ''),
g AS (SELECT question_id, count(*) AS n, max(core) FILTER (n = 1) AS c1, max(core) FILTER (n = 2) AS c2, max(core) FILTER (n = 3) AS c3 FROM c GROUP BY question_id),
s AS (SELECT question_id, n, {_agree('c1', 'c2')} AS a12, {_agree('c1', 'c3')} AS a13, {_agree('c2', 'c3')} AS a23 FROM g),
st AS (SELECT *, n = 1 OR (a12 AND (n = 2 OR a13)) AS one FROM s), w AS (SELECT st.*, CASE WHEN one THEN 'unanimous' WHEN n = 3 AND (a12 OR a13 OR a23) THEN 'majority' ELSE 'fallback' END AS status,
 CASE WHEN one OR n < 3 THEN [1, 2, 3] WHEN a12 THEN [1, 2] WHEN a13 THEN [1, 3] WHEN a23 THEN [2, 3] ELSE [1, 2, 3] END AS pool FROM st),
med AS (SELECT w.question_id, status, pod_name AS winner, answer, round(CASE WHEN status = 'fallback' THEN confidence * 0.8 ELSE confidence END, 6)::DOUBLE AS confidence FROM w JOIN c ON c.question_id = w.question_id AND list_contains(pool, c.n)
 QUALIFY row_number() OVER (PARTITION BY w.question_id ORDER BY c.confidence DESC, c.n) = 1)"""
_NODES = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(answer), {q(w)})' for w in ws)} THEN {q(n)} END" for n, ws in L.CAUSE_WORDS.items()) + "], lambda x: x IS NOT NULL)"
_VALUES = " UNION ALL ".join("SELECT question_id, pod_order, {n} AS node, try_cast(replace(regexp_extract(lower(answer), {p}, 1), ',', '') AS DOUBLE) AS value FROM cand".format(n=q(n), p=q("(?:" + "|".join(ws) + r")[^\d]{0,40}\$?([\d,]+(?:\.\d+)?)")) for n, ws in L.CAUSE_WORDS.items())
_CITES = r"len(regexp_extract_all(answer, '\[[^\]]*\]'))"
_CLEAN = r"list_transform(regexp_extract_all({0}, '[\d,]+(?:\.\d+)?'), lambda x: replace(x, ',', ''))"
_ASKS = "(question_id % 2 = 0)"
_GRADE = rf"""{_CAND}, v AS (SELECT question_id, pod_order,
 CASE WHEN question_id % 6 = 0 AND list_has_any({_CLEAN.format("'12'")}, {_CLEAN.format('answer')}) THEN 4 WHEN {_ASKS} THEN CASE WHEN regexp_matches(answer, '\$?[\d,]+(?:\.\d+)?') AND regexp_matches(answer, '(?i)million|billion|thousand|percent|%|\$') THEN 4 WHEN regexp_matches(answer, '\$?[\d,]+(?:\.\d+)?') THEN 2 ELSE -1 END WHEN length(answer) > 50 THEN 4 ELSE 2 END AS va,
 CASE WHEN regexp_matches(answer, '\[([A-Z_]+/P\d+[^\]]*)\]') OR ({_CITES} > 0 AND regexp_matches(answer, '\[.*?\]')) THEN 4 WHEN {_CITES} > 0 OR regexp_matches(answer, '\[.*?\]') THEN 2 ELSE -1 END AS vb,
 CASE WHEN length(trim(answer)) < 10 OR contains(answer, 'RETRIEVAL_MISS') THEN -1 WHEN length(trim(answer)) >= 75 THEN 4 WHEN length(trim(answer)) >= 30 THEN 2 ELSE -1 END AS vc FROM cand),
graded AS (SELECT *, va + vb + vc AS total, CASE WHEN va + vb + vc >= 8 THEN 'correct' WHEN va + vb + vc >= 3 THEN 'partial' ELSE 'wrong' END AS label FROM v)"""
_EN = r"(try_cast(regexp_extract(regexp_replace({0}, '[$,]', '', 'g'), '-?\d+\.?\d*') AS DOUBLE) * CASE WHEN regexp_matches(regexp_replace({0}, '[$,]', '', 'g'), '(?i)\bbillion') THEN 1000.0 ELSE 1.0 END)"
_EQ = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_RES = f"""{_CAND}, j AS (SELECT question_id, answer, confidence, o_orderpriority AS company, '$' || {_D} AS expected, floor(o_totalprice) / 1000 AS latency FROM cand JOIN orders ON question_id = o_orderkey WHERE pod_order = 2),
res AS (SELECT *, contains({_EQ.format('answer')}, {_EQ.format('expected')}) OR contains({_EQ.format('expected')}, {_EQ.format('answer')}) AS exact, coalesce({_EN.format('expected')} <> 0 AND abs({_EN.format('answer')} - {_EN.format('expected')}) / abs({_EN.format('expected')}) <= 0.01, false) AS numeric, question_id % 11 = 0 AS error, confidence > 0.63 AS hit FROM j)"""
_SUM = "count(*) AS n, round(avg((exact OR numeric)::INT), 6) AS accuracy, round(avg(numeric::INT), 6) AS numeric_accuracy, count(*) FILTER (error) AS errors, round(avg(confidence) FILTER (NOT error), 6) AS mean_confidence, round(avg(latency), 6) AS mean_latency, list_sort(list(latency))[count(*) // 2 + 1] AS p50, list_sort(list(latency))[greatest(0, floor(count(*) * 0.95)::INT - 1) + 1] AS p95, round(avg(hit::INT), 6) AS hit_rate"
_FIRST = r"try_cast(replace(regexp_extract({0}, '-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+\.\d+|-?\d+'), ',', '') AS DOUBLE)"
_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_LONG = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 3))"
_TOKENS = r"list_filter(regexp_split_to_array(answer, '\s+'), lambda w: w <> '')"
_CALLS = r"""calls AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Jane Doe - Analyst' WHEN turn % 4 = 1 THEN 'Tim Poe - CEO' WHEN turn % 4 = 3 THEN 'Luca May - CFO' ELSE 'Operator' END AS who, 'We expect strong growth, no risk. ' || replace(text, chr(10), ' ') AS words FROM conversations),
segs AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position, who AS speaker, CASE WHEN contains(lower(who), 'ceo') THEN 'CEO' WHEN contains(lower(who), 'cfo') THEN 'CFO' WHEN contains(lower(who), 'analyst') THEN 'Analyst' ELSE 'Operator' END AS role, trim(words) || ' it was weak and lower' AS text FROM calls)"""
_LIST = lambda ws: "(" + ", ".join(map(q, ws)) + ")"
_POS, _NEG = (f"len(list_filter(regexp_extract_all(lower({{0}}), '[a-z]+'), lambda w: w IN {_LIST(ws)}))" for ws in (L.POSITIVE, L.NEGATIVE))
_NET = f"(CASE WHEN len(regexp_extract_all(lower({{0}}), '[a-z]+')) > 0 THEN round(({_POS} - {_NEG}) / len(regexp_extract_all(lower({{0}}), '[a-z]+'))::DOUBLE, 4) ELSE 0.0 END)"
_SENT = "len(list_filter(list_transform(string_split(regexp_replace(a, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: ({w}) AND length(s) < 400)[1:10])"

ORACLES = {
    "core_answer": f"WITH {_CAND} SELECT question_id, pod_order, {_CORE.format('answer')} AS core FROM cand",
    "answers_agree": f"WITH {_TWO}, n AS (SELECT question_id, {_FIRST.format('a').replace('-?', '')} AS x, {_FIRST.format('b').replace('-?', '')} AS y FROM two) SELECT question_id, abs(x - y) / greatest(x, y) <= 0.05 AS agree FROM n",
    "majority_vote": f"WITH {_CAND}, c AS (SELECT question_id, pod_order AS i, {_CORE.format('answer')} AS a FROM cand) SELECT x.question_id, x.i, y.i AS j, {_agree('x.a', 'y.a')} AS agree FROM c x JOIN c y ON x.question_id = y.question_id AND x.i < y.i",
    "mediate": f"WITH {_MED} SELECT *, confidence < 0.65 AS low_confidence FROM med",
    "answer_contradictions": f"WITH {_TWO} SELECT question_id, concat_ws(',', CASE WHEN abs({_NUMS.format('a')}[1] - {_NUMS.format('b')}[1]) / greatest({_NUMS.format('a')}[1], {_NUMS.format('b')}[1]) > 0.1 THEN 'NUMBER' END, CASE WHEN regexp_extract(a, 'FY(20\\d\\d)', 1) <> coalesce(nullif(regexp_extract(b, '(20\\d\\d)', 1), ''), regexp_extract(a, 'FY(20\\d\\d)', 1)) AND regexp_extract(a, 'FY(20\\d\\d)', 1) <> '' THEN 'FISCAL_YEAR' END, CASE WHEN regexp_matches(a, '\\(\\s*[\\d,]+\\s*\\)') <> regexp_matches(b, '\\(\\s*[\\d,]+\\s*\\)') THEN 'SIGN' END) AS contradictions FROM two",
    "contradiction_lines": f"WITH d AS (SELECT doc_id, string_split('However it differs from page ' || n_chars || chr(10) || text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, i, trim(ls[i]) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS n FROM l WHERE length(line) > 20 AND ({' OR '.join(f'contains(lower(line), {q(w)})' for w in A.CONTRADICTION)})) SELECT doc_id, n, substr(line, 1, 300) AS line FROM h WHERE n <= 10",
    "word_overlap": f"SELECT item_id, round(coalesce(len(list_intersect({_LONG.format('a.text')}, {_LONG.format('b.text')})) / nullif(len({_LONG.format('a.text')}), 0)::DOUBLE, 0.0), 6) AS overlap FROM benchmark a JOIN (SELECT item_id + 1 AS item_id, text FROM benchmark) b USING (item_id)",
    "candidate_features": f"WITH {_CAND} SELECT question_id, pod_order, round(confidence, 6) AS f_confidence, round(least({_CITES}, 10) / 10.0::DOUBLE, 6) AS f_citations, round(least(length(answer), 2000) / 2000.0::DOUBLE, 6) AS f_length, round(coalesce(len(list_filter({_TOKENS}, lambda t: regexp_matches(replace(regexp_replace(t, '^[$%,.()]+|[$%,.()]+$', '', 'g'), ',', ''), {_NUM}))) / nullif(len({_TOKENS}), 0)::DOUBLE, 0.0), 6) AS f_numeric, round(coalesce(len(list_intersect({_LONG.format('answer')}, ['total', 'gross', 'profit', 'million'])) / nullif(len({_LONG.format('answer')}), 0)::DOUBLE, 0.0), 6) AS f_overlap, round(greatest(0.0, 1.0 - (pod_order - 1) * 0.25)::DOUBLE, 6) AS f_attempts, CASE WHEN confidence < 0.65 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS f_sure FROM cand",
    "arbiter_fallback": f"WITH {_CAND} SELECT question_id, pod_name, confidence AS arbiter_score FROM cand QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, pod_order) = 1",
    "numbers_in_text": f"SELECT doc_id, array_to_string(list_transform({_NUMS.format('text')}[1:10], lambda x: CASE WHEN x < 1e9 THEN round(x * 100)::BIGINT ELSE -1 END::VARCHAR), ',') AS numbers FROM documents",
    "numbers_distinct": f"SELECT doc_id, len(list_distinct(list_filter({_NUMS.format('text')}, lambda x: x < 1e15))[1:500])::INT AS n FROM documents",
    "context_first": "SELECT item_id, (instr(p, 'CONTEXT:') > 0 AND instr(p, 'CONTEXT:') < instr(p, 'QUESTION:')) AS ok FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'QUESTION: ?' || chr(10) || 'CONTEXT: ' ELSE 'CONTEXT: ' END || text || chr(10) || 'QUESTION: what?' AS p FROM benchmark)",
    "dag_nodes": f"WITH {_CAND} SELECT question_id, pod_order, array_to_string({_NODES}, ',') AS nodes FROM cand",
    "dag_levels": f"WITH RECURSIVE {_CAND}, e(cause, effect) AS (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in L.CAUSES)}), r AS (SELECT DISTINCT cause AS node, 0 AS level FROM e WHERE cause NOT IN (SELECT effect FROM e) UNION ALL SELECT effect, level + 1 FROM r JOIN e ON node = cause), n AS (SELECT unnest({_NODES}) AS node FROM cand), m AS (SELECT node, count(*) AS answers FROM n GROUP BY node) SELECT node, max(level) AS level, coalesce(max(answers), 0)::BIGINT AS answers FROM r LEFT JOIN m USING (node) GROUP BY node",
    "dag_values": f"WITH {_CAND}, v AS ({_VALUES}) SELECT * FROM v WHERE value IS NOT NULL",
    "labels": "SELECT c_custkey, CASE WHEN abs(c_acctbal) / 10000 >= 0.85 THEN 'HIGH' WHEN abs(c_acctbal) / 10000 >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN abs(c_acctbal) / 100 >= 60 THEN 'HIGH' WHEN abs(c_acctbal) / 100 >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM customer",
    "final_answer": f"WITH {_CAND} SELECT a.question_id, coalesce(nullif(a.answer, ''), b.answer) AS final_answer FROM cand a JOIN cand b USING (question_id) WHERE a.pod_order = 3 AND b.pod_order = 1",
    "report_view": f"WITH {_MED} SELECT question_id, status, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS label, substr(answer, 1, 350) AS excerpt FROM med",
    "prompt": "WITH u AS (SELECT conv_id AS question_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1), c AS (SELECT conv_id AS question_id, string_agg('--- Source ' || (turn + 1) || ' ---' || chr(10) || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY turn) AS ctx FROM conversations WHERE role = 'assistant' AND turn + 1 <= 5 GROUP BY 1) SELECT question_id, 'CONTEXT:' || chr(10) || coalesce(ctx, 'No context retrieved.') || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question AS prompt FROM u LEFT JOIN c USING (question_id)",
    "parse_llm": f"WITH {_CAND} SELECT question_id, pod_order, CASE WHEN answer = '' THEN 'CONFIDENCE: ' || confidence ELSE trim(answer) END AS reply_answer, confidence AS reply_confidence, 2 AS n_citations FROM cand",
    "offline_answer": rf"WITH {_CAND} SELECT question_id, pod_order, nullif(regexp_extract(answer, '\$\s?[\d,]+(?:\.\d+)?(?:\s*(?:million|billion))?'), '') AS amount FROM cand",
    "grade": f"WITH {_GRADE} SELECT * FROM graded",
    "grade_distribution": f"WITH {_GRADE} SELECT label, count(*) AS n FROM graded GROUP BY label",
    "grade_upsert": f"WITH {_GRADE} SELECT o_custkey, question_id, total, label FROM graded JOIN orders ON question_id = o_orderkey WHERE pod_order = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, question_id DESC) = 1",
    "dpo_pairs": f"""WITH {_GRADE}, p AS (SELECT o_orderpriority, question_id * 10 + pod_order AS session_id, total, o_orderdate AS ts FROM graded JOIN orders ON question_id = o_orderkey WHERE total >= 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY total DESC, ts DESC, session_id) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM p)
        SELECT a.o_orderpriority, a.session_id AS chosen, b.session_id AS rejected, a.total - b.total AS delta FROM r a JOIN r b ON a.o_orderpriority = b.o_orderpriority AND b.i = a.n + 1 - a.i WHERE a.i < b.i AND a.total > b.total""",
    "parse_plan": f"WITH {_CAND} SELECT question_id, pod_order, CASE WHEN pod_order = 1 THEN 'look up ' || answer ELSE 'Extract the answer to: ' || question_id END AS plan, 'total|tax' AS hints, 'cite' AS criteria, 'why|how ' || pod_name || CASE WHEN pod_order = 1 THEN '' ELSE chr(10) || 'RETRIEVAL_HINTS: total, , tax' || chr(10) || 'VALIDATION_CRITERIA: cite' END || '||||' AS curiosity FROM cand",
    "parse_answer": f"""WITH {_CAND}, r AS (SELECT *, pod_order = 3 AND question_id % 4 = 0 AS miss FROM cand) SELECT question_id, pod_order, CASE WHEN miss THEN '' ELSE trim(answer) END AS reply_answer, CASE WHEN miss THEN 'N/A' ELSE 'none' END AS computation,
        CASE WHEN miss THEN 0.0::DOUBLE ELSE round(confidence * [1.0::DOUBLE, 0.95::DOUBLE, 0.85::DOUBLE, 0.7::DOUBLE][pod_order + 1], 3) END AS reply_confidence, CASE WHEN miss THEN 0 ELSE 1 END AS n_citations, CASE WHEN miss THEN 'the table of prices' END AS needed FROM r""",
    "parse_verdict": f"WITH {_CAND} SELECT question_id, pod_order, question_id % 3 <> 0 AS passed, CASE WHEN question_id % 3 = 0 THEN 'sign is off|no unit' ELSE '' END AS reasons, CASE WHEN question_id % 3 = 0 THEN 'read again' ELSE '' END AS instructions, CASE WHEN question_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS sign, 'PASS' AS grounding FROM cand",
    "parse_json": "SELECT event_id, event_type AS kind, user_id AS n FROM events",
    "prompt_templates": "SELECT c_custkey, t.template, md5(replace(replace(replace(replace(replace(replace(replace(t.body, '{context}', c_name), '{question}', 'balance of ' || c_name), '{plan}', c_mktsegment), '{rejected}', ''), '{answer}', round(c_acctbal)::BIGINT::VARCHAR), '{answers}', c_mktsegment), '{checks}', " + q(", ".join(A.CHECKS)) + ")) AS md5, true AS ok FROM customer, (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in A.TEMPLATES.items()) + ") t(template, body)",
    "arbiter_gate": "SELECT n AS pairs, 300 AS required, n >= 300 AS met, false AS passed, CASE WHEN n < 300 THEN 'Need ' || (300 - n) || ' more DPO pairs AND model training' ELSE 'DPO threshold met - run training script' END AS blocker FROM (SELECT count(*) AS n FROM (__DPO__))",
    "eval_match": f"WITH {_RES} SELECT question_id, exact, numeric FROM res",
    "eval_summary": f"WITH {_RES} SELECT 'all' AS run, {_SUM} FROM res",
    "eval_by_company": f"WITH {_RES} SELECT company, {_SUM} FROM res GROUP BY company",
    "fb_score": f"""WITH {_RES}, f AS (SELECT question_id, {_FIRST.format('answer')} AS p, {_FIRST.format('expected')} AS g, len(list_intersect({_WORDS.format('answer')}, {_WORDS.format('expected')})) / len(list_distinct({_WORDS.format('answer')} || {_WORDS.format('expected')}))::DOUBLE AS o FROM res),
        r AS (SELECT *, CASE WHEN abs(p - g) / abs(g) < 0.02 THEN 'numeric' WHEN abs(p - g) / abs(g) < 0.05 THEN 'numeric_loose' WHEN o >= 0.5 THEN 'narrative' ELSE 'wrong' END AS reason FROM f)
        SELECT question_id, reason <> 'wrong' AS correct, reason, CASE reason WHEN 'numeric' THEN 1.0::DOUBLE WHEN 'numeric_loose' THEN 0.95::DOUBLE ELSE round(o, 6) END AS score FROM r""",
    "gates": f"WITH {_RES}, s AS (SELECT {_SUM} FROM res) SELECT accuracy >= 0.82 AS m1_accuracy, mean_confidence >= 0.65 AS m7_confidence, errors = 0 AS m8_no_errors FROM s",
    "eval_resume_anti": "SELECT o_orderkey AS question_id FROM orders WHERE o_orderkey % 11 <> 0",
    "questions_with_meta": "SELECT item_id, b.text, coalesce(source, 'UNKNOWN') AS company, coalesce(lang, 'UNKNOWN') AS doc_period FROM benchmark b LEFT JOIN documents d ON item_id = doc_id",
    "segments": f"WITH {_CALLS} SELECT * FROM segs",
    "role": f"WITH {_CALLS} SELECT role, count(*) AS n FROM segs GROUP BY role",
    "sentiment": f"WITH t AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' strong growth beat' ELSE ' weak decline' END AS text FROM conversations), s AS (SELECT conv_id, turn, {_POS.format('text')} AS p, {_NEG.format('text')} AS n, len(regexp_extract_all(lower(text), '[a-z]+')) AS t, {_NET.format('text')} AS net FROM t) SELECT conv_id, turn, p::INT AS positive, n::INT AS negative, t::INT AS total, net, CASE WHEN net > 0.005 THEN 'positive' WHEN net < -0.005 THEN 'negative' ELSE 'neutral' END AS polarity, CASE WHEN p + n >= 50 THEN 'high' WHEN p + n >= 20 THEN 'medium' WHEN p + n >= 5 THEN 'low' ELSE 'insufficient' END AS confidence FROM s",
    "transcript_analysis": f"WITH {_CALLS}, g AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY position) AS a, coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (role = 'CEO'), '') AS ceo, coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (role = 'CFO'), '') AS cfo, list(speaker ORDER BY position) AS who FROM segs GROUP BY conv_id) SELECT conv_id, {_NET.format('a')} AS net, {_NET.format('ceo')} AS ceo_net, {_NET.format('cfo')} AS cfo_net, {_SENT.format(w=' OR '.join(f'contains(lower(s), {q(w)})' for w in L.GUIDANCE))}::INT AS n_guidance, {_SENT.format(w=' OR '.join(f'contains(lower(s), {q(w)})' for w in L.RISKS))}::INT AS n_risks, (SELECT string_agg(w, '|' ORDER BY p) FROM (SELECT w, min(i) AS p FROM (SELECT unnest(who) AS w, unnest(range(1, len(who) + 1)) AS i) GROUP BY w)) AS speakers FROM g",
}
ORACLES["arbiter_gate"] = ORACLES["arbiter_gate"].replace("__DPO__", ORACLES["dpo_pairs"])
ORACLES["grade_store"] = ORACLES["grade_upsert"]
