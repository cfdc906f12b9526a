"""Candidate answers: agreement, contradictions, features, votes, grades, pairs and evaluation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .selection import at_ranks

LOW, FALLBACK = 0.65, 0.8
# An evaluation's gates, confidence by attempt, and a validator's checks.
GATES = {"accuracy": 0.82, "confidence": 0.65}
DECAY = [1.0, 0.95, 0.85, 0.70]
CHECKS = ["V1_SCOPE", "V2_UNITS", "V3_SIGN", "V4_CITATION", "V5_FISCAL_YEAR", "V6_CONSISTENCY", "V7_COMPLETENESS", "V8_GROUNDING"]
#: Prompts of the five kinds of call; labels are those that the parsers below read.
TEMPLATES = {
    "plan": "CONTEXT:\n{context}\n\nQUESTION:\n{question}\n\nReply with CURIOSITY_Q1 to CURIOSITY_Q6, ANALYSIS_PLAN, RETRIEVAL_HINTS and VALIDATION_CRITERIA.",
    "answer": "CONTEXT:\n{context}\n\nPLAN:\n{plan}\n{rejected}\n\nQUESTION:\n{question}\n\nReply with ANSWER, COMPUTATION, CONFIDENCE and CITATIONS, or RETRIEVAL_MISS and what is needed.",
    "check": "CONTEXT:\n{context}\n\nQUESTION:\n{question}\n\nPROPOSED ANSWER:\n{answer}\n\nFor each of {checks} give Result: PASS or FAIL, then REJECT_REASONS and RETRY_INSTRUCTIONS.",
    "mediate": "CONTEXT:\n{context}\n\nQUESTION:\n{question}\n\nANSWERS:\n{answers}\n\nReply with ANSWER, CONFIDENCE and CITATIONS of the best supported one.",
    "direct": "CONTEXT:\n{context}\n\nQUESTION:\n{question}\n\nAnswer from the context alone.",
}
# Signs of contradiction in an answer's lines.
CONTRADICTION = ["contradict", "inconsistent", "discrepancy", "conflict", "mismatch", "however", "disagree", "differs", "incorrect", "error", "restated", "does not match", "unsupported", "misstated"]
PRIVATE = "_rlef_"


def public(df: DataFrame) -> DataFrame:
    """df without private columns; every sink writes through it."""
    return df.select(*(c for c in df.columns if not c.startswith(PRIVATE)))


def pairs(candidates: DataFrame) -> DataFrame:
    """question_id, i, j, agree of every two of a question's candidates (question_id, pod_order, answer)."""
    c = candidates.select("question_id", F.col("pod_order").alias("i"), T.core_answer(F.col("answer")).alias("a"))
    d = c.select("question_id", F.col("i").alias("j"), F.col("a").alias("b"))
    return c.join(d, "question_id").where("i < j").select("question_id", "i", "j", T.answers_agree(F.col("a"), F.col("b")).alias("agree"))


def mediate(candidates: DataFrame) -> DataFrame:
    """question_id, status, winner, answer, confidence, low_confidence of up to three pods' answers.

    Blank answers do not count. One answer, or all agreeing with the first: unanimous. Of
    three, the first agreeing pair: majority, the more confident of it wins. Else the most
    confident wins at FALLBACK of its confidence.
    """
    c = candidates.where("trim(coalesce(answer, '')) <> ''").withColumn("core", T.core_answer(F.col("answer")))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("pod_order")))
    one = lambda k: F.max(F.when(F.col("n") == k, F.struct("pod_name", "answer", "confidence", "core"))).alias(f"p{k}")
    g = c.groupBy("question_id").agg(F.count("*").alias("n"), one(1), one(2), one(3))
    agree = lambda i, j: F.coalesce(T.answers_agree(F.col(f"p{i}.core"), F.col(f"p{j}.core")), F.lit(False))
    better = lambda i, j: F.when(F.col(f"p{i}.confidence") >= F.col(f"p{j}.confidence"), F.col(f"p{i}")).otherwise(F.col(f"p{j}"))
    best = F.when(F.col("n") == 1, F.col("p1")).when(F.col("n") == 2, better(1, 2)).otherwise(F.when(F.col("p1.confidence") >= F.greatest("p2.confidence", "p3.confidence"), F.col("p1")).otherwise(better(2, 3)))
    all_one = (F.col("n") == 1) | (agree(1, 2) & ((F.col("n") == 2) | agree(1, 3)))
    three = F.col("n") == 3
    status = F.when(all_one, "unanimous").when(three & (agree(1, 2) | agree(1, 3) | agree(2, 3)), "majority").otherwise("fallback")
    win = F.when(all_one, best).when(three & agree(1, 2), better(1, 2)).when(three & agree(1, 3), better(1, 3)).when(three & agree(2, 3), better(2, 3)).otherwise(best)
    out = g.select("question_id", status.alias("status"), win.alias("w"))
    conf = F.round(F.when(F.col("status") == "fallback", F.col("w.confidence") * FALLBACK).otherwise(F.col("w.confidence")), 6)
    return out.select("question_id", "status", F.col("w.pod_name").alias("winner"), F.col("w.answer").alias("answer"), conf.alias("confidence"), (conf < LOW).alias("low_confidence"))


def contradictions(a: Column, b: Column) -> Column:
    """Names of what two answers contradict each other in: number (over 10 %), year, sign."""
    x, y = (F.element_at(F.concat(T.numbers(t, cap=1), F.array(F.lit(None).cast("double"))), 1) for t in (a, b))
    ya, yb = T.answer_year(a), T.answer_year(b)
    neg = lambda t: t.rlike(r"\(\s*[\d,]+\s*\)")
    both = x.isNotNull() & y.isNotNull()
    return F.array_compact(F.array(F.when(both & (F.abs(x - y) / F.greatest(x, y) > 0.10), "NUMBER"), F.when(ya.isNotNull() & yb.isNotNull() & (ya != yb), "FISCAL_YEAR"), F.when(both & (neg(a) != neg(b)), "SIGN")))


def contradiction_lines(answers: DataFrame, key: str, cap: int = 10) -> DataFrame:
    """key, n, line: the first cap lines over 20 characters that hint at a contradiction, cut at 300."""
    lines = answers.select(key, F.posexplode(F.split("answer", "\n")).alias("ord", "raw")).withColumn("line", F.trim("raw"))
    hit = lines.where((F.length("line") > 20) & T.contains_any(F.lower("line"), CONTRADICTION))
    ranked = hit.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("n") <= cap)
    return ranked.select(key, "n", F.substring("line", 1, 300).alias("line"))


def is_numeric(token: Column) -> Column:
    return F.replace(F.regexp_replace(token, r"^[$%,.()]+|[$%,.()]+$", ""), F.lit(","), F.lit("")).rlike(T.NUMBER)


def features(answer: Column, confidence: Column, citations: Column, context: Column, attempts: Column, low: Column) -> dict[str, Column]:
    """Seven numbers that rank a candidate answer."""
    words = F.filter(F.split(answer, r"\s+"), lambda w: w != "")
    return {
        "f_confidence": confidence,
        "f_citations": F.least(citations, F.lit(10)) / 10.0,
        "f_length": F.least(F.length(answer), F.lit(2000)) / 2000.0,
        "f_numeric": F.coalesce(F.try_divide(F.size(F.filter(words, is_numeric)), F.size(words)), F.lit(0.0)),
        "f_overlap": T.word_overlap(answer, context),
        "f_attempts": F.greatest(F.lit(0.0), 1.0 - (attempts - 1) * 0.25),
        "f_sure": F.when(low, 0.0).otherwise(1.0),
    }


def arbiter(candidates: DataFrame, score: Column | None = None) -> DataFrame:
    """Each question's candidate of highest score (its confidence, without a model); ties to the earlier pod."""
    w = Window.partitionBy("question_id").orderBy(F.desc("arbiter_score"), "pod_order")
    return candidates.withColumn("arbiter_score", F.col("confidence") if score is None else score).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def grade(answer: Column, question: Column, citations: Column, gold: Column) -> dict[str, Column]:
    """va (numbers), vb (citations), vc (completeness), total, label."""
    has_number = answer.rlike(r"\$?[\d,]+(?:\.\d+)?")
    has_unit = answer.rlike(r"(?i)million|billion|thousand|percent|%|\$")
    clean = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"[\d,]+(?:\.\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    matches = F.coalesce((gold != "") & F.arrays_overlap(clean(gold), clean(answer)), F.lit(False))
    asks = T.contains_any(F.lower(question), L.NUMERICAL)
    va = F.when(matches, 4).when(asks, F.when(has_number & has_unit, 4).when(has_number, 2).otherwise(-1)).otherwise(F.when(F.length(answer) > 50, 4).otherwise(2))
    bracket, listed = answer.rlike(r"\[.*?\]"), citations > 0
    vb = F.when(answer.rlike(r"\[([A-Z_]+/P\d+[^\]]*)\]") | (listed & bracket), 4).when(listed | bracket, 2).otherwise(-1)
    n = F.length(F.trim(answer))
    vc = F.when((n < 10) | answer.contains("RETRIEVAL_MISS"), -1).when(n >= 75, 4).when(n >= 30, 2).otherwise(-1)
    total = va + vb + vc
    return {"va": va, "vb": vb, "vc": vc, "total": total, "label": F.when(total >= 8, "correct").when(total >= 3, "partial").otherwise("wrong")}


def upsert(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def preference_pairs(graded: DataFrame, kind: str, least: int, limit: int | None = None) -> DataFrame:
    """kind, chosen, rejected, delta: within a kind the i-th best graded session against the i-th worst.

    Out of the sessions of grade least or more, with a limit the 2 * limit best of them and
    the first limit pairs; pairs of equal grade go.
    """
    pool = graded.where(F.col("total") >= least)
    if limit is not None:
        pool = pool.orderBy(F.desc("total"), F.desc("ts"), "session_id").limit(2 * limit)
    up = Window.partitionBy(kind).orderBy(F.desc("total"), F.desc("ts"), "session_id")
    r = pool.withColumn("i", F.row_number().over(up)).withColumn("n", F.count("*").over(Window.partitionBy(kind))).withColumn("j", F.col("n") + 1 - F.col("i"))
    a = r.where("i < j").select(kind, "i", F.col("session_id").alias("chosen"), F.col("total").alias("ca"))
    b = r.select(kind, F.col("j").alias("i"), F.col("session_id").alias("rejected"), F.col("total").alias("cb"))
    pairs = a.join(b, [kind, "i"]).where("ca > cb").select(kind, "chosen", "rejected", (F.col("ca") - F.col("cb")).alias("delta"))
    return pairs if limit is None else pairs.orderBy(kind, F.desc("delta"), "chosen").limit(limit)


def eval_number(text: Column) -> Column:
    """The first number of an answer, in millions if it speaks of billions."""
    clean = F.regexp_replace(text, r"[$,]", "")
    return F.regexp_extract(clean, r"-?\d+\.?\d*", 0).try_cast("double") * F.when(clean.rlike(r"(?i)\bbillion"), 1000.0).otherwise(1.0)


def eval_match(predicted: Column, expected: Column) -> dict[str, Column]:
    norm = lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))
    p, e = eval_number(predicted), eval_number(expected)
    exact = (predicted != "") & (expected != "") & (norm(predicted).contains(norm(expected)) | norm(expected).contains(norm(predicted)))
    return {"exact": F.coalesce(exact, F.lit(False)), "numeric": F.coalesce((e != 0) & (F.abs(p - e) / F.abs(e) <= 0.01), F.lit(False))}


def gold_score(predicted: Column, gold: Column) -> dict[str, Column]:
    """correct, reason, score against a gold answer by number, then by words."""
    first = lambda t: F.replace(F.regexp_extract(t, r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+\.\d+|-?\d+", 0), F.lit(","), F.lit("")).try_cast("double")
    p, g, overlap = first(predicted), first(gold), T.jaccard_words(predicted, gold)
    near = lambda tol: F.coalesce(F.when(F.abs(g) < 1e-9, F.abs(p) < 1e-3).otherwise(F.abs(p - g) / F.abs(g) < tol), F.lit(False))
    reason = (
        F.when(F.trim(F.coalesce(predicted, F.lit(""))) == "", "empty").when(predicted.rlike("INSUFFICIENT_DATA|LLM_UNAVAILABLE"), "refused").when(near(0.02), "numeric").when(near(0.05), "numeric_loose")
        .when(overlap >= 0.5, "narrative").when(g.isNull() & (overlap >= 0.3), "narrative_partial").otherwise("wrong")
    )
    score = F.when(reason == "numeric", 1.0).when(reason == "numeric_loose", 0.95).when(reason.isin("empty", "refused"), 0.0).otherwise(F.round(overlap, 6))
    return {"correct": reason.isin("numeric", "numeric_loose", "narrative", "narrative_partial"), "reason": reason, "score": score}


def eval_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, errors, confidence and latencies by index rule; results: exact, numeric, error, confidence, latency, hit."""
    ok = F.col("exact") | F.col("numeric")
    g = results.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("numeric").cast("int")), 6).alias("numeric_accuracy"), F.count_if("error").alias("errors"),
        F.round(F.avg(F.when(~F.col("error"), F.col("confidence"))), 6).alias("mean_confidence"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"),
    )
    n, low = F.col("n"), F.lit(0)
    ranks = {"p50": F.floor(n / 2), "p95": F.greatest(low, F.floor(n * 0.95) - 1)}
    placed = at_ranks(results.select(F.struct(*keys).alias("__k"), "latency"), "__k", "latency", ranks).select("__k", *ranks)
    out = g.withColumn("__own", F.struct(*keys)).join(placed, F.col("__own").eqNullSafe(F.col("__k")), "left")
    return out.select(*keys, "n", "accuracy", "numeric_accuracy", "errors", "mean_confidence", "mean_latency", "p50", "p95", "hit_rate")


def chi_square_accuracy(ok: int, n: int, baseline: float = 0.60) -> tuple[float, float]:
    """Chi-square (Yates) and p-value of an accuracy against a baseline of as many questions."""
    base = round(n * baseline)
    a, b, c, d = ok, n - ok, base, n - base
    total, low = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    if not low:
        return 0.0, 1.0
    chi = total * max(0.0, abs(a * d - b * c) - total / 2) ** 2 / low
    return chi, math.erfc(math.sqrt(chi / 2))


def reachable(edges: DataFrame, start: list[str]) -> DataFrame:
    """node, level: nodes reached from start along edges (cause, effect), by the longest path; the graph is fixed and small."""
    spark = edges.sparkSession
    front = spark.createDataFrame([(n, 0) for n in start], "node string, level int")
    seen = front
    while not front.isEmpty():
        front = front.join(edges, F.col("node") == F.col("cause")).groupBy(F.col("effect").alias("node")).agg((F.max("level") + 1).alias("level"))
        seen = seen.unionByName(front)
    return seen.groupBy("node").agg(F.max("level").alias("level"))


def cause_nodes(text: Column) -> Column:
    """Line items that an answer speaks of, in order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in ws)), n) for n, ws in L.CAUSE_WORDS.items())))


def cause_values(text: Column) -> Column:
    """array<struct<node, value>>: the first number written after a line item's name."""
    rows = []
    for node, ws in L.CAUSE_WORDS.items():
        found = F.regexp_extract(F.lower(text), "(?:" + "|".join(ws) + r")[^\d]{0,40}\$?([\d,]+(?:\.\d+)?)", 1)
        rows.append(F.when(found != "", F.struct(F.lit(node).alias("node"), F.replace(found, F.lit(","), F.lit("")).try_cast("double").alias("value"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull() & r["value"].isNotNull())


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.85, "HIGH").when(c >= 0.60, "MEDIUM").otherwise("LOW")


def risk_label(s: Column) -> Column:
    return F.when(s >= 60, "HIGH").when(s >= 30, "MEDIUM").otherwise("LOW")


def final_answer(ranked: Column, plain: Column) -> Column:
    return F.coalesce(F.nullif(ranked, F.lit("")), F.nullif(plain, F.lit("")), F.lit(""))


def prompt(chunks: DataFrame, questions: DataFrame, cap: int = 5, chars: int = 1500) -> DataFrame:
    """question_id, prompt: up to cap ranked chunks of chars characters, context before question."""
    body = F.concat(F.lit("--- Source "), F.col("rank").cast("string"), F.lit(" ---\n"), F.substring("text", 1, chars))
    ctx = chunks.where(F.col("rank") <= cap).groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", body.alias("body")))), lambda s: s["body"]), "\n\n").alias("ctx"))
    return questions.join(ctx, "question_id", "left").select("question_id", F.concat(F.lit("CONTEXT:\n"), F.coalesce("ctx", F.lit("No context retrieved.")), F.lit("\n\nQUESTION:\n"), "question").alias("prompt"))


def context_first(prompt_text: Column) -> Column:
    """Whether a prompt has a context, and it stands before the question."""
    at = lambda w: F.instr(prompt_text, w)
    return (at("CONTEXT:") > 0) & (at("CONTEXT:") < at("QUESTION:"))


def gates(summary: DataFrame) -> DataFrame:
    """Milestones that an evaluation's summary reaches: accuracy, confidence, no errors."""
    return summary.select((F.col("accuracy") >= GATES["accuracy"]).alias("m1_accuracy"), (F.col("mean_confidence") >= GATES["confidence"]).alias("m7_confidence"), (F.col("errors") == 0).alias("m8_no_errors"))


def arbiter_gate(pairs: DataFrame, model_exists: bool, least: int = 300) -> DataFrame:
    """One row: pairs, required, met, passed, blocker: what a model of answers still waits for."""
    n = F.count("*")
    more = F.concat(F.lit("Need "), (F.lit(least) - n).cast("string"), F.lit(" more DPO pairs"))
    few = n < least
    blocker = F.when(few, more).otherwise("Ready") if model_exists else F.when(few, F.concat(more, F.lit(" AND model training"))).otherwise("DPO threshold met - run training script")
    return pairs.agg(n.alias("pairs"), F.lit(least).alias("required"), (~few).alias("met"), (~few & F.lit(model_exists)).alias("passed"), blocker.alias("blocker"))


def _part(text: Column, name: str, until: list[str]) -> Column:
    """What follows name up to the first of the labels until, or the end; empty without it."""
    stop = "|".join([*until, r"\z"])
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is){name}[:\s]+(.*?)(?={stop})", 1), r"^\s+|\s+$", ""))


def parse_plan(reply: Column, question: Column) -> dict[str, Column]:
    """plan, hints, criteria, curiosity (six answers) of a planner's reply, with defaults for what it leaves out."""
    asked = [_part(reply, f"CURIOSITY_Q{k}", [f"CURIOSITY_Q{k + 1}", "ANALYSIS_PLAN"]) for k in range(1, 7)]
    some = lambda c, default: F.when(c != "", c).otherwise(default)
    hints = F.filter(F.transform(F.split(_part(reply, "RETRIEVAL_HINTS", ["VALIDATION_CRITERIA"]), ","), lambda h: F.trim(h)), lambda h: h != "")
    return {
        "plan": some(_part(reply, "ANALYSIS_PLAN", ["RETRIEVAL_HINTS", "VALIDATION_CRITERIA"]), F.concat(F.lit("Extract the answer to: "), question)),
        "hints": hints,
        "criteria": some(_part(reply, "VALIDATION_CRITERIA", []), F.lit("Answer must be grounded in retrieved context with citations.")),
        "curiosity": F.array(*(F.substring(a, 1, 500) for a in asked)),
    }


def parse_answer(reply: Column, attempt: Column) -> dict[str, Column]:
    """answer, computation, confidence (less with each attempt from 0), citations, needed of an implementor's reply; a miss has no answer and says what it needs."""
    miss = F.upper(reply).contains("RETRIEVAL_MISS")
    answer = _part(reply, "ANSWER", ["COMPUTATION:", "CONFIDENCE:", "CITATIONS:"])
    computation = _part(reply, "COMPUTATION", ["CONFIDENCE:", "CITATIONS:"])
    conf = F.coalesce(F.regexp_extract(reply, r"(?i)CONFIDENCE[:\s]+([0-9.]+)", 1).try_cast("double"), F.lit(0.7))
    decay = F.coalesce(F.get(F.array(*map(F.lit, DECAY)), attempt.cast("int")), F.lit(DECAY[-1]))
    cites = _part(reply, "CITATIONS", [])
    needed = F.substring(_part(reply, "RETRIEVAL_MISS", ["ANSWER:"]), 1, 300)
    return {
        "answer": F.when(miss, "").when(answer != "", answer).otherwise(F.substring(reply, 1, 500)),
        "computation": F.when(~miss & (computation != ""), computation).otherwise("N/A"),
        "confidence": F.when(miss, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)) * decay, 3)),
        "citations": F.when(~miss & (cites != ""), F.array(cites)).otherwise(F.array().cast("array<string>")),
        "needed": F.when(miss, F.when(needed != "", needed).otherwise("Unknown")),
    }


def parse_verdict(reply: Column) -> dict[str, Column]:
    """checks (a map of the eight checks to PASS or FAIL; what is not reported passes), passed, reasons, instructions of a validator's reply."""
    result = lambda c: F.coalesce(F.nullif(F.upper(F.regexp_extract(reply, rf"(?is){c}.*?Result:\s*(PASS|FAIL)", 1)), F.lit("")), F.lit("PASS"))
    results = {c: result(c) for c in CHECKS}
    failed = reduce(lambda a, b: a | b, (r == "FAIL" for r in results.values()))
    reasons = F.filter(F.transform(F.split(_part(reply, "REJECT_REASONS", ["RETRY_INSTRUCTIONS"]), r"\d+\.|\n"), lambda r: F.trim(r)), lambda r: r != "")
    return {
        "checks": F.create_map(*(x for c, r in results.items() for x in (F.lit(c), r))),
        "passed": ~failed,
        "reasons": F.when(failed, reasons).otherwise(F.array().cast("array<string>")),
        "instructions": F.when(failed, F.substring(_part(reply, "RETRY_INSTRUCTIONS", []), 1, 1000)).otherwise(""),
    }


def parse_json(reply: Column, schema: str) -> Column:
    """A struct of a model's JSON reply without its code fence; null fields where it is no such JSON."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```[^\n]*\n(.*)\n[^\n]*$", "$1")
    return F.from_json(bare, schema)


def excerpts(chunks: DataFrame, cap: int, chars: int, head: str) -> DataFrame:
    """question_id, context: the first cap ranked chunks (question_id, rank, section, page, text), cut at chars, under a head with {n}, {section} and {page}."""
    filled = F.lit(head)
    for name in ("section", "page"):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    filled = F.replace(filled, F.lit("{n}"), F.col("rank").cast("string"))
    body = F.concat(filled, F.substring("text", 1, chars))
    rows = chunks.where(F.col("rank") <= cap).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", body.alias("body")))).alias("rows"))
    return rows.select("question_id", F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("context"))


def rendered(template: str, **parts: Column) -> Column:
    """A prompt of one of TEMPLATES; parts fill the fields that it names, and every template's context stands before its question."""
    out = F.lit(TEMPLATES[template])
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def parse_reply(text: Column) -> dict[str, Column]:
    """answer, confidence (clamped; 0.7 without one), citations of a labelled model reply."""
    part = lambda name: F.trim(F.regexp_extract(text, rf"(?is){name}\s*:\s*(.*?)(?=\n\s*[A-Z][A-Z_ ]{{2,}}\s*:|\z)", 1))
    conf = F.regexp_extract(part("CONFIDENCE"), r"(\d*\.?\d+)", 1).try_cast("double")
    return {"answer": part("ANSWER"), "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(conf, F.lit(0.7)))), "citations": F.regexp_extract_all(part("CITATIONS"), F.lit(r"\[([^\]]+)\]"), F.lit(1))}


def offline_answer(context: Column) -> Column:
    """The first dollar amount of a context; null without one."""
    return F.nullif(F.regexp_extract(context, r"\$\s?[\d,]+(?:\.\d+)?(?:\s*(?:million|billion))?", 0), F.lit(""))
