"""The plan, implement, validate loop over questions, with the caller's language model.

chat(prompt, temperature) is any picklable callable; it runs in tasks, a question a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .answers import CHECKS
from .written import written

# Confidence after each attempt, retries, and the mark below which an answer is unsure.
DECAY = {"live": [1.0, 0.95, 0.85, 0.70], "alt": [1.0, 0.95, 0.85, 0.70, 0.60]}
RETRIES = {"live": 3, "alt": 5}
EXHAUSTED, LOW, DEFAULT = 0.6, 0.65, 0.7
MISS = "RETRIEVAL_MISS"
SCHEMA = "question_id string, answer string, confidence double, attempts int, low_confidence boolean, verdict string"


def section(reply: str, name: str) -> str:
    m = re.search(rf"(?is){name}\s*:\s*(.*?)(?=\n\s*[A-Z][A-Z_ ]{{2,}}\s*:|\Z)", reply)
    return m[1].strip() if m else ""


def confidence(reply: str) -> float:
    m = re.search(r"\d*\.?\d+", section(reply, "CONFIDENCE"))
    return min(1.0, max(0.0, float(m[0]))) if m else DEFAULT


def checked(reply: str) -> tuple[bool, str]:
    """Whether none of the eight checks fails, and why and what to do otherwise; a check that is not reported passes, and so does a missing reply."""
    results = {c: re.search(rf"(?is){c}.*?Result:\s*(PASS|FAIL)", reply or "") for c in CHECKS}
    failed = [c for c, m in results.items() if m and m[1].upper() == "FAIL"]
    why = [section(reply or "", "REJECT_REASONS"), section(reply or "", "RETRY_INSTRUCTIONS")]
    return not failed, " ".join(["; ".join(failed), *filter(None, why)]) if failed else ""


def attempt(question: str, context: str, chat: Callable[[str, float], str] | None, variant: str = "live") -> tuple:
    """answer, confidence, attempts, low_confidence, verdict of one question.

    live plans once; alt plans anew with each rejection. A second miss ends the loop. With
    no attempt left the last answer stands at EXHAUSTED of its confidence. Without a model
    the context's first dollar amount is offered.
    """
    if chat is None:
        m = re.search(r"\$\s?[\d,]+(?:\.\d+)?(?:\s*(?:million|billion))?", context)
        return (m[0] if m else "", 0.5 if m else 0.0, 0, True, "OFFLINE")
    plan, rejected, misses, answer, conf = "", "", 0, "", 0.0
    for k in range(RETRIES[variant] + 1):
        if not k or variant == "alt":
            plan = chat(f"CONTEXT:\n{context}\n{rejected}\nQUESTION:\n{question}\nWrite a plan.", 0.0)
        reply = chat(f"CONTEXT:\n{context}\nPLAN:\n{plan}\n{rejected}\nQUESTION:\n{question}\nANSWER, CONFIDENCE, CITATIONS:", 0.0)
        answer = section(reply, "ANSWER")
        conf = confidence(reply) * DECAY[variant][min(k, len(DECAY[variant]) - 1)]
        if MISS in reply:
            misses += 1
            if misses == 2:
                return answer or MISS, 0.0, k + 1, True, MISS
        passed, why = checked(chat(f"CONTEXT:\n{context}\nCheck the ANSWER: {answer}\nFor each of {', '.join(CHECKS)} give Result: PASS or FAIL; REJECT_REASONS, RETRY_INSTRUCTIONS:", 0.0))
        if passed:
            return answer, conf, k + 1, conf < LOW, "PASS"
        rejected = f"REJECTED: {why}"
    return answer, conf * EXHAUSTED, RETRIES[variant] + 1, True, "EXHAUSTED"


#: What is known of a question between two attempts.
STATE = "question_id string, question string, context string, plan string, rejected string, misses int, answer string, confidence double, attempts int, low_confidence boolean, verdict string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def one_by_one(chat: Callable[[str, float], str]) -> Callable[[list[str]], list[str | Exception]]:
    """Replies to a list of prompts; a call that fails gives its error in place of a reply."""

    def batch(prompts: list[str]) -> list[str | Exception]:
        out = []
        for p in prompts:
            try:
                out.append(chat(p, 0.0))
            except Exception as e:  # one question's failure must not end the others
                out.append(e)
        return out

    return batch


def _asked(pdf: pd.DataFrame, name: str, ask: Callable, prompt: Callable) -> pd.DataFrame:
    """Column name of the rows that are still open from one batch of calls; those whose call failed end with its error."""
    live = pdf.index[pdf["verdict"].isna()]
    pdf[name] = pdf[name].astype(object) if name in pdf else None
    for k, reply in zip(live, ask([prompt(pdf.loc[k]) for k in live]) if len(live) else [], strict=True):
        if isinstance(reply, Exception):
            _ended(pdf, k, "", 0.0, 0, True, f"ERROR {type(reply).__name__}")
        else:
            pdf.at[k, name] = reply
    return pdf


def _ended(pdf: pd.DataFrame, k, answer: str, conf: float, attempts: int, low: bool, verdict: str) -> None:
    for name, value in zip(COLUMNS[1:], (answer, conf, attempts, low, verdict), strict=True):
        pdf.at[k, name] = value


def stepped(pdf: pd.DataFrame, attempt_no: int, ask: Callable, variant: str) -> pd.DataFrame:
    """The questions of pdf after one more attempt: three batches of calls, for plans, answers and checks."""
    pdf = pdf.reset_index(drop=True)
    pdf["verdict"] = pdf["verdict"].astype(object)
    said = lambda r, *parts: "\n".join(("CONTEXT:", r["context"] or "", *parts))
    if not attempt_no or variant == "alt":
        pdf = _asked(pdf, "plan", ask, lambda r: said(r, r["rejected"], "QUESTION:", r["question"] or "", "Write a plan."))
    pdf = _asked(pdf, "reply", ask, lambda r: said(r, "PLAN:", r["plan"], r["rejected"], "QUESTION:", r["question"] or "", "ANSWER, CONFIDENCE, CITATIONS:"))
    for k in pdf.index[pdf["verdict"].isna()]:
        reply = pdf.at[k, "reply"]
        pdf.at[k, "answer"] = section(reply, "ANSWER")
        pdf.at[k, "confidence"] = confidence(reply) * DECAY[variant][min(attempt_no, len(DECAY[variant]) - 1)]
        if MISS in reply:
            pdf.at[k, "misses"] += 1
            if pdf.at[k, "misses"] == 2:
                _ended(pdf, k, pdf.at[k, "answer"] or MISS, 0.0, attempt_no + 1, True, MISS)
    pdf = _asked(pdf, "check", ask, lambda r: said(r, f"Check the ANSWER: {r['answer']}", f"For each of {', '.join(CHECKS)} give Result: PASS or FAIL; REJECT_REASONS, RETRY_INSTRUCTIONS:"))
    for k in pdf.index[pdf["verdict"].isna()]:
        passed, why = checked(pdf.at[k, "check"])
        conf = pdf.at[k, "confidence"]
        if passed:
            _ended(pdf, k, pdf.at[k, "answer"], conf, attempt_no + 1, bool(conf < LOW), "PASS")
        elif attempt_no == RETRIES[variant]:
            _ended(pdf, k, pdf.at[k, "answer"], conf * EXHAUSTED, attempt_no + 1, True, "EXHAUSTED")
        pdf.at[k, "rejected"] = f"REJECTED: {why}"
    return pdf[[c.split()[0] for c in STATE.split(", ")]]


def debate(questions: DataFrame, chat: Callable[[str, float], str] | None, variant: str = "live", ask: Callable[[list[str]], list[str | Exception]] | None = None) -> DataFrame:
    """questions (question_id, question, context) answered as by attempt(), in one pass over the open ones per attempt.

    What is known after a pass is written, so a lost task repeats one attempt of its questions
    at most. ask, where given, answers a list of prompts at once, with an exception in place
    of a reply that failed; else chat is called for each. A question whose call fails gets an
    empty answer and the error as verdict.
    """
    start = questions.select(F.col("question_id").cast("string").alias("question_id"), "question", "context")
    if chat is None and ask is None:
        found = F.regexp_extract(F.coalesce("context", F.lit("")), r"\$\s?[\d,]+(?:\.\d+)?(?:\s*(?:million|billion))?", 0)
        return start.select("question_id", found.alias("answer"), F.when(found != "", 0.5).otherwise(0.0).alias("confidence"), F.lit(0).alias("attempts"), F.lit(True).alias("low_confidence"), F.lit("OFFLINE").alias("verdict"))
    ask = ask or one_by_one(chat)
    blank = {"plan": "''", "rejected": "''", "misses": "0", "answer": "''", "confidence": "0.0D", "attempts": "0", "low_confidence": "true", "verdict": "cast(null as string)"}
    open_, done = start.selectExpr("*", *(f"{v} as {c}" for c, v in blank.items())), None
    for k in range(RETRIES[variant] + 1):

        def run(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield stepped(pdf, k, ask, variant)

        after = written(open_.mapInPandas(run, STATE))
        ended = after.where("verdict is not null").select(*COLUMNS)
        done = ended if done is None else done.unionByName(ended)
        open_ = after.where("verdict is null")
        if open_.isEmpty():
            break
    return done


def blind_context(candidates: DataFrame, auditor: str) -> DataFrame:
    """What an auditor may see: no other pod's rows."""
    return candidates.where(candidates.pod_name == auditor)
