"""Sources with deadlines, offsets and filters; the debate in rounds against the debate question by question."""

import time

import pytest

from tallyfold.operators import debate as D
from tallyfold.sources import feeds


class Slow(feeds.FetchSource):
    @classmethod
    def name(cls):
        return "slow"

    def fetch(self, key):
        if key == "hangs":
            time.sleep(60)
        if key == "counted":
            with open(self.options["log"], "a") as f:
                f.write("x")
        return key


def test_a_fetch_that_hangs_is_given_up(spark):
    spark.dataSource.register(Slow)
    got = {r.key: (r.value, r.status, r.tries) for r in spark.read.format("slow").option("keys", "a,hangs").option("pause", "0").option("deadline", "0.5").load().collect()}
    assert got == {"a": ("a", "ok", 1), "hangs": (None, "failed: timeout", 3)}


def test_filters_keep_other_keys_from_being_fetched(spark, tmp_path):
    spark.dataSource.register(Slow)
    log = tmp_path / "log"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("slow").option("keys", "a,b,c,counted").option("log", str(log)).option("pushdown", "true").load()
        assert [r.value for r in load().where("key = 'b'").collect()] == ["b"]
        assert sorted(r.value for r in load().where("key in ('a', 'c', 'z') and length(value) = 1").collect()) == ["a", "c"]
        assert not log.exists() and load().count() == 4 and log.exists()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Numbered(feeds.FeedStream):
    """Items are lines of a file; key "hangs" does while a file of that name is there."""

    @classmethod
    def name(cls):
        return "numbered"

    def newest(self):
        return len(open(self.options["file"]).read().splitlines())

    def between(self, key, start, end):
        if key == "hangs":
            try:
                open(self.options["file"] + ".hangs").close()
                time.sleep(60)
            except FileNotFoundError:
                pass
        lines = open(self.options["file"]).read().splitlines()
        return [(i, f"{key}:{lines[i]}") for i in range(start, end)]


def test_feed_is_read_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(Numbered)
    file, seen = tmp_path / "feed", []
    options = {"file": str(file), "keys": "k,hangs", "pause": "0", "deadline": "1"}

    def run():
        s = spark.readStream.format("numbered").options(**options).load()
        q = s.writeStream.foreachBatch(lambda df, b: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    file.write_text("a\nb\n")
    (tmp_path / "feed.hangs").write_text("")
    run()
    run()  # nothing new
    (tmp_path / "feed.hangs").unlink()
    file.write_text("a\nb\nc\nd\n")
    run()
    assert sorted((r.seq, r.value) for r in seen if r.key == "k") == [(0, "k:a"), (1, "k:b"), (2, "k:c"), (3, "k:d")]
    assert [(r.seq, r.upto, r.status, r.tries) for r in seen if r.value is None] == [(0, 1, "failed: timeout", 3)]
    failed = spark.createDataFrame(seen, Numbered({}).schema())
    again = [(r.seq, r.value) for r in feeds.refetch(Numbered(options), failed).collect()]
    assert sorted(again + [(r.seq, r.value) for r in seen if r.key == "hangs" and r.value]) == [(0, "hangs:a"), (1, "hangs:b"), (2, "hangs:c"), (3, "hangs:d")]


def model(prompt, temperature):
    """Replies that depend on the question, on what was rejected and on the plan alone."""
    last = prompt.rsplit("\n", 1)[-1]
    if "boom" in prompt and ("late" not in prompt or "REJECTED" in prompt):
        raise ValueError("down")
    if "Write a plan" in last:
        return f"plan after {prompt.count('REJECTED')}"
    if "Result" in last:
        bad = "bad" in prompt.split("Check the ANSWER:")[1].split("\n")[0]
        return "V2_UNITS Result: FAIL\nREJECT_REASONS: units\nRETRY_INSTRUCTIONS: again" if bad else "V2_UNITS Result: PASS"
    if "misses" in prompt:
        return "RETRIEVAL_MISS\nANSWER: bad guess" if "once" not in prompt or "REJECTED" not in prompt else "ANSWER: found\nCONFIDENCE: 0.8"
    if "hard" in prompt or ("second" in prompt and "REJECTED" not in prompt):
        return "ANSWER: bad 5\nCONFIDENCE: 0.9"
    if "replanned" in prompt:
        return "ANSWER: 7\nCONFIDENCE: 0.5" if "plan after 1" in prompt else "ANSWER: bad 7"
    return "ANSWER: 5 million\nCONFIDENCE: 0.9"


@pytest.mark.parametrize("variant", ["live", "alt"])
def test_rounds_give_what_single_questions_give(spark, variant):
    asked = ["easy", "hard", "second", "boom", "late boom hard", "misses", "misses once", "replanned", "", None]
    rows = [(str(i), q, None if q == "easy" else f"context {i}") for i, q in enumerate(asked)]
    got = {r.question_id: tuple(r)[1:] for r in D.debate(spark.createDataFrame(rows, "question_id string, question string, context string").repartition(3), model, variant).collect()}
    for i, q, context in rows:
        try:
            want = D.attempt(q or "", context or "", model, variant)
        except ValueError:
            want = ("", 0.0, 0, True, "ERROR ValueError")
        assert got[i] == pytest.approx(want)


def test_a_batch_of_calls_is_asked_together(spark, tmp_path):
    log = str(tmp_path / "sizes")

    def ask(prompts):
        with open(log, "a") as f:
            f.write(f"{len(prompts)} ")
        return [model(p, 0.0) for p in prompts]

    q = spark.createDataFrame([(i, "easy" if i % 2 else "second", "c") for i in range(6)], "question_id int, question string, context string").coalesce(1)
    got = D.debate(q, None, ask=ask)
    assert {(r.question_id, r.attempts) for r in got.collect()} == {(str(i), 2 - i % 2) for i in range(6)}
    assert open(log).read().split() == ["6", "6", "6", "3", "3"]


def test_without_a_model_the_first_amount_is_offered(spark):
    q = spark.createDataFrame([("a", "q", "it was $5 million then $6"), ("b", "q", None)], "question_id string, question string, context string")
    got = {r.question_id: tuple(r)[1:] for r in D.debate(q, None).collect()}
    assert got["a"] == D.attempt("q", "it was $5 million then $6", None) and got["b"] == D.attempt("q", "", None)
