"""Expiring state of a stream and stored keyed tables, with restarts and killed jobs."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import cache as K
from tallyfold.operators import keyed_table
from tallyfold.plans import feeds
from tallyfold.streaming import expiring



@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, expiring.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def replay(spark, folder, checkpoint, seen):
    schema = "key string, kind string, value double, ts timestamp, tie long"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    put = lambda df, batch: seen.extend(df.collect())
    q = expiring.cached(rows, "0 seconds").writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_stream_cache_holds_what_is_live(rocks, sf, tmp_path):
    spark, folder, checkpoint, seen = rocks, str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    e = feeds._events(spark, sf).select("key", "kind", "value", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"))
    edges = e.select(F.percentile_approx("ts", F.array(F.lit(0.4), F.lit(0.8)))).first()[0]
    parts = [e.where(F.col("ts") < edges[0]), e.where((F.col("ts") >= edges[0]) & (F.col("ts") < edges[1])), e.where(F.col("ts") >= edges[1])]
    last = e.agg(F.max("ts")).first()[0]
    now = lambda: F.lit(last)  # noqa: E731  the stream's own time; the clock's row brings the watermark there
    tick = spark.createDataFrame([("tick", "default", 0.0, 0)], "key string, kind string, value double, tie long").select("key", "kind", "value", now().alias("ts"), F.col("tie").cast("long").alias("tie"))
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(folder)
        replay(spark, folder, checkpoint, seen)
    for part in (parts[2], tick):
        part.coalesce(1).write.mode("append").parquet(folder)
        replay(spark, folder, checkpoint, seen)  # from the checkpoint of the run before
    got = {(r.key, r.tie) for r in expiring.live_rows(spark, checkpoint, now()).collect()} - {("tick", 0)}
    want = {(r.key, r.event_id) for r in K.live_rows(feeds._events(spark, sf), "key", "kind", "ts", "event_id", now()).collect()}
    assert got == want and want
    puts, gone = ({(r.key, r.tie) for r in seen if r.change == c} for c in ("put", "expired"))
    assert want <= puts and gone <= puts and not gone & want and gone
    held = {(r.key.key, r.value.tie) for r in spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "row").load().collect()}
    assert held - {("tick", 0)} == want  # what expired is not kept


def table(spark, path, buckets=4):
    return keyed_table.KeyedTable(spark, str(path), "id", "ts", "tie", buckets)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id string, value string, ts int, tie int, _rlef_secret string")


def test_upserts_and_deletes(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert not t.exists() and t.vacuum() == 0
    with pytest.raises(FileNotFoundError):
        t.read()
    t.upsert(rows_of(spark, [(f"k{i}", "old", 1, 0, "s") for i in range(20)] + [("k1", "late", 0, 9, "s"), ("k2", "tie", 1, 1, "s"), (None, "none", 1, 0, "s")]))
    t.upsert(rows_of(spark, [("k3", "new", 2, 0, "s"), ("k4", "older", 0, 0, "s"), ("k99", "first", 1, 0, "s")]))
    t.delete(spark.createDataFrame([("k5",), ("nobody",)], "id string"))
    t.upsert(rows_of(spark, []))
    got = {r.id: r.value for r in t.read().collect()}
    assert got == {f"k{i}": "old" for i in range(20) if i != 5} | {"k2": "tie", "k3": "new", "k99": "first", None: "none"}
    assert t.read().columns == ["id", "value", "ts", "tie"] and t.vacuum() > 0 and {r.id: r.value for r in t.read().collect()} == got


def test_a_job_killed_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.upsert(rows_of(spark, [("a", "1", 1, 0, ""), ("b", "1", 1, 0, "")]), 0)

    def killed(self, m):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed_table.KeyedTable, "_swap", killed)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(rows_of(spark, [("a", "2", 2, 0, ""), ("c", "2", 2, 0, "")]), 1)
    assert {(r.id, r.value) for r in table(spark, tmp_path / "t").read().collect()} == {("a", "1"), ("b", "1")}
    t.upsert(rows_of(spark, [("a", "3", 3, 0, "")]), 1)
    assert {(r.id, r.value) for r in t.read().collect()} == {("a", "3"), ("b", "1")}
    before = t.manifest()
    t.upsert(rows_of(spark, [("a", "4", 4, 0, "")]), 1)
    assert t.manifest() == before


def test_a_stream_upserts_once(spark, tmp_path):
    folder, t = str(tmp_path / "in"), table(spark, tmp_path / "t")
    schema = "id string, value string, ts int, tie int"
    for k in range(3):
        spark.createDataFrame([("a", str(k), k, 0), (f"own{k}", str(k), k, 0)], schema).coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        s.writeStream.foreachBatch(t.sink()).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)

    run("one")
    want = {(r.id, r.value) for r in t.read().collect()}
    assert want == {("a", "2"), ("own0", "0"), ("own1", "1"), ("own2", "2")}
    version = t.manifest()["version"]
    run("two")  # the same batches again, from a lost checkpoint
    assert t.manifest()["version"] == version and {(r.id, r.value) for r in t.read().collect()} == want
