"""Stages: outcomes that fail, lost checkpoints, lost commits, merged parts; state that goes; the sink into the log."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import event_log, storage
from tidemark.operators.manifest import Manifest
from tidemark.streaming import streams

INPUT = "sequence long, identity string, good boolean"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


class Source:
    """A folder to which files are added, and a stage over it."""

    def __init__(self, spark, tmp_path, **how):
        self.spark, self.path, self.target, self.how = spark, str(tmp_path / "src"), str(tmp_path / "out"), how
        self.tmp, self.tried = tmp_path, []
        self.add()

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), INPUT).coalesce(1).write.mode("append").parquet(self.path)

    def step(self, df):
        self.tried += sorted(r.identity for r in df.collect())
        return df.select(F.col("identity").alias("key"), F.when(F.col("good"), "done").otherwise("failed").alias("type"), "sequence")

    def run(self, checkpoint="c"):
        stream = streams.source(self.spark, self.path, INPUT)
        streams.stage(stream, self.target, str(self.tmp / checkpoint), self.step, "key", input_key="identity", **self.how).awaitTermination()

    def rows(self):
        return sorted((r.key_text, r.type, r["try"]) for r in streams.Outcomes(self.spark, self.target).rows().collect())

    def latest(self):
        return {r.key_text: (r.type, r["try"]) for r in streams.Outcomes(self.spark, self.target).latest().collect()}


DONE = "type = 'done'"


def test_failed_keys_are_tried_again(spark, tmp_path):
    s = Source(spark, tmp_path, final=DONE, tries=3)
    s.add((1, "a", False), (2, "b", True))
    s.run()
    assert s.latest() == {"a": ("failed", 1), "b": ("done", 1)}
    s.add((3, "c", True))  # a batch of other keys: a waits and is tried too
    s.run()
    assert s.latest() == {"a": ("failed", 2), "b": ("done", 1), "c": ("done", 1)}
    s.add((4, "a", True), (5, "b", True))  # a comes anew and does well; b is done and doesn't reach the step
    s.tried.clear()
    s.run()
    assert s.latest()["a"] == ("done", 1) and s.tried == ["a"]
    s.add((6, "a", False))
    s.run()
    assert s.latest()["a"] == ("done", 1) and s.rows() == [("a", "done", 1), ("a", "failed", 1), ("a", "failed", 2), ("b", "done", 1), ("c", "done", 1)]


def test_tries_are_bounded(spark, tmp_path):
    s = Source(spark, tmp_path, final=DONE, tries=2)
    s.add((1, "a", False), (2, "a", True))  # twice in a batch: the first counts
    s.run()
    outcomes = streams.Outcomes(spark, s.target)
    again = lambda: streams.try_again(spark, s.target, s.step, "key", input_key="identity", final=DONE, tries=2)
    assert outcomes.waits()
    again()
    assert s.rows() == [("a", "failed", 1), ("a", "failed", 2)] and not outcomes.waits()
    again()
    assert len(s.rows()) == 2
    with pytest.raises(ValueError, match="key in the input"):
        streams.stage(streams.source(spark, s.path, INPUT), s.target, str(tmp_path / "x"), s.step, "key", final=DONE)


def test_failures_are_remembered_without_final(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.add((1, "a", False))
    s.run()
    s.add((2, "a", True), (3, None, True))
    s.run()
    assert [r[:2] for r in s.rows() if r[0]] == [("a", "failed")] and s.tried.count("a") == 1


def test_a_new_checkpoint_writes_no_key_twice(spark, tmp_path):
    s = Source(spark, tmp_path, final=DONE)
    s.add((1, "a", True))
    s.run()
    s.add((2, "b", True))
    s.run()
    s.add((3, "d", True))
    s.run("other")
    s.add((4, "e", True), (5, "b", True))
    s.run()  # and the old one goes on
    assert s.rows() == [(k, "done", 1) for k in "abde"]


def test_a_batch_lost_before_its_commit(spark, tmp_path, monkeypatch):
    s = Source(spark, tmp_path, final=DONE)
    s.add((1, "a", True), (2, "b", False))
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            s.run()
    with pytest.raises(ValueError, match="nothing"):
        streams.Outcomes(spark, s.target).rows()
    s.run()
    assert s.rows() == [("a", "done", 1), ("b", "failed", 1)]
    # one that was committed, whose checkpoint doesn't know it: passed over
    table = streams.Outcomes(spark, s.target)
    run, batch = next(iter(table.manifest.read().content["runs"].items()))
    streams.attempt(spark.createDataFrame([(9, "z", True)], INPUT), s.target, run, batch, s.step, "key", input_key="identity", final=DONE)
    assert len(s.rows()) == 2


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "MERGE", 3)
    s = Source(spark, tmp_path, final=DONE)
    for n in range(11):
        streams.attempt(spark.createDataFrame([(n, f"k{n}", True), (n, "same", True)], INPUT), s.target, "run", n, s.step, "key", input_key="identity", final=DONE)
    parts = streams.Outcomes(spark, s.target).manifest.read().content["parts"]
    assert sorted(p["level"] for p in parts) == [0, 0, 2] or len(parts) <= 6
    assert s.rows() == sorted([(f"k{n}", "done", 1) for n in range(11)] + [("same", "done", 1)])
    # merged parts go with the commit after
    assert len([n for n in storage.names(spark, s.target) if n.startswith("part=")]) <= len(parts) + 3


def test_state_of_a_dedupe_goes(spark, tmp_path):
    """Repeats within the delay are dropped, one later counts anew, one older than the watermark is dropped; the state stays small."""
    src, target = str(tmp_path / "src"), str(tmp_path / "out")
    start = datetime(2024, 1, 1)
    schema = "key string, at timestamp_ntz, n int"

    def add(*rows):
        spark.createDataFrame([(k, start + timedelta(minutes=m), n) for k, m, n in rows], schema).coalesce(1).write.mode("append").parquet(src)

    add(("a", 0, 1), ("b", 5, 2), ("a", 6, 3))
    states = []

    def run():
        q = streams.tail(streams.dedupe_within(streams.source(spark, src, schema), ["key"], "at", "10 minutes"), target, str(tmp_path / "c"))
        q.awaitTermination()
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
        return sorted(r.n for r in spark.read.parquet(target).collect())

    assert run() == [1, 2]
    add(("a", 9, 4), *[(f"k{i}", 60 + i, 10 + i) for i in range(5)])
    assert run() == [1, 2, *range(10, 15)]
    add(("a", 70, 5), ("b", 20, 6), ("k4", 66, 7))
    assert run() == [1, 2, 5, *range(10, 15)]
    add(*[(f"m{i}", 200 + i, 20 + i) for i in range(3)])
    run()
    add(("z", 230, 30))
    run()
    assert states[-1] <= 4 < states[1]


EVENT = "id string, type string, occurred_at timestamp, aggregate_key string, source string, data string"


def event_rows(spark, *ids):
    return spark.createDataFrame([(i, "t", datetime(2024, 1, 1), "k", "s", "{}") for i in ids], EVENT)


@pytest.mark.parametrize("store", [event_log.EventLog, event_log.JournalLog])
def test_stage_output_in_the_log(spark, tmp_path, monkeypatch, store):
    """Dense sequences over batches, a commit that is lost between write and manifest, and a new checkpoint."""
    src = str(tmp_path / "src")
    log = store(spark, str(tmp_path / "log"))
    log.append(event_rows(spark, "begin"), "id", now=now())

    def add(*ids):
        event_rows(spark, *ids).coalesce(1).write.mode("append").parquet(src)

    def run(checkpoint):
        streams.to_log(streams.source(spark, src, EVENT), log, str(tmp_path / checkpoint), "id", now=now()).awaitTermination()

    add("a", "b", "a")
    run("c")
    add("c", "b")
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            run("c")
    assert log.latest() == 3
    run("c")
    run("other")
    add("d")
    run("other")
    run("c")
    got = [(r.sequence, r.id) for r in log.records().orderBy("sequence").collect()]
    assert got == [(1, "begin"), (2, "a"), (3, "b"), (4, "c"), (5, "d")]


def test_a_part_has_one_file_a_bucket(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("sequence"), F.col("id").cast("string").alias("identity"), F.lit(True).alias("good"))
    rows.repartition(8).write.parquet(str(tmp_path / "src"))
    stream = streams.source(spark, str(tmp_path / "src"), INPUT, 8)
    streams.stage(stream, str(tmp_path / "out"), str(tmp_path / "c"), lambda df: df, "sequence").awaitTermination()
    assert len(list((tmp_path / "out").glob("part=*/bucket=*/*.parquet"))) == streams.BUCKETS
    assert streams.Outcomes(spark, str(tmp_path / "out")).rows().count() == 2000


def test_rows_come_back_in_three_batches_however_many_files(spark, tmp_path):
    from tidemark.plans import stream_queries

    rows = spark.range(0, 300, 1, 30).select("id", (F.col("id") % 10).alias("k"))
    a_batch = stream_queries._dealt(spark, rows, str(tmp_path / "src"), "k")
    files = list((tmp_path / "src").glob("*.parquet"))
    assert len(files) <= a_batch * stream_queries.BATCHES
    keys = [r.k for f in files for r in spark.read.parquet(str(f)).select("k").distinct().collect()]
    assert sorted(keys) == list(range(10))
