"""Growing journals and the log as streams; bytes and sequences as offsets."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import event_log
from tidemark.sources import journal, tailing
from tidemark.streaming import streams

EVENT = "id string, type string, occurred_at timestamp, aggregate_key string, source string, data string"


def now(day="2024-02-01"):
    return F.lit(f"{day} 00:00:00").cast("timestamp")


def record(n, kind="t"):
    return json.dumps({"sequence": n, "event": {"id": f"e{n}", "type": kind, "occurred_at": "2024-01-01T00:00:00Z", "aggregate_key": "k", "source": "s", "data": "{}"}, "appended_at": "2024-01-01T01:00:00Z"})


def grown(path, text):
    with open(path, "a") as f:
        f.write(text)


def test_tail_of_a_growing_journal(spark, tmp_path):
    """Each line once, over rounds in which the same file grows, is torn, is mended, and another day begins."""
    folder, target, checkpoint = tmp_path / "j", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()
    day = folder / "2024-01-01.ndjson"

    def round_of():
        streams.tail(tailing.journal_records(spark, str(folder), split=100), target, checkpoint).awaitTermination()
        return sorted(r.sequence for r in spark.read.parquet(target).collect())

    grown(day, record(1) + "\n\n" + record(2) + "\n" + record(3)[:30])
    (folder / "other.txt").write_text(record(99) + "\n")
    assert round_of() == [1, 2]
    assert round_of() == [1, 2]  # nothing new, the torn line stays back
    grown(day, record(3)[30:] + "\n" + "".join(record(n) + "\n" for n in range(4, 40)))
    assert round_of() == list(range(1, 40))
    grown(day, record(40) + "\n")
    grown(folder / "2024-01-02.ndjson", record(41) + "\n  " + record(42) + " \n")
    assert round_of() == list(range(1, 43))
    one = spark.read.parquet(target).where("sequence = 42").first()
    assert (one.id, one.type, one.data, str(one.appended_at)) == ("e42", "t", "{}", "2024-01-01 01:00:00")


def test_damaged_line_of_a_growing_journal(spark, tmp_path):
    (tmp_path / "2024-01-01.ndjson").write_text(record(1) + "\ngarbage\n" + record(2) + "\n")
    with pytest.raises(Exception, match="malformed record in 2024-01-01.ndjson at byte"):
        streams.tail(tailing.journal_records(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    streams.tail(tailing.journal_records(spark, str(tmp_path), strict=False), str(tmp_path / "out2"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.sequence for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == [1, 2]


@pytest.mark.parametrize("split", [1, 7, 64, 1000])
def test_ranges_of_a_journal(tmp_path, split):
    """However a range is cut, each line goes to one task; long lines and multi-byte letters too."""
    lines = ["a", "", "é" * 50, "x" * 300, "{}", "end"]
    path = tmp_path / "x.ndjson"
    path.write_text("".join(f"{x}\n" for x in lines) + "torn")
    reader = tailing.JournalTail({"path": str(tmp_path), "split": str(split)})
    end = reader.latestOffset()
    assert end == {"x.ndjson": path.stat().st_size - 4}
    got = [(a, v) for p in reader.partitions({}, end) for b in reader.read(p) for a, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert [v for _, v in got] == lines
    assert [path.read_bytes()[a:].split(b"\n")[0].decode() for a, _ in got] == lines
    middle = {"x.ndjson": got[3][0]}
    assert [v for p in reader.partitions(middle, end) for b in reader.read(p) for v in b.column(2).to_pylist()] == lines[3:]
    path.write_text("a\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.latestOffset()
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(end, tailing.JournalTail({"path": str(tmp_path)}).latestOffset())
    assert tailing.JournalTail({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_grown_journals_are_scanned_alike(spark, tmp_path):
    rows = spark.range(1, 201).select(F.col("id").alias("sequence"), F.concat(F.lit("e"), F.col("id")).alias("id"), F.lit("t").alias("type"), now().alias("occurred_at"), F.lit("k").alias("aggregate_key"), F.lit("s").alias("source"), F.lit("{}").alias("data"), (now() + F.make_dt_interval(days=(F.col("id") % 3).cast("int"))).alias("appended_at"))
    path = str(tmp_path / "j")
    for k in (0, 1):
        journal.grow_journal(rows.where(F.col("sequence") % 2 == k), path)
    assert sorted(p.name for p in (tmp_path / "j").iterdir()) == ["2024-02-01.ndjson", "2024-02-02.ndjson", "2024-02-03.ndjson"]
    assert journal.scan_journal(spark, path).exceptAll(rows).isEmpty() and journal.strict_journal(spark, path).count() == 200


def events(spark, low, high):
    return spark.createDataFrame([(f"e{i:04d}", "filing_discovered", None, "k", "sec", '{"form": "8-K"}') for i in range(low, high)], EVENT)


def test_log_as_a_stream(spark, tmp_path):
    """Newest records, then live ones: what is appended between start and stream comes once."""
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    log.append(events(spark, 0, 30), "id", now=now())
    log.append(events(spark, 30, 100), "id", now=now("2024-02-02"))

    def shown():
        streams.live_feed(log, target, checkpoint, now(), newest=50).awaitTermination()
        return sorted(r.sequence for r in spark.read.parquet(target).collect())

    assert shown() == list(range(51, 101))
    log.append(events(spark, 100, 120), "id", now=now("2024-02-03"))
    assert shown() == list(range(51, 121)) == shown()
    # a snapshot for a reader, rows appended, then the stream from where the snapshot ends
    rows, start = log.snapshot(50)
    assert [r.sequence for r in rows.collect()] == list(range(71, 121)) and start == 121
    log.append(events(spark, 120, 125), "id", now=now("2024-02-03"))
    streams.tail(tailing.log_records(spark, log.path, start=start), str(tmp_path / "rest"), str(tmp_path / "d")).awaitTermination()
    rest = spark.read.parquet(str(tmp_path / "rest")).orderBy("sequence").collect()
    assert [(r.sequence, r.id) for r in rest] == [(n, f"e{n - 1:04d}") for n in range(121, 126)]
    assert [tuple(r) for r in rest] == [tuple(r) for r in log.between(121, 125).orderBy("sequence").collect()]


def test_a_log_that_is_not_there_yet(spark, tmp_path):
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    rows, start = log.snapshot()
    assert rows.count() == 0 and start == 1
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    streams.live_feed(log, target, checkpoint, now()).awaitTermination()
    log.append(events(spark, 0, 3), "id", now=now())
    streams.live_feed(log, target, checkpoint, now()).awaitTermination()
    assert spark.read.parquet(target).count() == 3
