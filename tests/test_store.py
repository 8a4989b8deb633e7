"""The log's manifest: files opened, two writers, batches that happen once, sealed indexes."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import event_log, storage
from tidemark.operators.manifest import Manifest

EVENT = "id string, type string, occurred_at timestamp, aggregate_key string, source string, data string"


def now(day=1):
    return F.lit(f"2024-02-{day:02d} 00:00:00").cast("timestamp")


def events(spark, low, high, mark="e"):
    return spark.createDataFrame([(f"{mark}{i:04d}", "t", None, "k", "s", "{}") for i in range(low, high)], EVENT)


def numbers(log):
    return [(r.sequence, r.id) for r in log.records().orderBy("sequence").collect()]


def scanned(df):
    """Files and rows that the plan's scans have read."""
    df.collect()
    files = rows = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            files += metrics.apply("numFiles").value()
            rows += metrics.apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return files, rows


def test_a_page_opens_the_files_that_hold_it(spark, tmp_path):
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    for n in range(6):
        log.append(events(spark, n * 100, n * 100 + 100), "id", now=now(n + 1))
    all_files, all_rows = scanned(log.records())
    assert all_rows == 600 and all_files >= 6
    page = log.read(150, 20)
    files, rows = scanned(page)
    assert [r.sequence for r in page.collect()] == list(range(150, 170))
    assert files < all_files / 4 and rows <= 100
    assert scanned(log.snapshot(5)[0])[1] <= 100
    assert len(log.files(201, 300)) + len(log.files(1, 200)) + len(log.files(301)) == all_files
    # the latest sequences come from the manifest
    assert log.latest() == 600
    assert {str(r.day): r.latest for r in log.latest_by_journal().collect()} == {f"2024-02-0{n}": n * 100 for n in range(1, 7)}
    assert [r.sequence for r in log.read(-3, 2).collect()] == [1, 2] and log.read(601, 5).count() == 0


@pytest.mark.parametrize("store", [event_log.EventLog, event_log.JournalLog])
def test_the_writer_that_comes_second_numbers_anew(spark, tmp_path, monkeypatch, store):
    path = str(tmp_path / "log")
    log, other = store(spark, path), store(spark, path)
    log.append(events(spark, 0, 3), "id", now=now())
    write = log.write
    raced = []

    def write_slowly(records, folder):
        write(records, folder)
        if not raced:  # another append comes between this one's write and its commit
            raced.append(other.append(events(spark, 10, 15, "o"), "id", now=now()))

    monkeypatch.setattr(log, "write", write_slowly)
    got = log.append(events(spark, 3, 6), "id", now=now())
    assert sorted(r.sequence for r in got.collect()) == [9, 10, 11]
    assert numbers(store(spark, path)) == [(n, i) for n, i in enumerate(["e0000", "e0001", "e0002", "o0010", "o0011", "o0012", "o0013", "o0014", "e0003", "e0004", "e0005"], 1)]
    assert len(storage.names(spark, path)) == 4  # the overtaken folder is gone


def test_a_lost_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    log.append(events(spark, 0, 3), "id", now=now())
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            log.append(events(spark, 3, 6), "id", now=now(), token="run:0")
    assert log.latest() == 3 and len(numbers(log)) == 3
    for _ in range(2):  # and a batch that comes again is numbered once
        assert sorted(r.sequence for r in log.append(events(spark, 3, 6), "id", now=now(), token="run:0").collect()) == [4, 5, 6]
    log.append(events(spark, 6, 8), "id", now=now(), token="run:1")
    assert log.append(events(spark, 3, 6), "id", now=now(), token="run:0").count() == 0  # before the run's last batch
    assert numbers(log) == [(n, f"e{n - 1:04d}") for n in range(1, 9)]


def test_commit_of_an_old_view_fails(spark, tmp_path, monkeypatch):
    manifest = Manifest(spark, str(tmp_path / "t"))
    old = manifest.read()
    assert old.version == 0 and manifest.commit(old, {"n": 1}) and not manifest.commit(old, {"n": 2})
    assert manifest.read().content == {"n": 1}
    view = manifest.read()
    view.read_at -= 7 * 3600
    assert not manifest.commit(view, {"n": 3})
    # versions are tidied once nobody can commit upon them
    monkeypatch.setattr("tidemark.operators.manifest.STALE", 0.0)
    monkeypatch.setattr("tidemark.operators.manifest.KEPT", 2)
    for n in range(4, 10):
        view = manifest.read()
        view.read_at += 60
        assert manifest.commit(view, {"n": n})
    assert manifest.read().content == {"n": 9} and len(storage.names(spark, manifest.folder)) <= 4


def test_sealed_indexes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_log.Store, "SEAL", 4)
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    for n in range(7):
        log.append(events(spark, n * 10, n * 10 + 10), "id", now=now(n % 3 + 1))
    content = log.manifest.read().content
    assert content["sealed"] and sum(len(e["files"]) for e in content["open"]) < 4
    assert [s for s, _ in numbers(log)] == list(range(1, 71)) and log.latest() == 70
    assert [r.sequence for r in log.read(15, 30).collect()] == list(range(15, 45))
    assert {str(r.day): r.latest for r in log.latest_by_journal().collect()} == {"2024-02-01": 70, "2024-02-02": 50, "2024-02-03": 60}


@pytest.mark.parametrize("store", [event_log.EventLog, event_log.JournalLog])
def test_compaction(spark, tmp_path, monkeypatch, store):
    path = str(tmp_path / "log")
    log, other = store(spark, path), store(spark, path)
    assert not log.compact()
    for n in range(4):
        log.append(events(spark, n * 10, n * 10 + 10), "id", now=now(1), token=f"run:{n}")
    before, files = numbers(log), len(log.files())
    write = log.write
    with monkeypatch.context() as m:  # an append comes between
        m.setattr(log, "write", lambda records, folder: (write(records, folder), other.append(events(spark, 40, 45), "id", now=now(5))))
        assert log.compact()
    assert numbers(log)[:40] == before and [s for s, _ in numbers(log)] == list(range(1, 46))
    assert len(log.entries(log.manifest.read().content)) == 2 and len(log.files(1, 40)) < files
    assert [r.sequence for r in log.read(8, 5).collect()] == [8, 9, 10, 11, 12] and log.latest() == 45
    # what was appended once stays so, and what was replaced goes when it is old
    assert log.append(events(spark, 30, 40), "id", now=now(4), token="run:3").count() == 10 and log.latest() == 45
    assert log.vacuum() == 0 and log.vacuum(0) == 4 and log.vacuum(0) == 0
    assert [s for s, _ in numbers(log)] == list(range(1, 46)) and len([n for n in storage.names(spark, path) if n.startswith("append=")]) == 2


def test_compaction_that_another_has_overtaken(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log, other = event_log.EventLog(spark, path), event_log.EventLog(spark, path)
    for n in range(2):
        log.append(events(spark, n * 10, n * 10 + 10), "id", now=now())
    write, raced = log.write, []
    monkeypatch.setattr(log, "write", lambda records, folder: (write(records, folder), raced.append(other.compact())))
    assert not log.compact() and raced == [True]
    assert len(numbers(log)) == 20 and len(log.entries(log.manifest.read().content)) == 1
