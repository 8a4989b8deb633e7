"""Journals, the event log, discovery that is safe to run again, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import event_log, filings
from tidemark.sources import corpus, journal, listings
from tidemark.streaming import streams

EVENT = "id string, type string, occurred_at timestamp, aggregate_key string, source string, data string"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def record(n, **changed):
    event = {"id": f"e{n}", "type": "t", "occurred_at": "2024-01-01T00:00:00Z", "aggregate_key": "k", "source": "s", "data": "{}"} | changed
    import json

    return json.dumps({"sequence": n, "event": event, "appended_at": "2024-01-01T01:00:00Z"})


def test_journal_torn_and_damaged(spark, tmp_path):
    (tmp_path / "2024-01-01.ndjson").write_text(record(1) + "\n\n" + record(2) + "\n" + '{"sequence": 3, "ev')
    (tmp_path / "2024-01-02.ndjson").write_text("garbage\n" + record(4) + "\n")
    (tmp_path / "other.txt").write_text(record(9) + "\n")
    assert sorted(r.sequence for r in journal.scan_journal(spark, str(tmp_path)).collect()) == [1, 2, 4]
    verdicts = sorted((r.file.rsplit("/", 1)[-1], r.verdict) for r in journal.quarantined(spark, str(tmp_path)).collect())
    assert verdicts == [("2024-01-01.ndjson", "dropped"), ("2024-01-02.ndjson", "error")]
    with pytest.raises(Exception, match="malformed record in"):
        journal.strict_journal(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("store", [event_log.EventLog, event_log.JournalLog])
def test_append_read_reopen(spark, tmp_path, store):
    log = store(spark, str(tmp_path / "log"))
    assert log.latest() == 0
    rows = [(f"e{i}", "t", None, "k", "s", "{}") for i in range(50)]
    log.append(spark.createDataFrame(rows, EVENT), "id", now=now())
    log.append(spark.createDataFrame([("x", "t", datetime(2024, 1, 1), "k", "s", "null")], EVENT), "id", now=now())
    again = store(spark, str(tmp_path / "log"))
    assert again.latest() == 51
    last = again.read(51, 1).first()
    assert (last.id, last.type, last.occurred_at, last.data, last.appended_at) == ("x", "t", datetime(2024, 1, 1), "null", datetime(2024, 2, 1))
    assert [r.sequence for r in again.read(50, 10).collect()] == [50, 51]
    assert again.read(1, 0).count() == 0
    with pytest.raises(ValueError, match="limit"):
        again.read(1, -1)
    with pytest.raises(ValueError, match="no events"):
        log.append(spark.createDataFrame([], EVENT), "id", now=now())
    for bad, why in ((("", "t", None, "", "", "{}"), "missing id"), (("a", None, None, "", "", "{}"), "missing type"), (("a", "t", None, "", "", ""), "missing data")):
        with pytest.raises(ValueError, match=why):
            log.append(spark.createDataFrame([bad], EVENT), "id", now=now())
    assert again.latest() == 51


def test_numbering_is_dense(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = event_log.numbered(rows, "k", start=7).orderBy("k").collect()
    assert [r.sequence for r in got] == list(range(8, 1008))


def test_a_batch_is_not_merged_into_one_task(spark):
    """Spark would merge what is dealt out into as few parts as there are cores, however many rows they have."""
    rows = spark.range(20_000).selectExpr("id % 9000 AS k", "id AS n")
    keys = lambda df: sorted((r.k, r.n, r.nth) for r in df.collect())
    got = event_log.first_in_batch(rows, ["k"], "n", partitions=16)
    assert keys(got) == keys(event_log.first_in_batch(rows, ["k"], "n"))
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2_000


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_sorted_once_and_not_kept_as_tables(spark):
    import __spark_entry__

    plan = _plan(__spark_entry__.queries()["dedupe_in_batch"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan


@pytest.mark.parametrize("name, times", [("discovery_summary", 2), ("discover_filings", 1), ("submissions_explode", 1), ("submissions_errors", 1)])
def test_listing_documents_are_made_and_parsed_once(spark, name, times):
    """By each of the branches of a summary; filters on what a parser gives had copies of it, and of what made its text."""
    import __spark_entry__

    plan = _plan(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("from_json(StructField(cik,StringType,true), StructField(filings") == times
    assert plan.count("get_json_object(") <= 1


def test_seen_identities_are_parsed_once(spark):
    data = ['{"cik": "1", "accession_number": " a "}', '{"cik": "0000000001", "accession_number": "a"}', '{"cik": "1"}', '{"cik": "", "accession_number": "b"}', '{"cik": 2, "accession_number": "b", "form": {}}', "broken", None]
    log = spark.createDataFrame([("filing_discovered", d) for d in data] + [("other", data[0])], "type string, data string")
    seen = filings.seen_identities(log)
    assert _plan(seen).count("from_json(") == 1  # before it has run: the plan then is there twice
    assert sorted(r.identity for r in seen.collect()) == ["0000000001:a", "0000000002:b"]


def test_tagged_rows_are_dealt_and_sorted_once(spark):
    rows = spark.createDataFrame([("x", 2), ("x", 1), ("y", 1), ("z", 1), ("z", 2), (None, 1)], "identity string, n int")
    seen = spark.createDataFrame([("z",), ("w",)], "identity string")
    tagged = filings.tagged(rows, seen, "n")
    plan = _plan(tagged)
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 2  # the batch and the log
    assert "Broadcast" not in plan
    assert tagged.columns == ["identity", "n", "fresh"]
    assert sorted(map(str, tagged.collect())) == sorted(map(str, rows.selectExpr("identity", "n", "coalesce(identity, '') <> 'z' AND NOT (identity <=> 'x' AND n = 2) AS fresh").collect()))


def submissions(spark, **arrays):
    import json

    recent = {"accessionNumber": ["1", "2", " "], "form": ["10-K", "8-K", "x"], "filingDate": ["d1", "d2", "d3"], "primaryDocument": ["a", "b", "c"], "acceptanceDateTime": ["t1"]} | arrays
    doc = json.dumps({"cik": "320193", "filings": {"recent": recent}})
    return listings.submissions(spark.createDataFrame([("aapl", doc)], "ticker string, json string"))


def test_submissions(spark):
    rows = listings.recent_filings(submissions(spark)).orderBy("accession").collect()
    assert [(r.ticker, r.cik, r.accession, r.form, r.acceptance_datetime) for r in rows] == [("AAPL", "0000320193", "1", "10-K", "t1"), ("AAPL", "0000320193", "2", "8-K", "")]
    assert submissions(spark, form=["10-K"]).first().error == "form"
    assert listings.recent_filings(submissions(spark, form=["10-K"])).count() == 0
    assert listings.recent_filings(submissions(spark, accessionNumber=[])).count() == 0


def test_discovery_again_finds_nothing(spark, tmp_path):
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    watch = spark.createDataFrame([("0000320193", ["8-K"], True), ("0000000001", [], True)], "cik string, allowed_forms array<string>, enabled boolean")

    def run(dry):
        found = filings.tagged(filings.watched_filings(watch, listings.recent_filings(submissions(spark))), filings.seen_identities(log.records()), "accession")
        fresh = found.where("fresh")
        n, old = fresh.count(), found.count()
        if n and not dry:
            log.append(filings.discovery_events(fresh, now()), "id", now=now())
        return n, old - n

    assert run(True) == (1, 0)
    assert run(False) == (1, 0)
    assert run(False) == (0, 1)
    assert log.latest() == 1


def test_stage_replays_nothing(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "out")
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(40)], "sequence long, key string")
    rows.repartition(4).write.parquet(src)
    for attempt in ("a", "b"):  # a new checkpoint reads all again, as after a loss
        stream = streams.source(spark, src, rows.schema)
        streams.stage(stream, target, str(tmp_path / attempt), lambda df: df, "key").awaitTermination()
        got = spark.read.parquet(target)
        assert sorted(r.key for r in got.collect()) == [f"k{i}" for i in range(7)]


def test_two_logs_are_numbered_by_themselves(spark, tmp_path):
    filings_log, bodies = event_log.JournalLog(spark, str(tmp_path / "a")), event_log.EventLog(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([(f"e{i}", "t", None, "k", "s", "{}") for i in range(3)], EVENT)
    filings_log.append(rows, "id", now=now())
    bodies.append(rows.limit(1), "id", now=now())
    assert (filings_log.latest(), bodies.latest()) == (3, 1)


def test_later_batches_read_their_own_buckets(spark, tmp_path, monkeypatch):
    """Two rounds over a growing source; the second sees what the first wrote."""
    src, target = str(tmp_path / "src"), str(tmp_path / "out")
    rows = lambda ks: spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "sequence long, key string")
    rows("abc").coalesce(1).write.parquet(src)
    asked = []
    earlier = streams.earlier
    monkeypatch.setattr(streams, "earlier", lambda *a: asked.append(len(a[-1])) or earlier(*a))
    start = lambda: streams.stage(streams.source(spark, src, rows("").schema), target, str(tmp_path / "c"), lambda df: df, "key")
    streams.rounds(start, 2, lambda n: rows("cdd").coalesce(1).write.mode("append").parquet(src))
    assert sorted(r.key for r in spark.read.parquet(target).collect()) == ["a", "b", "c", "d"]
    assert max(asked) <= 3
    with pytest.raises(ValueError, match="round"):
        streams.rounds(start, 0)


def test_feed_streams_cards(spark, tmp_path):
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    rows = [(f"e{i}", "filing_discovered", datetime(2024, 1, 31, 23, 59), "k", "sec", '{"form": "8-K", "cik": "1"}') for i in range(4)]
    log.append(spark.createDataFrame(rows, EVENT), "id", now=now())
    stream = streams.source(spark, log.path, log.records().schema)
    streams.feed(stream, str(tmp_path / "cards"), str(tmp_path / "c"), now()).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "cards")).collect()
    assert sorted(r.sequence for r in got) == [1, 2, 3, 4] and {(r.headline, r.ago, r["class"]) for r in got} == {("8-K (1)", "1m ago", "sec")}


def test_tree_of_a_corpus(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, text in {"A_1/f_1/metadata.json": "{}", "A_1/f_1/doc.htm": "<html>", "A_1/f_1/sub/x.xml": "y", "B_2/f_2/index.json": "{}", "readme.txt": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = corpus.tree(spark, str(root))
    assert {r.path: r.length for r in files.collect()} == {"A_1/f_1/metadata.json": 2, "A_1/f_1/doc.htm": 6, "A_1/f_1/sub/x.xml": 1, "B_2/f_2/index.json": 2, "readme.txt": 1}
    units = {(r.issuer, r.filing): r for r in corpus.units(corpus.path_parts(files)).collect()}
    assert units["A_1", "f_1"].files == ["doc.htm", "metadata.json", "sub/x.xml"] and units["A_1", "f_1"].candidates == ["doc.htm", "sub/x.xml"]
    assert units["B_2", "f_2"]["index"] == "index.json" and len(units) == 2


def test_discovery_of_a_corpus_is_deterministic(spark):
    """Units, their files and their order don't depend on how the files are dealt out."""
    paths = [(f"I{i % 3}/f{i % 7}/{n}", i) for i in range(200) for n in ("metadata.json", "index.json", f"d{i}.htm", f"r{i}.jpg")]
    files = spark.createDataFrame(paths, "path string, length int")
    found = [[tuple(r) for r in corpus.units(corpus.path_parts(f)).orderBy("issuer", "filing").collect()] for f in (files, files.repartition(13), files.orderBy(F.rand(3)).repartition(5, "length"))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 21
