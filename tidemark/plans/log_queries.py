"""Queries over the event log and its feed."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import relative_time, rfc3339
from ..operators import event_log, feed
from ..operators.storage import scratch
from ..sources import journal
from .bindings import LOG, NOW, log, now, table
from .registry import query

TEXT = "%Y-%m-%d %H:%M:%S.%f"


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _sql(body: str) -> str:
    return f"WITH {LOG} {body}"


def _journal(spark: SparkSession, sf_dir: str, damaged: bool) -> str:
    path = scratch(spark)
    rows = log(spark, sf_dir)
    if not damaged:
        journal.write_journal(rows, path)
        return path
    whole = F.to_json(F.struct("sequence", F.struct(*journal.EVENT_COLUMNS).alias("event"), "appended_at"))
    text = F.when(F.col("sequence") % 101 == 0, F.substring(whole, 1, 40)).when(F.col("sequence") % 103 == 0, "  ").otherwise(whole)
    rows.select(text.alias("value"), F.to_date("appended_at").alias("day")).write.partitionBy("day").option("compression", "none").text(path)
    return path


def _stored_log(spark: SparkSession, sf_dir: str) -> event_log.EventLog:
    stored = event_log.EventLog(spark, scratch(spark))
    stored.append(log(spark, sf_dir).drop("sequence", "appended_at"), "occurred_at", "id", now=now())
    return stored


@query("journal_scan", _sql("SELECT sequence, id, type, aggregate_key, source, data, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at FROM log"))
def _(spark, sf_dir):
    """Written as journals and read back."""
    records = journal.scan_journal(spark, _journal(spark, sf_dir, False))
    return records.select("sequence", "id", "type", "aggregate_key", "source", "data", _text("occurred_at"))


@query("journal_quarantine", _sql("SELECT 'error' AS verdict, count(*)::BIGINT AS n FROM log WHERE sequence % 101 = 0"))
def _(spark, sf_dir):
    return journal.quarantined(spark, _journal(spark, sf_dir, True)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("journal_last_lines", _sql("SELECT count(DISTINCT appended_at::DATE)::BIGINT AS days, true AS ended FROM log"))
def _(spark, sf_dir):
    """Every day has a last line, and no journal of ours ends amid one."""
    lines = journal.journal_lines(spark, _journal(spark, sf_dir, False))
    ends = journal.last_per_file(lines).join(journal.open_files(lines), "file").where(journal.parsed_record(F.col("value")).isNotNull())
    return ends.agg(F.count_distinct(F.regexp_extract("file", "day=([0-9-]+)", 1)).alias("days"), F.bool_and(~F.col("open")).alias("ended"))


@query("append_records", _sql("SELECT 1 + row_number() OVER (ORDER BY occurred_at, id)::BIGINT AS sequence, id, type, source FROM log WHERE data IS NOT NULL UNION ALL SELECT 1, 'first', 'begin', ''"))
def _(spark, sf_dir):
    """Appended to a log that has a record, then read from the log opened anew."""
    path = scratch(spark)
    first = spark.createDataFrame([("first", "begin", None, "", "", "{}")], "id string, type string, occurred_at timestamp, aggregate_key string, source string, data string")
    event_log.EventLog(spark, path).append(first, "id", now=now())
    event_log.EventLog(spark, path).append(log(spark, sf_dir).drop("sequence", "appended_at"), "occurred_at", "id", now=now())
    return event_log.EventLog(spark, path).records().select("sequence", "id", "type", "source")


@query("journal_append", _sql("SELECT row_number() OVER (ORDER BY occurred_at, id)::BIGINT AS sequence, id, data FROM log"))
def _(spark, sf_dir):
    """The same in the other store, a log of journals."""
    path = scratch(spark)
    event_log.JournalLog(spark, path).append(log(spark, sf_dir).drop("sequence", "appended_at"), "occurred_at", "id", now=now())
    return event_log.JournalLog(spark, path).records().select("sequence", "id", "data")


@query("second_log", _sql("SELECT aggregate_key, count(*)::BIGINT AS n, max(k)::BIGINT AS latest FROM (SELECT *, row_number() OVER (ORDER BY occurred_at, id) AS k FROM log WHERE type IN ('pr_body_fetched', 'pr_body_failed')) GROUP BY 1"))
def _(spark, sf_dir):
    """Bodies in a log of their own, numbered by itself."""
    bodies = event_log.EventLog(spark, scratch(spark))
    rows = event_log.of_type(log(spark, sf_dir), "pr_body_fetched", "pr_body_failed").drop("sequence", "appended_at")
    bodies.append(rows, "occurred_at", "id", now=now())
    return bodies.records().groupBy("aggregate_key").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("latest"))


@query(
    "validate_events",
    _sql(
        """SELECT sequence, CASE WHEN sequence % 7 = 0 THEN 'missing id' WHEN sequence % 11 = 0 THEN 'missing type' WHEN sequence % 13 = 0 THEN 'missing data' END AS violation FROM log"""
    ),
)
def _(spark, sf_dir):
    rows = log(spark, sf_dir)
    blanked = rows.withColumns({"id": F.when(F.col("sequence") % 7 == 0, "").otherwise(F.col("id")), "type": F.when(F.col("sequence") % 11 != 0, F.col("type")), "data": F.when(F.col("sequence") % 13 == 0, "").otherwise(F.col("data"))})
    return event_log.validated(blanked).select("sequence", "violation")


@query("default_occurred_at", _sql(f"SELECT sequence, strftime(CASE WHEN sequence % 9 = 0 THEN TIMESTAMP '{NOW}' ELSE occurred_at END, '{TEXT}') AS occurred_at FROM log"))
def _(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("occurred_at", F.when(F.col("sequence") % 9 != 0, F.col("occurred_at")))
    return event_log.with_occurred_at(rows, now()).select("sequence", _text("occurred_at"))


@query("read_from", _sql("SELECT sequence, id FROM log WHERE sequence >= 4000 ORDER BY sequence LIMIT 512"))
def _(spark, sf_dir):
    return event_log.read_from(log(spark, sf_dir), 4000, event_log.PAGE).select("sequence", "id")


@query("read_page", _sql("SELECT sequence, id FROM (SELECT row_number() OVER (ORDER BY occurred_at, id)::BIGINT AS sequence, id FROM log) WHERE sequence BETWEEN 4000 AND 4511"))
def _(spark, sf_dir):
    """A page of a stored log: of its files only those that hold it are opened."""
    return _stored_log(spark, sf_dir).read(4000, event_log.PAGE).select("sequence", "id")


@query("latest_of_store", _sql("SELECT strftime(appended_at, '%Y-%m-%d') AS day, count(*)::BIGINT AS latest FROM (SELECT TIMESTAMP '2024-02-01' AS appended_at FROM log) GROUP BY 1"))
def _(spark, sf_dir):
    """The latest sequence of each day, from the manifest, without a scan."""
    return _stored_log(spark, sf_dir).latest_by_journal().select(F.date_format("day", "yyyy-MM-dd").alias("day"), "latest")


@query("append_two_writers", _sql("SELECT count(*)::BIGINT AS n, 1::BIGINT AS first, count(*)::BIGINT AS last, count(*)::BIGINT AS sequences, count(DISTINCT id)::BIGINT AS ids FROM log"))
def _(spark, sf_dir):
    """Two writers append to one log at a time; numbers stay dense and unique."""
    path, rows = scratch(spark), log(spark, sf_dir)

    def write(k: int) -> None:
        for part in (0, 1):
            mine = rows.where((F.col("sequence") % 4) == 2 * part + k).drop("sequence", "appended_at")
            event_log.EventLog(spark, path).append(mine, "occurred_at", "id", now=now())

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, (0, 1)))
    found = event_log.EventLog(spark, path).records()
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count_distinct("sequence").alias("sequences"), F.count_distinct("id").alias("ids"))


@query("events_by_type", _sql("SELECT sequence, aggregate_key FROM log WHERE type IN ('pr_body_fetched', 'pr_body_failed')"))
def _(spark, sf_dir):
    return event_log.of_type(log(spark, sf_dir), "pr_body_fetched", "pr_body_failed").select("sequence", "aggregate_key")


@query("decode_payload", _sql("SELECT sequence, CASE WHEN sequence % 10 = 0 THEN NULL ELSE (props->>'k')::BIGINT END AS k FROM log JOIN events ON event_id + 1 = sequence"))
def _(spark, sf_dir):
    props = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("sequence"), F.when((F.col("event_id") + 1) % 10 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("data"))
    return event_log.decoded(props, "k BIGINT").select("sequence", F.col("payload.k").alias("k"))


@query("latest_sequence", _sql("SELECT coalesce(max(sequence), 0)::BIGINT AS latest FROM log"))
def _(spark, sf_dir):
    return event_log.latest_sequence(log(spark, sf_dir))


@query("latest_by_journal", _sql("SELECT strftime(appended_at, '%Y-%m-%d') AS day, max(sequence)::BIGINT AS latest FROM log GROUP BY 1"))
def _(spark, sf_dir):
    return event_log.latest_by_journal(log(spark, sf_dir)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "latest")


@query(
    "batch_stats",
    _sql(
        """SELECT ((sequence - 1) // 512)::BIGINT AS batch, count(*)::BIGINT AS records, min(sequence)::BIGINT AS first, max(sequence)::BIGINT AS last,
        count(*) FILTER (type = 'filing_discovered')::BIGINT AS matched, count(*) FILTER (type <> 'filing_discovered')::BIGINT AS skipped FROM log GROUP BY 1"""
    ),
)
def _(spark, sf_dir):
    return event_log.batch_stats(log(spark, sf_dir), F.col("type") == "filing_discovered")


@query("events_by_type_source", _sql("SELECT type, source, count(*)::BIGINT AS n FROM log GROUP BY 1, 2"))
def _(spark, sf_dir):
    return event_log.by_type_source(log(spark, sf_dir))


@query("assign_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id)::BIGINT AS sequence FROM events")
def _(spark, sf_dir):
    return event_log.numbered(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "sequence")


@query("tail_n", _sql("SELECT sequence, id FROM log ORDER BY sequence DESC LIMIT 50"))
def _(spark, sf_dir):
    return event_log.tail(log(spark, sf_dir)).select("sequence", "id")


@query("dedupe_in_batch", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS copies, min(l_partkey)::BIGINT AS first_part FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    keys, li = ["l_orderkey", "l_linenumber"], table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = event_log.first_in_batch(li, keys, "l_partkey", "l_suppkey", partitions=event_log.parts_of(li))
    # counted in the order that the rows have, so that a task holds no tables of keys beside it
    counted = rows.withColumn("copies", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return counted.where("nth = 1").select(*keys, "copies", F.col("l_partkey").alias("first_part"))


@query("duplicate_sequences", _sql("SELECT sequence // 3 AS sequence, count(*)::BIGINT AS n FROM log GROUP BY 1 HAVING count(*) > 1"))
def _(spark, sf_dir):
    """What two writers of one log would leave."""
    rows = log(spark, sf_dir).withColumn("sequence", F.floor(F.col("sequence") / 3).cast("long"))
    return rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("rfc3339", _sql("SELECT sequence, rtrim(rtrim(strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z' AS at FROM log"))
def _(spark, sf_dir):
    return log(spark, sf_dir).select("sequence", rfc3339(F.col("occurred_at")).alias("at"))


@query("journal_day", _sql("SELECT sequence, strftime(appended_at, '%Y-%m-%d') AS day FROM log"))
def _(spark, sf_dir):
    return log(spark, sf_dir).select("sequence", F.date_format(F.to_date("appended_at"), "yyyy-MM-dd").alias("day"))


AGO = f"""CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END"""
SECONDS = f"floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(occurred_at)) / 1000000.0)::BIGINT AS s"


@query("rel_time", _sql(f"SELECT sequence, {AGO} AS ago FROM (SELECT *, {SECONDS} FROM log)"))
def _(spark, sf_dir):
    return log(spark, sf_dir).select("sequence", relative_time(F.col("occurred_at"), now()).alias("ago"))


FIELD = lambda f: f"nullif(data->>'{f}', '')"
HEADLINE = f"""CASE WHEN lower(type) LIKE '%filing%' THEN trim(coalesce({FIELD('form')}, {FIELD('filing_type')}, type) || ' ' || coalesce('(' || coalesce({FIELD('accession')}, {FIELD('cik')}) || ')', ''))
  WHEN lower(type) LIKE '%press%' OR lower(type) LIKE '%news%' THEN coalesce({FIELD('headline')}, {FIELD('title')}, {FIELD('subject')}, type)
  ELSE coalesce({FIELD('headline')}, {FIELD('title')}, {FIELD('summary')}, data) END"""
CLASS = "CASE WHEN source LIKE '%sec%' THEN 'sec' WHEN source LIKE '%pr%' THEN 'pr-newswire' ELSE '' END"


@query("feed_rows", _sql("SELECT sequence AS id, 'record' AS event, id AS event_id, data AS payload FROM log"))
def _(spark, sf_dir):
    inner = F.from_json("data", journal.RECORD)
    return feed.feed_rows(log(spark, sf_dir)).select("id", "event", inner["event"]["id"].alias("event_id"), inner["event"]["data"].alias("payload"))


@query("feed_headline", _sql(f"SELECT sequence, {HEADLINE} AS headline FROM log"))
def _(spark, sf_dir):
    return log(spark, sf_dir).select("sequence", feed.headline().alias("headline"))


@query("feed_source_class", _sql(f"SELECT sequence, {CLASS} AS class FROM log"))
def _(spark, sf_dir):
    return log(spark, sf_dir).select("sequence", feed.source_class().alias("class"))


CARDS = f"""SELECT sequence, coalesce(nullif(source, ''), 'unknown') AS source, coalesce(nullif(aggregate_key, ''), 'N/A') AS ticker, strftime(occurred_at, '{TEXT}') AS shown_at,
  {AGO} AS ago, {CLASS} AS class, {HEADLINE} AS headline FROM (SELECT *, {SECONDS} FROM log)"""


@query("feed_cards", _sql(CARDS))
def _(spark, sf_dir):
    return feed.cards(log(spark, sf_dir), now()).withColumn("shown_at", _text("shown_at"))


@query("feed_latest", _sql("SELECT sequence, id FROM log ORDER BY sequence DESC LIMIT 300"))
def _(spark, sf_dir):
    rows = log(spark, sf_dir)
    return feed.latest(rows.unionByName(rows)).select("sequence", "id")
