"""Streaming queries run to the end of their input; the table they leave is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import event_log, press, signals
from ..operators.storage import names, scratch
from ..sources import journal, tailing
from ..sources import press as cards
from ..streaming import streams
from . import bindings as b
from .bindings import LOG, PAGES, now
from .log_queries import CARDS
from .registry import query
from .text_queries import ANALYSED, CAP, _analysed, _clean, _releases

#: Micro-batches in which rows written at one time come back.
BATCHES = 3


def _dealt(spark, rows, path, *key):
    """rows appended as files, one for each core at least, so that a large table isn't written by a few tasks; gives the files of a batch. Rows of equal key share a file."""
    files = max(BATCHES, spark.sparkContext.defaultParallelism)
    rows.repartition(files, *key).write.mode("append").parquet(path)
    return -(-files // BATCHES)


def _stream(spark, rows, *key):
    """rows written as files and streamed back, a third of them in a batch."""
    path = scratch(spark)
    a_batch = _dealt(spark, rows, path, *key)
    return streams.source(spark, path, rows.schema, a_batch)


def _finished(spark, started, target, schema=None):
    started.awaitTermination()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(target)


def _staged(spark, started, target):
    started.awaitTermination()
    return streams.Outcomes(spark, target).rows()


@query("stream_tail", f"WITH {LOG} SELECT sequence, id, type FROM log")
def _(spark, sf_dir):
    target = scratch(spark)
    rows = b.log(spark, sf_dir)
    started = streams.tail(_stream(spark, rows), target, scratch(spark))
    return _finished(spark, started, target, rows.schema).select("sequence", "id", "type")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf_dir):
    """Each key once, over micro-batches."""
    target = scratch(spark)
    rows = b.table(spark, sf_dir, "events").select("user_id", "event_type", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"))
    started = streams.stage(_stream(spark, rows), target, scratch(spark), lambda df: df, "id")
    return _staged(spark, started, target).select("user_id", "event_type")


@query(
    "stream_body",
    f"""WITH {PAGES} SELECT CASE WHEN ok THEN 'pr_body_fetched:' ELSE 'pr_body_failed:' END || release_id AS id, CASE WHEN ok THEN {_clean('html')} END AS body
    FROM (SELECT cards.*, html, page_id % 3 <> 1 AND octet_length(encode(html)) <= {CAP} AS ok, row_number() OVER (PARTITION BY release_id ORDER BY page_id, pos) AS nth FROM cards JOIN pages USING (page_id)) WHERE nth = 1""",
)
def _(spark, sf_dir):
    """Releases to fetched or failed bodies, each id once, by its first page; contents come from the page table."""
    target = scratch(spark)
    contents = b.table(spark, sf_dir, "pages").where("page_id % 3 <> 1").select("page_id", "html")
    releases = _releases(spark, sf_dir).drop("html", "url", "href", "block")
    step = lambda df: press.body_events(cards.guarded(press.fetched(df, contents, "page_id"), max_bytes=CAP), now())
    started = streams.stage(_stream(spark, releases, "release_id"), target, scratch(spark), step, "aggregate_key", input_key="release_id", arrival=("page_id", "pos"))
    return _staged(spark, started, target).select("id", F.get_json_object("data", "$.body").alias("body"))


@query("stream_signal", f"WITH {ANALYSED} SELECT CASE WHEN failed THEN 'signal_failed:' ELSE 'signal_generated:' END || identity AS id, CASE WHEN NOT failed THEN impact END AS impact FROM a")
def _(spark, sf_dir):
    target = scratch(spark)
    rows = _analysed(spark, sf_dir).drop("text", "clean")  # the events don't carry them
    step = lambda df: signals.signal_events(signals.with_defaults(df, F.col("identity"), F.col("ticker"), now()), now())
    started = streams.stage(_stream(spark, rows), target, scratch(spark), step, "aggregate_key", input_key="identity")
    return _staged(spark, started, target).select("id", F.get_json_object("data", "$.impact_analysis").alias("impact"))


@query("stream_feed", f"WITH {LOG} {CARDS}")
def _(spark, sf_dir):
    target = scratch(spark)
    rows = b.log(spark, sf_dir)
    shown = _finished(spark, streams.feed(_stream(spark, rows), target, scratch(spark), now()), target)
    return shown.withColumn("shown_at", F.date_format("shown_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("stream_rounds", f"WITH {LOG} SELECT sequence, id FROM log")
def _(spark, sf_dir):
    """Two rounds; half of the log comes after the first."""
    rows = b.log(spark, sf_dir)
    path, target, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    half = lambda k: _dealt(spark, rows.where(F.col("sequence") % 2 == k), path)
    a_batch = half(0)
    streams.rounds(lambda: streams.stage(streams.source(spark, path, rows.schema, a_batch), target, checkpoint, lambda df: df, "sequence"), 2, lambda n: half(1))
    return streams.Outcomes(spark, target).rows().select("sequence", "id")


@query("stream_journal_tail", f"WITH {LOG} SELECT sequence, id, type, data, strftime(appended_at, '%Y-%m-%d') AS day FROM log")
def _(spark, sf_dir):
    """Journals that are appended to between three rounds; each round reads what has come to the same files."""
    rows = b.log(spark, sf_dir)
    path, target, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    more = lambda k: journal.grow_journal(rows.where(F.col("sequence") % 3 == k), path)
    more(0)
    streams.rounds(lambda: streams.tail(tailing.journal_records(spark, path), target, checkpoint), 3, lambda n: more(n + 1))
    return spark.read.parquet(target).select("sequence", "id", "type", "data", F.date_format("appended_at", "yyyy-MM-dd").alias("day"))


@query("stream_signal_retry", f"WITH {ANALYSED} SELECT identity, CASE WHEN failed THEN 'signal_failed' ELSE 'signal_generated' END AS type, count(*)::BIGINT AS tries FROM (SELECT * FROM a UNION ALL SELECT * FROM a WHERE failed OR doc_id % 3 = 0) GROUP BY ALL")
def _(spark, sf_dir):
    """Documents that are missing in the first round fail, wait, and are tried again in the second, when their contents have come; those too large fail twice. A round is one batch, since each later one is another try."""
    rows = _analysed(spark, sf_dir).drop("text", "clean")
    path, target, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    some = lambda k: rows.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(path)
    late = [True]

    def step(df):
        absent = (F.col("doc_id") % 3 == 0) & F.lit(late[0])
        df = df.withColumn("error", F.when(absent, "document missing").otherwise(F.col("error")))
        return signals.signal_events(signals.with_defaults(df, F.col("identity"), F.col("ticker"), now()), now())

    final = "type = 'signal_generated'"
    start = lambda: streams.stage(streams.source(spark, path, rows.schema, len(names(spark, path))), target, checkpoint, step, "aggregate_key", input_key="identity", final=final, tries=2)
    rows.limit(0).write.parquet(path)
    some(0)
    some(1)
    start().awaitTermination()
    late[0] = False
    # what waits is also tried without a further batch
    while streams.Outcomes(spark, target).waits():
        streams.try_again(spark, target, step, "aggregate_key", input_key="identity", final=final, tries=2)
    return streams.Outcomes(spark, target).latest().select(F.col("key_text").alias("identity"), "type", F.col("try").cast("long").alias("tries"))


@query("stream_dedupe_watermark", "SELECT event_id, event_type FROM events")
def _(spark, sf_dir):
    """Each event delivered twice, the second time within the delay: once each, with state that goes."""
    events = b.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    twice = events.unionByName(events)
    path, target = scratch(spark), scratch(spark)
    twice.repartitionByRange(BATCHES, "ts").write.parquet(path)
    stream = streams.dedupe_within(streams.source(spark, path, twice.schema), ["event_id"], "ts", "40 days")
    return _finished(spark, streams.tail(stream, target, scratch(spark)), target).select("event_id", "event_type")


@query("stream_to_log", f"WITH {LOG} SELECT count(*)::BIGINT AS n, 1::BIGINT AS first, count(*)::BIGINT AS last, count(DISTINCT id)::BIGINT AS ids FROM log")
def _(spark, sf_dir):
    """Events in micro-batches into a log; then all again under a new checkpoint, which adds nothing."""
    rows = b.log(spark, sf_dir).drop("sequence", "appended_at")
    path, log = scratch(spark), event_log.EventLog(spark, scratch(spark))
    rows.repartition(BATCHES).write.parquet(path)
    for _run in range(2):
        streams.to_log(streams.source(spark, path, rows.schema), log, scratch(spark), "occurred_at", "id", now=now()).awaitTermination()
    return log.records().agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count_distinct("id").alias("ids"))


@query("stream_live_feed", f"WITH {LOG}, placed AS (SELECT row_number() OVER (ORDER BY occurred_at, id) AS sequence, * EXCLUDE (sequence) FROM log) SELECT * FROM ({CARDS.replace('FROM log', 'FROM placed')}) WHERE sequence > (SELECT count(*) FROM log WHERE sequence <= (SELECT count(*) // 2 FROM log)) - 50")
def _(spark, sf_dir):
    """The newest 50 of half a log, then the other half as it comes."""
    rows = b.log(spark, sf_dir)
    half = rows.count() // 2
    log, target, checkpoint = event_log.EventLog(spark, scratch(spark)), scratch(spark), scratch(spark)
    more = lambda df: log.append(df.drop("sequence", "appended_at"), "occurred_at", "id", now=now())
    more(rows.where(F.col("sequence") <= half))
    streams.rounds(lambda: streams.live_feed(log, target, checkpoint, now()), 2, lambda n: more(rows.where(F.col("sequence") > half)))
    return spark.read.parquet(target).withColumn("shown_at", F.date_format("shown_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
