"""Streaming forms of the log's stages: tail, dedupe, bodies, signals, feed.

Each takes a streaming DataFrame and a target. A stage's table is a set of parts that a
manifest names, together with the last batch of every run: a batch that was committed before
is passed over, one that was lost on the way leaves nothing, and a run under a new checkpoint,
which reads its input anew, finds the keys of earlier runs. With `once` a query takes what
there is and ends; otherwise it goes on at an interval.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import storage
from ..operators.event_log import EventLog, Store, first_in_batch
from ..operators.feed import cards
from ..operators.manifest import Manifest, View
from ..sources import tailing

BUCKETS = 64
#: So many parts of a level are merged into one of the next.
MERGE = 16
#: Columns by which rows of a batch are in order.
ARRIVAL = ("sequence", "occurred_at")


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New files of a Parquet log, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _started(writer, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def tail(stream: DataFrame, target: str, checkpoint: str, *, once: bool = True, interval: str = "15 seconds") -> StreamingQuery:
    """The log as it grows, appended to a table."""
    return _started(stream.writeStream.format("parquet").option("path", target), checkpoint, once, interval)


def feed(stream: DataFrame, target: str, checkpoint: str, now: Column, *, once: bool = True, interval: str = "1 second") -> StreamingQuery:
    """The feed's cards of each record as it comes, appended to a table."""
    return tail(cards(stream, now), target, checkpoint, once=once, interval=interval)


def live_feed(log: EventLog, target: str, checkpoint: str, now: Column, *, newest: int = 50, once: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Cards of the newest records there are at the first start, then of each as it comes: one sequence of offsets, without gap or overlap."""
    return feed(tailing.log_records(log.spark, log.path, newest=newest), target, checkpoint, now, once=once, interval=interval)


def dedupe_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first record of each key, with state that is let go: a key is forgotten once the watermark is `delay` past its first record.

    The watermark is the greatest event time of the batches before, less `delay`. A repeat within
    `delay` of the first is dropped, wherever it comes in. One that is later than that may count
    as new. A record older than the watermark is dropped, whether or not its key was seen. Event
    times without a zone are taken in the session's.
    """
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to; a new checkpoint is a new run."""
    return json.loads(storage.read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


class Outcomes:
    """What a stage has written: parts in buckets by a hash of the key, and the inputs that wait for another try.

    Rows have `key_text`, `final` and `try` beside the step's columns. A key with a final outcome is
    done; the outcomes of one that failed stay as a record of its tries.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self.manifest = Manifest(spark, self.target)

    def parts(self, view: View) -> list[str]:
        return [f"{self.target}/{p['name']}" for p in view.content.get("parts", [])]

    def read(self, view: View) -> DataFrame | None:
        parts = self.parts(view)
        return self.spark.read.option("basePath", self.target).parquet(*parts) if parts else None

    def rows(self) -> DataFrame:
        """All outcomes; a failed key has one for each try."""
        found = self.read(self.manifest.read())
        if found is None:
            raise ValueError(f"nothing has been written to {self.target}")
        return found.drop("bucket", "part")

    def latest(self) -> DataFrame:
        """The last outcome of each key."""
        last = W.partitionBy("key_text").orderBy(F.desc("final"), F.desc("try"))
        return self.rows().withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")

    def waits(self) -> bool:
        """Whether inputs wait for another try."""
        return bool(self.manifest.read().content.get("waiting"))

    def waiting(self, view: View) -> DataFrame | None:
        """Inputs of failed keys that are to be tried again, with the number of tries they have had."""
        name = view.content.get("waiting")
        return self.spark.read.parquet(f"{self.target}/{name}") if name else None

    def write(self, rows: DataFrame) -> str:
        """One file a bucket, however many tasks made the rows."""
        name = f"part={uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.target}/{name}")
        return name

    def merged(self, parts: list[dict]) -> tuple[list[dict], list[str]]:
        """Parts after merging those of a level that has MERGE of them, and the names that are no longer needed."""
        gone: list[str] = []
        for level in sorted({p["level"] for p in parts}):
            mine = [p for p in parts if p["level"] == level]
            if len(mine) >= MERGE:
                rows = self.spark.read.option("basePath", self.target).parquet(*[f"{self.target}/{p['name']}" for p in mine]).drop("part")
                one = {"name": self.write(rows), "level": level + 1}
                parts = [p for p in parts if p["level"] != level] + [one]
                gone += [p["name"] for p in mine]
        return parts, gone

    def commit(self, view: View, part: str | None, waiting: str | None, run: str, batch: int) -> None:
        content = view.content
        parts, gone = self.merged([*content.get("parts", []), *([{"name": part, "level": 0}] if part else [])])
        # what was merged away, and old waiting inputs, go with the next commit: whoever reads now may still hold them
        old = [n for n in (content.get("waiting"),) if n] if waiting != content.get("waiting") else []
        said = {"parts": parts, "waiting": waiting, "runs": {**content.get("runs", {}), run: batch}, "gone": [*gone, *old]}
        if not self.manifest.commit(view, said):
            raise RuntimeError(f"another stage writes to {self.target}")
        for name in content.get("gone", []):
            storage.delete(self.spark, f"{self.target}/{name}")


def earlier(table: Outcomes, view: View, buckets: list[int]) -> DataFrame | None:
    """Keys with a final outcome in these buckets; other buckets' files aren't opened."""
    found = table.read(view)
    return None if found is None else found.where(F.col("bucket").isin(buckets) & F.col("final")).select("key_text").distinct()


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _without(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    return rows if keys is None else rows.join(keys, "key_text", "left_anti")


def stage(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame],
    key: str,
    *,
    input_key: str | None = None,
    final: str | None = None,
    tries: int = 3,
    arrival: Sequence[str] = ARRIVAL,
    once: bool = True,
    interval: str = "15 seconds",
) -> StreamingQuery:
    """A step over each micro-batch; of rows with a key that is done, or twice in the batch, the first stays.

    Which is first is said by the columns of `arrival` that the input has.
    `key` names the key in what the step gives. With `input_key`, its name in the input, rows
    whose key is done don't even reach the step. `final`, a predicate in SQL, says which outcomes
    make a key done: without it all do, so that failures are remembered like results. Where it is
    given, the inputs of keys that failed are kept and tried again with each later batch, up to
    `tries` times altogether, and a failed key that comes in anew is tried at once and afresh.
    `Outcomes(spark, target)` reads the table.
    """
    if final is not None and input_key is None:
        raise ValueError("trying again needs the key in the input")

    def run(rows: DataFrame, batch: int) -> None:
        attempt(rows, target, run_of(rows.sparkSession, checkpoint), batch, step, key, input_key=input_key, final=final, tries=tries, arrival=arrival)

    return _started(stream.writeStream.foreachBatch(run), checkpoint, once, interval)


def attempt(rows: DataFrame, target: str, run: str, batch: int, step: Callable[[DataFrame], DataFrame], key: str, *, input_key: str | None = None, final: str | None = None, tries: int = 3, arrival: Sequence[str] = ARRIVAL) -> None:
    """One batch of a stage. A batch that its run has committed before changes nothing."""
    spark = rows.sparkSession
    table = Outcomes(spark, target)
    view = table.manifest.read()
    if view.content.get("runs", {}).get(run, -1) >= batch:
        return
    held: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        waiting = None
        if input_key is not None:
            rows = rows.withColumns({"key_text": F.col(input_key).cast("string"), "try": F.lit(1)})
            if final is not None and (waiting := table.waiting(view)) is not None:
                rows = rows.unionByName(waiting.withColumn("try", F.col("try") + 1))
            order = [c for c in arrival if c in rows.columns]
            rows = kept(first_in_batch(rows, ["key_text"], "try", *order).where("nth = 1").drop("nth").withColumn("bucket", _bucket(F.col("key_text"))))
            buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]
            rows = kept(_without(rows, earlier(table, view, buckets)).drop("bucket"))
            out = step(rows.drop("key_text", "try"))
        else:
            out = step(rows)
        out = out.withColumn("key_text", F.col(key).cast("string"))
        order = [c for c in ("sequence", "occurred_at", "id") if c in out.columns] or [key]
        out = first_in_batch(out, ["key_text"], *order).where("nth = 1").drop("nth").withColumns({"final": F.lit(True) if final is None else F.coalesce(F.expr(final), F.lit(False)), "bucket": _bucket(F.col("key_text"))})
        if input_key is not None:
            out = kept(out.join(rows.select("key_text", "try"), "key_text"))
        else:
            out = kept(out.withColumn("try", F.lit(1)))
            out = _without(out, earlier(table, view, [r.bucket for r in out.select("bucket").distinct().collect()]))
        part = None if out.isEmpty() else table.write(out)
        name = None
        if final is not None:
            failed = out.where(~F.col("final")).select("key_text")
            again = rows.join(failed, "key_text", "left_semi").where(F.col("try") < tries)
            if not again.isEmpty():
                name = f"waiting={uuid.uuid4().hex}"
                again.write.parquet(f"{table.target}/{name}")
        table.commit(view, part, name, run, batch)
    finally:
        for df in held:
            df.unpersist()


def try_again(spark: SparkSession, target: str, step: Callable[[DataFrame], DataFrame], key: str, *, input_key: str, final: str, tries: int = 3) -> None:
    """Another try of the inputs that wait, without waiting for a batch."""
    table = Outcomes(spark, target)
    view = table.manifest.read()
    waiting = table.waiting(view)
    if waiting is not None and not waiting.isEmpty():
        attempt(waiting.drop("key_text", "try").where("false"), target, "by hand", view.version, step, key, input_key=input_key, final=final, tries=tries)


def to_log(stream: DataFrame, store: Store, checkpoint: str, *order: str, now: Column, step: Callable[[DataFrame], DataFrame] = lambda rows: rows, once: bool = True, interval: str = "15 seconds") -> StreamingQuery:
    """Events of each micro-batch (what `step` makes of it), appended to a log with dense sequences.

    The log's manifest names the last batch of every run with its sequences, so that a batch that
    is replayed is numbered once, also when its first try was lost between writing and commit. A
    new checkpoint is a new run that reads its input anew: events whose id the log has are left
    out, as are those that come twice in a batch.
    """

    def run(rows: DataFrame, batch: int) -> None:
        token = f"{run_of(rows.sparkSession, checkpoint)}:{batch}"
        if store.committed(token, store.manifest.read().content):
            return
        events = first_in_batch(step(rows), ["id"], *order).where("nth = 1").drop("nth")
        fresh = events.join(store.records().select("id"), "id", "left_anti").persist()
        try:
            if not fresh.isEmpty():
                store.append(fresh, *order, now=now, token=token)
        finally:
            fresh.unpersist()

    return _started(stream.writeStream.foreachBatch(run), checkpoint, once, interval)


def rounds(start: Callable[[], StreamingQuery], count: int, between: Callable[[int], None] = lambda n: None) -> None:
    """A fixed number of rounds: each takes what there is and ends; `between` is called after each but the last."""
    if count < 1:
        raise ValueError("there must be a round")
    for n in range(count):
        start().awaitTermination()
        if n + 1 < count:
            between(n)
