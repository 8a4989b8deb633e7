"""An append-only event log as DataFrames: validation, numbering, reads, statistics."""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank
from ..sources import journal
from . import storage
from .manifest import Manifest
from .storage import settled

PAGE = 512
RECORD_COLUMNS = ("sequence", "id", "type", "occurred_at", "aggregate_key", "source", "data", "appended_at")


def violation() -> Column:
    """The first rule that an event breaks, or null."""
    return F.when(blank(F.col("id")), "missing id").when(blank(F.col("type")), "missing type").when(blank(F.col("data")), "missing data")


def validated(events: DataFrame) -> DataFrame:
    return events.withColumn("violation", violation())


def with_occurred_at(events: DataFrame, now: Column) -> DataFrame:
    return events.withColumn("occurred_at", F.coalesce("occurred_at", now))


def parts_of(df: DataFrame) -> int:
    """Into how many parts its session deals out rows."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: str, start: int = 0, name: str = "sequence", partitions: int | None = None) -> DataFrame:
    """df with a dense number from start + 1 in the given order, without one task seeing all rows.

    Rows are range-partitioned and written to the shared folder, so that a lost executor changes no number; each partition is counted, and its rows are numbered from the
    sum of those before; only the counts, one per partition, meet in a window.
    """
    parts = partitions or parts_of(df)
    placed = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    placed = settled(placed)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = W.partitionBy("__part").orderBy(*order)
    inside = placed.withColumn("__in", F.row_number().over(within))
    return inside.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__ahead") + F.col("__in") + start).drop("__part", "__ahead", "__in")


def read_from(log: DataFrame, first: int, limit: int) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return log.where(F.col("sequence") >= first).orderBy("sequence").limit(limit)


def tail(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest n records, ascending."""
    return log.orderBy(F.desc("sequence")).limit(n).orderBy("sequence")


def latest_sequence(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("latest"))


def latest_by_journal(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("appended_at").alias("day")).agg(F.max("sequence").alias("latest"))


def of_type(log: DataFrame, *types: str) -> DataFrame:
    return log.where(F.col("type").isin(*types))


def decoded(log: DataFrame, schema: str) -> DataFrame:
    """log with `payload`; null where the data isn't of that schema."""
    return log.withColumn("payload", F.from_json("data", schema))


def batch_stats(log: DataFrame, matched: Column, page: int = PAGE) -> DataFrame:
    batch = F.floor((F.col("sequence") - 1) / page).cast("long")
    hit = matched.cast("long")
    return log.groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("records"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.sum(hit).alias("matched"), F.sum(1 - hit).alias("skipped")
    )


def by_type_source(log: DataFrame) -> DataFrame:
    return log.groupBy("type", "source").agg(F.count(F.lit(1)).alias("n"))


def first_in_batch(rows: DataFrame, keys: list[str], *arrival: str, partitions: int | None = None) -> DataFrame:
    """rows with `nth` among those of equal keys by arrival: the first is new, the others were seen.

    With `partitions` they are dealt by key into so many parts, each sorted by itself; without, Spark may merge what it deals into as few as there are cores.
    """
    if partitions:
        rows = rows.repartition(partitions, *keys)
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*arrival)))


class Store:
    """A log that is appended to, by any number of writers, and read in order. Subclasses say how records are kept.

    Each append writes a folder of its own and then names it in the manifest, with the least and
    greatest sequence of every file. That is the zone map by which reads open only what they need,
    and the latest sequence is known without a scan. Of two writers that number from the same
    latest record one commits first; the other moves its numbers up and tries again, so sequences
    are dense and unique. An append with a `token` (a run and its batch) happens once: later
    batches of a run make earlier ones known, and a repeated one gives back the records that it
    made. When the manifest names `SEAL` files, all but their bounds move to an index file that
    isn't rewritten. `compact` makes few files of many appends; what it replaces stays for those
    who read it until `vacuum`.
    """

    SEAL, FILE_ROWS = 2048, 1_000_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)

    def load(self, files: list[str]) -> DataFrame:
        """The records in these files of the log."""
        raise NotImplementedError

    def located(self, folder: str) -> DataFrame:
        """file, sequence and appended_at of the records of an append."""
        raise NotImplementedError

    def write(self, records: DataFrame, folder: str) -> None:
        raise NotImplementedError

    def nothing(self) -> DataFrame:
        schema = "sequence long, id string, type string, occurred_at timestamp, aggregate_key string, source string, data string, appended_at timestamp"
        return self.spark.createDataFrame([], schema)

    def entries(self, content: dict, first: int = 1, last: int | None = None) -> list[dict]:
        """The appends that hold sequences from `first` to `last`, in order; only index files that do are read."""
        met = lambda e: e["last"] >= first and (last is None or e["first"] <= last)
        sealed = [e for s in content.get("sealed", []) if met(s) for e in json.loads(storage.read_text(self.spark, f"{self.manifest.folder}/{s['name']}"))]
        return [e for e in [*sealed, *content.get("open", [])] if met(e)]

    def files(self, first: int = 1, last: int | None = None, content: dict | None = None) -> list[str]:
        """The files that hold sequences from `first` to `last`."""
        content = self.manifest.read().content if content is None else content
        return [f"{self.path}/{e['name']}/{name}" for e in self.entries(content, first, last) for name, low, high in e["files"] if high >= first and (last is None or low <= last)]

    def records(self) -> DataFrame:
        folders = [f"{self.path}/{e['name']}" for e in self.entries(self.manifest.read().content)]
        return self.load(folders) if folders else self.nothing()

    def between(self, first: int, last: int) -> DataFrame:
        """The records from `first` to `last`; only files that hold some are opened."""
        files = self.files(first, last) if last >= first else []
        return self.load(files).where(F.col("sequence").between(first, last)) if files else self.nothing()

    def latest(self) -> int:
        return self.manifest.read().content.get("last", 0)

    def latest_by_journal(self) -> DataFrame:
        """The last sequence of each day; from the manifest."""
        days = self.manifest.read().content.get("days", {})
        return self.spark.createDataFrame(list(days.items()), "day string, latest long").withColumn("day", F.col("day").cast("date"))

    def read(self, first: int, limit: int) -> DataFrame:
        """At most `limit` records from `first` on, in order; numbers are dense, so they can't lie further than `limit`."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        return self.between(first, max(first, 1) + limit - 1).orderBy("sequence").limit(limit)

    def snapshot(self, n: int = 50) -> tuple[DataFrame, int]:
        """The newest n records, and the sequence from which a stream goes on with neither gap nor overlap."""
        latest = self.latest()
        return self.between(max(1, latest - n + 1), latest).orderBy("sequence").limit(n), latest + 1

    def committed(self, token: str, content: dict) -> tuple[int, int] | None:
        """The first and last sequence that a batch has got, if it has been appended; an empty range for one of which only later batches are known."""
        run, batch = token.rsplit(":", 1)
        known = content.get("runs", {}).get(run)
        if known is None or known[0] < int(batch):
            return None
        return (known[1], known[2]) if known[0] == int(batch) else (1, 0)

    def append(self, events: DataFrame, *order: str, now: Column, token: str | None = None) -> DataFrame:
        """Validates all events, numbers them after the latest in the given order, writes them; returns the records."""
        view = self.manifest.read()
        if token and (done := self.committed(token, view.content)):
            return self.between(*done)
        found = validated(events).agg(F.count(F.lit(1)).alias("n"), F.min_by("violation", F.col("violation")).alias("violation")).first()
        if found.violation is not None:
            raise ValueError(found.violation)
        if not found.n:
            raise ValueError("no events")
        name = f"append={uuid.uuid4().hex}"
        records = numbered(with_occurred_at(events, now), *order, start=view.content.get("last", 0)).withColumn("appended_at", now).select(*RECORD_COLUMNS)
        self.write(records, f"{self.path}/{name}")
        entry = self.described(name)
        while not self.manifest.commit(view, self.extended(view.content, entry, token)):
            view = self.manifest.read()
            if token and (done := self.committed(token, view.content)):
                storage.delete(self.spark, f"{self.path}/{entry['name']}")
                return self.between(*done)
            entry = self.moved(entry, view.content.get("last", 0) + 1)
        return self.load([f"{self.path}/{entry['name']}"])

    def described(self, name: str) -> dict:
        """An append's manifest entry, from the files that it has written."""
        rows = self.located(f"{self.path}/{name}").groupBy("file", F.to_date("appended_at").cast("string").alias("day"))
        zones = rows.agg(F.min("sequence").alias("first"), F.max("sequence").alias("last")).orderBy("first").collect()
        days: dict[str, int] = {}
        for z in zones:
            days[z.day] = max(days.get(z.day, 0), z.last)
        return {"name": name, "first": zones[0].first, "last": max(z.last for z in zones), "files": [[unquote(z.file).rsplit(f"{name}/", 1)[1], z.first, z.last] for z in zones], "days": days}

    def moved(self, entry: dict, first: int) -> dict:
        """What another writer's commit has overtaken, numbered from `first` on."""
        if entry["first"] == first:
            return entry
        name = f"append={uuid.uuid4().hex}"
        rows = self.load([f"{self.path}/{entry['name']}"])
        self.write(rows.withColumn("sequence", F.col("sequence") + (first - entry["first"])), f"{self.path}/{name}")
        storage.delete(self.spark, f"{self.path}/{entry['name']}")
        return self.described(name)

    def compact(self) -> bool:
        """Writes the appends that the manifest names one by one anew, in files of FILE_ROWS records by sequence.

        Appends that are committed meanwhile stay as they are. False where there is nothing to do,
        or another has compacted or sealed them meanwhile.
        """
        view = self.manifest.read()
        mine = view.content.get("open", [])
        if len(mine) < 2:
            return False
        rows = mine[-1]["last"] - mine[0]["first"] + 1
        name = f"append={uuid.uuid4().hex}"
        self.write(self.load([f"{self.path}/{e['name']}" for e in mine]).repartitionByRange(-(-rows // self.FILE_ROWS), "sequence").sortWithinPartitions("sequence"), f"{self.path}/{name}")
        entry = {k: v for k, v in self.described(name).items() if k != "days"}
        while view.content.get("open", [])[: len(mine)] == mine:
            gone = [[e["name"], time.time()] for e in mine]
            said = {**view.content, "open": [entry, *view.content["open"][len(mine) :]], "gone": [*view.content.get("gone", []), *gone]}
            if self.manifest.commit(view, said):
                return True
            view = self.manifest.read()
        storage.delete(self.spark, f"{self.path}/{name}")
        return False

    def vacuum(self, seconds: float = 24 * 3600) -> int:
        """Deletes what compaction has replaced so long ago; how many folders."""
        view = self.manifest.read()
        old = [n for n, at in view.content.get("gone", []) if at <= time.time() - seconds]
        if old and not self.manifest.commit(view, {**view.content, "gone": [g for g in view.content["gone"] if g[0] not in old]}):
            return 0
        for name in old:
            storage.delete(self.spark, f"{self.path}/{name}")
        return len(old)

    def extended(self, content: dict, entry: dict, token: str | None) -> dict:
        """The manifest with one more append."""
        out = {**content, "last": entry["last"], "sealed": content.get("sealed", []), "open": [*content.get("open", []), {k: entry[k] for k in ("name", "first", "last", "files")}], "days": dict(content.get("days", {})), "runs": dict(content.get("runs", {}))}
        for day, last in entry["days"].items():
            out["days"][day] = max(out["days"].get(day, 0), last)
        if token:
            run, batch = token.rsplit(":", 1)
            out["runs"][run] = [int(batch), entry["first"], entry["last"]]
        if sum(len(e["files"]) for e in out["open"]) >= self.SEAL:
            name = f"sealed-{uuid.uuid4().hex}.json"
            storage.write_new(self.spark, f"{self.manifest.folder}/{name}", json.dumps(out["open"]))
            out["sealed"] = [*out["sealed"], {"name": name, "first": out["open"][0]["first"], "last": entry["last"]}]
            out["open"] = []
        return out


class EventLog(Store):
    """A log of Parquet files, in day folders within each append."""

    def load(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*files).select(*RECORD_COLUMNS)

    def located(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file"), "sequence", "appended_at")

    def write(self, records: DataFrame, folder: str) -> None:
        records.withColumn("day", F.to_date("appended_at")).write.partitionBy("day").parquet(folder)


class JournalLog(Store):
    """A log as journals of JSON lines, in day folders within each append; a malformed line fails reads."""

    def load(self, files: list[str]) -> DataFrame:
        return journal.whole_journal(self.spark, files).select(*RECORD_COLUMNS)

    def located(self, folder: str) -> DataFrame:
        return journal.whole_journal(self.spark, folder).select("file", "sequence", "appended_at")

    def write(self, records: DataFrame, folder: str) -> None:
        journal.write_journal(records, folder)
