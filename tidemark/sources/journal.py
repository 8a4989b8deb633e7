"""Journals of JSON event records, a file or a folder of files per day, one record per line."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import local_path

RECORD = "sequence BIGINT, event STRUCT<id: STRING, type: STRING, occurred_at: TIMESTAMP, aggregate_key: STRING, source: STRING, data: STRING>, appended_at TIMESTAMP"
#: Day files, and the files that `write_journal` leaves in day folders.
FILES = "{*.ndjson,part-*.txt}"
STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
EVENT_COLUMNS = ("id", "type", "occurred_at", "aggregate_key", "source", "data")


def journal_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of the journals in path and its day folders: file, size, block, pos, value. Blank lines count as lines."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", FILES).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block")).withColumn("pos", F.monotonically_increasing_id())


def parsed_record(text: Column) -> Column:
    """The record in a line's trimmed text, or null."""
    record = F.from_json(text, RECORD)
    return F.when(record["sequence"].isNotNull() & record["event"].isNotNull(), record)


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with `record` (null where the text isn't a record) and `text`, trimmed."""
    text = F.trim(F.regexp_replace("value", r"^[\t-\r ]+|[\t-\r ]+$", ""))
    return lines.withColumn("text", text).withColumn("record", parsed_record(text))


def records_of(df: DataFrame) -> DataFrame:
    return df.select("record.sequence", *[F.col(f"record.event.{c}").alias(c) for c in EVENT_COLUMNS], "record.appended_at")


def scan_journal(spark: SparkSession, path: str) -> DataFrame:
    """Records of all journals; blank and malformed lines are left to `quarantined`."""
    return records_of(parsed(journal_lines(spark, path)).where(F.col("record").isNotNull()))


def quarantined(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Malformed lines with a verdict: `dropped` for a file's last line without a newline, else `error`."""
    lines = parsed(journal_lines(spark, path))
    ends = last_per_file(lines).select("file", F.col("block").alias("last_block"), F.col("pos").alias("last_pos"))
    bad = lines.where(F.col("record").isNull() & (F.col("text") != "")).join(ends, "file")
    torn = F.col("open") & (F.col("block") == F.col("last_block")) & (F.col("pos") == F.col("last_pos"))
    return bad.join(open_files(lines), "file").select("file", "text", F.when(torn, "dropped").otherwise("error").alias("verdict"))


def whole_journal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records, with their file, of journals whose lines are all complete, in one pass; a malformed line fails the query, naming its file."""
    lines = parsed(journal_lines(spark, path)).where(F.col("text") != "")
    wrong = F.raise_error(F.concat(F.lit("malformed record in "), F.col("file"))).cast("bigint")
    checked = F.when(F.col("record").isNull(), wrong).otherwise(F.col("record.sequence")).alias("sequence")
    return lines.select(checked, *[F.col(f"record.event.{c}").alias(c) for c in EVENT_COLUMNS], "record.appended_at", "file")


def strict_journal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As scan_journal, but a malformed line other than a torn last one is an error, naming its file. Lines are read a second time only where some are malformed."""
    lines = parsed(journal_lines(spark, path))
    if not lines.where(F.col("record").isNull() & (F.col("text") != "")).isEmpty():
        errors = quarantined(spark, path).where("verdict = 'error'").agg(F.min("file").alias("bad")).first()
        if errors.bad is not None:
            raise ValueError(f"malformed record in {errors.bad}")
    return records_of(lines.where(F.col("record").isNotNull()))


def write_journal(records: DataFrame, path: str) -> None:
    """One folder of JSON lines per ingest day."""
    line = F.to_json(F.struct("sequence", F.struct(*EVENT_COLUMNS).alias("event"), "appended_at"), STAMP)
    records.select(line.alias("value"), F.to_date("appended_at").alias("day")).write.mode("append").partitionBy("day").option("compression", "none").text(path)


def grow_journal(records: DataFrame, path: str) -> None:
    """Appends records to `<day>.ndjson`, the journal of their ingest day, in order of sequence: one task a day, since a file grows at one end.

    `path` is a folder of a file system that can append, seen alike by all executors. A task that
    is tried again first takes away what the lost try left beyond the journal's length at the start.
    """
    root = Path(local_path(path))
    root.mkdir(parents=True, exist_ok=True)
    line = F.to_json(F.struct("sequence", F.struct(*EVENT_COLUMNS).alias("event"), "appended_at"), STAMP)
    rows = records.select(F.date_format("appended_at", "yyyy-MM-dd").alias("day"), "sequence", line.alias("value")).repartition("day").sortWithinPartitions("day", "sequence")
    before = {p.name: p.stat().st_size for p in root.glob("*.ndjson")}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: set[str] = set()
        for batch in batches:
            days, values = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for day in dict.fromkeys(days):
                with open(root / f"{day}.ndjson", "ab") as f:
                    if day not in begun:
                        f.truncate(before.get(f"{day}.ndjson", 0))
                        begun.add(day)
                    f.write("".join(f"{v}\n" for d, v in zip(days, values, strict=True) if d == day).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def last_per_file(lines: DataFrame) -> DataFrame:
    """The last line of each journal; by a maximum, so that no task holds a file."""
    last = F.max(F.struct("block", "pos", "value")).alias("last")
    return lines.groupBy("file").agg(last).select("file", "last.block", "last.pos", "last.value")


def open_files(lines: DataFrame) -> DataFrame:
    """(file, open): whether a journal ends without a newline."""
    return lines.groupBy("file").agg((F.sum(F.octet_length("value") + 1) == F.max("size") + 1).alias("open"))
