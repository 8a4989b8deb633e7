"""Stream sources that follow what grows: journals by bytes, the event log by sequence.

Both are Python data sources. Spark plans and runs them like any stream: offsets go to the
query's checkpoint, ranges become tasks, and a task that is lost reads its range again.

`tidemark_journal` follows the journals below a folder, also ones that are appended to. An
offset says how many bytes of each journal have been delivered; it never lies within a line, so
a torn last line is held back until its end has come. Long ranges are cut into tasks of
`SPLIT` bytes at line ends. A journal that got shorter is an error.

`tidemark_log` follows an `EventLog`. An offset is a sequence; of the files that the log's
manifest names, only those that hold new sequences are opened. It starts with `start`, or with
the `newest` records there are when the stream is first started: these are its first batch,
and since snapshot and stream are one sequence of offsets nothing is left out or twice.

Files are opened by pyarrow, so the folder may be local or any that pyarrow knows.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import journal

SPLIT, READ, BACK = 32 << 20, 1 << 20, 64 << 10
#: Day files, and the files that `write_journal` leaves in day folders.
JOURNAL = re.compile(r"(?:.*/)?(?:[^/]*\.ndjson|part-[^/]*\.txt)")
LINE = "file string, at bigint, value string"
RECORD = "sequence bigint, id string, type string, occurred_at timestamp, aggregate_key string, source string, data string, appended_at timestamp"
_UTC = pa.timestamp("us", tz="UTC")
RECORD_TYPES = {"sequence": pa.int64(), "id": pa.string(), "type": pa.string(), "occurred_at": _UTC, "aggregate_key": pa.string(), "source": pa.string(), "data": pa.string(), "appended_at": _UTC}


def opened(path: str) -> tuple[pf.FileSystem, str]:
    """pyarrow's file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path.rstrip("/"))


def complete(fs: pf.FileSystem, path: str, low: int, size: int) -> int:
    """The end of the last whole line of the first `size` bytes; `low` where there is none after it."""
    with fs.open_input_file(path) as f:
        high = size
        while high > low:
            begin = max(low, high - BACK)
            f.seek(begin)
            if (found := f.read(high - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            high = begin
    return low


class JournalTail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.sizes: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = opened(self.path)
        found = fs.get_file_info(pf.FileSelector(root, allow_not_found=True, recursive=True))
        for info in found:
            name = info.path[len(root) :].lstrip("/")
            if info.type != pf.FileType.File or not JOURNAL.fullmatch(name) or self.sizes.get(name) == info.size:
                continue
            if info.size < self.known.get(name, 0):
                raise ValueError(f"journal {name} got shorter: {info.size} bytes, {self.known[name]} have been read")
            self.known[name] = complete(fs, info.path, self.known.get(name, 0), info.size)
            self.sizes[name] = info.size
        return {name: end for name, end in sorted(self.known.items()) if end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # after a restart what was read before is known from the checkpoint alone
        self.known = {**start, **self.known}
        out = []
        for name, high in end.items():
            low = start.get(name, 0)
            if high < low:
                raise ValueError(f"journal {name} got shorter: {high} bytes, {low} have been read")
            out += [InputPartition((name, low, at, min(high, at + self.split), high)) for at in range(low, high, self.split)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """The lines that begin within a range of bytes."""
        name, first, low, high, end = partition.value
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{name}") as f:
            at = low
            if low > first:  # the line that the byte before belongs to is another task's
                at = low - 1
            f.seek(at)
            skip, rest = low > first, b""
            while at < high:
                while b"\n" not in rest:
                    got = f.read(min(READ, end - at - len(rest)))
                    if not got:
                        break
                    rest += got
                whole, newline, rest = rest.rpartition(b"\n")
                if not newline:
                    return  # can't be, as ranges end with lines; what is torn isn't delivered
                lines = whole.split(b"\n")
                starts, values = [], []
                for line in lines:
                    if at >= high:
                        break
                    if not skip:
                        starts.append(at)
                        values.append(line.decode(errors="replace"))
                    skip, at = False, at + len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())], ["file", "at", "value"])


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_journal"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return JournalTail(dict(self.options))


class LogTail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.start, self.newest = options["path"], int(options.get("start", 1)), options.get("newest")
        self.first = 0

    def content(self) -> dict:
        fs, root = opened(self.path)
        found = fs.get_file_info(pf.FileSelector(f"{root}/_manifest", allow_not_found=True))
        name = max((i.base_name for i in found if i.base_name.startswith("v-")), default=None)
        return json.loads(self.text(name)) if name else {}

    def text(self, name: str) -> bytes:
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/_manifest/{name}") as f:
            return f.read()

    def initialOffset(self) -> dict:
        first = self.start if self.newest is None else self.content().get("last", 0) - int(self.newest) + 1
        self.first = max(0, first - 1)
        return {"sequence": self.first}

    def latestOffset(self) -> dict:
        return {"sequence": max(self.content().get("last", 0), self.first)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = start["sequence"] + 1, end["sequence"]
        self.first = max(self.first, low - 1)
        content = self.content()
        met = lambda e: e["first"] <= high and e["last"] >= low
        sealed = [e for s in content.get("sealed", []) if met(s) for e in json.loads(self.text(s["name"]))]
        files = [(f"{e['name']}/{name}", a, b) for e in [*sealed, *content.get("open", [])] if met(e) for name, a, b in e["files"] if a <= high and b >= low]
        return [InputPartition((name, max(a, low), min(b, high))) for name, a, b in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, low, high = partition.value
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=list(RECORD_TYPES)):
                rows = pa.Table.from_batches([batch]).filter((pc.field("sequence") >= low) & (pc.field("sequence") <= high))
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([_typed(rows.column(c).combine_chunks(), t) for c, t in RECORD_TYPES.items()], list(RECORD_TYPES))


def _typed(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """Timestamps as Spark's; what Parquet holds without a zone is in UTC."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_timestamp(kind) and column.type.tz is None:
        column = column.cast(pa.timestamp("us"), safe=False)
    return column.cast(kind)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTail(dict(self.options))


def _reader(spark: SparkSession, source: type[DataSource], path: str, **options):
    # the readers go to Spark's Python processes as they stand here, since those may not find this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("path", path).options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def journal_lines(spark: SparkSession, path: str, *, split: int | None = None) -> DataFrame:
    """A stream of the whole lines of growing journals: file, at (byte), value."""
    return _reader(spark, JournalSource, path, split=split)


def journal_records(spark: SparkSession, path: str, *, strict: bool = True, split: int | None = None) -> DataFrame:
    """A stream of their records. Blank lines are passed over; a malformed one fails the query, naming its file and byte, or is passed over where not `strict`."""
    lines = journal.parsed(journal_lines(spark, path, split=split)).where(F.col("text") != "")
    broken: Column = F.col("record").isNull()
    if not strict:
        return journal.records_of(lines.where(~broken))
    wrong = F.raise_error(F.concat(F.lit("malformed record in "), F.col("file"), F.lit(" at byte "), F.col("at").cast("string"))).cast("bigint")
    checked = F.when(broken, wrong).otherwise(F.col("record.sequence")).alias("sequence")
    return lines.select(checked, *[F.col(f"record.event.{c}").alias(c) for c in journal.EVENT_COLUMNS], "record.appended_at")


def log_records(spark: SparkSession, path: str, *, start: int | None = None, newest: int | None = None) -> DataFrame:
    """A stream of an event log's records: from `start` on, or the `newest` ones and what comes after."""
    return _reader(spark, LogSource, path, start=start, newest=newest)
