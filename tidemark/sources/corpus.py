"""Filing corpora: trees of <issuer>/<filing>/ folders with metadata, index and documents."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension
from ..operators.storage import file_system, local_path, settled
from .listings import METADATA
from .press import DOCUMENT_BYTES

ITEM = "ARRAY<STRUCT<name: STRING, type: STRING, size: STRING, `last-modified`: STRING>>"
#: From where the last match ended: whole strings and whatever holds no number, then a number.
BARE_NUMBER = r'\G((?:[^"0-9-]|"(?:[^"\\]|\\.)*+")*+)(-?[0-9][0-9.eE+-]*)'
CANDIDATE_EXTENSIONS = (".htm", ".html", ".xml", ".txt")


def below(spark: SparkSession, root: str) -> Column:
    """The part of `path` below root."""
    fs, at = file_system(spark, root)
    whole = fs.makeQualified(at).toString()
    return F.substring("path", len(whole) + 2, 1 << 30)


def _files(spark: SparkSession, root: str, names: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", names) if names else reader).load(root)


def _folder(spark: SparkSession, root: str) -> str | None:
    """The plain path of a root that is a folder which all executors see; None for other stores."""
    fs, at = file_system(spark, root)
    return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _walker(top: str, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts what is in a folder (a row without a length) in its place, or all that is below it; names that Spark's file sources hide, and empty files, are left out."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        def entries(path: str) -> Iterator[tuple[str, int | None]]:
            with os.scandir(os.path.join(top, path)) as found:
                for e in found:
                    hidden = e.name.startswith(".") or e.name.endswith("._COPYING_") or (e.name.startswith("_") and "=" not in e.name)
                    at = f"{path}/{e.name}" if path else e.name
                    if hidden:
                        continue
                    if not e.is_dir():
                        if size := e.stat().st_size:
                            yield at, size
                    elif deep:
                        yield from entries(at)
                    else:
                        yield at, None

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[str, int | None]]:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if length is None:
                    yield from entries(path)
                else:
                    yield path, length

        held: list[tuple[str, int | None]] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.string()), pa.array([r[1] for r in held], pa.int64())], ["path", "length"])
        for batch in batches:
            for row in rows(batch):
                held.append(row)
                if len(held) == 8192:
                    yield made()
                    held.clear()
        yield made()

    return walk


def _contents(files: DataFrame, top: str) -> DataFrame:
    """files with their `content` (binary), read by the tasks from `path` below top."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["path", "length", "content"])
        held, size = [], 0
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(os.path.join(top, path), "rb") as f:
                    held.append((path, length, f.read()))
                size += length
                if size > 1 << 24 or len(held) == 4096:
                    yield made(held)
                    held, size = [], 0
        yield made(held)

    return files.select("path", "length").mapInArrow(read, "path string, length bigint, content binary")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Paths below root and file sizes; contents aren't read. Empty files, which Spark's file sources pass over, aren't listed.

    A folder that all executors see is listed by tasks: its entries are dealt out, then those of
    the folders among them, whose own are walked. Elsewhere Spark's listing goes through the driver.
    """
    if top := _folder(spark, root):
        rows = spark.createDataFrame([("", None)], "path string, length bigint")
        for deep in (False, False, True):
            rows = rows.repartition("path").mapInArrow(_walker(top, deep), "path string, length bigint")
        return rows
    return _files(spark, root).select(below(spark, root).alias("path"), "length")


def any_case(name: str) -> str:
    """A glob for a file name in capital or small letters."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def texts(spark: SparkSession, root: str, *names: str, max_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """issuer, filing, relative, length and content of the files with these names (globs), or of all.

    Files of more than `max_bytes` aren't read: the size filter goes to the listing. They are
    there with a null content. Bytes that aren't UTF-8 become replacement characters.
    """
    if (top := _folder(spark, root)) and not any(c in n for n in names for c in "{\\"):
        files = tree(spark, root)
        if names:
            patterns = [fnmatch.translate(n.replace("[^", "[!")) for n in names]
            files = files.where(base_name(F.col("path")).rlike("^(?:" + "|".join(patterns) + ")$"))
        return _texts(files, top, max_bytes)
    globs = "{" + ",".join(names) + "}" if names else None
    files, at = _files(spark, root, globs), below(spark, root).alias("path")
    small = files.where(F.col("length") <= max_bytes).select(at, "length", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    large = files.where(F.col("length") > max_bytes).select(at, "length", F.lit(None).cast("string").alias("content"))
    return path_parts(small.unionByName(large)).select("issuer", "filing", "relative", "length", "content")


def _texts(files: DataFrame, top: str, max_bytes: int) -> DataFrame:
    small = _contents(files.where(F.col("length") <= max_bytes), top).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("string").alias("content"))
    return path_parts(small.unionByName(large)).select("issuer", "filing", "relative", "length", "content")


def lookup(units: DataFrame, which: str, documents: DataFrame) -> DataFrame:
    """Of each unit that names one in column `which`, that document: issuer, filing, relative, length, content (null where there is none)."""
    wanted = units.where(F.col(which).isNotNull()).select("issuer", "filing", F.col(which).alias("relative"))
    return wanted.join(documents, ["issuer", "filing", "relative"], "left")


@dataclass
class Corpus:
    """A tree of filings: its files and units, and what the units' metadata and index documents say."""

    files: DataFrame
    units: DataFrame
    metadata: DataFrame
    indexes: DataFrame


def from_tree(spark: SparkSession, root: str, max_bytes: int = DOCUMENT_BYTES) -> Corpus:
    """The corpus below root. Names and sizes come from one listing; contents are read of metadata and index documents alone."""
    top = _folder(spark, root)
    files = path_parts(settled(tree(spark, root)) if top else tree(spark, root))
    found = units(files)
    said = lambda which: _texts(files.where(F.lower("name") == f"{which}.json"), top, max_bytes) if top else texts(spark, root, any_case(f"{which}.json"), max_bytes=max_bytes)
    json = lambda which: lookup(found, which, said(which)).select("issuer", "filing", F.col("content").alias("json"))
    return Corpus(files, found, metadata(json("metadata")), index_documents(json("index")))


def write_tree(files: DataFrame, root: str) -> None:
    """Files (path, content) as a tree below root, a folder that all executors see; a task that is tried again writes the same."""
    top = Path(local_path(root))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = top / path
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", F.coalesce("content", F.lit(""))).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def path_parts(files: DataFrame, path: str = "path") -> DataFrame:
    """issuer, filing, relative (below the unit), name and extension of the files at depth 3 or more."""
    pattern = r"^([^/]+)/([^/]+)/(.+)$"
    issuer, two = F.substring_index(path, "/", 1), F.substring_index(path, "/", 2)
    # cut without patterns, which cost more than all else here
    return files.where(F.col(path).rlike(pattern)).select("*", issuer.alias("issuer"), F.substring_index(two, "/", -1).alias("filing"), F.substring(F.col(path), F.length(two) + 2, F.length(path)).alias("relative"), base_name(F.col(path)).alias("name"), extension(F.col(path)).alias("ext"))


def is_candidate(ext: Column) -> Column:
    return ext.isin(*CANDIDATE_EXTENSIONS)


def file_role(name: Column, ext: Column) -> Column:
    low = F.lower(name)
    return F.when(low == "metadata.json", "metadata").when(low == "index.json", "index").when(is_candidate(ext), "candidate").otherwise("companion")


def units(parts: DataFrame) -> DataFrame:
    """A row per unit: its metadata and index paths (the last wins) and sorted arrays of its files."""
    role = file_role(F.col("name"), F.col("ext"))
    rows = parts.withColumn("role", role)
    found = rows.groupBy("issuer", "filing").agg(
        F.max(F.when(F.col("role") == "metadata", F.col("relative"))).alias("metadata"),
        F.max(F.when(F.col("role") == "index", F.col("relative"))).alias("index"),
        F.sort_array(F.collect_list(F.struct("relative", "role"))).alias("all"),
    )
    these = lambda r: F.transform(F.filter("all", lambda f: f["role"] == r), lambda f: f["relative"])
    return found.select("issuer", "filing", "metadata", "index", F.col("all.relative").alias("files"), these("candidate").alias("candidates"), these("companion").alias("companions"))


def metadata(documents: DataFrame, column: str = "json") -> DataFrame:
    return documents.withColumn("m", F.from_json(column, METADATA)).select(*[c for c in documents.columns if c != column], "m.*")


def with_quoted_numbers(json: Column) -> Column:
    """JSON text with its numbers as strings, so that 1.50 stays 1.50."""
    return F.regexp_replace(json, BARE_NUMBER, '$1"$2"')


def index_documents(documents: DataFrame, column: str = "json") -> DataFrame:
    """Index documents parsed: `dir_name`, `parent_dir`, `items` and an `error` naming what is missing.

    An item may stand alone instead of in an array; scalars may be numbers, and keep their text.
    """
    # parsed once for nearly all: what isn't a list is looked at again, by a name of its own so that nothing is parsed for each use
    many = f"directory STRUCT<name: STRING, `parent-dir`: STRING, item: {ITEM}>"
    one = f"directory STRUCT<name: STRING, `parent-dir`: STRING, item: {ITEM[6:-1]}>"
    keep = [c for c in documents.columns if c != column]
    quoted = documents.select(*keep, with_quoted_numbers(F.col(column)).alias("json"))
    first = quoted.select(*keep, "json", F.from_json("json", many)["directory"].alias("many"))
    is_list = F.col("many.item").isNotNull()
    raw = first.select(*keep, "json", "many", F.when(~is_list, F.get_json_object("json", "$.directory.item")).alias("raw"))
    single = F.coalesce(F.col("raw").startswith("{"), F.lit(False))
    second = raw.select(*keep, "json", "many", "raw", F.when(single, F.from_json("json", one)["directory"]).alias("one"))
    items = F.when(single, F.array("one.item")).otherwise(F.col("many.item"))
    filled = lambda i: F.struct(*[F.coalesce(i[f], F.lit("")).alias(f.replace("-", "_")) for f in ("name", "type", "size", "last-modified")])
    ordered = F.sort_array(F.transform(items, lambda i: F.struct(F.lower(F.coalesce(i["name"], F.lit(""))).alias("k"), F.lower(F.coalesce(i["type"], F.lit(""))).alias("t"), filled(i).alias("i"))))
    error = F.when(~is_list & F.col("raw").isNull(), F.when(F.get_json_object("json", "$.directory").isNull(), "directory missing").otherwise("directory.item missing"))
    name = lambda f: F.coalesce(F.when(single, F.col("one")[f]).otherwise(F.col("many")[f]), F.lit(""))
    return second.select(*keep, name("name").alias("dir_name"), name("parent-dir").alias("parent_dir"), ordered["i"].alias("items"), error.alias("error"))


def index_items(parsed: DataFrame) -> DataFrame:
    """A row per item, in the order of lower-case name, then type; `position` counts from 0."""
    keep = [c for c in parsed.columns if c not in ("items", "error", "dir_name", "parent_dir")]
    # outer, since Spark puts the filter of an inner one, and one on the error, below the parser, which then runs for each
    rows = parsed.select(*keep, F.posexplode_outer(F.when(F.col("error").isNull(), F.col("items"))).alias("position", "i"))
    return rows.where(F.col("position").isNotNull()).select(*keep, "position", "i.*")
