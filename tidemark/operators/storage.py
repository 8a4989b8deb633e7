"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        there = held.get() if held.isDefined() else None
    if not there:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def scratch(spark: SparkSession) -> str:
    """A name for a new folder there."""
    return f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, written there once, so that whatever reads it sees the same rows in the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def local_path(path: str) -> str:
    """A file: URI as a plain path; others as they are."""
    return path.split(":", 1)[1].replace("//", "", 1) if path.startswith("file:") else path


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A whole new file, seen by nobody before it is complete; False, and nothing changed, where that name is taken."""
    fs, at = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    keep[0] = hadoop.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(at), keep)
    except Exception:
        fs.delete(draft, False)
        if fs.exists(at):
            return False
        raise
    return True
