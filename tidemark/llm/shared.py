"""What several operators need: the shared folder, held-out folds, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contract: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        there = held.get() if held.isDefined() else None
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_written: list[str] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def stored_alone(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What make() gives, stored; the tables that were stored on the way are deleted."""
    before = len(_written)
    out = stored(make(), what)
    for name in _written[before:-1]:
        path = out.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return out


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus` (a null id counts as empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def shipped(spark: SparkSession) -> None:
    """Once per context, send this package to the executors, which may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, target: int, id_col: str = "doc_id") -> DataFrame:
    """About `target` rows of df at most, the same at each run: those whose hashed id is under a threshold."""
    rows = df.count()
    if rows <= target:
        return df
    grain = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(grain))
    return df.where(draw < int(grain * target / rows))
