"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and
returns a DataFrame, which `run` writes as Parquet and reads again for the next stage. All
but the last return the columns of their input; the last has size, source_size, target and
taken beside them, for the documents that the mix takes. Columns beyond those of `documents`
go through each stage as they are, whatever their names: operators see them as one struct.
Only the last stage's own four columns take the place of others of their names. Nulls, empty
texts, repeated rows and empty tables are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_dup, quality
from tidemark.llm.shared import fold, stored_alone, table

#: Near copies of the near-dedup stage: 100 * intersection >= 80 * union.
NEAR = (80, 100)

#: The columns of `documents`, which operators see; and the name under which they see all others.
OWN, REST = ("doc_id", "text", "lang", "source", "n_chars"), "rest_of_row"
MIXED = ("size", "source_size", "target", "taken")


def packed(docs: DataFrame) -> DataFrame:
    """docs with the columns beyond those of `documents` in one."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in OWN]
    return docs.select(*[c for c in docs.columns if c in OWN], *([F.struct(*rest).alias(REST)] if rest else []))


def unpacked(out: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """What a stage gives, with the columns of docs; those named in `more` are the stage's own."""
    columns = [F.col(c) if c in OWN else F.col(REST)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c.lower() not in more]
    return out.select(*columns, *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose Bradley-Terry score is under the threshold; learns from the labelled ones."""
    train = fold(4) != 2
    model = quality.learned(docs.where(train), table(spark, sf_dir, "labels").where(train))
    return unpacked(quality.scored(packed(docs), model).where(F.col("quality_score") >= quality.THRESHOLD), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines whose template recurs across documents, then passages wherever they begin and end, but for the first document's."""
    rows = packed(docs)
    whole = stored_alone(lambda: line_dedup.drop_recurring(rows).select(*rows.columns), "pipeline-whole-lines")
    return unpacked(line_dedup.drop_passages(whole), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return unpacked(near_dup.one_of_each(packed(docs), threshold=NEAR), docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which benchmark windows cover a twentieth of the words."""
    found = decontaminate.find_hits(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(~decontaminate.is_contaminated(decontaminate.n_hit(), F.col("n_words"))), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words of each."""
    rows = packed(docs)
    mixed = mixing.mix(rows, keep=[c for c in rows.columns if c != "doc_id"])
    return unpacked(mixed.where("taken > 0"), docs, *MIXED)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: The quality stage is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
