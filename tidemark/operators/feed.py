"""The live feed: rows, headlines, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, relative_time

KEEP = 300


def feed_rows(log: DataFrame) -> DataFrame:
    """What a server sends for each record."""
    event = F.struct("id", "type", "occurred_at", "aggregate_key", "source", "data")
    return log.select(F.col("sequence").alias("id"), F.lit("record").alias("event"), F.to_json(F.struct("sequence", event.alias("event"), "appended_at")).alias("data"))


def headline() -> Column:
    field = lambda name: F.nullif(F.get_json_object("data", f"$.{name}"), F.lit(""))
    kind = F.lower(F.coalesce("type", F.lit("")))
    own = F.nullif(F.col("type"), F.lit(""))
    about = F.coalesce(field("accession"), field("cik"))
    filing = F.trim(F.concat(F.coalesce(field("form"), field("filing_type"), own, F.lit("Filing")), F.lit(" "), F.coalesce(F.concat(F.lit("("), about, F.lit(")")), F.lit(""))))
    press = F.coalesce(field("headline"), field("title"), field("subject"), own, F.lit("Press release"))
    other = F.coalesce(field("headline"), field("title"), field("summary"), F.col("data"))
    return F.when(kind.contains("filing"), filing).when(kind.contains("press") | kind.contains("news"), press).otherwise(other)


def source_class() -> Column:
    s = F.lower(F.coalesce("source", F.lit("")))
    return F.when(s.contains("sec"), "sec").when(s.contains("pr"), "pr-newswire").otherwise("")


def cards(log: DataFrame, now: Column) -> DataFrame:
    when = F.coalesce("occurred_at", "appended_at")
    return log.select(
        "sequence",
        first_filled(F.col("source"), F.lit("unknown")).alias("source"),
        first_filled(F.col("aggregate_key"), F.lit("N/A")).alias("ticker"),
        when.alias("shown_at"),
        relative_time(when, now).alias("ago"),
        source_class().alias("class"),
        headline().alias("headline"),
    )


def latest(log: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest records, one per sequence."""
    return log.dropDuplicates(["sequence"]).orderBy(F.desc("sequence")).limit(keep)
