"""Press releases: dedupe, events, the body stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, rfc3339

RELEASE = "headline STRING, company STRING, url STRING, published_at STRING, discovered_at STRING"


def seen_releases(log: DataFrame, *types: str) -> DataFrame:
    """Keys of the log's events of these types: the aggregate key, else the payload's URL."""
    key = first_filled(F.col("aggregate_key"), F.get_json_object("data", "$.url"))
    return log.where(F.col("type").isin(*types)).select(key.alias("release_id")).where("release_id is not null").distinct()


def new_releases(releases: DataFrame, log: DataFrame) -> DataFrame:
    return releases.join(seen_releases(log, "pr_discovered"), "release_id", "left_anti")


def pending_bodies(releases: DataFrame, log: DataFrame) -> DataFrame:
    """Those neither fetched nor failed: failures aren't tried again."""
    return releases.join(seen_releases(log, "pr_body_fetched", "pr_body_failed"), "release_id", "left_anti")


def release_events(releases: DataFrame, now: Column, source: str = "press") -> DataFrame:
    data = F.to_json(
        F.struct("headline", F.nullif(F.col("company"), F.lit("")).alias("company"), F.col("release_url").alias("url"), rfc3339(F.col("published_at")).alias("published_at"), rfc3339(now).alias("discovered_at")),
        {"ignoreNullFields": "true"},
    )
    return releases.select(F.concat(F.lit("pr_discovered:"), F.col("release_id")).alias("id"), F.lit("pr_discovered").alias("type"), now.alias("occurred_at"), F.col("release_id").alias("aggregate_key"), F.lit(source).alias("source"), data.alias("data"))


def fetched(releases: DataFrame, documents: DataFrame, *keys: str) -> DataFrame:
    """Releases or filings with their document, which may be missing."""
    return releases.join(documents, list(keys), "left")


def body_events(outcomes: DataFrame, now: Column, source: str = "bodies") -> DataFrame:
    """From guarded documents: a fetched event, or a failed one where there is an error."""
    failed = F.col("error").isNotNull()
    kind = F.when(failed, "pr_body_failed").otherwise("pr_body_fetched")
    good = F.to_json(F.struct(F.col("release_id").alias("pr_discovery_id"), "headline", F.nullif(F.col("company"), F.lit("")).alias("company"), F.col("release_url").alias("url"), rfc3339(F.col("published_at")).alias("published_at"), F.col("clean").alias("body"), rfc3339(now).alias("fetched_at")), {"ignoreNullFields": "true"})
    bad = F.to_json(F.struct(F.col("release_id").alias("pr_discovery_id"), F.col("release_url").alias("url"), "error", rfc3339(now).alias("failed_at")))
    return outcomes.select(F.concat(kind, F.lit(":"), F.col("release_id")).alias("id"), kind.alias("type"), now.alias("occurred_at"), F.col("release_id").alias("aggregate_key"), F.lit(source).alias("source"), F.when(failed, bad).otherwise(good).alias("data"))


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum((~F.col("fresh")).cast("long")), F.lit(0)).alias("seen"), F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0)).alias("discovered"))
