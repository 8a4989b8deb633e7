"""Filing discovery: watchlist filter, dedupe against the log, events, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filing_identity, normalize_cik, normalize_code, rfc3339
from ..sources import listings
from .event_log import first_in_batch, parts_of

DISCOVERED = "ticker STRING, cik STRING, accession_number STRING, form STRING, filing_date STRING, acceptance_datetime STRING, primary_document STRING, submissions_source_url STRING, discovered_at STRING"


def allowed(form: Column, forms: Column) -> Column:
    """An empty list allows every form."""
    return (F.size(forms) == 0) | F.array_contains(forms, normalize_code(form))


def watched_filings(watchlist: DataFrame, filings: DataFrame) -> DataFrame:
    """Filings of enabled companies whose form is allowed, with identity."""
    entries = watchlist.where("enabled").select("cik", "allowed_forms")
    joined = filings.join(entries, "cik").where(allowed(F.col("form"), F.col("allowed_forms")))
    return joined.drop("allowed_forms").withColumn("identity", filing_identity(F.col("cik"), F.col("accession")))


#: Enabled entries of a watchlist up to which they go to every task.
WATCHED = 200_000


def watched_documents(watchlist: DataFrame, documents: DataFrame, column: str = "json") -> DataFrame:
    """Submissions documents of enabled companies, with their allowed_forms; only the document's own cik is looked at before the join.

    The entries are counted, and broadcast where there are few enough, so that documents stay where they are.
    """
    entries = watchlist.where("enabled").select(F.col("cik").alias("watched"), "allowed_forms")
    few = entries.limit(WATCHED + 1).count() <= WATCHED
    # a column of its own, so that the document isn't gone through for each use
    said = documents.withColumn("watched", F.get_json_object(column, "$.cik"))
    keyed = said.withColumn("watched", normalize_cik(F.col("watched")))
    return keyed.join(F.broadcast(entries) if few else entries, "watched").drop("watched")


def discovered(watchlist: DataFrame, documents: DataFrame, column: str = "json") -> DataFrame:
    """As watched_filings of recent_filings: companies are chosen before their documents are parsed, forms before filings become rows."""
    rows = listings.recent_filings(listings.submissions(watched_documents(watchlist, documents, column), column, keep=("allowed_forms",)), allowed=lambda form: allowed(form, F.col("allowed_forms")))
    # both parts are normalised already
    return rows.withColumn("identity", F.concat("cik", F.lit(":"), "accession"))


def seen_identities(log: DataFrame) -> DataFrame:
    """Identities in the log's discovery events; those without cik or accession don't count."""
    p = F.from_json("data", "cik STRING, accession_number STRING")
    # as rows of an array of one: Spark puts a filter on what a plain column has below the parser, which then runs again for it
    rows = log.where(F.col("type") == "filing_discovered").select(F.inline_outer(F.array(p))).where("coalesce(cik, '') <> '' and coalesce(accession_number, '') <> ''")
    return rows.select(filing_identity(F.col("cik"), F.col("accession_number")).alias("identity")).distinct()


def new_filings(filings: DataFrame, seen: DataFrame) -> DataFrame:
    return filings.join(seen, "identity", "left_anti")


def tagged(filings: DataFrame, seen: DataFrame, *arrival: str, dry_run: bool = False) -> DataFrame:
    """filings with `fresh`: not in the log, and the first of its identity in the batch.

    A dry run marks nothing as seen while it goes, so that each repeat in the batch is fresh.
    """
    # merged where both are dealt out: Spark takes what a parser gives for smaller than it is, and a broadcast goes through the driver
    old = seen.withColumn("old", F.lit(True)).hint("merge")
    if dry_run:
        return filings.join(old, "identity", "left").withColumn("fresh", F.col("old").isNull()).drop("old")
    # numbered before the join, which takes the rows dealt and sorted as they are
    marked = first_in_batch(filings, ["identity"], *arrival, partitions=parts_of(filings)).join(old, "identity", "left")
    return marked.withColumn("fresh", F.col("old").isNull() & (F.col("nth") == 1)).drop("old", "nth")


def discovery_events(filings: DataFrame, now: Column, source: str = "filings") -> DataFrame:
    data = F.to_json(
        F.struct(
            "ticker",
            "cik",
            F.col("accession").alias("accession_number"),
            "form",
            "filing_date",
            F.nullif(F.col("acceptance_datetime"), F.lit("")).alias("acceptance_datetime"),
            "primary_document",
            F.col("submissions_url").alias("submissions_source_url"),
            rfc3339(now).alias("discovered_at"),
        ),
        {"ignoreNullFields": "true"},
    )
    return filings.select(F.concat(F.lit("filing_discovered:"), F.col("identity")).alias("id"), F.lit("filing_discovered").alias("type"), now.alias("occurred_at"), F.col("identity").alias("aggregate_key"), F.lit(source).alias("source"), data.alias("data"))


def run_summary(companies: DataFrame, found: DataFrame) -> DataFrame:
    """One row from companies(ok) and tagged filings(fresh): watched, ok, failed, already_seen, discovered."""
    one = companies.agg(F.count(F.lit(1)).alias("watched"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("ok"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("failed"))
    two = found.agg(F.coalesce(F.sum((~F.col("fresh")).cast("long")), F.lit(0)).alias("already_seen"), F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0)).alias("discovered"))
    return one.crossJoin(two)  # one row each
