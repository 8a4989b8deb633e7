"""Company listings: watchlists, submissions documents, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_cik, normalize_code, submissions_url, trim_unicode
from ..operators.event_log import numbered

WATCHLIST = "entries ARRAY<STRUCT<ticker: STRING, company_name: STRING, cik: STRING, allowed_forms: ARRAY<STRING>, enabled: BOOLEAN, poll_priority: INT, notes: STRING>>"
SUBMISSIONS = "cik STRING, filings STRUCT<recent: STRUCT<accessionNumber: ARRAY<STRING>, form: ARRAY<STRING>, filingDate: ARRAY<STRING>, primaryDocument: ARRAY<STRING>, acceptanceDateTime: ARRAY<STRING>>>"
# fixed values: the fields of a unit's metadata
METADATA_FIELDS = ("acceptance_datetime", "accession_number", "cik", "filing_date", "filing_index_url", "form", "primary_doc_description", "primary_document", "primary_document_url", "ticker")
METADATA = ", ".join(f"{f} STRING" for f in METADATA_FIELDS)
MANIFEST = f"base_dir STRING, generated_by STRING, targets ARRAY<STRUCT<cik: STRING, ticker: STRING, submissions_url: STRING, filings: ARRAY<STRUCT<{METADATA.replace(' STRING', ': STRING')}>>>>"


def normalized_forms(forms: Column) -> Column:
    """Sorted distinct forms, blanks left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(forms, F.array().cast("array<string>")), normalize_code), lambda f: f != "")))


def watchlist(documents: DataFrame, column: str = "json") -> DataFrame:
    """Entries of watchlist documents, normalised."""
    entry = F.explode(F.from_json(column, WATCHLIST)["entries"]).alias("e")
    e = lambda name: F.col(f"e.{name}")
    return documents.select(entry).select(
        normalize_code(e("ticker")).alias("ticker"),
        e("company_name").alias("company_name"),
        normalize_cik(e("cik")).alias("cik"),
        normalized_forms(e("allowed_forms")).alias("allowed_forms"),
        F.coalesce(e("enabled"), F.lit(False)).alias("enabled"),
        F.coalesce(e("poll_priority"), F.lit(0)).alias("poll_priority"),
    )


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Entries with their place in an order."""
    return numbered(df, *order, name="place")


def submissions(documents: DataFrame, column: str = "json", ticker: str = "ticker", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents parsed, with n (accessions) and `error` where a required array is shorter, and the columns of `keep`."""
    # as rows of an array of one: Spark puts a filter on what a plain column has below the parser, which then runs again for each use
    doc = documents.select(*[c for c in documents.columns if c != "doc"], F.explode_outer(F.array(F.from_json(column, SUBMISSIONS))).alias("doc"))
    recent = "doc.filings.recent."
    size = lambda name: F.coalesce(F.size(F.col(recent + name)), F.lit(0))
    short = [F.when(F.greatest(size(name), F.lit(0)) < F.greatest(size("accessionNumber"), F.lit(0)), name) for name in ("form", "filingDate", "primaryDocument")]
    broken = F.when(F.col("doc").isNull(), F.lit("json"))
    return doc.select(F.col(ticker).alias("ticker"), "doc", F.greatest(size("accessionNumber"), F.lit(0)).alias("n"), F.coalesce(broken, *short).alias("error"), *keep)


def recent_filings(parsed: DataFrame, allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row per filing of the documents without an error; blank accessions are dropped, and forms that `allowed` doesn't take, before they become rows."""
    r = "doc.filings.recent."
    text = lambda c: trim_unicode(F.coalesce(c, F.lit("")))
    # the shorter arrays are padded with nulls; what is beyond the accessions has none
    whole = F.arrays_zip(*[F.col(r + f).alias(f) for f in ("accessionNumber", "form", "filingDate", "primaryDocument")], F.coalesce(F.col(r + "acceptanceDateTime"), F.array().cast("array<string>")).alias("acceptanceDateTime"))
    wanted = lambda f: (text(f["accessionNumber"]) != "") & (F.lit(True) if allowed is None else allowed(f["form"]))
    # what a document has once is made before there are rows of it
    once = parsed.withColumns({"ticker": normalize_code(F.col("ticker")), "cik": normalize_cik(F.col("doc.cik")), "submissions_url": submissions_url(F.col("doc.cik"))})
    # outer, since Spark adds a filter to an inner one, for which the list is made twice
    rows = once.select("ticker", "cik", "submissions_url", F.explode_outer(F.when(F.col("error").isNull(), F.filter(whole, wanted))).alias("f")).where(F.col("f").isNotNull())
    return rows.select(
        "ticker",
        "cik",
        text(F.col("f.accessionNumber")).alias("accession"),
        normalize_code(F.coalesce("f.form", F.lit(""))).alias("form"),
        text(F.col("f.filingDate")).alias("filing_date"),
        text(F.col("f.primaryDocument")).alias("primary_document"),
        text(F.col("f.acceptanceDateTime")).alias("acceptance_datetime"),
        "submissions_url",
    )


def manifest_filings(documents: DataFrame, column: str = "json") -> DataFrame:
    targets = documents.select(F.explode(F.from_json(column, MANIFEST)["targets"]).alias("t"))
    return targets.select(F.col("t.ticker").alias("target_ticker"), F.col("t.submissions_url").alias("submissions_url"), F.explode("t.filings").alias("f")).select("target_ticker", "submissions_url", "f.*")
