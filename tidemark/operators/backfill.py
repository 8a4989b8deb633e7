"""Rolling backfill of filings: selection, gaps, amendments, breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def base_form(form: Column) -> Column:
    return F.regexp_replace(form, "/A$", "")


def select(filings: DataFrame, forms: list[str], since: str, until: str, per_issuer: int, per_run: int) -> DataFrame:
    """Newest filings in the window, amendments included: at most per_issuer each, per_run in all."""
    inside = filings.where(base_form(F.col("form")).isin(*forms) & (F.col("filing_date") >= since) & (F.col("filing_date") < until))
    newest = W.partitionBy("cik").orderBy(F.desc("filing_date"), "accession")
    capped = inside.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= per_issuer)
    return capped.orderBy(F.desc("filing_date"), "cik", "accession").limit(per_run)


def missing_quarters(filings: DataFrame, since: str, until: str) -> DataFrame:
    """Quarters of the window in which an issuer has no filing."""
    issuers = filings.select("cik").distinct()
    all_quarters = F.sequence(F.date_trunc("quarter", F.lit(since)).cast("date"), F.lit(until).cast("date"), F.expr("interval 3 months"))
    wanted = issuers.select("cik", F.explode(all_quarters).alias("quarter"))
    had = filings.select("cik", F.date_trunc("quarter", "filing_date").cast("date").alias("quarter")).distinct()
    return wanted.join(had, ["cik", "quarter"], "left_anti")


def supersede(filings: DataFrame, period: Column) -> DataFrame:
    """For each issuer, base form and period the last filing, which an amendment may be."""
    last = W.partitionBy("cik", base_form(F.col("form")), period).orderBy(F.desc("filing_date"), F.desc(F.col("form").endswith("/A").cast("int")), F.desc("accession"))
    return filings.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def breadth(filings: DataFrame, annual: list[str], quarterly: list[str]) -> DataFrame:
    of = lambda forms: F.coalesce(F.bool_or(base_form(F.col("form")).isin(*forms)), F.lit(False))
    return filings.groupBy("cik").agg(of(annual).alias("has_annual"), of(quarterly).alias("has_quarterly"))
