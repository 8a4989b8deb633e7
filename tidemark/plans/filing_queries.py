"""Queries over company listings and filing discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import filing_identity, normalize_cik, normalize_code, submissions_url
from ..operators import backfill, event_log, filings
from ..sources import listings
from . import bindings as b
from .bindings import FIL, SUB, WL, now
from .registry import query

FORMS_TEXT = "array_to_string(allowed_forms, ',')"


def _watchlist(spark, sf_dir):
    return listings.watchlist(b.watchlist_documents(spark, sf_dir))


@query("watchlist_load", f"WITH {WL} SELECT ticker, company_name, cik, {FORMS_TEXT} AS forms, enabled, poll_priority, row_number() OVER (ORDER BY poll_priority, ticker)::BIGINT AS place FROM wl")
def _(spark, sf_dir):
    rows = listings.ranked(_watchlist(spark, sf_dir), "poll_priority", "ticker")
    return rows.select("ticker", "company_name", "cik", F.array_join("allowed_forms", ",").alias("forms"), "enabled", "poll_priority", F.col("place").cast("long").alias("place"))


@query("watchlist_enabled", f"WITH {WL} SELECT ticker, cik, row_number() OVER (ORDER BY ticker)::BIGINT AS place FROM wl WHERE enabled")
def _(spark, sf_dir):
    return listings.ranked(_watchlist(spark, sf_dir).where("enabled"), "ticker").select("ticker", "cik", F.col("place").cast("long").alias("place"))


@query("forms_normalized", f"WITH {WL} SELECT ticker, {FORMS_TEXT} AS forms, len(allowed_forms)::BIGINT AS n FROM wl")
def _(spark, sf_dir):
    return _watchlist(spark, sf_dir).select("ticker", F.array_join("allowed_forms", ",").alias("forms"), F.size("allowed_forms").cast("long").alias("n"))


SUB_COLUMNS = "ticker, cik, accession, form, filing_date, primary_document, acceptance_datetime, submissions_url"


@query("submissions_explode", f"WITH {SUB} SELECT {SUB_COLUMNS} FROM found")
def _(spark, sf_dir):
    return listings.recent_filings(listings.submissions(b.submissions(spark, sf_dir)))


@query("submissions_errors", "SELECT 't' || o_custkey AS ticker, count(*)::BIGINT AS n, 'form' AS error FROM orders WHERE o_custkey % 10 = 1 GROUP BY o_custkey")
def _(spark, sf_dir):
    return listings.submissions(b.submissions(spark, sf_dir)).where("error is not null").select("ticker", F.col("n").cast("long").alias("n"), "error")


@query("manifest_flatten", f"WITH {FIL} SELECT ticker AS target_ticker, submissions_url, accession AS accession_number, form, filing_date FROM fil")
def _(spark, sf_dir):
    f = b.filings(spark, sf_dir)
    entry = F.struct(F.col("accession").alias("accession_number"), "form", "filing_date", "cik", "ticker")
    per = f.groupBy("cik", "ticker", "submissions_url").agg(F.collect_list(entry).alias("filings")).select("cik", F.struct("cik", "ticker", "submissions_url", "filings").alias("t"))
    documents = per.select(F.to_json(F.struct(F.lit("base").alias("base_dir"), F.array("t").alias("targets"))).alias("json"))
    return listings.manifest_filings(documents).select("target_ticker", "submissions_url", "accession_number", "form", "filing_date")


@query("filter_forms", f"WITH {FIL}, {WL} SELECT fil.accession, fil.form FROM fil JOIN wl USING (cik) WHERE len(allowed_forms) = 0 OR list_contains(allowed_forms, fil.form)")
def _(spark, sf_dir):
    joined = b.filings(spark, sf_dir).join(_watchlist(spark, sf_dir).select("cik", "allowed_forms"), "cik")
    return joined.where(filings.allowed(F.col("form"), F.col("allowed_forms"))).select("accession", "form")


DISCOVER = f"""WITH {SUB}, {WL}, hits AS (
  SELECT found.*, found.cik || ':' || accession AS identity FROM found JOIN wl USING (cik) WHERE enabled AND (len(allowed_forms) = 0 OR list_contains(allowed_forms, found.form))
)"""


def _discovered(spark, sf_dir):
    return filings.discovered(_watchlist(spark, sf_dir), b.submissions(spark, sf_dir))


def _seen(spark, sf_dir):
    """A log in which every third filing has been discovered."""
    old = b.filings(spark, sf_dir).where(F.col("accession").cast("long") % 3 == 0).withColumn("identity", filing_identity(F.col("cik"), F.col("accession")))
    return filings.seen_identities(filings.discovery_events(old, now()))


@query("discover_filings", f"{DISCOVER} SELECT ticker, cik, accession, form, identity FROM hits")
def _(spark, sf_dir):
    return _discovered(spark, sf_dir).select("ticker", "cik", "accession", "form", "identity")


@query("filings_new", f"WITH {FIL} SELECT accession, cik || ':' || accession AS identity FROM fil WHERE accession::BIGINT % 3 <> 0")
def _(spark, sf_dir):
    f = b.filings(spark, sf_dir).withColumn("identity", filing_identity(F.col("cik"), F.col("accession")))
    return filings.new_filings(f, _seen(spark, sf_dir)).select("accession", "identity")


@query(
    "discovery_summary",
    f"""{DISCOVER}, c AS (SELECT wl.cik, NOT coalesce(bool_or(o_custkey % 10 = 1), true) AS ok FROM wl LEFT JOIN orders ON lpad(o_custkey::VARCHAR, 10, '0') = wl.cik WHERE enabled GROUP BY wl.cik)
    SELECT (SELECT count(*) FROM c)::BIGINT AS watched, (SELECT count(*) FROM c WHERE ok)::BIGINT AS ok, (SELECT count(*) FROM c WHERE NOT ok)::BIGINT AS failed,
    (SELECT count(*) FROM hits WHERE o_orderkey % 3 = 0)::BIGINT AS already_seen, (SELECT count(*) FROM hits WHERE o_orderkey % 3 <> 0)::BIGINT AS discovered""",
)
def discovery_summary(spark, sf_dir):
    parsed = listings.submissions(b.submissions(spark, sf_dir)).withColumn("cik", normalize_cik(F.col("doc.cik")))
    companies = _watchlist(spark, sf_dir).where("enabled").select("cik").join(parsed.select("cik", F.col("error").isNull().alias("fine")).hint("merge"), "cik", "left").select(F.coalesce("fine", F.lit(False)).alias("ok"))
    found = filings.tagged(_discovered(spark, sf_dir), _seen(spark, sf_dir), "filing_date", "accession")
    return filings.run_summary(companies, found)


@query("discovery_dry_run", "WITH f AS (SELECT *, l_orderkey % 3 = 0 AS old, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS nth FROM lineitem) SELECT count(*) FILTER (NOT old)::BIGINT AS dry, count(*) FILTER (NOT old AND nth = 1)::BIGINT AS real, count(*) FILTER (old OR nth > 1)::BIGINT AS seen FROM f")
def _(spark, sf_dir):
    """Filings with repeats: a dry run counts each as new, a real one the first."""
    key = lambda c: F.col(c).cast("string")
    rows = b.table(spark, sf_dir, "lineitem").select(filing_identity(key("l_orderkey"), key("l_linenumber")).alias("identity"), (F.col("l_orderkey") % 3 == 0).alias("known"), "l_partkey")
    seen = rows.where("known").select("identity").distinct()
    count = lambda c: F.count_if(c).cast("long")
    dry = filings.tagged(rows, seen, "l_partkey", dry_run=True).agg(count("fresh").alias("dry"))
    return dry.crossJoin(filings.tagged(rows, seen, "l_partkey").agg(count("fresh").alias("real"), count(~F.col("fresh")).alias("seen")))  # one row each


@query("filings_ordered", f"WITH {FIL} SELECT accession, row_number() OVER (ORDER BY ticker, cik || ':' || accession)::BIGINT AS place FROM fil")
def _(spark, sf_dir):
    f = b.filings(spark, sf_dir).withColumn("identity", filing_identity(F.col("cik"), F.col("accession")))
    return event_log.numbered(f, "ticker", "identity", name="place").select("accession", "place")


@query(
    "filing_events",
    f"""WITH {FIL} SELECT 'filing_discovered:' || cik || ':' || accession AS id, cik || ':' || accession AS aggregate_key, ticker, accession AS accession_number, nullif(acceptance_datetime, '') AS acceptance_datetime, '2024-02-01T00:00:00Z' AS discovered_at FROM fil""",
)
def _(spark, sf_dir):
    f = b.filings(spark, sf_dir).withColumn("identity", filing_identity(F.col("cik"), F.col("accession")))
    p = F.from_json("data", filings.DISCOVERED)
    return filings.discovery_events(f, now()).select("id", "aggregate_key", p["ticker"].alias("ticker"), p["accession_number"].alias("accession_number"), p["acceptance_datetime"].alias("acceptance_datetime"), p["discovered_at"].alias("discovered_at"))


@query("seen_after_run", f"WITH {FIL} SELECT cik || ':' || accession AS identity FROM fil WHERE accession::BIGINT % 3 = 0 OR accession::BIGINT % 5 = 0")
def _(spark, sf_dir):
    fresh = b.filings(spark, sf_dir).where(F.col("accession").cast("long") % 5 == 0).select(filing_identity(F.col("cik"), F.col("accession")).alias("identity"))
    return _seen(spark, sf_dir).unionByName(fresh).distinct()


@query("normalize_cik", "SELECT c_custkey, lpad(regexp_extract(c_name, '#(.*)', 1), 10, '0') AS cik, '' AS none, '12345678901' AS long, c_custkey::VARCHAR || '0000000000' AS kept FROM customer")
def _(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    return c.select("c_custkey", normalize_cik(F.col("c_name")).alias("cik"), normalize_cik(F.col("c_mktsegment")).alias("none"), normalize_cik(F.lit(" 1234-5678901 ")).alias("long"), normalize_cik(F.concat(F.col("c_custkey").cast("string"), F.lit(" 0000000000"))).alias("kept"))


@query("filing_identity", f"WITH {FIL} SELECT accession, cik || ':' || accession AS identity, submissions_url FROM fil")
def _(spark, sf_dir):
    f = b.filings(spark, sf_dir)
    return f.select("accession", filing_identity(F.regexp_replace("cik", "^0+(?=.)", ""), F.concat(F.lit("\t"), "accession", F.lit(" "))).alias("identity"), submissions_url(F.col("cik")).alias("submissions_url"))


@query("normalize_form", f"WITH {FIL} SELECT accession, form FROM fil")
def _(spark, sf_dir):
    return b.filings(spark, sf_dir).select("accession", normalize_code(F.concat(F.lit("  "), F.lower("form"), F.lit("\n"))).alias("form"))


@query(
    "backfill_select",
    f"""WITH {FIL}, r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession) AS nth FROM fil WHERE form IN ('1-URGENT', '2-HIGH') AND filing_date >= '1996-01-01' AND filing_date < '1999-01-01')
    SELECT cik, accession, filing_date FROM r WHERE nth <= 2 ORDER BY filing_date DESC, cik, accession LIMIT 25""",
)
def _(spark, sf_dir):
    return backfill.select(b.filings(spark, sf_dir), ["1-URGENT", "2-HIGH"], "1996-01-01", "1999-01-01", 2, 25).select("cik", "accession", "filing_date")


@query(
    "missing_quarters",
    f"""WITH {FIL}, q AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 3 MONTH))::DATE AS quarter)
    SELECT DISTINCT cik, strftime(quarter, '%Y-%m-%d') AS quarter FROM fil, q WHERE NOT EXISTS (SELECT 1 FROM fil g WHERE g.cik = fil.cik AND date_trunc('quarter', g.filing_date::DATE)::DATE = quarter)""",
)
def _(spark, sf_dir):
    found = backfill.missing_quarters(b.filings(spark, sf_dir).withColumn("filing_date", F.to_date("filing_date")), "1996-01-01", "1997-12-31")
    return found.select("cik", F.date_format("quarter", "yyyy-MM-dd").alias("quarter"))


AMENDED = "CASE WHEN accession::BIGINT % 4 = 0 THEN form || '/A' ELSE form END"


@query(
    "supersede_amendments",
    f"""WITH {FIL}, a AS (SELECT cik, accession, filing_date, form AS base, {AMENDED} AS form FROM fil),
    r AS (SELECT *, row_number() OVER (PARTITION BY cik, base, filing_date[1:4] ORDER BY filing_date DESC, (form LIKE '%/A')::INT DESC, accession DESC) AS nth FROM a) SELECT cik, accession, form FROM r WHERE nth = 1""",
)
def _(spark, sf_dir):
    f = b.filings(spark, sf_dir).withColumn("form", F.when(F.col("accession").cast("long") % 4 == 0, F.concat("form", F.lit("/A"))).otherwise(F.col("form")))
    return backfill.supersede(f, F.substring("filing_date", 1, 4)).select("cik", "accession", "form")


@query("breadth_check", f"WITH {FIL} SELECT cik, bool_or(form = '1-URGENT') AS has_annual, bool_or(form IN ('2-HIGH', '3-MEDIUM')) AS has_quarterly FROM fil GROUP BY cik")
def _(spark, sf_dir):
    return backfill.breadth(b.filings(spark, sf_dir), ["1-URGENT"], ["2-HIGH", "3-MEDIUM"])
