"""The toolkit's inputs, bound to tables of events, orders, customers, lineitems and pages.

LOG: events as an event log. FIL: orders as filings; SUB: the same per customer as listing
documents. WL: customers as a watchlist. CORP: orders as filing units, lineitems as index
items. Each has its SQL form beside it, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records; ids are already in order of time."""
    k = F.col("event_id") % 5
    text = F.col("event_id").cast("string")
    kind = F.when(F.col("event_type") == "click", "filing_discovered").when(F.col("event_type") == "view", "pr_discovered").when(F.col("event_type") == "purchase", "pr_body_fetched").when(F.col("event_type") == "error", "pr_body_failed").otherwise("press_note")
    source = F.when(F.col("event_type") == "click", "sec_filings").when(F.col("event_type") == "view", "press_wire").when(F.col("event_type") == "purchase", "processor").when(F.col("event_type") == "signup", "bodies").otherwise("")
    data = (
        F.when(k == 0, F.concat(F.lit('{"form":"8-K","cik":"'), F.col("user_id").cast("string"), F.lit('"}')))
        .when(k == 1, F.concat(F.lit('{"headline":"Note '), text, F.lit('"}')))
        .when(k == 2, F.col("props"))
        .when(k == 3, F.concat(F.lit('{"title":"T'), text, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"summary":"S '), text, F.lit('","subject":"J"}')))
    )
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("sequence"),
        F.concat("event_type", F.lit(":"), text).alias("id"),
        kind.alias("type"),
        ts.alias("occurred_at"),
        F.col("user_id").cast("string").alias("aggregate_key"),
        source.alias("source"),
        data.alias("data"),
        (ts + F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))).alias("appended_at"),
    )


LOG = """log AS (
  SELECT event_id + 1 AS sequence, event_type || ':' || event_id AS id,
    CASE event_type WHEN 'click' THEN 'filing_discovered' WHEN 'view' THEN 'pr_discovered' WHEN 'purchase' THEN 'pr_body_fetched' WHEN 'error' THEN 'pr_body_failed' ELSE 'press_note' END AS type,
    ts AS occurred_at, user_id::VARCHAR AS aggregate_key,
    CASE event_type WHEN 'click' THEN 'sec_filings' WHEN 'view' THEN 'press_wire' WHEN 'purchase' THEN 'processor' WHEN 'signup' THEN 'bodies' ELSE '' END AS source,
    CASE event_id % 5 WHEN 0 THEN '{"form":"8-K","cik":"' || user_id || '"}' WHEN 1 THEN '{"headline":"Note ' || event_id || '"}' WHEN 2 THEN props
      WHEN 3 THEN '{"title":"T' || event_id || '"}' ELSE '{"summary":"S ' || event_id || '","subject":"J"}' END AS data,
    ts + to_hours((event_id % 7)::INT) AS appended_at
  FROM events
)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        key.alias("accession"),
        F.col("o_orderpriority").alias("form"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
        F.concat(key, F.lit(".htm")).alias("primary_document"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("acceptance_datetime"),
        F.concat(F.lit("https://data.sec.gov/submissions/CIK"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit(".json")).alias("submissions_url"),
    )


FIL = """fil AS (
  SELECT 'T' || o_custkey AS ticker, lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderkey::VARCHAR AS accession, o_orderpriority AS form,
    strftime(o_orderdate, '%Y-%m-%d') AS filing_date, o_orderkey || '.htm' AS primary_document,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS acceptance_datetime,
    'https://data.sec.gov/submissions/CIK' || lpad(o_custkey::VARCHAR, 10, '0') || '.json' AS submissions_url
  FROM orders
)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing document per customer. One in ten has a form too few, one in three an acceptance too few, some accessions are blank."""
    o = table(spark, sf_dir, "orders").withColumn("row", F.struct("o_orderkey", "o_orderpriority", "o_orderdate"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    key = lambda r: r["o_orderkey"].cast("string")
    date = lambda r: F.date_format(r["o_orderdate"], "yyyy-MM-dd")
    all_of = lambda f: F.transform("rows", f)
    shorter = lambda a: F.slice(a, 1, F.size("rows") - 1)
    forms = all_of(lambda r: F.concat(F.lit(" "), F.lower(r["o_orderpriority"])))
    recent = F.struct(
        all_of(lambda r: F.when(r["o_orderkey"] % 50 == 0, " ").otherwise(key(r))).alias("accessionNumber"),
        F.when(F.col("o_custkey") % 10 == 1, shorter(forms)).otherwise(forms).alias("form"),
        all_of(date).alias("filingDate"),
        all_of(lambda r: F.concat(key(r), F.lit(".htm"))).alias("primaryDocument"),
        F.when(F.col("o_custkey") % 3 == 0, shorter(all_of(date))).otherwise(all_of(date)).alias("acceptanceDateTime"),
    )
    doc = F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))
    return per.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("ticker"), "o_custkey", F.to_json(doc).alias("json"))


SUB = """sub AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
), found AS (
  SELECT 'T' || o_custkey AS ticker, lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderkey::VARCHAR AS accession, o_orderpriority AS form,
    strftime(o_orderdate, '%Y-%m-%d') AS filing_date, o_orderkey || '.htm' AS primary_document,
    CASE WHEN o_custkey % 3 = 0 AND pos = n THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS acceptance_datetime,
    'https://data.sec.gov/submissions/CIK' || lpad(o_custkey::VARCHAR, 10, '0') || '.json' AS submissions_url, o_custkey, o_orderkey
  FROM sub WHERE o_custkey % 10 <> 1 AND o_orderkey % 50 <> 0
)"""


def watchlist_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watchlist document per nation."""
    forms = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit(" 1-urgent "), F.lit("2-HIGH"), F.lit("2-high")))
        .when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("5-LOW")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT"), F.lit("")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("4-not specified")))
        .otherwise(F.array().cast("array<string>"))
    )
    key = F.col("c_custkey").cast("string")
    entry = F.struct(F.concat(F.lit(" t"), key).alias("ticker"), F.col("c_name").alias("company_name"), key.alias("cik"), forms.alias("allowed_forms"), (F.col("c_acctbal") > 0).alias("enabled"), F.col("c_nationkey").cast("int").alias("poll_priority"), F.lit("").alias("notes"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 64).alias("part"), entry.alias("e"))
    return rows.groupBy("c_nationkey", "part").agg(F.collect_list("e").alias("entries")).select(F.to_json(F.struct("entries")).alias("json"))


WL = """wl AS (
  SELECT 'T' || c_custkey AS ticker, c_name AS company_name, lpad(c_custkey::VARCHAR, 10, '0') AS cik,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['1-URGENT', '2-HIGH'] WHEN 'BUILDING' THEN ['5-LOW'] WHEN 'HOUSEHOLD' THEN ['1-URGENT', '3-MEDIUM'] WHEN 'MACHINERY' THEN ['4-NOT SPECIFIED'] ELSE []::VARCHAR[] END AS allowed_forms,
    c_acctbal > 0 AS enabled, c_nationkey::INT AS poll_priority
  FROM customer
)"""


def corpus_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issuer, filing and a metadata document per order; some fields blank, some URLs wrong."""
    o = table(spark, sf_dir, "orders")
    key, cik = F.col("o_orderkey"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    number = F.concat(F.lpad(key.cast("string"), 10, "0"), F.lit("-24-"), F.lpad((key % 1000).cast("string"), 6, "0"))
    bare = F.replace(number, F.lit("-"), F.lit(""))
    url = F.concat(F.lit("https://files.example.com/"), F.when(key % 13 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string")), F.lit("/"), F.when(key % 17 == 0, F.lit("none")).otherwise(bare), F.lit("/"))
    m = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("acceptance_datetime"),
        number.alias("accession_number"),
        cik.alias("cik"),
        F.when(key % 29 == 0, " ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filing_date"),
        url.alias("filing_index_url"),
        F.when(key % 31 == 0, "").otherwise(F.col("o_orderpriority")).alias("form"),
        F.lit("doc").alias("primary_doc_description"),
        F.when(key % 19 == 0, "").when(key % 7 == 0, F.lit("Item1.HTM")).otherwise(F.concat(F.lit("item"), (key % 9).cast("string"), F.lit(".htm"))).alias("primary_document"),
        F.lit("https://files.example.com/doc").alias("primary_document_url"),
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"),
    )
    return o.select(F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("issuer"), F.concat(F.lit("F"), key.cast("string")).alias("filing"), F.to_json(m).alias("json"))


META = """meta AS (
  SELECT 'I' || o_custkey AS issuer, 'F' || o_orderkey AS filing, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS acceptance_datetime,
    lpad(o_orderkey::VARCHAR, 10, '0') || '-24-' || lpad((o_orderkey % 1000)::VARCHAR, 6, '0') AS accession_number, lpad(o_custkey::VARCHAR, 10, '0') AS cik,
    CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filing_date,
    'https://files.example.com/' || CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE o_custkey::VARCHAR END || '/' || CASE WHEN o_orderkey % 17 = 0 THEN 'none' ELSE lpad(o_orderkey::VARCHAR, 10, '0') || '24' || lpad((o_orderkey % 1000)::VARCHAR, 6, '0') END || '/' AS filing_index_url,
    CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE o_orderpriority END AS form, 'doc' AS primary_doc_description,
    CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'Item1.HTM' ELSE 'item' || (o_orderkey % 9) || '.htm' END AS primary_document,
    'https://files.example.com/doc' AS primary_document_url, 'T' || o_custkey AS ticker, o_orderkey, o_custkey
  FROM orders
)"""


def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issuer, filing and an index document per order with lineitems; one of a single item has it bare, sizes are numbers or text."""
    # dealt out by order once, for the distinct rows, the list and the join
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    item = F.concat(
        F.lit('{"name":"'),
        F.when(F.col("l_partkey") % 97 == 0, "").otherwise(F.concat(F.when(F.col("l_partkey") % 2 == 0, F.lit("Item")).otherwise(F.lit("item")), F.col("l_linenumber").cast("string"), F.lit(".htm"))),
        F.lit('","type":"t'),
        (F.col("l_partkey") % 3).cast("string"),
        F.lit('.gif","size":'),
        F.when(F.col("l_partkey") % 5 == 0, F.lit('""')).when(F.col("l_partkey") % 5 == 1, F.concat(F.col("l_partkey").cast("string"), F.lit(".50"))).otherwise(F.concat(F.lit('"'), F.col("l_partkey").cast("string"), F.lit('"'))),
        F.lit("}"),
    )
    per = items.select("l_orderkey", item.alias("item")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    body = F.when(F.size("items") == 1, F.col("items")[0]).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    directory = F.concat(F.lit('{"directory":{"name":"/d/'), F.when(F.col("o_orderkey") % 23 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string")), F.lit('","parent-dir":"/d","item":'), body, F.lit("}}"))
    return per.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("issuer"), F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("filing"), directory.alias("json"))


ITEMS = """items AS (
  SELECT 'I' || o_custkey AS issuer, 'F' || o_orderkey AS filing, o_orderkey, o_custkey,
    CASE WHEN l_partkey % 97 = 0 THEN '' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'Item' ELSE 'item' END || l_linenumber || '.htm' END AS name,
    't' || (l_partkey % 3) || '.gif' AS type,
    CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN l_partkey || '.50' ELSE l_partkey::VARCHAR END AS size
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
)"""


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths: a metadata file per order, an index and item files where there are lineitems, a few stray files at other depths."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    unit = F.concat(F.lit("I"), F.col("o_custkey").cast("string"), F.lit("/F"), F.col("o_orderkey").cast("string"), F.lit("/"))
    n = F.col("l_linenumber")
    name = (
        F.when(n == 1, F.lit("Item1.htm")).when(n == 2, F.lit("item2.HTML")).when(n == 3, F.lit("R3.xml")).when(n == 4, F.lit("sub/pic4.jpg")).when(n == 5, F.lit("FilingSummary.xml")).when(n == 6, F.lit("MetaLinks.json")).otherwise(F.lit("notes.txt"))
    )
    meta = o.where("o_orderkey % 11 <> 0").select(F.concat(unit, F.when(F.col("o_orderkey") % 2 == 0, F.lit("metadata.json")).otherwise(F.lit("Metadata.JSON"))).alias("path"))
    index = li.select(F.concat(unit, F.lit("index.json")).alias("path")).distinct()
    stray = o.select(F.concat(F.lit("I"), F.col("o_custkey").cast("string"), F.lit("/readme.txt")).alias("path")).distinct()
    return meta.unionByName(index).unionByName(li.select(F.concat(unit, name).alias("path"))).unionByName(stray)


FILES = """li AS (
  SELECT DISTINCT o_orderkey, o_custkey, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), files AS (
  SELECT 'I' || o_custkey || '/F' || o_orderkey || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'metadata.json' ELSE 'Metadata.JSON' END AS path FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT DISTINCT 'I' || o_custkey || '/F' || o_orderkey || '/index.json' FROM li
  UNION ALL SELECT 'I' || o_custkey || '/F' || o_orderkey || '/' || CASE n WHEN 1 THEN 'Item1.htm' WHEN 2 THEN 'item2.HTML' WHEN 3 THEN 'R3.xml' WHEN 4 THEN 'sub/pic4.jpg' WHEN 5 THEN 'FilingSummary.xml' WHEN 6 THEN 'MetaLinks.json' ELSE 'notes.txt' END FROM li
  UNION ALL SELECT DISTINCT 'I' || o_custkey || '/readme.txt' FROM orders
), parts AS (
  SELECT path, split_part(path, '/', 1) AS issuer, split_part(path, '/', 2) AS filing, regexp_extract(path, '^[^/]+/[^/]+/(.+)$', 1) AS relative,
    regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext
  FROM files WHERE regexp_matches(path, '^[^/]+/[^/]+/.+')
), roles AS (
  SELECT *, CASE WHEN lower(name) = 'metadata.json' THEN 'metadata' WHEN lower(name) = 'index.json' THEN 'index' WHEN ext IN ('.htm', '.html', '.xml', '.txt') THEN 'candidate' ELSE 'companion' END AS role FROM parts
)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small corpus with contents (path, content), a unit per page: metadata, index and documents, some missing, some empty, some without an extension; a stray file per issuer."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.concat(F.lit("I"), F.col("page_id") % 7).alias("issuer"))
    k, text = F.col("page_id"), F.col("page_id").cast("string")
    name = F.when(k % 9 == 8, "page").otherwise("doc.htm")
    primary = F.when(k % 3 == 0, name).when(k % 3 == 1, "gone.htm").otherwise(" ")
    form = F.when(k % 4 == 0, "10-K").when(k % 4 == 1, " 8-K ").when(k % 4 == 2, "").otherwise("10-Q")
    meta = F.to_json(F.struct(form.alias("form"), text.alias("cik"), primary.alias("primary_document")))
    item = lambda n: F.concat(F.lit(f'{{"name":"{n}","type":"t.gif","size":'), text, F.lit("}"))
    items = F.when(k % 2 == 0, item("doc.htm")).otherwise(F.concat(F.lit("["), item("doc.htm"), F.lit(","), item("b.htm"), F.lit("]")))
    index = F.concat(F.lit('{"directory":{"name":"/d/'), text, F.lit('","parent-dir":"/d","item":'), items, F.lit("}}"))
    document = F.when(k % 10 == 3, "").when((k % 9 == 8) & (k % 2 == 0), "plain words").otherwise(F.col("html"))
    file = lambda wanted, at, content: F.when(wanted, F.struct(F.concat(F.col("issuer"), F.lit("/F"), text, F.lit("/"), at).alias("path"), content.alias("content")))
    files = F.array(
        file(k % 5 != 4, F.when(k % 2 == 0, "metadata.json").otherwise("Metadata.JSON"), meta),
        file(k % 6 != 5, F.lit("index.json"), index),
        file(k % 8 != 7, name, document),
        file(k % 3 == 1, F.lit("sub/notes.txt"), F.concat(F.lit("Accession Number "), text)),
    )
    stray = p.select(F.concat("issuer", F.lit("/readme.txt")).alias("path"), F.lit("x").alias("content")).distinct()
    return p.select(F.explode(F.array_compact(files)).alias("f")).select("f.*").unionByName(stray)


PAGE_CORPUS = """pc AS (
  SELECT page_id, 'I' || (page_id % 7) AS issuer, 'F' || page_id AS filing, page_id % 5 <> 4 AS has_meta, page_id % 6 <> 5 AS has_index, page_id % 8 <> 7 AS has_doc, page_id % 3 = 1 AS has_notes,
    CASE WHEN page_id % 2 = 0 THEN 'metadata.json' ELSE 'Metadata.JSON' END AS meta_name, CASE WHEN page_id % 9 = 8 THEN 'page' ELSE 'doc.htm' END AS doc_name,
    CASE page_id % 4 WHEN 0 THEN '10-K' WHEN 1 THEN ' 8-K ' WHEN 2 THEN '' ELSE '10-Q' END AS form,
    CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 9 = 8 THEN 'page' ELSE 'doc.htm' END WHEN 1 THEN 'gone.htm' ELSE ' ' END AS primary_document,
    CASE WHEN page_id % 10 = 3 THEN '' WHEN page_id % 9 = 8 AND page_id % 2 = 0 THEN 'plain words' ELSE html END AS content
  FROM pages
)"""


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as press-list pages: two cards each, from the page's URL and first heading; some lack a headline or a time."""
    p = table(spark, sf_dir, "pages")
    head = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    href = F.concat(F.lit("/news/"), F.regexp_replace("url", r"^https?://|[?#].*$", ""), F.lit("-"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".html"))
    time = F.when(F.col("page_id") % 4 == 0, "May 3, 2026, 08:15 ET").when(F.col("page_id") % 4 == 1, "May 13, 2026, 3:04 PM ET").when(F.col("page_id") % 4 == 2, "January 2, 2026, 11:30 AM ET").otherwise("soon")
    card = lambda link, title: F.concat(F.lit('<a class="x newsreleaseconsolidatelink y" href="'), link, F.lit('"><h3>'), title, F.lit("</h3><p>"), time, F.lit('</p></a> <a class="color-inherit">Firm</a>'))
    second = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<b>"), head, F.lit("</b> again")))
    return p.select("page_id", "url", F.concat(F.lit("<html>"), card(href, head), F.lit("<hr>"), card(F.col("url"), second), F.lit("</html>")).alias("html"))


PAGES = r"""heads AS (
  SELECT page_id, url, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS head,
    '/news/' || regexp_replace(url, '^https?://|[?#].*$', '', 'g') || '-' || lpad(page_id::VARCHAR, 9, '0') || '.html' AS href,
    CASE page_id % 4 WHEN 0 THEN TIMESTAMP '2026-05-03 00:15:00' WHEN 1 THEN TIMESTAMP '2026-05-13 15:04:00' WHEN 2 THEN TIMESTAMP '2026-01-02 11:30:00' END AS published_at
  FROM pages
), texts AS (
  SELECT *, regexp_replace(regexp_replace(head, '(?is)<[^>]+>', '', 'g'), '^[\t-\r \x{85}\x{A0}]+|[\t-\r \x{85}\x{A0}]+$', '', 'g') AS plain FROM heads
), ids AS (
  SELECT *, regexp_replace(string_split(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '^/+|/+$', '', 'g'), '-')[-1], '\.html$', '') AS piece FROM texts
), cards AS (
  SELECT page_id, 0 AS pos, plain AS headline, 'https://press.example.com' || href AS release_url, lpad(page_id::VARCHAR, 9, '0') AS release_id, published_at FROM texts WHERE plain <> ''
  UNION ALL
  SELECT page_id, 1, ltrim(regexp_replace(head, '(?is)<[^>]+>', '', 'g')) || ' again', url, CASE WHEN strlen(piece) >= 8 THEN piece ELSE url END, published_at FROM ids WHERE page_id % 3 <> 0
)"""
