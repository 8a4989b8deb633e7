"""Queries over pages and documents: cleaning, press releases, classification, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import corpus, press, signals
from ..sources import press as cards
from . import bindings as b
from .bindings import LOG, PAGES, now
from .registry import query

TRIM = r"'^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$'"
BASE = "https://press.example.com"
CAP = 3000


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {TRIM}, '', 'g')"


def _clean(x: str) -> str:
    for p in (t.SCRIPT_STYLE, t.NAMESPACE_TAGS, t.ALL_TAGS):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return _trim(rf"regexp_replace({_entities(x)}, '[\t\n\f\r ]+', ' ', 'g')")


def _entities(x: str) -> str:
    for e, plain in t.ENTITIES:
        quoted = plain.replace("'", "''")
        x = f"replace({x}, '{e}', '{quoted}')"
    return x


def _pages(spark, sf_dir):
    return b.table(spark, sf_dir, "pages")


@query("trim_unicode", f"SELECT doc_id, {_trim('chr(160) || chr(8195) || text || chr(12288) || chr(10)')} AS text FROM documents")
def _(spark, sf_dir):
    padded = F.concat(F.lit("  "), "text", F.lit("　\n"))
    return b.table(spark, sf_dir, "documents").select("doc_id", t.trim_unicode(padded).alias("text"))


@query("clean_text", f"SELECT page_id, {_clean('html')} AS text FROM pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", t.clean_text(F.col("html")).alias("text"))


@query("decode_entities", f"SELECT page_id, md5({_entities('html')}) AS digest FROM pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(t.decode_entities(F.col("html")).cast("binary")).alias("digest"))


@query("first_text", f"SELECT page_id, {_trim(chr(39).join(['regexp_replace(regexp_extract(html, ', '(?is)<h1[^>]*>(.*?)</h1>', ', 1), ', '(?is)<[^>]+>', ', ', '', ', ', 'g', ')']))} AS text FROM pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", t.first_text(F.col("html"), r"(?is)<h1[^>]*>(.*?)</h1>").alias("text"))


#: The links of a page, here in place of a list page's cards.
ANCHOR = r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
LINKS = r"""links AS (
  SELECT page_id, unnest(range(0, len(h))) AS pos, unnest(h) AS href, unnest(x) AS block
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2) AS x FROM pages)
)"""


@query("page_links", f"WITH {LINKS} SELECT page_id, pos::INT AS pos, href, block FROM links")
def _(spark, sf_dir):
    return cards.matches(_pages(spark, sf_dir), ANCHOR).select("page_id", "pos", "href", "block")


@query(
    "resolve_url",
    f"""WITH {LINKS}, h AS (
      SELECT page_id, pos, CASE pos % 6 WHEN 0 THEN href WHEN 1 THEN ltrim(href, '/') WHEN 2 THEN '/a/../b/.' || href WHEN 3 THEN '//cdn.example.com' || href WHEN 4 THEN '?q=' || pos ELSE 'http://other.example.com' || href END AS href, href AS raw FROM links)
    SELECT page_id, pos::INT AS pos, CASE pos % 6 WHEN 2 THEN '{BASE}/b/' || ltrim(raw, '/') WHEN 3 THEN 'https:' || href WHEN 5 THEN href WHEN 4 THEN '{BASE}' || href ELSE '{BASE}/' || ltrim(href, '/') END AS url FROM h""",
)
def _(spark, sf_dir):
    links = cards.matches(_pages(spark, sf_dir), ANCHOR)
    k = F.col("pos") % 6
    bare = F.regexp_replace("href", "^/+", "")
    href = (
        F.when(k == 0, F.col("href")).when(k == 1, bare).when(k == 2, F.concat(F.lit("/a/../b/./"), bare)).when(k == 3, F.concat(F.lit("//cdn.example.com"), "href")).when(k == 4, F.concat(F.lit("?q="), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("http://other.example.com"), "href"))
    )
    return links.select("page_id", "pos", t.resolve_url(F.lit(BASE), href).alias("url"))


@query("extract_pr_id", "SELECT page_id, lpad(page_id::VARCHAR, 9, '0') AS release_id, '' AS short FROM pages")
def _(spark, sf_dir):
    bare = F.regexp_replace("url", "[?#].*$", "")
    long = F.concat(bare, F.lit("-"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".html?x=1"))
    return _pages(spark, sf_dir).select("page_id", t.extract_release_id(long).alias("release_id"), t.extract_release_id(F.concat(bare, F.lit("-1234567.html"))).alias("short"))


@query(
    "parse_pr_time",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + to_minutes((o_orderkey % 60)::INT), '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(o_orderdate + to_minutes((o_orderkey % 1440)::INT), '%Y-%m-%d %H:%M')
    WHEN 2 THEN strftime(o_orderdate + to_minutes((o_orderkey % 1440)::INT), '%Y-%m-%d %H:%M') END AS at FROM orders""",
)
def _(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    minute = F.when(k == 0, F.col("o_orderkey") % 60).otherwise(F.col("o_orderkey") % 1440)
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=minute.cast("int"))
    text = F.when(k == 0, F.date_format(at, "MMM d, yyyy, '08':mm 'ET'")).when(k == 1, F.date_format(at, "MMM d, yyyy,' 'h:mm a 'ET'")).when(k == 2, F.date_format(at, "MMMM d, yyyy, h:mm a 'ET'")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    return o.select("o_orderkey", F.date_format(t.parse_release_time(text), "yyyy-MM-dd HH:mm").alias("at"))


RELEASES = f"WITH {PAGES}"
AT = "strftime(published_at, '%Y-%m-%dT%H:%M:%SZ')"


def _releases(spark, sf_dir):
    return cards.press_cards(b.list_pages(spark, sf_dir), F.lit(BASE))


@query("pr_cards", f"{RELEASES} SELECT page_id, headline, release_url, release_id, '' AS company, {AT} AS published_at FROM cards")
def _(spark, sf_dir):
    return _releases(spark, sf_dir).select("page_id", "headline", "release_url", "release_id", "company", t.rfc3339(F.col("published_at")).alias("published_at"))


def _release_log(spark, sf_dir):
    """Discovery events of the releases of every other page, half of them keyed by URL alone."""
    old = press.release_events(_releases(spark, sf_dir).where("page_id % 2 = 0"), now())
    return old.withColumn("aggregate_key", F.when(F.col("aggregate_key").startswith("http"), "").otherwise(F.col("aggregate_key")))


@query("pr_new", f"{RELEASES} SELECT release_id, headline FROM cards WHERE release_id NOT IN (SELECT release_id FROM cards WHERE page_id % 2 = 0)")
def _(spark, sf_dir):
    return press.new_releases(_releases(spark, sf_dir), _release_log(spark, sf_dir)).select("release_id", "headline")


@query("pr_events", f"{RELEASES} SELECT 'pr_discovered:' || release_id AS id, headline, release_url AS url, {AT} AS published_at FROM cards")
def _(spark, sf_dir):
    p = F.from_json("data", press.RELEASE)
    return press.release_events(_releases(spark, sf_dir), now()).select("id", p["headline"].alias("headline"), p["url"].alias("url"), p["published_at"].alias("published_at"))


@query(
    "pr_summary",
    f"""{RELEASES}, f AS (SELECT *, release_id IN (SELECT release_id FROM cards WHERE page_id % 2 = 0) AS old, row_number() OVER (PARTITION BY release_id ORDER BY page_id, pos) AS nth FROM cards)
    SELECT count(*) FILTER (old OR nth > 1)::BIGINT AS seen, count(*) FILTER (NOT old AND nth = 1)::BIGINT AS discovered FROM f""",
)
def _(spark, sf_dir):
    from ..operators.event_log import first_in_batch, parts_of

    seen = press.seen_releases(_release_log(spark, sf_dir), "pr_discovered").withColumn("old", F.lit(True))
    releases = _releases(spark, sf_dir)
    marked = first_in_batch(releases, ["release_id"], "page_id", "pos", partitions=parts_of(releases)).join(seen, "release_id", "left")
    return press.summary(marked.withColumn("fresh", F.col("old").isNull() & (F.col("nth") == 1)))


@query("doc_size_guard", f"SELECT page_id, octet_length(encode(html))::BIGINT AS n_bytes, octet_length(encode(html)) > {CAP} AS too_large FROM pages")
def _(spark, sf_dir):
    return cards.guarded(_pages(spark, sf_dir), max_bytes=CAP).select("page_id", F.col("n_bytes").cast("long").alias("n_bytes"), F.col("error").isNotNull().alias("too_large"))


@query("fetch_join", f"SELECT doc_id, CASE WHEN page_id IS NULL THEN 'document missing' END AS error, coalesce(length({_clean('html')}), 0)::BIGINT AS n FROM labels LEFT JOIN pages ON page_id = doc_id")
def _(spark, sf_dir):
    wanted = b.table(spark, sf_dir, "labels").select("doc_id")
    got = cards.guarded(press.fetched(wanted, _pages(spark, sf_dir).withColumnRenamed("page_id", "doc_id"), "doc_id"))
    return got.select("doc_id", "error", F.coalesce(F.length("clean"), F.lit(0)).cast("long").alias("n"))


def _outcomes(spark, sf_dir):
    """Releases with their pages' contents, a third of them missing."""
    releases = _releases(spark, sf_dir).drop("html")
    contents = _pages(spark, sf_dir).where("page_id % 3 <> 1").select("page_id", "html")
    return cards.guarded(press.fetched(releases, contents, "page_id"), max_bytes=CAP)


@query(
    "body_events",
    f"""{RELEASES} SELECT CASE WHEN ok THEN 'pr_body_fetched:' ELSE 'pr_body_failed:' END || release_id AS id, CASE WHEN ok THEN {_clean('html')} END AS body,
    CASE WHEN page_id % 3 = 1 THEN 'document missing' WHEN NOT ok THEN 'document too large: ' || octet_length(encode(html)) || ' bytes > {CAP}' END AS error
    FROM (SELECT cards.*, html, page_id % 3 <> 1 AND octet_length(encode(html)) <= {CAP} AS ok FROM cards JOIN pages USING (page_id))""",
)
def _(spark, sf_dir):
    events = press.body_events(_outcomes(spark, sf_dir), now())
    return events.select("id", F.get_json_object("data", "$.body").alias("body"), F.get_json_object("data", "$.error").alias("error"))


PENDING = "aggregate_key || ':' || strftime(occurred_at, '%Y-%m-%d')"


@query("body_pending", f"WITH {LOG}, k AS (SELECT type, {PENDING} AS release_id FROM log) SELECT DISTINCT release_id FROM k WHERE type = 'pr_discovered' AND release_id NOT IN (SELECT release_id FROM k WHERE type IN ('pr_body_fetched', 'pr_body_failed'))")
def _(spark, sf_dir):
    key = F.concat("aggregate_key", F.lit(":"), F.date_format("occurred_at", "yyyy-MM-dd"))
    daily = b.log(spark, sf_dir).withColumn("aggregate_key", key)
    releases = daily.where("type = 'pr_discovered'").select(F.col("aggregate_key").alias("release_id")).distinct()
    return press.pending_bodies(releases, daily)


KINDS = """docs AS (
  SELECT page_id AS id, CASE page_id % 8 WHEN 0 THEN 'a/b.HTM' WHEN 1 THEN 'x.xsd' WHEN 2 THEN 'x.TXT' WHEN 7 THEN 'MetaLinks.json' ELSE 'page' END AS name, CASE page_id % 5 WHEN 0 THEN '<p>XMLNS:IX Form 10-K' ELSE '' END || html AS content FROM pages
  UNION ALL SELECT doc_id + 1000000, CASE doc_id % 4 WHEN 0 THEN 'FilingSummary.xml' ELSE 'doc' END, CASE doc_id % 5 WHEN 0 THEN ' <?xml x' WHEN 1 THEN ' <XBRL' WHEN 2 THEN 'Accession Number' ELSE '' END || text FROM documents
), low AS (SELECT *, lower(content) AS c, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) AS ext FROM docs)"""


def _contents(spark, sf_dir):
    p, d = _pages(spark, sf_dir), b.table(spark, sf_dir, "documents")
    k, j = F.col("page_id") % 8, F.col("doc_id") % 5
    one = p.select(
        F.col("page_id").alias("id"),
        F.when(k == 0, "a/b.HTM").when(k == 1, "x.xsd").when(k == 2, "x.TXT").when(k == 7, "MetaLinks.json").otherwise("page").alias("name"),
        F.concat(F.when(F.col("page_id") % 5 == 0, "<p>XMLNS:IX Form 10-K").otherwise(""), "html").alias("content"),
    )
    two = d.select(
        (F.col("doc_id") + 1000000).alias("id"),
        F.when(F.col("doc_id") % 4 == 0, "FilingSummary.xml").otherwise("doc").alias("name"),
        F.concat(F.when(j == 0, " <?xml x").when(j == 1, " <XBRL").when(j == 2, "Accession Number").otherwise(""), "text").alias("content"),
    )
    return one.unionByName(two)


KIND = f"CASE WHEN ext IN ('.htm', '.html') THEN 'html' WHEN ext IN ('.xml', '.xsd') THEN 'xml' WHEN ext = '.txt' THEN 'text' WHEN contains(c, '<html') THEN 'html' WHEN starts_with({_trim('c')}, '<?xml') OR starts_with({_trim('c')}, '<xbrl') THEN 'xml' WHEN contains(c, 'accession number') THEN 'text' ELSE 'unknown' END"
INLINE = "(" + " OR ".join(f"contains(c, '{m}')" for m in t.INLINE_MARKERS) + ")"
FILING = "(" + " OR ".join(f"contains(c, '{m}')" for m in t.FILING_MARKERS) + ")"


@query("doc_kind", f"WITH {KINDS} SELECT id, {KIND} AS kind FROM low")
def _(spark, sf_dir):
    return _contents(spark, sf_dir).select("id", t.document_kind(F.col("name"), F.col("content")).alias("kind"))


@query("doc_flags", f"WITH {KINDS} SELECT id, {INLINE} AS inline_xbrl, {FILING} AS filing_like FROM low")
def _(spark, sf_dir):
    return _contents(spark, sf_dir).select("id", t.contains_any(F.col("content"), t.INLINE_MARKERS).alias("inline_xbrl"), t.contains_any(F.col("content"), t.FILING_MARKERS).alias("filing_like"))


@query(
    "corpus_by_doc_class",
    f"""WITH {KINDS}, k AS (SELECT {KIND} AS class FROM low UNION ALL SELECT 'likely_inline_xbrl' FROM low WHERE {INLINE} UNION ALL SELECT 'likely_filing_document' FROM low WHERE {FILING}
    UNION ALL SELECT 'interesting_companion_primary_candidate' FROM low WHERE lower(name) IN ('filingsummary.xml', 'metalink.json', 'metallinks.json')) SELECT class, count(*)::BIGINT AS n FROM k GROUP BY class""",
)
def _(spark, sf_dir):
    return corpus.by_class(_contents(spark, sf_dir))


@query("doc_sizes", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, text = '' AS empty FROM documents")
def _(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), (F.col("text") == "").alias("empty"))


@query("source_kind", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 THEN 'sec_8k' ELSE 'press_release' END AS kind FROM orders")
def _(spark, sf_dir):
    form = F.when(F.col("o_orderkey") % 3 == 0, "8-k/A").when(F.col("o_orderkey") % 3 == 1, "Form 8-K").otherwise(F.col("o_orderpriority"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", signals.source_kind(form).alias("kind"))


def _analysed(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    form = F.when(F.col("doc_id") % 2 == 0, "8-K").otherwise("10-Q")
    keyed = d.withColumns({"form": form, "ticker": F.col("source"), "cik": F.lpad(F.col("doc_id").cast("string"), 10, "0"), "accession": F.col("doc_id").cast("string")})
    identity = t.filing_identity(F.col("cik"), F.col("accession"))
    guarded = cards.guarded(keyed.withColumn("identity", identity), "text", 20_000)
    return signals.stub(guarded, signals.analyzer_input(F.col("form"), F.col("clean")))


ANALYSED = f"""a AS (
  SELECT doc_id, source AS ticker, lpad(doc_id::VARCHAR, 10, '0') || ':' || doc_id AS identity, octet_length(encode(text)) > 20000 AS failed,
    'Input length: ' || octet_length(encode('source_type=' || CASE WHEN doc_id % 2 = 0 THEN 'sec_8k' ELSE 'press_release' END || chr(10) || 'form=' || CASE WHEN doc_id % 2 = 0 THEN '8-K' ELSE '10-Q' END || chr(10) || chr(10) || {_clean('text')})) || ' chars' AS impact
  FROM documents
)"""


@query("signal_stub", f"WITH {ANALYSED} SELECT doc_id, 'Other' AS signal_type, 5 AS importance, impact AS impact_analysis, 'stub' AS provider FROM a WHERE NOT failed")
def _(spark, sf_dir):
    return _analysed(spark, sf_dir).where("error is null").select("doc_id", "signal_type", "importance", "impact_analysis", F.col("raw_metadata")["provider"].alias("provider"))


@query("signal_events", f"WITH {ANALYSED} SELECT CASE WHEN failed THEN 'signal_failed:' ELSE 'signal_generated:' END || identity AS id, CASE WHEN NOT failed THEN impact END AS impact, ticker, CASE WHEN NOT failed THEN 'signal:' || identity END AS signal_id FROM a")
def _(spark, sf_dir):
    rows = signals.with_defaults(_analysed(spark, sf_dir), F.col("identity"), F.col("ticker"), now())
    field = lambda f: F.get_json_object("data", f"$.{f}")
    return signals.signal_events(rows, now()).select("id", field("impact_analysis").alias("impact"), field("ticker").alias("ticker"), field("id").alias("signal_id"))


@query("signal_defaults", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'signal:' || doc_id ELSE 'own' END AS signal_id, CASE WHEN quality = 1 THEN 'Q' ELSE 'T' || doc_id END AS signal_ticker, CASE WHEN doc_id % 3 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS day FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left")
    raw = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise("own").alias("signal_id"), F.when(F.col("quality") == 1, "Q").alias("signal_ticker"), F.when(F.col("doc_id") % 3 != 0, F.lit("2024-01-01").cast("timestamp")).alias("signal_timestamp"))
    key = F.col("doc_id").cast("string")
    return signals.with_defaults(raw, key, F.concat(F.lit("T"), key), now()).select("doc_id", "signal_id", "signal_ticker", F.date_format("signal_timestamp", "yyyy-MM-dd").alias("day"))


@query(
    "signal_validate",
    """SELECT doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'signal_type' END, CASE WHEN doc_id % 12 NOT BETWEEN 1 AND 10 THEN 'importance' END, CASE WHEN (doc_id % 5) - 2.0 NOT BETWEEN -1 AND 1 THEN 'sentiment' END) AS violations
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.withColumns({"signal_type": F.when(F.col("quality") == 1, "Earnings").when(F.col("quality") == 0, "Legal"), "importance": (F.col("doc_id") % 12).cast("int"), "sentiment": (F.col("doc_id") % 5) - 2.0})
    return rows.select("doc_id", signals.violations().alias("violations"))


@query("signal_pending", f"WITH {LOG} SELECT DISTINCT aggregate_key AS identity FROM log WHERE type = 'filing_discovered' AND aggregate_key NOT IN (SELECT aggregate_key FROM log WHERE type = 'press_note' AND aggregate_key::BIGINT % 3 = 0)")
def _(spark, sf_dir):
    log = b.log(spark, sf_dir)
    done = log.withColumn("type", F.when((F.col("type") == "press_note") & (F.col("aggregate_key").cast("long") % 3 == 0), "signal_generated").otherwise(F.col("type")))
    wanted = log.where("type = 'filing_discovered'").select(F.col("aggregate_key").alias("identity")).distinct()
    return signals.pending(wanted, done)


def _by_length(text: str) -> dict:
    if len(text) < 100:
        raise ValueError("too short")
    return {"signal_type": "Other", "importance": min(10, 1 + len(text) // 1000), "sentiment": 0.0, "summary": text[:20]}


@query("analyze_custom", "SELECT doc_id, CASE WHEN length(text) >= 100 THEN least(10, 1 + length(text) // 1000)::INT END AS importance, CASE WHEN length(text) < 100 THEN 'too short' END AS error FROM documents")
def _(spark, sf_dir):
    return signals.custom(b.table(spark, sf_dir, "documents"), "doc_id", "text", _by_length).select("doc_id", "importance", "error")
