"""Queries over filing corpora: inventory, histograms, joins, consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import FILING_MARKERS, INLINE_MARKERS, strip_zeros, without_dashes
from ..operators import corpus as ops
from ..operators.storage import scratch
from ..sources import corpus as src
from . import bindings as b
from .bindings import FILES, ITEMS, META, PAGE_CORPUS
from .registry import query

ESCAPED = FILES
UNITS = f"""{ESCAPED}, units AS (
  SELECT issuer, filing, max(relative) FILTER (role = 'metadata') AS metadata, max(relative) FILTER (role = 'index') AS index,
    coalesce(string_agg(relative, ',' ORDER BY relative), '') AS files, coalesce(string_agg(relative, ',' ORDER BY relative) FILTER (role = 'candidate'), '') AS candidates,
    coalesce(string_agg(relative, ',' ORDER BY relative) FILTER (role = 'companion'), '') AS companions
  FROM roles GROUP BY issuer, filing
)"""


def _parts(spark, sf_dir):
    return src.path_parts(b.corpus_files(spark, sf_dir))


def _units(spark, sf_dir):
    return src.units(_parts(spark, sf_dir))


def _meta(spark, sf_dir):
    return src.metadata(b.corpus_metadata(spark, sf_dir))


def _index(spark, sf_dir):
    return src.index_documents(b.corpus_index(spark, sf_dir))


@query("path_parts", f"WITH {FILES} SELECT path, issuer, filing, relative, name, ext FROM parts")
def _(spark, sf_dir):
    return _parts(spark, sf_dir)


@query("file_roles", f"WITH {FILES} SELECT path, role FROM roles")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).select("path", src.file_role(F.col("name"), F.col("ext")).alias("role"))


@query("primary_candidates", f"WITH {FILES} SELECT path FROM parts WHERE ext IN ('.htm', '.html', '.xml', '.txt')")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).where(src.is_candidate(F.col("ext"))).select("path")


@query("corpus_tree", "SELECT 'issuer=' || (page_id % 7) AS issuer, count(DISTINCT page_id % 21)::BIGINT AS filings, sum(octet_length(encode(html)) + 1)::BIGINT AS n_bytes FROM pages GROUP BY 1")
def _(spark, sf_dir):
    """Pages written as a tree of folders, which is then scanned."""
    root = scratch(spark)
    rows = b.table(spark, sf_dir, "pages").select(F.col("html").alias("value"), (F.col("page_id") % 7).alias("issuer"), (F.col("page_id") % 21).alias("filing"))
    rows.write.partitionBy("issuer", "filing").option("compression", "none").text(root)
    files = src.path_parts(src.tree(spark, root))
    return files.groupBy("issuer").agg(F.count_distinct("filing").alias("filings"), F.sum("length").alias("n_bytes"))


@query("corpus_units", f"WITH {UNITS} SELECT issuer, filing, metadata, index, files, candidates, companions, row_number() OVER (PARTITION BY issuer ORDER BY filing)::BIGINT AS place FROM units")
def _(spark, sf_dir):
    from pyspark.sql import Window as W

    joined = [F.array_join(c, ",").alias(c) for c in ("files", "candidates", "companions")]
    place = F.row_number().over(W.partitionBy("issuer").orderBy("filing")).cast("long").alias("place")
    return _units(spark, sf_dir).select("issuer", "filing", "metadata", "index", *joined, place)


@query(
    "corpus_totals",
    f"WITH {UNITS} SELECT count(*)::BIGINT AS units, count(metadata)::BIGINT AS with_metadata, count(index)::BIGINT AS with_index, count(*) FILTER (metadata IS NOT NULL AND index IS NOT NULL)::BIGINT AS with_both, count(*) FILTER (candidates <> '')::BIGINT AS with_candidates FROM units",
)
def _(spark, sf_dir):
    return ops.totals(_units(spark, sf_dir))


@query("corpus_by_form", f"WITH {META} SELECT form, count(*)::BIGINT AS n FROM meta WHERE trim(form) <> '' GROUP BY form")
def _(spark, sf_dir):
    return ops.by_form(_meta(spark, sf_dir))


@query("corpus_by_issuer", f"WITH {UNITS} SELECT issuer, count(*)::BIGINT AS n FROM units GROUP BY issuer")
def _(spark, sf_dir):
    return ops.by_issuer(_units(spark, sf_dir))


@query("corpus_metadata", f"WITH {META} SELECT issuer, filing, acceptance_datetime, accession_number, cik, filing_date, filing_index_url, form, primary_doc_description, primary_document, primary_document_url, ticker FROM meta")
def _(spark, sf_dir):
    return _meta(spark, sf_dir)


@query("index_items", f"WITH {ITEMS} SELECT issuer, filing, name, type, size, rank() OVER (PARTITION BY issuer, filing ORDER BY lower(name), lower(type), name, type, size)::INT - 1 AS position FROM items")
def _(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = src.index_items(_index(spark, sf_dir))
    # items of equal name and type stand in either order: the place is that among equals' first
    order = W.partitionBy("issuer", "filing").orderBy(F.lower("name"), F.lower("type"), "name", "type", "size")
    return rows.select("issuer", "filing", "name", "type", "size", (F.rank().over(order) - 1).cast("int").alias("position"))


@query("json_scalar_text", f"WITH {ITEMS} SELECT issuer, filing, name, size FROM items")
def _(spark, sf_dir):
    return src.index_items(_index(spark, sf_dir)).select("issuer", "filing", "name", "size")


@query("accession_nodash", f"WITH {META} SELECT filing, replace(accession_number, '-', '') AS plain, ltrim(cik, '0') AS cik FROM meta")
def _(spark, sf_dir):
    return _meta(spark, sf_dir).select("filing", without_dashes(F.col("accession_number")).alias("plain"), strip_zeros(F.col("cik")).alias("cik"))


BOTH = f"WITH {META}, {ITEMS}, dirs AS (SELECT DISTINCT o_orderkey, '/d/' || CASE WHEN o_orderkey % 23 = 0 THEN 'none' ELSE o_custkey::VARCHAR END AS dir_name, '/d' AS parent_dir FROM items), both_of AS (SELECT meta.*, dir_name, parent_dir FROM meta JOIN dirs USING (o_orderkey))"


def _both(spark, sf_dir):
    return _meta(spark, sf_dir).join(_index(spark, sf_dir), ["issuer", "filing"])


@query("metadata_index_join", f"{BOTH} SELECT b.issuer, b.filing, accession_number, dir_name, (SELECT count(*) FROM items i WHERE i.o_orderkey = b.o_orderkey)::BIGINT AS n FROM both_of b")
def _(spark, sf_dir):
    return _both(spark, sf_dir).select("issuer", "filing", "accession_number", "dir_name", F.size("items").cast("long").alias("n"))


def _exceptions(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").where("o_orderkey % 41 = 0").select(F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("issuer"), F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("filing"), F.lit("known").alias("reason"))


@query("qc_primary_in_index", f"{BOTH} SELECT issuer, filing FROM both_of b WHERE o_orderkey % 41 <> 0 AND NOT EXISTS (SELECT 1 FROM items i WHERE i.o_orderkey = b.o_orderkey AND lower(i.name) = lower(b.primary_document))")
def _(spark, sf_dir):
    items = src.index_items(_index(spark, sf_dir))
    return ops.primary_not_in_index(_meta(spark, sf_dir), items, _exceptions(spark, sf_dir)).select("issuer", "filing")


@query("exceptions_lookup", "SELECT 'F' || o_orderkey AS filing, CASE WHEN o_orderkey % 41 = 0 THEN 'known' WHEN o_orderkey % 43 = 0 THEN 'number' END AS reason FROM orders")
def _(spark, sf_dir):
    rows = _meta(spark, sf_dir).select("issuer", "filing", F.col("accession_number").alias("accession"))
    numbers = rows.where(F.substring("filing", 2, 20).cast("long") % 43 == 0).select("accession", F.lit("number").alias("reason"))
    return ops.exception_reasons(rows, _exceptions(spark, sf_dir), numbers).select("filing", "reason")


DISK = f"{ESCAPED}, disk AS (SELECT DISTINCT issuer, filing, lower(relative) AS name FROM parts UNION SELECT DISTINCT issuer, filing, lower(name) FROM parts)"
COVER = f"""WITH {ITEMS}, {DISK}, cov AS (
  SELECT i.issuer, i.filing, count(*) FILTER (i.name <> '' AND d.name IS NOT NULL)::BIGINT AS matches, count(*) FILTER (i.name <> '' AND d.name IS NULL)::BIGINT AS missing, count(*)::BIGINT AS total
  FROM items i LEFT JOIN disk d ON d.issuer = i.issuer AND d.filing = i.filing AND d.name = lower(i.name) GROUP BY ALL
)"""


def _coverage(spark, sf_dir):
    return ops.coverage(src.index_items(_index(spark, sf_dir)), ops.disk_names(_parts(spark, sf_dir)))


@query("qc_disk_index_coverage", f"{COVER} SELECT issuer, filing, matches, missing, total FROM cov")
def _(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query("qc_coverage_zero", f"{COVER} SELECT issuer, filing FROM cov WHERE matches = 0")
def _(spark, sf_dir):
    return _coverage(spark, sf_dir).where("matches = 0").select("issuer", "filing")


@query("qc_metadata_required", f"WITH {META} SELECT issuer, filing, unnest(list_filter([CASE WHEN trim(filing_date) = '' THEN 'filing_date' END, CASE WHEN trim(form) = '' THEN 'form' END, CASE WHEN primary_document = '' THEN 'primary_document' END], lambda x: x IS NOT NULL)) AS rule FROM meta")
def _(spark, sf_dir):
    return ops.missing_fields(_meta(spark, sf_dir))


@query("qc_index_items", f"WITH {ITEMS} SELECT DISTINCT issuer, filing, 'blank item name' AS rule FROM items WHERE name = ''")
def _(spark, sf_dir):
    return ops.bad_indexes(_index(spark, sf_dir))


@query("qc_index_sorted", "SELECT 'F' || l_orderkey AS filing FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_partkey, l_suppkey, l_linenumber) AS l FROM lineitem GROUP BY l_orderkey) WHERE l <> list_sort(l)")
def _(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))).alias("rows"))
    names = F.transform("rows", lambda r: F.struct(F.concat(F.lit("N"), r["l_linenumber"].cast("string")).alias("name")))
    units = li.select(F.lit("I").alias("issuer"), F.concat(F.lit("F"), F.col("l_orderkey").cast("string")).alias("filing"), names.alias("items"))
    return ops.unsorted_indexes(units).select("filing")


@query("qc_url_cik", f"WITH {META} SELECT issuer, filing FROM meta WHERE NOT contains(filing_index_url, ltrim(cik, '0'))")
def _(spark, sf_dir):
    return ops.url_without_cik(_meta(spark, sf_dir))


@query("qc_url_accession", f"{BOTH} SELECT issuer, filing FROM both_of WHERE NOT contains(filing_index_url, replace(accession_number, '-', '')) AND NOT contains(dir_name, replace(accession_number, '-', ''))")
def _(spark, sf_dir):
    return ops.without_accession(_both(spark, sf_dir))


@query("qc_dir_cik", f"{BOTH} SELECT issuer, filing FROM both_of WHERE ltrim(cik, '0') <> '' AND NOT contains(dir_name, ltrim(cik, '0')) AND NOT contains(parent_dir, ltrim(cik, '0'))")
def _(spark, sf_dir):
    return ops.directory_without_cik(_both(spark, sf_dir))


@query("qc_primary_on_disk", f"WITH {META}, {DISK} SELECT issuer, filing FROM meta m WHERE trim(primary_document) <> '' AND NOT EXISTS (SELECT 1 FROM disk d WHERE d.issuer = m.issuer AND d.filing = m.filing AND d.name = lower(m.primary_document))")
def _(spark, sf_dir):
    return ops.primary_not_on_disk(_meta(spark, sf_dir), ops.disk_names(_parts(spark, sf_dir))).select("issuer", "filing")


@query("qc_companions", f"WITH {DISK} SELECT issuer, filing, name FROM disk WHERE name = 'filingsummary.xml'")
def _(spark, sf_dir):
    """FilingSummary.xml counts as a candidate, so the check reports it wherever it is."""
    return ops.companions_not_listed(ops.disk_names(_parts(spark, sf_dir)), _units(spark, sf_dir))


@query("choose_primary", f"WITH {META}, {UNITS} SELECT u.issuer, u.filing, coalesce(nullif(trim(m.primary_document), ''), nullif(split_part(candidates, ',', 1), '')) AS chosen FROM units u LEFT JOIN meta m USING (issuer, filing) WHERE coalesce(nullif(trim(m.primary_document), ''), nullif(split_part(candidates, ',', 1), '')) IS NOT NULL")
def _(spark, sf_dir):
    return ops.chosen_primary(_meta(spark, sf_dir), _units(spark, sf_dir))


@query(
    "corpus_from_tree",
    f"""WITH {PAGE_CORPUS} SELECT issuer, filing, CASE WHEN has_meta THEN form END AS form, CASE WHEN has_meta THEN primary_document END AS primary_document, CASE WHEN has_index THEN '/d/' || page_id END AS dir_name,
    CASE WHEN has_index THEN 1 + page_id % 2 ELSE 0 END::BIGINT AS items, CASE WHEN has_index THEN page_id::VARCHAR END AS size,
    array_to_string(list_sort(list_filter([CASE WHEN has_meta THEN meta_name END, CASE WHEN has_index THEN 'index.json' END, CASE WHEN has_doc AND content <> '' THEN doc_name END, CASE WHEN has_notes THEN 'sub/notes.txt' END], lambda x: x IS NOT NULL)), ',') AS files,
    CASE WHEN has_doc AND content <> '' THEN octet_length(encode(content)) END::BIGINT AS doc_bytes
    FROM pc WHERE has_meta OR has_index OR has_notes OR (has_doc AND content <> '')""",
)
def _(spark, sf_dir):
    """Files written as a tree, then the corpus read from it: units, metadata, index items and document sizes."""
    root = scratch(spark)
    src.write_tree(b.page_files(spark, sf_dir), root)
    corpus = src.from_tree(spark, root)
    unit = ["issuer", "filing"]
    meta = corpus.metadata.select(*unit, "form", "primary_document")
    index = corpus.indexes.select(*unit, "dir_name", F.size("items").cast("long").alias("items"), F.col("items")[0]["size"].alias("size"))
    sizes = corpus.files.where(F.col("relative").isin("doc.htm", "page")).select(*unit, F.col("length").alias("doc_bytes"))
    rows = corpus.units.select(*unit, F.array_join("files", ",").alias("files")).join(meta, unit, "left").join(index, unit, "left").join(sizes, unit, "left")
    return rows.select(*unit, "form", "primary_document", "dir_name", F.coalesce("items", F.lit(0)).cast("long").alias("items"), "size", "files", "doc_bytes")


MAP = lambda keys, n="n": f"coalesce(string_agg({keys} || '=' || {n}, ',' ORDER BY {keys}), '')"
ANY = lambda markers: "(" + " OR ".join(f"contains(lower(content), '{m}')" for m in markers) + ")"
PAGE_KIND = "CASE WHEN doc_name = 'doc.htm' THEN 'html' WHEN contains(lower(content), '<html') THEN 'html' WHEN regexp_matches(lower(content), '^\\s*(<\\?xml|<xbrl)') THEN 'xml' WHEN contains(lower(content), 'accession number') THEN 'text' ELSE 'unknown' END"


@query(
    "corpus_summary",
    f"""WITH {PAGE_CORPUS}, candidates AS (
      SELECT doc_name AS name, content FROM pc WHERE has_doc AND doc_name = 'doc.htm' UNION ALL SELECT 'notes.txt', 'Accession Number ' || page_id FROM pc WHERE has_notes
    ), classes AS (
      SELECT CASE WHEN name = 'doc.htm' THEN 'html' ELSE 'text' END AS class FROM candidates
      UNION ALL SELECT 'likely_inline_xbrl' FROM candidates WHERE {ANY(INLINE_MARKERS)} UNION ALL SELECT 'likely_filing_document' FROM candidates WHERE {ANY(FILING_MARKERS)}
    ), units AS (SELECT *, (has_doc AND doc_name = 'doc.htm') OR has_notes AS has_candidates FROM pc WHERE has_meta OR has_index OR has_doc OR has_notes)
    SELECT (SELECT count(*) FROM units)::BIGINT AS units, (SELECT count(*) FROM units WHERE has_meta)::BIGINT AS with_metadata, (SELECT count(*) FROM units WHERE has_index)::BIGINT AS with_index,
      (SELECT count(*) FROM units WHERE has_meta AND has_index)::BIGINT AS with_both, (SELECT count(*) FROM units WHERE has_candidates)::BIGINT AS with_candidates,
      (SELECT {MAP('form')} FROM (SELECT trim(form) AS form, count(*) AS n FROM units WHERE has_meta AND trim(form) <> '' GROUP BY 1)) AS forms,
      (SELECT {MAP('issuer')} FROM (SELECT issuer, count(*) AS n FROM units GROUP BY 1)) AS by_issuer, (SELECT {MAP('class')} FROM (SELECT class, count(*) AS n FROM classes GROUP BY 1)) AS by_class""",
)
def _(spark, sf_dir):
    files = src.path_parts(b.page_files(spark, sf_dir))
    units = src.units(files)
    meta = src.metadata(src.lookup(units, "metadata", files).select("issuer", "filing", F.col("content").alias("json")))
    found = ops.summary(units, meta, files.where(src.file_role(F.col("name"), F.col("ext")) == "candidate"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return found.select("units", "with_metadata", "with_index", "with_both", "with_candidates", *map(text, ("forms", "by_issuer", "by_class")))


@query(
    "qc_primary_classified",
    f"""WITH {PAGE_CORPUS}, chosen AS (
      SELECT *, CASE WHEN has_meta AND trim(primary_document) <> '' THEN primary_document WHEN has_doc AND doc_name = 'doc.htm' THEN 'doc.htm' WHEN has_notes THEN 'sub/notes.txt' END AS chosen FROM pc
    ), found AS (
      SELECT issuer, filing, chosen, CASE WHEN chosen = doc_name AND has_doc THEN content WHEN chosen = 'sub/notes.txt' THEN 'Accession Number ' || page_id END AS content, doc_name FROM chosen WHERE chosen IS NOT NULL
    ), kinds AS (SELECT *, CASE WHEN content <> '' THEN CASE WHEN chosen = 'sub/notes.txt' THEN 'text' ELSE {PAGE_KIND} END END AS kind FROM found)
    SELECT issuer, filing, chosen, octet_length(encode(content))::BIGINT AS n_bytes, kind, CASE WHEN content <> '' THEN {ANY(INLINE_MARKERS)} END AS inline_xbrl, CASE WHEN content <> '' THEN {ANY(FILING_MARKERS)} END AS filing_like,
      CASE WHEN content IS NULL THEN 'missing' WHEN content = '' THEN 'empty' WHEN kind = 'unknown' THEN 'unclassified' END AS problem FROM kinds""",
)
def _(spark, sf_dir):
    """Each unit's primary document, looked up, sized and classified."""
    files = src.path_parts(b.page_files(spark, sf_dir))
    units = src.units(files)
    meta = src.metadata(src.lookup(units, "metadata", files).select("issuer", "filing", F.col("content").alias("json")))
    return ops.classified_primary(ops.chosen_primary(meta, units), files)


@query("corpus_determinism", f"WITH {UNITS} SELECT count(*)::BIGINT AS units, 0::BIGINT AS differing FROM units")
def _(spark, sf_dir):
    """Two discoveries of the same files, dealt out differently, agree."""
    files = b.corpus_files(spark, sf_dir)
    one, two = (src.units(src.path_parts(f)) for f in (files, files.repartition("path")))
    return ops.discoveries_compared(one, two)
