"""Filing corpora: totals, histograms, joins of metadata, index and disk, consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FILING_MARKERS, INLINE_MARKERS, base_name, kind_of_lowered, lowered_contains_any, strip_zeros, trim_unicode, without_dashes

# fixed values: the companions of interest, and the metadata fields that must be filled
COMPANIONS = ("filingsummary.xml", "metalink.json", "metallinks.json")
REQUIRED = ("accession_number", "cik", "filing_date", "form", "ticker", "primary_document", "filing_index_url", "primary_document_url")
UNIT = ["issuer", "filing"]


def totals(units: DataFrame) -> DataFrame:
    has = lambda c: F.col(c).isNotNull().cast("long")
    both = (F.col("metadata").isNotNull() & F.col("index").isNotNull()).cast("long")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return units.agg(F.count(F.lit(1)).alias("units"), zero(has("metadata")).alias("with_metadata"), zero(has("index")).alias("with_index"), zero(both).alias("with_both"), zero((F.size("candidates") > 0).cast("long")).alias("with_candidates"))


def discoveries_compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: the units of one, and how many rows of either the other lacks. Both have a row per unit, by which they meet where they are."""
    said = [c for c in one.columns if c not in UNIT]
    side = lambda df, name: df.select(*UNIT, F.struct(*said).alias(name))
    met = side(one, "a").join(side(two, "b"), UNIT, "full")
    has = lambda c: F.col(c).isNotNull().cast("long")
    lacking = F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(has("a") + has("b"))
    return met.agg(F.coalesce(F.sum(has("a")), F.lit(0)).alias("units"), F.coalesce(F.sum(lacking), F.lit(0)).alias("differing"))


def by_form(metadata: DataFrame) -> DataFrame:
    form = trim_unicode(F.coalesce("form", F.lit("")))
    return metadata.select(form.alias("form")).where("form <> ''").groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def by_issuer(units: DataFrame) -> DataFrame:
    return units.groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))


def _classes(documents: DataFrame, name: str, content: str) -> DataFrame:
    """A row for each class of each document; one has several: its kind, its flags, and whether it is a companion of interest."""
    # lowered in a projection of its own, once for all that looks at it
    low = documents.select(F.col(name).alias("name"), F.lower(content).alias("low"))
    classes = F.array_compact(
        F.array(
            kind_of_lowered(F.col("name"), F.col("low")),
            F.when(lowered_contains_any(F.col("low"), INLINE_MARKERS), "likely_inline_xbrl"),
            F.when(lowered_contains_any(F.col("low"), FILING_MARKERS), "likely_filing_document"),
            F.when(F.lower(base_name(F.col("name"))).isin(*COMPANIONS), "interesting_companion_primary_candidate"),
        )
    )
    return low.select(F.explode(classes).alias("class"))


def by_class(documents: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Documents by class."""
    return _classes(documents, name, content).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def summary(units: DataFrame, metadata: DataFrame, documents: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """One row: five counters and three maps, by form, issuer and document class.

    Everything counted is a (what, key) pair; pairs of all inputs are counted together, partly
    before the shuffle, and the few sums become the row. Maps have their keys in order.
    """
    pair = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"))
    none = F.lit("")
    has_both = F.col("metadata").isNotNull() & F.col("index").isNotNull()
    of_unit = F.array_compact(
        F.array(
            pair("units", none),
            F.when(F.col("metadata").isNotNull(), pair("with_metadata", none)),
            F.when(F.col("index").isNotNull(), pair("with_index", none)),
            F.when(has_both, pair("with_both", none)),
            F.when(F.size("candidates") > 0, pair("with_candidates", none)),
            pair("by_issuer", F.col("issuer")),
        )
    )
    form = trim_unicode(F.coalesce("form", F.lit("")))
    seen = units.select(F.explode(of_unit).alias("p")).unionAll(metadata.where(form != "").select(pair("forms", form).alias("p"))).unionAll(_classes(documents, name, content).select(pair("by_class", F.col("class")).alias("p")))
    counts = seen.groupBy("p.what", "p.key").agg(F.count(F.lit(1)).alias("n"))
    counter = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
    table = lambda what: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("key", "n"))))).alias(what)
    return counts.agg(*map(counter, ("units", "with_metadata", "with_index", "with_both", "with_candidates")), *map(table, ("forms", "by_issuer", "by_class")))


def missing_fields(metadata: DataFrame) -> DataFrame:
    rules = F.array_compact(F.array(*[F.when(trim_unicode(F.coalesce(f, F.lit(""))) == "", f) for f in REQUIRED]))
    return metadata.select(*UNIT, F.explode(rules).alias("rule"))


def bad_indexes(parsed: DataFrame) -> DataFrame:
    """Empty indexes and blank item names, a row per violation."""
    empty = F.when(F.coalesce(F.size("items"), F.lit(0)) <= 0, "empty index")
    nameless = F.when(F.exists(F.coalesce("items", F.array().cast("array<struct<name:string,type:string,size:string,last_modified:string>>")), lambda i: trim_unicode(i["name"]) == ""), "blank item name")
    return parsed.select(*UNIT, F.explode(F.array_compact(F.array(empty, nameless))).alias("rule"))


def unsorted_indexes(parsed: DataFrame, items: str = "items") -> DataFrame:
    names = F.transform(items, lambda i: F.lower(i["name"]))
    return parsed.where(names != F.array_sort(names)).select(*UNIT)


def primary_not_in_index(metadata: DataFrame, items: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Units with an index whose metadata names a primary document that the index lacks; known exceptions don't count."""
    wanted = metadata.select(*UNIT, F.lower(trim_unicode(F.coalesce("primary_document", F.lit("")))).alias("name"))
    # items are gone through once: each unit's names in a set
    listed = items.groupBy(*UNIT).agg(F.collect_set(F.lower("name")).alias("names"))
    return wanted.join(listed, UNIT).where(~F.array_contains("names", F.col("name"))).select(*wanted.columns).join(exceptions, UNIT, "left_anti")


def disk_names(files: DataFrame) -> DataFrame:
    """Lower-case relative paths and base names of each unit's files."""
    return files.select(*UNIT, F.explode(F.array_distinct(F.array(F.lower("relative"), F.lower("name")))).alias("name")).distinct()


def coverage(items: DataFrame, disk: DataFrame) -> DataFrame:
    """Per unit: index items found on disk, missing, and all; blank names are neither."""
    marked = items.select(*UNIT, F.lower("name").alias("name"), (trim_unicode(F.col("name")) != "").alias("named")).join(disk.withColumn("here", F.lit(True)), [*UNIT, "name"], "left")
    here = F.col("here").isNotNull()
    return marked.groupBy(*UNIT).agg(F.sum((F.col("named") & here).cast("long")).alias("matches"), F.sum((F.col("named") & ~here).cast("long")).alias("missing"), F.count(F.lit(1)).alias("total"))


def primary_not_on_disk(metadata: DataFrame, disk: DataFrame) -> DataFrame:
    wanted = metadata.where(trim_unicode(F.coalesce("primary_document", F.lit(""))) != "").select(*UNIT, F.lower("primary_document").alias("name"))
    return wanted.join(disk, [*UNIT, "name"], "left_anti")


def companions_not_listed(disk: DataFrame, units: DataFrame) -> DataFrame:
    """Companions of interest that are on disk but not among the unit's companions."""
    there = disk.where(F.col("name").isin(*COMPANIONS))
    listed = units.select(*UNIT, F.explode("companions").alias("c")).select(*UNIT, F.lower(base_name(F.col("c"))).alias("name")).distinct()
    return there.join(listed, [*UNIT, "name"], "left_anti")


def url_without_cik(metadata: DataFrame) -> DataFrame:
    return metadata.where(~F.lower("filing_index_url").contains(F.lower(strip_zeros(F.col("cik"))))).select(*UNIT)


def without_accession(both: DataFrame) -> DataFrame:
    plain = without_dashes(F.col("accession_number"))
    places = [F.lower(c).contains(plain) for c in ("filing_index_url", "dir_name", "parent_dir")]
    return both.where(~(places[0] | places[1] | places[2])).select(*UNIT)


def directory_without_cik(both: DataFrame) -> DataFrame:
    cik = strip_zeros(F.lower("cik"))
    return both.where((cik != "") & ~F.lower("dir_name").contains(cik) & ~F.lower("parent_dir").contains(cik)).select(*UNIT)


def chosen_primary(metadata: DataFrame, units: DataFrame) -> DataFrame:
    """Each unit's primary document: the metadata's, else the first candidate, else none."""
    named = F.when(trim_unicode(F.coalesce("primary_document", F.lit(""))) != "", F.col("primary_document"))
    rows = units.join(metadata.select(*UNIT, named.alias("named")), UNIT, "left")
    return rows.select(*UNIT, F.coalesce("named", F.try_element_at("candidates", F.lit(1))).alias("chosen")).where("chosen is not null")


def classified_primary(chosen: DataFrame, documents: DataFrame, *, unknown_counts: bool = True) -> DataFrame:
    """Of each unit's primary document: n_bytes, kind, inline_xbrl, filing_like, and a `problem`.

    The chosen path (below the unit) is looked up among documents (issuer, filing, relative,
    content). Problems are `missing`, `empty`, and `unclassified`: a kind of `unknown`, unless
    `unknown_counts` is off, with which it is a kind like others.
    """
    named = chosen.select(*UNIT, "chosen").join(documents.select(*UNIT, F.col("relative").alias("chosen"), "content"), [*UNIT, "chosen"], "left")
    low = named.select(*UNIT, "chosen", F.octet_length("content").cast("long").alias("n_bytes"), F.lower("content").alias("low"))
    there = F.col("n_bytes") > 0
    kind = F.when(there, kind_of_lowered(F.col("chosen"), F.col("low")))
    flag = lambda markers: F.when(there, lowered_contains_any(F.col("low"), markers))
    problem = F.when(F.col("n_bytes").isNull(), "missing").when(F.col("n_bytes") == 0, "empty")
    if unknown_counts:
        problem = problem.when(F.col("kind") == "unknown", "unclassified")
    rows = low.select(*UNIT, "chosen", "n_bytes", kind.alias("kind"), flag(INLINE_MARKERS).alias("inline_xbrl"), flag(FILING_MARKERS).alias("filing_like"))
    return rows.withColumn("problem", problem)


def exception_reasons(units: DataFrame, by_unit: DataFrame, by_accession: DataFrame) -> DataFrame:
    """units(issuer, filing, accession) with the reason of a registered exception, by unit, else by accession."""
    rows = units.join(by_unit.withColumnRenamed("reason", "r1"), UNIT, "left").join(by_accession.withColumnRenamed("reason", "r2"), "accession", "left")
    return rows.withColumn("reason", F.coalesce("r1", "r2")).drop("r1", "r2")
