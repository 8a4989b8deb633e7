"""Source divergence audit: how far the sources of a language differ in their words.

Terms are counted by language and source; a language keeps those that enough of its documents
have. Each (language, source) group gives every kept term a smoothed share in parts of
1,000,000,000 (`share`), and two groups differ by the sum of the shares' differences.

The counts of a group are a column over the vocabulary, which is long and mostly made of few
different numbers. The vocabulary is put into an order in which equal counts stand together
(range partitions of the terms' count vectors, the rarest groups first), cut into blocks, and
each group's column of a block is run-length encoded. Pairs of groups meet within a block:
between two run boundaries of either both counts stay the same, so a difference is worked out
once for such a stretch and multiplied by its length. The blocks' sums are added up.

Terms are cut and counted in Arrow batches of whole texts; a task sums what it has seen by
language and term before it hands it on, so that a very common word or a large source is a few
rows for each task. Equality of terms within a task is that of 64-bit hashes; across tasks it
is that of the text.

All arithmetic is exact: on 64-bit integers, and on Python's where counts times 10^9 need more.

Defined cases: null text, lang or source is as an empty one; a null text's document still
makes its group occur; repeated rows count each; a group without terms gives each kept term
its smoothed zero; a language of one source has no pairs; without kept terms pairs differ by
0; equal values rank by the item's UTF-8 bytes; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shipped, stored, table
from .words import blocks

LEAST_DOCUMENTS, SMOOTHING, PARTS, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Terms of a block of the vocabulary.
BLOCK_TERMS = 4096
#: Distinct (group, term) entries that a counting task holds before it hands them on.
HELD = 1_000_000

#: What isn't part of a term: all of ASCII but letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[0x00:0x41] = OUTSIDE[0x5B:0x61] = OUTSIDE[0x7B:0x80] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNTED = "lang string, term string, counts array<struct<source:string,n:bigint,docs:bigint>>"


class Tally:
    """Counts by (group, term) of the texts that a task has seen, where a group is a (lang, source)."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list[np.ndarray] = []
        self.held = self.bytes = 0

    def add(self, lang: list[str], source: list[str], text: pa.Array) -> Iterator[pa.RecordBatch]:
        """Takes in texts; gives rows whenever HELD entries have come together."""
        group = np.array([self.groups.setdefault(key, len(self.groups)) for key in zip(lang, source, strict=True)], np.int64)
        for block in blocks(text):
            starts, ends, words = block.words(OUTSIDE)
            if not len(starts):
                continue
            h = block.hashes(starts, ends)
            of = np.repeat(np.arange(block.lo, block.hi), np.diff(words))
            order = np.argsort(h, kind="stable")  # documents stay in order among equal terms
            h, of, at = h[order], of[order], order
            begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
            n = np.diff(np.append(begins, len(h)))
            h, g, at = h[begins], group[of[begins]], at[begins]
            # by term and group: occurrences, documents, and the place of one of them
            order = np.lexsort((g, h))
            h, g, at, n = h[order], g[order], at[order], n[order]
            begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
            docs = np.diff(np.append(begins, len(h)))
            at = at[begins]
            size = (ends - starts)[at]
            base = self.bytes + np.concatenate([[0], np.cumsum(size)])
            self.parts.append((h[begins], g[begins], np.add.reduceat(n, begins), docs, base[:-1], size))
            self.texts.append(_LOWER[block.data[np.repeat(starts[at] - (base[:-1] - self.bytes), size) + np.arange(size.sum())]])
            self.bytes = int(base[-1])
            self.held += len(begins)
            if self.held >= HELD:
                yield self.rows()

    def rows(self) -> pa.RecordBatch:
        """A row per (lang, term): occurrences and documents by source. The tally starts anew."""
        h, g, n, docs, at, size = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        data = np.concatenate(self.texts)
        names = list(self.groups)
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in names))}
        lang_of = np.array([langs[lang] for lang, _ in names], np.int64)
        order = np.lexsort((g, lang_of[g], h))
        h, g, n, docs, at, size = h[order], g[order], n[order], docs[order], at[order], size[order]
        begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
        n, docs = np.add.reduceat(n, begins), np.add.reduceat(docs, begins)
        h, g, at, size = h[begins], g[begins], at[begins], size[begins]
        lang = lang_of[g]
        rows = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])]))
        cuts = np.append(rows, len(h)).astype(np.int32)
        sources = pa.DictionaryArray.from_arrays(pa.array(g), pa.array([source for _, source in names])).cast(pa.string())
        counts = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([sources, pa.array(n), pa.array(docs)], ["source", "n", "docs"]))
        ends = np.concatenate([[0], np.cumsum(size[rows])])
        packed = data[np.repeat(at[rows] - ends[:-1], size[rows]) + np.arange(ends[-1])]
        terms = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(packed.tobytes())).cast(pa.string())
        lang_text = pa.DictionaryArray.from_arrays(pa.array(lang[rows]), pa.array(list(langs))).cast(pa.string())
        self.parts, self.texts, self.held, self.bytes = [], [], 0, 0
        return pa.RecordBatch.from_arrays([lang_text, terms, counts], ["lang", "term", "counts"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) rows to sums by language and term."""
    tally = Tally()
    for batch in batches:
        yield from tally.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
    if tally.held:
        yield tally.rows()


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(PARTS * (count + SMOOTHING) / (total + SMOOTHING * size)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(count) + SMOOTHING) * F.lit(PARTS).cast("decimal(10,0)")
    return 1 + F.call_function("div", above, wide(total) + wide(size) * SMOOTHING)


def shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """The same for an array of counts; in Python's integers where 64 bits don't hold the product."""
    below = int(total) + SMOOTHING * int(size)
    if len(counts) and (int(counts.max()) + SMOOTHING) * PARTS > np.iinfo(np.int64).max:
        return np.array([1 + PARTS * (int(c) + SMOOTHING) // below for c in counts], np.int64)
    return 1 + PARTS * (counts + SMOOTHING) // below


def encoded(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins, and the number."""
    begins = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, np.int64)
    return begins, column[begins]


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """The sum of |a - b| over two run-length columns: once for each stretch between run boundaries of either, times its length."""
    cuts = np.union1d(a[0], b[0])
    x = a[1][np.searchsorted(a[0], cuts, "right") - 1]
    y = b[1][np.searchsorted(b[0], cuts, "right") - 1]
    return int((np.abs(x - y) * np.diff(np.append(cuts, length))).sum())


def run_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms in order (lang, counts, term) to blocks of one language, named by their first term: for each group that has some, the block's run-length column."""
    lang, first, kept = "", "", []

    def block() -> pa.RecordBatch:
        terms = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
        names = [s["source"] for k in kept for s in k]
        codes = {s: i for i, s in enumerate(dict.fromkeys(names))}
        of, n = np.array([codes[s] for s in names], np.int64), np.array([s["n"] for k in kept for s in k], np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(codes) + 1))
        runs = []
        for i in range(len(codes)):
            mine = order[cuts[i] : cuts[i + 1]]
            column = np.zeros(len(kept), np.int64)
            column[terms[mine]] = n[mine]
            runs.append(encoded(column))
        rows, long = len(codes), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * rows), pa.array([first] * rows), pa.array([len(kept)] * rows, pa.int64()), pa.array(list(codes)), pa.array([r[0] for r in runs], long), pa.array([r[1] for r in runs], long)],
            ["lang", "block", "terms", "source", "starts", "counts"],
        )

    for batch in batches:
        for at, counts, term in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kept and (at != lang or len(kept) >= BLOCK_TERMS):
                yield block()
                kept = []
            if not kept:
                lang, first = at, term
            kept.append(counts)
    if kept:
        yield block()


RUNS = "lang string, block string, terms bigint, source string, starts array<bigint>, counts array<bigint>"


def paired(columns: pa.Table) -> pa.Table:
    """The groups of a block (lang, terms, source, total, size, starts, counts) to the sums of each pair."""
    columns = columns.sort_by("source").combine_chunks()
    lang, terms, source, total, size = (columns.column(c).to_pylist() for c in ("lang", "terms", "source", "total", "size"))
    runs = []
    for starts, counts, n, v in zip(columns.column("starts"), columns.column("counts"), total, size, strict=True):
        # a group without any of the block's terms is one run of zeros
        here = [np.zeros(1, np.int64)] * 2 if starts.values is None else [c.values.to_numpy() for c in (starts, counts)]
        runs.append((here[0], shares(here[1], n, v)))
    a, b = np.triu_indices(len(runs), 1)
    sums = [difference(runs[i], runs[j], terms[0]) for i, j in zip(a, b, strict=True)]
    names = pa.array(source, pa.string())
    return pa.table({"lang": pa.array(lang[:1] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(sums, pa.int64())})


def audit(df: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank of documents (lang, source, text)."""
    shipped(df.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = df.select(text("lang"), text("source"), text("text"))
    # a task's sums of one (lang, term) meet in one partition, which the grouping and the windows below keep
    sums = rows.mapInArrow(counted, COUNTED).repartition("lang", "term")
    each = sums.select("lang", "term", F.explode("counts").alias("c")).groupBy("lang", "term", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"), F.sum("c.docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    each = each.withColumns({"of_docs": F.sum("docs").over(term), "of_lang": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    kept = stored(each.where(F.col("of_docs") >= least_documents).select("lang", "term", "source", "n", "of_lang", "first"), "divergence-counts")

    # every group, with its occurrences of kept terms and the size of its language's vocabulary
    groups = rows.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count_if("first").alias("size"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    groups = stored(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", zero("total"), zero("size"), zero("lang_total")), "divergence-groups")

    # term: what a group has more of than its language
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("of_lang"), F.col("lang_total"), F.col("size"))
    over = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= term_ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # pair: run-length columns over a vocabulary in the order of its count vectors, the groups of least total first
    place = F.row_number().over(W.partitionBy("lang").orderBy("total", "source"))
    placed = kept.join(groups.withColumn("place", place).select("lang", "source", "place"), ["lang", "source"])
    vectors = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "n", "source"))).alias("counts"))
    key = F.transform("counts", lambda c: F.struct(c["place"], c["n"]))
    ordered = vectors.select("lang", "counts", "term", key.alias("key")).repartitionByRange("lang", "key", "term").sortWithinPartitions("lang", "key", "term")
    columns = stored(ordered.select("lang", F.transform("counts", lambda c: F.struct(c["source"], c["n"])).alias("counts"), "term").mapInArrow(run_columns, RUNS), "divergence-runs")
    every = columns.select("lang", "block", "terms").distinct().join(groups.select("lang", "source", "total", "size"), "lang")
    met = every.join(columns.drop("terms"), ["lang", "block", "source"], "left").select("lang", "block", "terms", "source", "total", "size", "starts", "counts")
    sums = met.groupBy("lang", "block").applyInArrow(paired, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    wanted = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = wanted.join(both, ["lang", "source", "item"], "left").withColumn("value", zero("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  found AS (SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
  vocabulary AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 30),
  sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM vocabulary GROUP BY ALL),
  groups AS (SELECT DISTINCT lang, source FROM docs),
  counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
  totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
  shares AS (
    SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v) AS p
    FROM groups g JOIN vocabulary w USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term) LEFT JOIN totals t USING (lang, source)
  ),
  whole AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM shares JOIN sizes USING (lang) GROUP BY lang, term),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (
    SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
  ),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM terms) WHERE rank <= 50
"""
