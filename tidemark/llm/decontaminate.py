"""Benchmark decontamination by an FM-index over each training shard.

A shard is a block of documents within a partition. Its words become symbols: each word of
the benchmark's vocabulary has its own, a run of other words is one separator (no phrase
holds any), and so is the end of a document. The shard's suffixes are sorted by prefix
doubling; the Burrows-Wheeler transform goes into a wavelet matrix with prefix counts;
all benchmark windows are searched backward at once by its ranks. Rows of matching ranges
walk back by LF steps to the next sampled suffix position, which gives the occurrences;
overlapping ones merge into spans.

The benchmark is a query set: it comes in blocks of at most `block_bytes` of UTF-8, each
broadcast, and the documents pass the blocks one after the other, so neither side needs a
join. An item longer than a block comes in pieces that share window - 1 words, so that each of
its windows stands whole in one of them. After every `CHAIN` blocks the documents are written
with what was found, which bounds the plan, the Python workers of a task and the live
broadcasts, whatever the benchmark's size.

Defined cases: null or wordless texts have 0 words and no hits; null or wordless items
never occur; items of equal text all count; repeated document rows each get a row; an empty
table gives an empty result. Extra columns of documents are kept by `find_hits`, whose own
columns are named `n_words`, `spans` (word numbers) and `items`; clashing ones are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shipped, stored, table
from .words import NON_ALNUM, blocks

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
#: Every so many positions of the text, a suffix position is kept.
SAMPLE = 8
#: Blocks of items that follow one another in one plan.
CHAIN = 4
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of text by their suffixes, by prefix doubling over the groups not yet told apart."""
    n = len(text)
    bits = max(1, int(symbols - 1).bit_length())
    depth = max(1, min(8, 62 // bits))
    key = text.astype(np.int64)
    for d in range(1, depth):
        key <<= bits
        key[: n - d] |= text[d:] if d < n else 0
    order = np.argsort(key)
    # within equal keys a suffix that ends within `depth` is the smaller: ends are smaller than any symbol
    ordered = key[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    rank[n] = -1
    tied = ~(head & np.append(head[1:], True))
    slots = np.flatnonzero(tied)
    step = depth
    while len(slots):
        at = order[slots]
        group = rank[at]
        key = group * np.int64(n + 2) + rank[np.minimum(at + step, n)] + 1
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        rank[at] = np.repeat(slots[first], np.diff(np.append(first, len(at))))
        slots = slots[~(head & np.append(head[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of symbols whose last, 0, stands nowhere else."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        n = self.n = len(text)
        order = suffix_order(text, symbols)
        last = text[order - 1]  # of the suffix at 0, the terminator
        self.before = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.before[1:])
        kept = order % sample == 0
        self.kept, self.kept_rank, self.samples = kept, np.cumsum(kept) - 1, order[kept]
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(symbols - 1).bit_length())
        level = last.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1 == 0
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=zeros[1:], dtype=np.int32)
            self.levels.append((zeros, int(zeros[n])))
            level = np.concatenate([level[bit], level[~bit]])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, (zeros, split) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            low = zeros[at]
            at = np.where((symbol >> b) & 1 == 0, low, split + at - low)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first `at` of the transform."""
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer."""
        at, start, symbol = rows, np.zeros_like(rows), np.zeros_like(rows)
        for zeros, split in self.levels:
            low, low0 = zeros[at], zeros[start]
            zero = zeros[at + 1] > low
            symbol = symbol * 2 + ~zero
            at = np.where(zero, low, split + at - low)
            start = np.where(zero, low0, split + start - low0)
        return self.before[symbol] + at - start

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase (a row of symbols), the first row of its suffixes and the row after the last."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            start = self.before[c]
            zero = self._down(c, np.zeros(len(c), np.int64))
            a, b = start + self._down(c, lo[live]) - zero, start + self._down(c, hi[live]) - zero
            lo[live], hi[live] = a, b
            live = live[a < b]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        found = np.empty(len(rows), np.int64)
        where, steps = np.arange(len(rows)), 0
        while len(rows):
            here = self.kept[rows]
            found[where[here]] = self.samples[self.kept_rank[rows[here]]] + steps
            rows, where = self.back(rows[~here]), where[~here]
            steps += 1
        return found


class Phrases:
    """The windows of a block of items, as symbols of the block's vocabulary (0 ends a shard, 1 separates)."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids = ids
        hashes: list[np.ndarray] = []
        for block in blocks(pa.array(texts, pa.large_string())):
            starts, ends, offsets = block.words(NON_ALNUM)
            h = block.hashes(starts, ends)
            hashes += [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        symbols = np.searchsorted(self.vocabulary, np.concatenate(hashes)).astype(np.int32) + 2 if hashes else np.zeros(0, np.int32)
        lengths = np.array([len(h) for h in hashes], np.int64)
        begin = np.cumsum(lengths) - lengths
        sizes = np.minimum(lengths, window)
        #: by window length: distinct windows; for each, where its items begin; the items
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            of = np.flatnonzero(sizes == size)
            many = lengths[of] - size + 1
            item = np.repeat(of, many)
            first = np.repeat(begin[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found = np.lib.stride_tricks.sliding_window_view(symbols, size)[first]
            distinct, which = np.unique(found, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0)
            begins = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
            self.windows[size] = (distinct, begins, pairs[:, 1])

    def hits(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For a shard's words (documents begin at `offsets`): which are hit; the items found in each document."""
        n, docs = len(hashes), len(offsets) - 1
        hit = np.zeros(n, bool)
        none: list[np.ndarray] = [np.zeros(0, np.int64)] * docs
        if not n or not len(self.vocabulary):
            return hit, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        # a separator stands before each document and for each run of unknown words
        opens = np.zeros(n, bool)
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        previous = np.append(False, known[:-1])
        gap = opens | (known & ~previous)
        width = known.astype(np.int64) + (gap & known)
        size = int(width.sum()) + 1
        place = np.cumsum(width) - 1  # of a known word, its symbol
        words = np.flatnonzero(known)
        text = np.ones(size, np.int64)
        text[-1] = 0
        text[place[words]] = at[words] + 2
        word_at = np.full(size, -1, np.int64)
        word_at[place[words]] = words
        index = FMIndex(text, len(self.vocabulary) + 2)
        doc_of: list[np.ndarray] = []
        item_of: list[np.ndarray] = []
        cover = np.zeros(n + 1, np.int64)
        for length, (windows, begins, items) in self.windows.items():
            lo, hi = index.ranges(windows)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            times = (hi - lo)[some]
            rows = np.repeat(lo[some] - np.cumsum(times) + times, times) + np.arange(times.sum())
            first = word_at[index.locate(rows)]
            np.add.at(cover, first, 1)
            np.add.at(cover, first + length, -1)
            pairs = np.unique(np.stack([np.searchsorted(offsets, first, "right") - 1, np.repeat(some, times)], 1), axis=0)
            many = begins[pairs[:, 1] + 1] - begins[pairs[:, 1]]
            which = np.repeat(begins[pairs[:, 1]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            doc_of.append(np.repeat(pairs[:, 0], many))
            item_of.append(items[which])
        hit = np.cumsum(cover[:-1]) > 0
        if not doc_of:
            return hit, none
        found = np.unique(np.stack([np.concatenate(doc_of), np.concatenate(item_of)], 1), axis=0)
        cuts = np.searchsorted(found[:, 0], np.arange(docs + 1))
        return hit, [found[a:b, 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pieces(text: str, limit: int, window: int) -> Iterator[tuple[str, int]]:
    """A text whole where its UTF-8 has at most `limit` bytes, else in parts of about so many that share window - 1 words; their bytes."""
    size = len(text.encode())
    if size <= limit:
        yield text, size
        return
    held: list[str] = []
    size, fresh = 0, False
    for word in WORD.finditer(text):
        held.append(word[0])
        size += len(word[0].encode()) + 1
        fresh = True
        if size >= limit and len(held) >= window:
            yield " ".join(held), size
            held = held[len(held) - window + 1 :]
            size, fresh = sum(len(w.encode()) + 1 for w in held), False
    if fresh:
        yield " ".join(held), size


def item_blocks(benchmark: DataFrame, limit: int, window: int = WINDOW) -> Iterator[tuple[list[str], list[str]]]:
    """The items, in blocks of about `limit` bytes of text; the driver holds one block at a time."""
    ids: list[str] = []
    texts: list[str] = []
    held = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        for text, size in pieces(row.t, limit, window):
            if held and held + size > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(row.i)
            texts.append(text)
            held += size
    yield ids, texts


_built: dict[tuple[str, int], Phrases] = {}


def built(held, window: int) -> Phrases:
    """The windows of a broadcast block, made once in each Python worker, which keeps one block's."""
    ids, texts, name = held.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = Phrases(ids, texts, window)
    return _built[name, window]


def _spans(hit: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words by document: where each document's runs begin, their first word and the one after, by document."""
    padded = np.zeros(len(hit) + 2, bool)
    padded[1:-1] = hit
    begin, end = padded[1:] & ~padded[:-1], ~padded[1:] & padded[:-1]
    cuts = offsets[1:-1]
    glued = cuts[(cuts > 0) & (cuts < len(hit))]
    glued = glued[hit[glued] & hit[glued - 1]]
    begin[glued] = end[glued] = True
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    return np.searchsorted(begin, offsets), begin, end


def find_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans of hit words, and the ids of the items that occur, sorted as strings."""
    spark = docs.sparkSession
    shipped(spark)
    taken = ("n_words", "spans", "items")
    out = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    schema = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def searched(held, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = built(held, window)
            ids = phrases.ids
            for batch in batches:
                names = batch.schema.names
                text = batch.column(names.index("text"))
                if not batch.num_rows:
                    continue
                old = None if first else (batch.column(names.index("spans")).to_pylist(), batch.column(names.index("items")).to_pylist())
                counts, spans, items = [], [], []
                for block in blocks(text, SHARD_BYTES):
                    starts, ends, offsets = block.words(NON_ALNUM)
                    hit, found = phrases.hits(block.hashes(starts, ends), offsets)
                    if old:
                        for d in range(block.lo, block.hi):
                            for s in old[0][d]:
                                hit[offsets[d - block.lo] + s["start"] : offsets[d - block.lo] + s["end"]] = True
                    cuts, begin, end = _spans(hit, offsets)
                    counts.append(np.diff(offsets))
                    for d in range(block.hi - block.lo):
                        zero = offsets[d]
                        spans.append([(int(a - zero), int(b - zero)) for a, b in zip(begin[cuts[d] : cuts[d + 1]], end[cuts[d] : cuts[d + 1]], strict=True)])
                        names_found = {ids[i] for i in found[d]} | (set(old[1][block.lo + d]) if old else set())
                        items.append(sorted(names_found))
                kept = [c for i, c in enumerate(batch.columns) if names[i] not in taken]
                columns = [*kept, pa.array(np.concatenate(counts), pa.int64()), pa.array(spans, SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*[x for x in names if x not in taken], *taken])

        return run

    live = []
    for k, (ids, texts) in enumerate(item_blocks(benchmark, block_bytes, window)):
        if k and k % CHAIN == 0:
            out = stored(out, "decontaminated")
            for old in live:
                old.destroy()
            live = []
        live.append(spark.sparkContext.broadcast((ids, texts, uuid.uuid4().hex)))
        out = out.mapInArrow(searched(live[-1], k == 0), schema)
    return out


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_hits, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hits > 0) & (20 * n_hits >= n_words)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    counted = found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.col("items"))
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), m AS (
  SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
