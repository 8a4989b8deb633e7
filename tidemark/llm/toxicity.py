"""Toxicity: class-conditional Kneser-Ney models of toxic and of ordinary text.

Text is a sequence of bytes, A-Z lower-cased, each word (a run of anything but ASCII white
space) between two blanks. For each class an interpolated Kneser-Ney model of order `ORDER`
gives a byte's probability after up to four bytes of its word: the class's own counts, less a
discount, and for what they leave the next shorter context. All shorter contexts are shared:
they count, over both classes, how many different bytes stand before a sequence, so a rare
expression that one class hasn't seen gets the same smooth estimate in both, and only what
the classes disagree on tells them apart. Where neither class has seen a sequence the shared
part cancels, so that scoring looks up one table of sequences and one of contexts.

A toxic text is mostly made of ordinary words. Its model takes a word from the toxic model
with probability `SHARE`, else from the ordinary one; a text's evidence is its log-likelihood
under that, less the ordinary one's, divided by its number of words. The threshold is learned
on training rows that weren't counted (`fold` decides), in the middle between the two
values where the labels are told apart best.

Learning is bounded by documented parameters: at most about `SAMPLE_ROWS` labelled rows of
each class, by hashed id, and `MOST_GRAMS` sequences, the most frequent ones. Equal texts with
the same label are learned from once. Counting and scoring run in Arrow batches of whole
texts; the counts meet in one aggregation, and only the kept ones reach the driver.

Defined cases: a null text is as an empty one, and both have no evidence, 0, like a text of
white space; rows without a label aren't learned from; an id with both labels is learned from
as each; rows that share an id count each; without labels of both kinds every score is 0.0;
an empty table gives an empty result. `scored` keeps all columns; its own, `toxicity_score`,
replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fold, sampled, shipped, table
from .words import BLANKS, BLOCK_BYTES, Block, blocks

ORDER = 5
DISCOUNT = 0.75
#: The share of a toxic text's words that the toxic model gives.
SHARE = 0.003
SAMPLE_ROWS = 40_000
MOST_GRAMS = 1_000_000
#: Sequences that a counting task holds before it hands them on.
HELD = 1_000_000
THRESHOLD = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[BLANKS] = 32
_BLANK, _BYTE = np.uint64(32), np.uint64(8)


def pieces(column: pa.Array, most: int = 2 * BLOCK_BYTES) -> Iterator[Block]:
    """The blocks of a text column; one longer text is cut at blanks, so that what is held doesn't grow with it (a longer word stays whole)."""
    for block in blocks(column):
        if len(block.data) <= most:
            yield block
            continue
        begin = 0  # a block beyond its bound is one document
        blank = np.flatnonzero(BLANKS[block.data])
        while begin < len(block.data):
            near = np.searchsorted(blank, begin + most)
            end = int(blank[near]) + 1 if near < len(blank) else len(block.data)
            yield Block(block.lo, block.hi, block.data[begin:end], np.array([0, end - begin]))
            begin = end


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte of a block's words, and the blank after each word, with up to ORDER - 1 bytes before it in the word and the blank before that.

    Packed as numbers, the last byte lowest; where each word begins among them; the document of each word.
    """
    docs = len(block.offsets) - 1
    placed = np.full(len(block.data) + docs + 1, 32, np.uint8)  # a blank before each document and at the end
    owner = np.repeat(np.arange(docs), np.diff(block.offsets))
    placed[np.arange(len(block.data)) + owner + 1] = _LOWER[block.data]
    blank = placed == 32
    at = np.arange(len(placed), dtype=np.int32)
    last = np.maximum.accumulate(np.where(blank, at, 0))
    behind = at - np.concatenate([[0], last[:-1]])  # from the blank before, for blanks too
    wide = placed.astype(np.uint64)
    key = wide.copy()
    for k in range(1, ORDER):
        key[k:] |= np.where(behind[k:] >= k, wide[:-k] << np.uint64(8 * k), np.uint64(0))
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # a blank counts only as the end of a word
    keep[0] = False
    ends = np.flatnonzero(blank[keep])
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    begins = np.flatnonzero(keep & np.concatenate([[True], blank[:-1]]))  # first byte of each word, by place
    of = np.searchsorted(block.offsets[1:] + np.arange(1, docs + 1), begins, "right")
    return key[keep], starts, of


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (rows of two)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins, axis=0) if len(begins) else counts


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to distinct sequences with how often each class has them; texts are worked on in blocks."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def handed() -> pa.RecordBatch:
        k, n = _summed(np.concatenate(keys), np.concatenate(counts))
        keys[:], counts[:] = [], []
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["gram", "toxic", "ordinary"])

    held = 0
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False) == 1
        for block in pieces(batch.column(1)):
            key, starts, of = grams(block)
            mine = np.repeat(toxic[block.lo : block.hi][of], np.diff(np.append(starts, len(key))))
            for side in (0, 1):
                k, n = np.unique(key[mine if side == 0 else ~mine], return_counts=True)
                row = np.zeros((len(k), 2), np.int64)
                row[:, side] = n
                keys.append(k)
                counts.append(row)
                held += len(k)
            if held >= HELD:
                yield handed()
                held = 0
    if keys:
        yield handed()


def _shorter(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a sequence has more than one byte, and it without the first."""
    length = np.zeros(len(keys), np.int64)
    for k in range(ORDER):
        length[keys >= np.uint64(1) << np.uint64(8 * k)] = k + 1
    cut = (np.uint64(1) << (8 * np.maximum(length - 1, 0)).astype(np.uint64)) - np.uint64(1)
    return length > 1, keys & cut


def _discounted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sequence the discounted frequency after its context and what the context leaves; the contexts and what each leaves."""
    contexts, of = np.unique(keys >> _BYTE, return_inverse=True)
    total = np.bincount(of, counts, len(contexts))
    own = np.maximum(counts - DISCOUNT, 0) / np.maximum(total[of], 1)
    left = np.where(total > 0, 1 - np.bincount(of, own, len(contexts)), 1.0)
    return own, left[of], contexts, left


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


@dataclass
class KneserNey:
    """Log ratios of the two models: of seen sequences, and of all others by their context."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    left: np.ndarray
    cut: float = 0.0
    width: float = 1.0

    @staticmethod
    def of(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> KneserNey:
        """From sorted distinct sequences and their counts."""
        levels, now = [], keys
        while True:
            more, rest = _shorter(now)
            if not more.any():
                break
            levels.append(np.unique(rest[more], return_counts=True))
            now = levels[-1][0]
        shared, known = np.zeros(0), np.zeros(0, np.uint64)

        def below(k: np.ndarray) -> np.ndarray:
            more, rest = _shorter(k)
            at, there = _find(known, rest)
            return np.where(more & there, shared[at] if len(shared) else 0.0, 1 / 256)

        for k, n in reversed(levels):
            own, left, _, _ = _discounted(k, n.astype(float))
            shared, known = own + left * below(k), k
        low = below(keys)
        p, remains = [], []
        for n in (toxic, ordinary):
            own, left, contexts, rest = _discounted(keys, n.astype(float))
            p.append(own + left * low)
            remains.append(rest)
        return KneserNey(keys, np.log(p[0] / p[1]), contexts, np.log(remains[0] / remains[1]))

    def words(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log ratio of each word."""
        value = np.zeros(len(keys))
        at, seen = _find(self.grams, keys)
        value[seen] = self.ratio[at[seen]]
        rest = np.flatnonzero(~seen)
        at, seen = _find(self.contexts, keys[rest] >> _BYTE)
        value[rest[seen]] = self.left[at[seen]]
        return np.add.reduceat(value, starts) if len(starts) else np.zeros(0)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Of each text: log-likelihood as a toxic one, less that as an ordinary one, a word."""
        total, count = np.zeros(len(column)), np.zeros(len(column))
        for block in pieces(column):
            keys, starts, of = grams(block)
            mixed = np.log1p(SHARE * np.expm1(np.minimum(self.words(keys, starts), 600)))
            total[block.lo : block.hi] += np.bincount(of, mixed, block.hi - block.lo)
            count[block.lo : block.hi] += np.bincount(of, minlength=block.hi - block.lo)
        return total / np.maximum(1, count)

    def learn_cut(self, z: np.ndarray, toxic: np.ndarray) -> None:
        """The cut that tells the labels apart best, halfway between two values; the scale from how far apart they are."""
        values = np.unique(z)
        bad, good = np.sort(z[toxic]), np.sort(z[~toxic])
        # errors with the cut below each value, and above all
        wrong = np.searchsorted(bad, np.append(values, np.inf)) + len(good) - np.searchsorted(good, np.append(values, np.inf))
        best = int(np.flatnonzero(wrong == wrong.min())[0])
        ends = np.concatenate([[values[0] - 1e-6], values, [values[-1] + 1e-6]])
        self.cut = float((ends[best] + ends[best + 1]) / 2)
        self.width = max(1e-6, float(bad.mean() - good.mean()) / 8) if len(bad) and len(good) else 1.0

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.evidence(column) - self.cut) / self.width, -700, 700)))


def learned(docs: DataFrame, labels: DataFrame, held_back: Column, *, sample_rows: int = SAMPLE_ROWS, most_grams: int = MOST_GRAMS) -> KneserNey | None:
    """From docs (doc_id, text) and labels (doc_id, toxic); rows for which `held_back` holds set the threshold, the others are counted.

    None without labels of both kinds. Where no held-back row has one of the labels, the counted rows set the threshold.
    """
    spark = docs.sparkSession
    shipped(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), held_back.alias("back")).distinct()
    known = sampled(known.where("toxic = 1"), sample_rows).unionByName(sampled(known.where("toxic = 0"), sample_rows))
    few = F.broadcast(known) if known.limit(4 * sample_rows + 1).count() <= 4 * sample_rows else known
    rows = docs.select("doc_id", "text").join(few, "doc_id").select("toxic", "back", "text").where("text is not null")
    # equal texts count once for each label; they set the threshold only if no copy is counted
    same = F.struct(F.xxhash64("text"), F.hash("text"), F.length("text")).alias("same")
    rows = rows.groupBy("toxic", same).agg(F.first("text").alias("text"), F.bool_and("back").alias("back")).persist()
    try:
        kinds = {(r.toxic, r.back) for r in rows.groupBy("toxic", "back").count().collect()}
        counting, setting = ~F.col("back"), F.col("back")
        if len({t for t, back in kinds if back}) < 2 or len({t for t, back in kinds if not back}) < 2:
            counting = setting = F.lit(True)
        if len({t for t, _ in kinds}) < 2:
            return None
        found = rows.where(counting).select("toxic", "text").mapInArrow(counted, "gram bigint, toxic bigint, ordinary bigint").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).withColumn("n", F.col("toxic") + F.col("ordinary")).persist()
        try:
            # the least frequency that leaves no more than most_grams
            least, total = 1, 0
            for r in found.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect():
                total += r["count"]
                if total > most_grams:
                    least = r.n + 1
                    break
            kept = found.where(F.col("n") >= least).select("gram", "toxic", "ordinary").toArrow()
        finally:
            found.unpersist()
        keys = kept.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        model = KneserNey.of(keys[order], *[kept.column(c).to_numpy()[order] for c in ("toxic", "ordinary")])
        held = spark.sparkContext.broadcast(model)

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.evidence(batch.column(1)))], ["toxic", "z"])

        told = rows.where(setting).select("toxic", "text").mapInArrow(weighed, "toxic int, z double").orderBy(F.xxhash64("z", "toxic")).limit(4 * sample_rows).toArrow()
    finally:
        rows.unpersist()
    model.learn_cut(told.column("z").to_numpy(), told.column("toxic").to_numpy() == 1)
    return model


def scored(docs: DataFrame, model: KneserNey | None) -> DataFrame:
    """docs with toxicity_score."""
    shipped(docs.sparkSession)
    out = docs.drop(*[c for c in docs.columns if c.lower() == "toxicity_score"])
    if model is None:
        return out.withColumn("toxicity_score", F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*out.schema.fields, T.StructField("toxicity_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = [n.lower() for n in names].index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(batch.column(at)))], [*names, "toxicity_score"])

    return out.mapInArrow(run, schema)


def trained(spark: SparkSession, sf_dir: str) -> KneserNey | None:
    train = fold(5) != 0
    return learned(table(spark, sf_dir, "documents").where(train), table(spark, sf_dir, "labels").where(train), fold(5) == 1)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    score = F.col("toxicity_score")
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
