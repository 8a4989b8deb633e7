"""Quality classifier: Bradley-Terry scores from preference pairs.

A document is described by `FEATURES` numbers about its characters, words and lines. Each
pair of a good and a bad document says that the first is preferred; the weights minimise
the logistic loss of the pair's feature differences. A document's strength is its weighted
sum. The threshold is a quantile of the training strengths: of the quantiles, the one that
tells the labels apart best. The score is the logistic of the strength less the threshold,
scaled so that the threshold scores 0.7.

Features of all rows are made in Arrow batches of whole texts. Learning takes a bounded,
repeatable sample of the labelled rows (`SAMPLE_ROWS`, by hashed id, then by hashed features),
of which only the feature vectors reach the driver; each of its bad documents meets `PAIRS`
good ones.

Defined cases: a null text is as an empty one, and both get the score of an empty text;
rows without a label aren't learned from; a doc_id with the same label more
than once counts once, with both labels as each; rows that share an id count each; without labels of both kinds every score is 0.7; an empty table gives an empty
result. `scored` keeps all columns; its own, `quality_score`, replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fold, sampled, shipped, table
from .words import BLANKS, blocks

SAMPLE_ROWS = 40_000
PAIRS = 8
THRESHOLD = 0.7
RIDGE = 1e-3
STEPS = 60

_KINDS = np.zeros((6, 256), bool)
_KINDS[0, 65:91] = True  # capitals
_KINDS[1, 97:123] = True  # small letters
_KINDS[2, 48:58] = True  # digits
_KINDS[3, [ord(c) for c in ".,;:'\"?-()"]] = True  # ordinary marks
_KINDS[4, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_KINDS[4] &= ~_KINDS[3]  # other marks
_KINDS[5, 128:] = True  # beyond ASCII
#: UTF-8 pairs C3 80 to C3 9E are Latin capitals with accents.
_LATIN_LEAD, _LATIN_CAPITALS = 0xC3, (0x80, 0x9E)
FEATURES = 14


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    out = []
    for block in blocks(column):
        data, offsets = block.data, block.offsets
        n = np.diff(offsets).astype(float)
        docs = len(n)

        def per_doc(flags: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

        kinds = [per_doc(k[data]) for k in _KINDS]
        accented = np.zeros(len(data), bool)
        if len(data) > 1:
            accented[:-1] = (data[:-1] == _LATIN_LEAD) & (data[1:] >= _LATIN_CAPITALS[0]) & (data[1:] <= _LATIN_CAPITALS[1])
        capitals = kinds[0] + per_doc(accented)
        starts, ends, words = block.words(BLANKS)
        h = block.hashes(starts, ends)
        count = np.diff(words).astype(float)
        long = np.concatenate([[0], np.cumsum(ends - starts > 20)])
        of = np.repeat(np.arange(docs), np.diff(words))
        order = np.lexsort((h, of))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        distinct = np.bincount(of[order], weights=fresh, minlength=docs) if len(h) else np.zeros(docs)
        pairs = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else np.zeros(0, np.uint64)
        pair_of = of[:-1] if len(h) > 1 else of[:0]
        inner = pair_of == of[1:] if len(h) > 1 else np.zeros(0, bool)
        pairs, pair_of = pairs[inner], pair_of[inner]
        order = np.lexsort((pairs, pair_of))
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = (pairs[order][1:] != pairs[order][:-1]) | (pair_of[order][1:] != pair_of[order][:-1])
        new_pairs = np.bincount(pair_of[order], weights=fresh, minlength=docs) if len(pairs) else np.zeros(docs)
        lines = per_doc(data == 10) + 1
        bangs, bars = per_doc(data == ord("!")), per_doc(data == ord("|"))
        size, some = np.maximum(n, 1), np.maximum(count, 1)
        out.append(
            np.stack(
                [
                    capitals / size,
                    kinds[1] / size,
                    kinds[2] / size,
                    kinds[3] / size,
                    kinds[4] / size,
                    kinds[5] / size,
                    bangs / some,
                    bars / some,
                    np.minimum(n / some, 50),
                    (long[words[1:]] - long[words[:-1]]) / some,
                    distinct / some,
                    new_pairs / np.maximum(count - 1, 1),
                    np.log1p(count),
                    np.log1p(count / lines),
                ],
                1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


class BradleyTerry:
    """Strengths from pairs: weights on standardised features, threshold and scale."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 5):
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights, self.cut, self.scale = np.zeros(FEATURES), 0.0, 1.0
        win, lose = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(win) or not len(lose):
            return
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = self.standard(x)
        rng = np.random.default_rng(seed)
        bad = np.repeat(lose, pairs)
        difference = z[win[rng.integers(0, len(win), len(bad))]] - z[bad]
        for _ in range(STEPS):  # Newton's method on the logistic loss, with a ridge
            p = 1 / (1 + np.exp(np.clip(difference @ self.weights, -30, 30)))
            gradient = -(difference * p[:, None]).mean(0) + RIDGE * self.weights
            curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + RIDGE * np.eye(FEATURES)
            step = np.linalg.solve(curve, gradient)
            self.weights = self.weights - step
            if np.abs(step).max() < 1e-6:
                break
        strength = z @ self.weights
        quantiles = np.unique(np.quantile(strength, np.linspace(0, 1, 1001), method="midpoint"))
        weigh = np.sort(strength[good]), np.sort(strength[~good])
        wrong = np.searchsorted(weigh[0], quantiles) / len(win) + 1 - np.searchsorted(weigh[1], quantiles) / len(lose)
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        self.cut = float(quantiles[best[len(best) // 2]])
        self.scale = 1 / max(1e-9, float(strength.std()))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def scores(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        logit = (self.standard(x) @ self.weights - self.cut) * self.scale * 4 + shift
        # at the threshold itself rounding must not fall below it
        return np.where(np.abs(logit - shift) < 1e-12, THRESHOLD, 1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["quality", "x"])


def learned(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> BradleyTerry:
    """From docs (doc_id, text) and labels (doc_id, quality), on at most about `sample_rows` rows."""
    shipped(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = sampled(known, sample_rows)
    few = F.broadcast(known) if known.limit(2 * sample_rows + 1).count() <= 2 * sample_rows else known
    rows = docs.select("doc_id", "text").join(few, "doc_id").select("quality", "text").mapInArrow(_vectors, "quality int, x array<double>")
    # ids may repeat in docs, so that the sample is bounded here once more
    rows = rows.orderBy(F.xxhash64("x"), "quality").limit(sample_rows).collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), FEATURES)
    good = np.array([r.quality == 1 for r in rows], bool)
    order = np.lexsort([*x.T, good])
    return BradleyTerry(x[order], good[order])


def scored(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """docs with quality_score."""
    shipped(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop(*[c for c in docs.columns if c.lower() == "quality_score"])
    schema = T.StructType([*out.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = [n.lower() for n in names].index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(features(batch.column(at))))], [*names, "quality_score"])

    return out.mapInArrow(run, schema)


def trained(spark: SparkSession, sf_dir: str) -> BradleyTerry:
    train = fold(4) != 2
    return learned(table(spark, sf_dir, "documents").where(train), table(spark, sf_dir, "labels").where(train))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    score = F.col("quality_score")
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
