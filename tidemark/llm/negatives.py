"""Hard-negative mining by a secondary-sort shuffle.

A pair of an anchor and another row is a packed key: the anchor's number, the score so that
higher ones sort first, whether the labels differ, the row's id. All of an anchor's keys are
sent to one partition, which `repartitionAndSortWithinPartitions` sorts; a streaming iterator
reads an anchor's keys by descending score. A row of the anchor's label opens a window while
there are fewer than `POSITIVES`; a row of another label goes to each open window whose bounds
hold its score, until the window has `NEGATIVES`. A window never lies above its positive, so it
is open before the first score within it comes; at equal scores (0 alone) the rows of the same
label sort first. No anchor's rows are ever held together: only its open windows are.

Not every pair need be sorted. Anchors are taken in blocks of `ANCHORS`, which go to the
tasks, and a task scores its rows against them in matrix products. Of a chunk of rows only
an anchor's first `POSITIVES` can become positives: their shuffle comes first and gives, for a
block, at most `POSITIVES` scores an anchor. With those scores known, of a chunk only the
first `NEGATIVES` of each window can be returned; they and the positives are what the second
shuffle sorts. So a block's shuffle grows with its anchors and with the chunks, not with the
pairs, and nothing is left out: what isn't sent is preceded by enough of its own chunk.

Scores are inner products of whole numbers, floor(256 * x); products that doubles hold exactly
are made with them, others with Python's integers, and a score beyond 64 bits counts as the
greatest or least 64-bit number.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part, nor do rows of another dimension than most; of rows that share an id the one
of least label, then least vector counts; equal scores go to the smaller id; an anchor without
positives, or whose windows hold no row, gives none; a positive with a negative score has an
empty window; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, shipped, stored, table

POSITIVES, NEGATIVES = 5, 10
#: A window: LOW * positive <= WHOLE * negative <= HIGH * positive.
LOW, HIGH, WHOLE = 30, 90, 100
GRAIN = 256
#: Anchors of a block; anchors whose scores a task holds at once; bytes of a chunk of rows.
ANCHORS, AT_ONCE, CHUNK_BYTES = 4096, 64, 16 << 20
#: Rows of a partition at least, where there are more than the cluster's cores.
PART_ROWS = 65_536

#: anchor's number, turned score, other label, turned id: big-endian, so that keys sort as bytes.
KEY = struct.Struct(">QQBQ")
_TOP = 1 << 63
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def packed(anchor: np.ndarray, score: np.ndarray, other: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Keys of many pairs."""
    key = np.zeros(len(ids), np.dtype([("a", ">u8"), ("s", ">u8"), ("o", "u1"), ("i", ">u8")]))
    turn = np.uint64(_TOP)
    key["a"], key["o"] = anchor, other
    key["s"] = ~(score.astype(np.int64).view(np.uint64) ^ turn)
    key["i"] = ids.astype(np.int64).view(np.uint64) ^ turn
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.size), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    """anchor's number, score, other label, id."""
    anchor, score, other, at = KEY.unpack(key)
    return anchor, (~score & (2 * _TOP - 1)) - _TOP, other, at - _TOP


def usable(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, with whole components as doubles."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
    # floor() of a double gives a long; beyond its range a double is whole already
    whole = lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x.cast("double") * GRAIN).cast("double")).otherwise(x.cast("double") * GRAIN)
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(v, whole).alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with those of y, as 64-bit integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < 2**53:
        return (x @ y.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in x], object).reshape(x.shape) @ np.array([[int(c) for c in r] for r in y], object).reshape(y.shape).T
    return np.array([[min(_MOST, max(_LEAST, s)) for s in r] for r in exact], np.int64).reshape(len(x), len(y))


def first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first; earlier places first among equals."""
    some = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.argsort(~score[some], kind="stable")][:k]  # ~ turns the order and holds the least number too


class Anchors:
    """A block of anchors, in the tasks; with the scores of their positives once they are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.positives: list[list[int]] | None = None


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of about CHUNK_BYTES, by id."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(held).sort_by("vec_id").combine_chunks()
        return whole.column("vec_id").to_numpy(), whole.column("label").to_numpy(), matrix(whole.column("q").chunk(0))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(2).flatten().nbytes
        if size >= CHUNK_BYTES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def paired(held: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that a chunk of rows sends: each anchor's first rows of its label, and, once positives are known, of each window."""
    block: Anchors = held.value
    for ids, labels, x in chunks(batches):
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        same = {int(label): labels == label for label in np.unique(block.labels)}
        for lo in range(0, len(block.ids), AT_ONCE):
            scores = products(block.vectors[lo : lo + AT_ONCE], x)
            for n, s in enumerate(scores, lo):
                alike = same[int(block.labels[n])]
                mine = np.flatnonzero(alike & (ids != block.ids[n]))
                keep = [mine[first(s[mine], POSITIVES)]]
                if block.positives is not None:
                    others = np.flatnonzero(~alike)
                    t = s[others]
                    # whole bounds: LOW * p <= WHOLE * s <= HIGH * p
                    for p in set(block.positives[n]):
                        inside = others[(t >= -(-LOW * p // WHOLE)) & (t <= HIGH * p // WHOLE)]
                        keep.append(inside[first(s[inside], NEGATIVES)])
                    keep[1:] = [np.unique(np.concatenate(keep[1:]))] if len(keep) > 1 else []
                for other, at in enumerate(keep):
                    rows.append((np.full(len(at), n), s[at], np.full(len(at), other), ids[at]))
        cat = [np.concatenate(c) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([packed(*cat)], ["key"])


def shuffled(base: DataFrame, held: Broadcast, partitions: int):
    """The keys of all rows with the block's anchors, an anchor's in one partition, sorted."""
    keys = base.mapInArrow(lambda batches: paired(held, batches), "key binary").rdd.map(lambda r: (bytes(r.key), None))
    return keys.repartitionAndSortWithinPartitions(partitions, lambda key: int.from_bytes(key[:8], "big"))


def positives_of(keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple[int, int]]:
    """(anchor's number, score) of each anchor's first POSITIVES keys."""
    now, seen = -1, 0
    for key, _ in keys:
        anchor, score, _, _ = unpacked(key)
        if anchor != now:
            now, seen = anchor, 0
        if seen < POSITIVES:
            seen += 1
            yield anchor, score


def mined(keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Sorted keys to (anchor's number, positive, rank, negative, positive's score, negative's score)."""
    now, opened = -1, 0
    windows: list[list[int]] = []
    for key, _ in keys:
        anchor, score, other, at = unpacked(key)
        if anchor != now:
            now, opened, windows = anchor, 0, []
        if not other:
            if opened < POSITIVES:
                opened += 1
                windows.append([at, score, 0])
            continue
        for window in windows:
            if window[2] < NEGATIVES and LOW * window[1] <= WHOLE * score <= HIGH * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], at, window[1], score


def named(held: Broadcast, keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple[int, ...]]:
    """As mined, with the anchors' ids."""
    return ((int(held.value.ids[anchor]), *rest) for anchor, *rest in mined(keys))


def hard_negatives(df: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = ANCHORS) -> DataFrame:
    """For each row for which `anchors` (of vec_id) holds: anchor_id, positive_id, rank, negative_id and both scores."""
    spark = df.sparkSession
    shipped(spark)
    some = usable(df, id_col, label_col, vector_col)
    common = some.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None or common.d == 0:
        return spark.createDataFrame([], OUT)
    partitions = max(spark.sparkContext.defaultParallelism, -(-common.n // PART_ROWS))
    one = F.min(F.struct("label", "q")).alias("r")
    base = stored(some.where(F.size("q") == common.d).repartition(partitions, "vec_id").groupBy("vec_id").agg(one).select("vec_id", "r.label", "r.q"), "negatives-vectors")
    asked = base.where(anchors)
    target, written = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}", False
    for held in anchor_blocks(asked, block):
        n = min(partitions, len(held.ids))
        known: list[list[int]] = [[] for _ in held.ids]
        for at, score in shuffled(base, spark.sparkContext.broadcast(held), n).mapPartitions(positives_of).collect():
            known[at].append(score)
        held.positives = known
        sent = spark.sparkContext.broadcast(held)
        rows = spark.createDataFrame(shuffled(base, sent, n).mapPartitions(lambda keys, sent=sent: named(sent, keys)), OUT, verifySchema=False)
        rows.write.mode("append" if written else "overwrite").parquet(target)
        written = True
    return spark.read.schema(OUT).parquet(target) if written else spark.createDataFrame([], OUT)


def anchor_blocks(rows: DataFrame, size: int) -> Iterator[Anchors]:
    """Anchors by so many at a time; the driver holds one block."""
    held: list[tuple[int, int, list[float]]] = []

    def block() -> Anchors:
        return Anchors(np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.float64))

    for r in rows.toLocalIterator():
        held.append((r.vec_id, r.label, r.q))
        if len(held) == size:
            yield block()
            held = []
    if held:
        yield block()


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ),
  pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike, list_inner_product(a.q, r.q)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
  ),
  positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
  ),
  met AS (
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  )
SELECT * FROM met WHERE rank <= 10
"""
