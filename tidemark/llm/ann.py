"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to length one, goes through pseudo-rotations (three rounds of random signs
and a fast Hadamard transform, padded to a power of two); the nearest signed axis of each of
`ROTATIONS` of them makes its code in a table. A query probes in each table its best codes
(multiprobe), and every candidate found is ranked by its exact Euclidean distance.

How many codes a query probes is measured, not set by size: `SAMPLE_QUERIES` rows are
answered exactly in one pass over the vectors, and the probes are the fewest with which their
true neighbours are found with a share of `TARGET`. Where `MOST_PROBES` of the codes of
`ROTATIONS` rotations find less than `LEAST` of them, as with unlike vectors of many dimensions,
codes of fewer rotations are tried, which are coarser; `chosen` says what has been measured.
Should none do, all queries are answered exactly: by passes over all vectors with the queries
in blocks. So is a query that finds fewer than `k` candidates, because there are few vectors
or all lie far off.

Only ids travel with codes. Ids and queries meet by cell (table, hash of the code); what comes
out are, for each query, the ids of its candidates, by the shard in which their vectors are.
Each shard then meets its candidates once. Cells of more than `CELL` ids, and shards of more
than `NEAR` candidates, are dealt into chunks. Of equal vectors only the `k` + 1 of least id
are indexed, since no other can be among the nearest `k`: copies, however many, fill no cell.

Where norms differ, a further coordinate sqrt(M^2 - |x|^2), with M the greatest norm, is
hashed along, so that directions order as Euclidean distances do.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows without an id or of another dimension than most; rows that share
an id count as one with the nearest of its vectors, and are no candidates of their own
query; equal distances go to the smaller id; an empty table gives an empty result; extra
columns are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shared_dir, shipped, stored, table
from .words import mix64

K = 10
TABLES, ROTATIONS = 32, 2
#: Probes of a query in a table at most, and the share of true neighbours that they are to find.
MOST_PROBES, TARGET, LEAST = 4096, 0.96, 0.9
SAMPLE_QUERIES = 64
#: Vectors of a shard, and of a cell's chunk; queries of a cell's chunk, and of a block of the exact pass.
SHARD, CELL, QUERY_CELL, BLOCK = 20_000, 65_536, 4096, 1024
#: Candidates of a shard that are ranked at once; vectors in a file of the index; cells of a table at least.
NEAR, FILE, MOST_FILES, LEAST_CELLS = 2_000_000, 4096, 100_000, 8
SEED = 97
OUT = "query_id bigint, vec_id bigint, score double"


def _matrix(width: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, not scaled: a product for the shortest strides, butterflies for the others."""
    rows, width = x.shape
    h = min(width, 16)
    x = (x.reshape(-1, h) @ _matrix(h)).reshape(rows, width)
    while h < width:
        y = x.reshape(rows, -1, 2, h)
        a = y[:, :, 0] + y[:, :, 1]
        np.subtract(y[:, :, 0], y[:, :, 1], out=y[:, :, 1])
        y[:, :, 0] = a
        h *= 2
    return x


class CrossPolytope:
    """Codes of `tables` tables, each of `rotations` pseudo-rotations."""

    def __init__(self, dimension: int, tables: int, rotations: int, greatest: float, seed: int = SEED):
        self.width = 1 << int(dimension).bit_length()
        self.axes_of = 2 * self.width
        self.dimension, self.greatest, self.tables, self.rotations = dimension, greatest, tables, rotations
        self.signs = (np.random.default_rng(seed).integers(0, 2, (tables, rotations, 3, self.width)) * 2 - 1).astype(np.float32)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.width), np.float32)
        norm = np.sqrt((x * x).sum(1))
        y[:, : self.dimension] = x / self.greatest
        y[:, self.dimension] = np.sqrt(np.maximum(0, 1 - (norm / self.greatest) ** 2))
        return y

    def rotated(self, y: np.ndarray, t: int, r: int) -> np.ndarray:
        """Agreement with each axis after a rotation; that with the opposite axis is its negative."""
        out = hadamard(y * self.signs[t, r, 0])
        for s in self.signs[t, r, 1:]:
            out *= s / self.width**0.5
            out = hadamard(out)
        return out

    def codes(self, x: np.ndarray, t: int, rows: int = 512) -> np.ndarray:
        """A row per vector: the axis of each rotation. Some rows at a time, which stay in the processor's cache."""
        return np.concatenate([self._codes(x[i : i + rows], t) for i in range(0, len(x), rows)]) if len(x) else np.zeros((0, self.rotations), np.int64)

    def _codes(self, x: np.ndarray, t: int) -> np.ndarray:
        y = self.lifted(x)
        out = np.empty((len(x), self.rotations), np.int64)
        for r in range(self.rotations):
            a = self.rotated(y, t, r)
            best = np.abs(a).argmax(1)
            out[:, r] = best + self.width * (a[np.arange(len(a)), best] < 0)
        return out

    def packed(self, axes: np.ndarray) -> np.ndarray:
        """Codes as single numbers."""
        code = np.zeros(axes.shape[:-1], np.int64)
        for r in range(self.rotations):
            code = code * self.axes_of + axes[..., r]
        return code

    def probes(self, x: np.ndarray, t: int, count: int, rows: int = 64) -> np.ndarray:
        """The best codes of each row, best first: rows x (at most count) x rotations."""
        return np.concatenate([self._probes(x[i : i + rows], t, count) for i in range(0, len(x), rows)]) if len(x) else np.zeros((0, 0, self.rotations), np.int64)

    def _probes(self, x: np.ndarray, t: int, count: int) -> np.ndarray:
        y, rows = self.lifted(x), np.arange(len(x))[:, None]
        codes, short = np.zeros((len(x), 1, 0), np.int64), np.zeros((len(x), 1))
        for r in range(self.rotations):
            a = self.rotated(y, t, r)
            a = np.concatenate([a, -a], 1).astype(np.float64)
            best = np.argsort(-a, axis=1, kind="stable")[:, :count]
            lost = (a[rows, best[:, :1]] - a[rows, best]) ** 2
            # both are in order: the i-th with the j-th loses no less than the i * j pairs before it
            most = [min(best.shape[1], count // (i + 1)) for i in range(short.shape[1])]
            i = np.repeat(np.arange(len(most)), most)
            j = np.concatenate([np.arange(m) for m in most])
            short = short[:, i] + lost[:, j]
            keep = np.argpartition(short, count, axis=1)[:, :count] if short.shape[1] > count else np.arange(short.shape[1])[None].repeat(len(x), 0)
            keep = keep[rows, np.argsort(short[rows, keep], axis=1, kind="stable")]
            codes = np.concatenate([codes[rows, i[keep]], best[rows, j[keep]][:, :, None]], 2)
            short = short[rows, keep]
        return codes


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; v as doubles, which holds floats exactly."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each vector from one query, in doubles."""
    return np.sqrt(((x - q) ** 2).sum(1))


def least(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties by id."""
    some = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]) if len(d) else np.zeros(0, np.int64)
    some = some[np.isfinite(d[some])]
    return some[np.lexsort((ids[some], d[some]))][:k]


def merged(lists: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in all lists."""
    best = lists.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(base: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The k nearest of a block of queries within each batch of all vectors."""
    held = base.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mine = vectors_of(batch.column(1)), batch.column(0).to_numpy()
            rows: list[list[np.ndarray]] = [[], [], []]
            for one, at in zip(held.value[1], held.value[0], strict=True):
                d = distances(x, one)
                d[mine == at] = np.inf
                best = least(d, mine, k)
                for out, found in zip(rows, (np.full(len(best), at), mine[best], d[best]), strict=True):
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], ["query_id", "vec_id", "score"])

    return base.mapInArrow(run, OUT)


def exact_blocks(base: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """The same for any number of queries: a pass over all vectors for each block, written before the next; None without queries."""
    path, mode = f"{shared_dir(base.sparkSession)}/ann-exact-{uuid.uuid4().hex}", "overwrite"
    for block in query_blocks(asked):
        merged(exact(base, *block, k), k).write.mode(mode).parquet(path)
        mode = "append"
    return None if mode == "overwrite" else base.sparkSession.read.parquet(path)


def probes_for(base: DataFrame, hashing: CrossPolytope, k: int) -> tuple[int, float]:
    """The fewest probes that find a share TARGET of a sample's true neighbours, and the share that they find."""
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    ids, q = np.array([r.vec_id for r in sample]), np.array([r.v for r in sample])
    true = merged(exact(base, ids, q, k), k).join(base.groupBy("vec_id").agg(F.min("v").alias("v")), "vec_id").collect()
    if not true:
        return 1, 1.0
    row = {int(i): n for n, i in enumerate(ids)}
    of, near = np.array([row[r.query_id] for r in true]), np.array([r.v for r in true])
    first = np.full(len(true), MOST_PROBES)
    for t in range(hashing.tables):
        codes, theirs = hashing.probes(q, t, MOST_PROBES), hashing.codes(near, t)
        same = (codes[of] == theirs[:, None, :]).all(2)
        first = np.minimum(first, np.where(same.any(1), same.argmax(1), MOST_PROBES))
    count = min(MOST_PROBES, int(np.sort(first)[min(len(first) - 1, int(np.ceil(TARGET * len(first))) - 1)]) + 1)
    return count, float((first < count).mean())


def chosen(base: DataFrame, dimension: int, tables: int, greatest: float, k: int) -> tuple[CrossPolytope | None, int, float]:
    """The hashing, its probes, and the share of a sample's true neighbours that they find; no hashing where none finds LEAST."""
    share = 0.0
    for rotations in range(ROTATIONS, 0, -1):
        hashing = CrossPolytope(dimension, tables, rotations, greatest)
        probes, share = probes_for(base, hashing, k)
        if share >= LEAST:
            return hashing, probes, share
    return None, 0, share


def nearest(df: DataFrame, queries: Column, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, cell: int = CELL, query_cell: int = QUERY_CELL) -> DataFrame:
    """For each row for which `queries` holds: query_id, rank, vec_id, score of its k nearest found."""
    spark = df.sparkSession
    shipped(spark)
    some = usable(df, id_col, vector_col)
    sizes = some.groupBy(F.size("v").alias("d")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = stored(usable(df.where(queries), id_col, vector_col).where(F.size("v") == sizes.d), "ann-queries")
    copy = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    base = stored(some.where(F.size("v") == sizes.d).distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v").repartition(min(MOST_FILES, -(-sizes.n // FILE))), "ann-vectors")
    hashing, probes, _ = chosen(base, sizes.d, tables, float(np.sqrt(sizes.m)), k)
    if hashing is None:
        found = exact_blocks(base, asked, k)
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if found is None else found
    held = spark.sparkContext.broadcast(hashing)
    rows = base.count()
    shards, groups = max(1, -(-rows // SHARD)), max(LEAST_CELLS, -(-2 * rows // CELL))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell that a batch's vectors fall into: their ids and codes."""
        for batch in batches:
            x, ids = vectors_of(batch.column(1)), batch.column(0).to_numpy()
            for t in range(held.value.tables):
                yield cells(t, ids, held.value.packed(held.value.codes(x, t)))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell that a batch's queries probe: the queries and codes."""
        for batch in batches:
            x, ids = vectors_of(batch.column(1)), batch.column(0).to_numpy()
            for t in range(held.value.tables):
                codes = held.value.packed(held.value.probes(x, t, probes))
                yield cells(t, np.repeat(ids, codes.shape[1]), codes.ravel())

    def cells(t: int, ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        group = (mix64(codes.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, begins = np.unique(group[order], return_index=True)
        cuts = np.append(begins, len(order))
        lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v[order], pa.int64())) for v in (ids, codes)]
        return pa.RecordBatch.from_arrays([pa.array(t * groups + group, pa.int64()), pa.array(np.diff(cuts), pa.int64()), *lists], ["cell", "n", "ids", "codes"])

    schema = "cell bigint, n bigint, ids array<bigint>, codes array<bigint>"
    found = stored(base.mapInArrow(coded, schema), "ann-codes")
    wanted = stored(asked.mapInArrow(probed, schema), "ann-probes")
    # a cell of many vectors or queries is dealt into chunks by the rows that it came in; the others are one
    counts = [rows.groupBy("cell").agg(F.ceil(F.sum("n") / most).cast("int").alias(name)) for rows, most, name in ((found, cell, "is"), (wanted, query_cell, "js"))]
    cut = stored(counts[0].join(counts[1], "cell"), "ann-cells")

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        wide = rows.join(cut, "cell")
        own, others = F.pmod(F.xxhash64("ids"), F.col(mine + "s")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))
        return wide.select("cell", "ids", "codes", own.alias(mine), others.alias(other))

    def met(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        """The ids of the vectors in the cell that each query probes, by shard."""
        out: list[list] = [[], [], []]
        if vectors.num_rows and wanted.num_rows:
            ids, codes = (np.concatenate([x.values.to_numpy() for x in vectors.column(c)]) for c in ("ids", "codes"))
            who, probe = (np.concatenate([x.values.to_numpy() for x in wanted.column(c)]) for c in ("ids", "codes"))
            order = np.argsort(codes, kind="stable")
            ids, codes = ids[order], codes[order]
            a, b = np.searchsorted(codes, probe), np.searchsorted(codes, probe, "right")
            times = b - a
            query, near = np.repeat(who, times), ids[np.repeat(a - np.cumsum(times) + times, times) + np.arange(times.sum())]
            shard = shard_of(near)
            order = np.lexsort((shard, query))
            query, near, shard = query[order], near[order], shard[order]
            begins = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (shard[1:] != shard[:-1]))) if len(query) else np.zeros(0, np.int64)
            out = [query[begins], shard[begins], np.split(near, begins[1:]) if len(query) else []]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "shard": pa.array(out[1], pa.int64()), "ids": pa.array(out[2], pa.list_(pa.int64()))})

    def shard_of(ids: np.ndarray) -> np.ndarray:
        return (mix64(ids.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(batch.column(0).to_numpy())), *batch.columns], ["shard", "vec_id", "v"])

    def ranked(vectors: pa.Table, lists: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and lists.num_rows:
            vectors, lists = vectors.sort_by("vec_id").combine_chunks(), lists.combine_chunks()
            x, ids = vectors_of(vectors.column("v").chunk(0)), vectors.column("vec_id").to_numpy()
            q = vectors_of(lists.column("q").chunk(0))
            for n, (at, near) in enumerate(zip(lists.column("query_id").to_numpy(), lists.column("ids"), strict=True)):
                wanted = np.unique(near.values.to_numpy())
                a, b = np.searchsorted(ids, wanted), np.searchsorted(ids, wanted, "right")
                here = a if (b - a == 1).all() else np.concatenate([np.arange(s, e) for s, e in zip(a, b, strict=True)])
                here = here[ids[here] != at]
                d = distances(x[here], q[n])
                best = least(d, ids[here], k)
                rows.append((np.full(len(best), at), ids[here][best], d[best]))
        cat = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    pairs = dealt(found, "i", "j").groupBy("cell", "i", "j").cogroup(dealt(wanted, "j", "i").groupBy("cell", "i", "j")).applyInArrow(met, "query_id bigint, shard bigint, ids array<bigint>")
    lists = stored(pairs.groupBy("query_id", "shard").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")), "ann-candidates")
    chunks = max(1, -(-(lists.agg(F.sum(F.size("ids"))).first()[0] or 0) // (shards * NEAR)))
    lists = lists.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    spread = base.mapInArrow(placed, "shard bigint, vec_id bigint, v array<double>").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    near = spread.groupBy("shard", "chunk").cogroup(lists.groupBy("shard", "chunk")).applyInArrow(ranked, OUT)
    near = stored(near, "ann-near")
    # queries with too few candidates are compared with all vectors
    few = near.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = asked.join(few, F.col("vec_id") == F.col("query_id"), "left_anti")
    out = near.join(few.select("query_id"), "query_id", "left_semi")
    rest = exact_blocks(base, short, k)
    return merged(out if rest is None else out.unionByName(rest.select(*out.columns)), k)


def query_blocks(rows: DataFrame, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of rows, so many at a time; the driver holds one block."""
    ids: list[int] = []
    vectors: list[list[float]] = []
    for r in rows.toLocalIterator():
        ids.append(r.vec_id)
        vectors.append(r.v)
        if len(ids) == size:
            yield np.array(ids), np.array(vectors)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
