"""Near-duplicate groups: MinHash bands propose, odd sketches estimate, full sets confirm.

A document's set holds the hashes of its distinct five-word shingles (all its words as one
where it has fewer). Documents of equal sets share one representative. Its MinHash samples
make `BANDS` band keys of `ROWS` samples each, and are folded into an odd sketch: sample i
of value v flips one bit of a bitmap, so that the ones in the XOR of two bitmaps count the
samples in which two documents differ, which is precise at high similarity. A pair of
similarity 0.85 shares no band with a probability under 1e-8.

Links are found without making all pairs of a bucket:

1. each member of a bucket is paired with two leaders (those of least id and of least
   hashed id, the same over bands); the sketch and the set sizes drop what can't reach the
   threshold; the rest is confirmed on full sets, and components are labelled;
2. buckets of one label are done. The members of the others get keys of an exact prefix
   filter: with a document's shingles in order of rising frequency among those members, the
   first common shingle of two documents that link stands so early in both that what
   follows still suffices. Each of the early shingles is a key, together with the largest
   partner that its place allows. A passage that many documents share stands last and makes
   no key, unless little else is in a document. Keys of one label, and members larger than
   the others of a key allow, fall out;
3. the few members that are left meet by key inside tasks, in chunks of bounded size, where
   places, sizes, sketches and full sets are compared; only links between labels come out.

So every pair that shares a band is either tested, or excluded by a bound, or already in one
component.

Defined cases: a null, empty or wordless text has no shingles and is linked with nothing; a
null doc_id has a null component of its own and isn't kept; rows that share a doc_id count
as one document with the links of all its texts; an empty table gives an empty result.
`near_duplicates` returns only its own columns, so extra ones can't clash. `one_of_each`
keeps all different texts of a kept doc_id, and one row (that of the least hash) of those
that have both in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, shipped, stored, table
from .words import BLANKS, blocks, mix64

SHINGLE = 5
BANDS = 32
ROWS = 5
#: 64-bit words of an odd sketch.
SKETCH_WORDS = 8
#: 100 * intersection >= 85 * union.
THRESHOLD = (85, 100)
#: How far an estimate may fall short of the threshold and still be confirmed on sets: over six standard deviations.
SLACK = 0.17
#: Members of a key that meet in one chunk.
CHUNK = 512
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(7919)
_A = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_GRAM = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts: the sorted distinct shingle hashes of its documents end to end, and their offsets."""
    for block in blocks(column):
        starts, ends, offsets = block.words(BLANKS)
        h = block.hashes(starts, ends)
        n = len(h)
        grams = np.zeros(n, np.uint64)
        for j, r in enumerate(_GRAM):
            grams[: n - j] += h[j:] * r
        grams = mix64(grams)
        sets = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= SHINGLE:
                sets.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:
                sets.append(mix64((h[a:b] * _GRAM[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
        lengths = np.array([len(s) for s in sets])
        yield (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)])


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples, a row per document (documents without values are left out)."""
    begins = offsets[:-1][np.diff(offsets) > 0]
    x, y = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    out = np.empty((len(begins), len(_A)), np.uint32)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, i] = np.minimum.reduceat((x * a) ^ (y * b), begins) if len(begins) else 0
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    mixed = (samples.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(2) + np.arange(BANDS, dtype=np.uint64)
    return mix64(mixed)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Bitmaps in which each sample's hash has flipped a bit."""
    bits = SKETCH_WORDS * 64
    at = mix64(samples.astype(np.uint64) * np.uint64(2654435761) + (np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(40))) % np.uint64(bits)
    flips = np.zeros((len(samples), bits), np.uint8)
    for i in range(samples.shape[1]):
        flips[np.arange(len(samples)), at[:, i].astype(np.int64)] ^= 1
    return np.packbits(flips, axis=1).view(np.uint64)


def most_ones(threshold: tuple[int, int] = THRESHOLD) -> float:
    """The XOR of two sketches has no more ones than this unless their similarity is under the threshold less SLACK."""
    bits, differing = SKETCH_WORDS * 64, 2 * BANDS * ROWS * (1 - threshold[0] / threshold[1] + SLACK)
    return bits / 2 * (1 - (1 - 2 / bits) ** differing)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(x: np.ndarray) -> pa.Array:
    rows, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), _signed(x.ravel()))


SIGNATURE = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"]
    for batch in batches:
        done = 0
        for values, offsets in shingle_sets(batch.column(1)):
            docs = len(offsets) - 1
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            samples = minhashes(values, offsets)
            keys, sketches = np.zeros((docs, BANDS), np.uint64), np.zeros((docs, SKETCH_WORDS), np.uint64)
            prints = np.zeros((docs, 2), np.uint64)
            if len(some):
                keys[some], sketches[some] = band_keys(samples), odd_sketches(samples)
                begins = offsets[:-1][some]
                prints[some, 0] = np.add.reduceat(mix64(values + np.uint64(1)), begins)
                prints[some, 1] = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), begins)
            ids = batch.column(0).slice(done, docs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), _signed(prints[:, 0]), _signed(prints[:, 1]), _lists(keys), _lists(sketches)], names)
            done += docs


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for values, offsets in shingle_sets(batch.column(1)):
            docs = len(offsets) - 1
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(values))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, docs), sets], ["node", "shingles"])
            done += docs


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges(u, v) of longs -> (node, label) for the nodes that have edges; label is the least node reachable.

    Alternating large-star and small-star steps; each is a minimum by node and a join, so no neighbourhood is gathered.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), F.least("u", "low").alias("low"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both)
        large = both.join(low, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = checkpointed(large.distinct())
        low = least(large)
        small = large.join(low, F.col("u") == F.col("of")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.unionByName(low.select(F.col("of").alias("u"), F.col("low").alias("v"))).where("u <> v")
        now = checkpointed(small.distinct())
        if (then := state(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _ones(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def rare_shingles(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """members(node, label, shingles) -> (key, node, label, size, most), the keys of the prefix filter that could link two labels.

    A shingle at place p of a set of n leaves n - p at most in common with a set in which it is the first common one
    too, which suffices for sets of up to `most` shingles.
    """
    num, den = threshold
    rows = members.select("node", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("found")).where("found > 1")
    placed = rows.join(often, "key", "left").groupBy("node", "label", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("found", F.lit(1)).alias("found"), "key"))).alias("in_order"))
    early = F.slice("in_order", F.lit(1), (F.col("size") - F.ceil(F.col("size") * num / den) + 1).cast("int"))
    keyed = placed.select("node", "label", "size", F.posexplode(early).alias("p", "at")).where("at.found > 1")
    most = F.floor((F.col("size") - F.col("p")) * (num + den) / num) - F.col("size")
    keyed = stored(keyed.select(F.col("at.key").alias("key"), "node", "label", "size", most.cast("int").alias("most")), "near-rare")
    return _open_keys(_open_keys(keyed).where("most >= least").drop("least")).drop("least")


def _open_keys(keyed: DataFrame) -> DataFrame:
    """The rows of keys that are found with several labels, and the size of the smallest set there."""
    labels = keyed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("size").alias("least")).where("a <> b")
    return keyed.join(labels.select("key", "least"), "key")


def _links(threshold: tuple[int, int]):
    """A function over rows sorted by cell (key, i, j), of the chunks i and j of a key's members: links that join two labels."""
    num, den = threshold
    most_differing = most_ones(threshold)

    def linked(rows: dict) -> list[tuple[int, int]]:
        label, node, most, chunk = rows["label"], rows["node"], rows["most"], rows["chunk"]
        first, second = np.flatnonzero(chunk == rows["i"][0]), np.flatnonzero(chunk == rows["j"][0])
        alone = rows["i"][0] == rows["j"][0]
        if not len(first) or not len(second):
            return []
        flat, offsets = rows["flat"], rows["offsets"]
        sizes = np.diff(offsets)
        universe, ids = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(universe), np.int32)
        group = np.unique(label, return_inverse=True)[1]  # labels as small numbers, merged below
        found = []
        for x in first:
            other = second[(group[second] != group[x]) & (sizes[second] <= most[x]) & (sizes[x] <= most[second]) & ((second > x) | (not alone))]
            if len(other):
                ones = np.bitwise_count(rows["sketch"][other] ^ rows["sketch"][x]).sum(1)
                other, ones = other[ones <= most_differing], ones[ones <= most_differing]
                other = other[np.argsort(ones, kind="stable")]
            if not len(other):
                continue
            mark[ids[offsets[x] : offsets[x + 1]]] = 1
            spans = sizes[other]
            begins = np.cumsum(spans) - spans
            shared = np.add.reduceat(mark[ids[np.repeat(offsets[other] - begins, spans) + np.arange(spans.sum())]], begins)
            mark[ids[offsets[x] : offsets[x + 1]]] = 0
            for y in other[den * shared >= num * (sizes[other] + sizes[x] - shared)]:
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    found.append((int(node[x]), int(node[y])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            groups = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            cuts = np.append(np.flatnonzero(np.append(True, (groups[1:] != groups[:-1]).any(1))), len(groups))
            sets, sketch = t.column("shingles").combine_chunks(), t.column("sketch").combine_chunks()
            values, at = sets.values.to_numpy(), sets.offsets.to_numpy()
            sketches = sketch.flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
            cols = {c: t.column(c).to_numpy() for c in ("label", "chunk", "node", "most", "i", "j")}
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found += linked({c: v[a:b] for c, v in cols.items()} | {"sketch": sketches[a:b], "flat": values[at[a] : at[b]], "offsets": at[a : b + 1] - at[a]})
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            # the last group may go on in the next batch
            groups = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            last = int(np.flatnonzero((groups != groups[-1]).any(1))[-1]) + 1 if (groups != groups[-1]).any() else 0
            if last:
                yield done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def bounded_broadcast(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids, marked for broadcast only if counted to be few enough."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def near_duplicates(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    num, den = threshold
    shipped(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(text.mapInArrow(_signatures, SIGNATURE), "near-signatures")
    linkable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = stored(
        linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "near-nodes",
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("second"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("print"))
        .where("members > 1")
    )
    buckets = stored(buckets, "near-buckets")
    # buckets of the same members are one
    buckets = buckets.groupBy("members", "print", "first", "second").agg(F.min("key").alias("key"))
    members = stored(keyed.join(buckets.select("key", "members", "first", "second"), "key"), "near-members")

    candidates = members.select("node").distinct()
    few = bounded_broadcast(candidates)
    sets = stored(text.join(few, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(_sets, "node bigint, shingles array<bigint>"), "near-sets")
    sketches = nodes.select("node", "size", "sketch")

    pairs = members.select("node", F.explode(F.array("first", "second")).alias("lead")).where("node <> lead").distinct()
    of_lead = sketches.select(F.col("node").alias("lead"), F.col("size").alias("lead_size"), F.col("sketch").alias("lead_sketch"))
    likely = (
        pairs.join(sketches, "node")
        .join(of_lead, "lead")
        .where((den * F.least("size", "lead_size") >= num * F.greatest("size", "lead_size")) & (_ones("sketch", "lead_sketch") <= most_ones(threshold)))
        .select("node", "lead")
    )
    shared = F.size(F.array_intersect("shingles", "lead_shingles"))
    union = F.size("shingles") + F.size("lead_shingles") - F.col("shared")
    confirmed = (
        likely.join(sets, "node")
        .join(sets.select(F.col("node").alias("lead"), F.col("shingles").alias("lead_shingles")), "lead")
        .withColumn("shared", shared)
        .where(den * F.col("shared") >= num * union)
        .select(F.col("node").alias("u"), F.col("lead").alias("v"))
    )
    labels = checkpointed(components(confirmed))

    # what the leaders didn't join
    labelled = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b and n > 2")
    apart = labelled.join(several.select("key"), "key", "left_semi").select("node", "label").distinct()
    rare = stored(rare_shingles(apart.join(sets, "node"), threshold), "near-open")
    chunks = rare.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = rare.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    met = dealt.join(sets, "node").join(sketches.select("node", "sketch"), "node")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.select("key", "i", "j", "chunk", "node", "label", "most", "sketch", "shingles").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = met.mapInArrow(_links(threshold), "u bigint, v bigint")

    stars = labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    final = checkpointed(components(stars.unionByName(more)))

    found = nodes.select("set_a", "set_b", "node").join(final, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("component"))
    found = stored(found, "near-components")
    plain = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    joined = plain.join(found, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents that stay: one of each group, and the rows without a doc_id as they are."""
    kept = near_duplicates(docs, threshold=threshold).where("kept").groupBy(F.col("doc_id").alias("__kept")).agg(F.count(F.lit(1)).alias("__rows"))
    stay = docs.join(kept, F.col("doc_id") == F.col("__kept"))
    once = stay.where("__rows = 1").select(*docs.columns)
    # rows equal in id and text are one
    often = stay.where("__rows > 1").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"))
    often = often.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(often).unionByName(docs.where(F.col("doc_id").isNull()))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (
  SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id, (d.doc_id <= coalesce(c.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS low FROM r GROUP BY u) c USING (doc_id)
"""
