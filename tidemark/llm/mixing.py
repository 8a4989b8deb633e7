"""Mixing sources to target weights: Efraimidis-Spirakis sampling with word budgets.

Built-in functions only. Each source gets a target number of words: `share` of all words
dealt by weight, at most `max_epochs` times the source's size, the excess dealt again by
weight among the others (water-filling). A source is read in whole epochs first. What is
left of its target is a fraction of an epoch, filled by sampling without replacement:
every document gets the key -ln(u) / w with u uniform from a hash of its id and w its
quality weight, documents are taken by ascending key, and the last one is cut so that the
words meet the budget.

The prefix sum over a source's keys is done in two levels, so that no task holds a source:
keys fall into about sqrt(n) ordered buckets, sizes are summed by bucket, bucket sums are
prefix-summed, and only then is each bucket ordered by itself. Sources are ranked and filled
in two levels too, by range partitions, since there may be as many as hosts.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its
own, last in order; equal keys are ordered by id, then size; repeated rows count each; an
empty table gives an empty result; with no words at all every target is 0. Extra columns
are dropped unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, checkpointed, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: Hex digits of the md5 that make a key's uniform number: 52 bits, exact in a double.
DIGITS = 13
CAPITALS, MARKS = "[A-Z]{2,}", "[!#$%&*|]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """4 for ordinary text, halved for each fault, 1 at least.

    Faults are what the quality classifier's features tell apart most: words of another length
    than 3 to 10 characters (blanks included), shouting (more runs of capitals than half the
    words), and marks (more runs of them than three for ten words).
    """
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    faults = (~mean.between(3, 10)).cast("int") + (2 * count(CAPITALS) > size).cast("int") + (10 * count(MARKS) > 3 * size).cast("int")
    return F.when(faults == 0, F.lit(4.0)).when(faults == 1, F.lit(2.0)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """Exponential with rate `weight`, the same for an id at each run."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 1.0) / float(16**DIGITS)
    return -F.log(u) / weight


def with_sums_before(df: DataFrame, order: Sequence[str], **values: Column) -> DataFrame:
    """df with the sums of some values over the rows before each in a given order, nulls last.

    Rows are range-partitioned; only the partitions' sums meet in one window.
    """
    keys = [k for c in order for k in (F.col(c).isNull(), F.col(c))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, *keys).withColumns(values).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select("__part", *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    within = W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumns({v: F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    # a row for each partition
    joined = inside.join(F.broadcast(ahead), "__part").withColumns({v: F.col(v) + F.col(f"__{v}") for v in values})
    return joined.drop("__part", *[f"__{v}" for v in values])


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """totals(source, source_size, n_docs), a row per source -> with target."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = with_sums_before(totals, ["source"], __nth=F.lit(1))
    weighed = ranked.withColumn("weight", F.element_at(cycle, (F.col("__nth") % len(weights) + 1).cast("int"))).drop("__nth")
    capped = weighed.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = with_sums_before(capped, ["ratio", "source"], __caps=F.col("cap"), __weights=F.col("weight"), __nth=F.lit(1))
    whole = totals.agg(F.sum("source_size")).first()[0]
    if whole is None:
        return totals.withColumn("target", F.lit(0.0))
    all_weights = capped.agg(F.sum("weight")).first()[0]
    level = (F.lit(float(whole)) * float(share) - F.col("__caps")) / (F.lit(all_weights) - F.col("__weights"))
    # the water level is that of the first source, by rising ratio, which stays under its cap
    first = filled.select("__nth", "ratio", level.alias("level")).agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("__nth", "level")))["level"]).first()[0]
    water = float("inf") if first is None else first
    return filled.withColumn("target", F.least(F.col("cap"), F.lit(water) * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, and the columns in `keep`."""
    extra = [F.col(c).alias(f"__{c}") for c in keep]
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.col("text").alias("__of"), *extra)
    rows = sized.withColumn("key", sampling_key(F.col("doc_id"), quality_weight(F.col("__of"), F.col("size")))).drop("__of")
    rows = stored(rows, "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = stored(source_targets(totals, weights, share, max_epochs), "mix-targets")
    plan = targets.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.ceil(F.sqrt("n_docs")).alias("buckets"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # monotone in the key, and even for documents of weight 1
    bucket = F.least(F.floor((1.0 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1).cast("long")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket).drop("of")
    in_order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = (
        placed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(in_order), F.lit(0)).alias("ahead"))
    )
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("inside")))
    taken = F.least(F.col("epochs") * F.col("size") + part, (F.col("size") * max_epochs).cast("long"))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *[F.col(f"__{c}").alias(c) for c in keep])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(coalesce(text, '')) AS chars,
    len(regexp_extract_all(coalesce(text, ''), '[A-Z]{2,}')) AS capitals, len(regexp_extract_all(coalesce(text, ''), '[!#$%&*|]+')) AS marks FROM documents
), f AS (
  SELECT *, (chars / greatest(size, 1) NOT BETWEEN 3 AND 10)::INT + (2 * capitals > size)::INT + (10 * marks > 3 * size)::INT AS faults FROM d
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0)
      / (CASE faults WHEN 0 THEN 4.0 WHEN 1 THEN 2.0 ELSE 1.0 END) AS key
  FROM f
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM t
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth FROM r
), g AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, nth) FROM l WHERE level <= cap / w)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g
), c AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size)::BIGINT AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, least(epochs * size + greatest(0, least(size, rest - ahead)), 2 * size)::BIGINT AS taken FROM c
"""
