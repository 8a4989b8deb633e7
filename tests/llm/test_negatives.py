"""Hard negatives: keys, windows and results against brute force, odd rows."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchor):
    rows = [(i, label, v) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    single = {}
    for i, label, v in rows:
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        single[i] = min(single.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in single.items():
        if not anchor(a):
            continue
        ranked = sorted((-sum(x * y for x, y in zip(q, w)), i, other) for i, (other, w) in single.items() if i != a)
        for p, i, other in [r for r in ranked if r[2] == label][:5]:
            met = [(n, j) for n, j, third in ranked if third != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(met[:10], 1)]
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect())


def test_keys_sort_as_wanted():
    rng = random.Random(0)
    pairs = [(rng.randrange(3), rng.choice([-(1 << 63), -5, 0, 5, (1 << 63) - 1, rng.randrange(-99, 99)]), rng.randrange(2), rng.choice([-7, 0, 7, rng.randrange(-(1 << 62), 1 << 62)])) for _ in range(200)]
    keys = negatives.packed(*[np.array(c) for c in zip(*pairs)]).to_pylist()
    assert [negatives.unpacked(k) for k in keys] == pairs
    assert [negatives.unpacked(k) for k in sorted(keys)] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_products_are_exact():
    x = np.array([[3.0, -2.0], [2.0**40, 1.0], [2.0**600, 0.0], [-(2.0**600), 1.0]])
    got = negatives.products(x, x)
    wanted = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in x]
    assert got.tolist() == [[min((1 << 63) - 1, max(-(1 << 63), w)) for w in r] for r in wanted]
    assert negatives.products(np.zeros((0, 3)), np.ones((2, 3))).shape == (0, 2)


@pytest.mark.parametrize("grain,dimension", [(1.0, 2), (0.01, 6)])
def test_against_brute_force(spark, monkeypatch, grain, dimension):
    """Few values make many ties, and scores of 0; chunks and blocks are small."""
    monkeypatch.setattr(negatives, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(negatives, "AT_ONCE", 3)
    rng = random.Random(int(grain * 100))
    rows = [(i, rng.randrange(3), [round(rng.gauss(0, 1) / grain) * grain * (rng.random() < 0.8) for _ in range(dimension)]) for i in range(150)]
    rows += [(i, 1, rows[3][2]) for i in range(150, 190)]  # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = brute(rows, lambda i: i % 10 == 0)
    assert wanted and found(df, block=7) == wanted == found(df)


def test_zero_positive_and_equal_scores(spark):
    """A positive of score 0 has a window of 0 alone, which holds rows of lesser id too."""
    rows = [(10, 1, [1.0, 0.0]), (21, 1, [0.0, 1.0]), (1, 2, [0.0, 3.0]), (33, 2, [-1.0, 0.0]), (31, 2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows, lambda i: i % 10 == 0) == [(10, 21, 1, 1, 0, 0), (10, 21, 2, 31, 0, 0)]


def test_odd_rows(spark):
    rng = random.Random(4)
    good = [(i, rng.randrange(2), [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(60)]
    odd = [(None, 1, [1.0, 1.0]), (70, None, [1.0, 1.0]), (71, 1, None), (72, 1, [1.0, None]), (73, 1, [float("nan"), 1.0]), (74, 0, [float("inf"), 1.0]), (-10, 1, [0.5, 0.5])]
    twice = [good[20], good[3], (4, good[4][1] + 1, [9.0, 9.0]), (50, 7, [0.1, 0.2])]  # repeated rows, and other rows of an id; no other row has label 7
    rows = good + odd + twice
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"anchor": F.lit("z"), "q": F.lit("z"), "d": F.lit(1), "rank": F.lit(0)})
    assert found(df) == brute(rows, lambda i: i % 10 == 0)
    other = spark.createDataFrame([(900, 1, [1.0]), (910, 1, []), (920, 0, [1.0, 2.0, 3.0])], SCHEMA)
    assert found(df.select("vec_id", "label", "embedding").unionByName(other)) == found(df)
    assert found(df.where("false")) == [] == found(spark.createDataFrame([(10, 1, [])], SCHEMA))
    assert found(spark.createDataFrame([(10, 1, [1.0]), (11, 2, [1.0])], SCHEMA)) == []  # no positive
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).columns == negatives.hard_negatives(df, F.lit(True)).columns


def test_a_chunk_sends_no_more_than_can_count(monkeypatch):
    class Held:
        value = negatives.Anchors(np.array([0]), np.array([1]), np.array([[1.0]]))

    n = 5000
    batch = pa.RecordBatch.from_arrays([pa.array(range(1, n + 1)), pa.array([i % 2 for i in range(n)]), pa.array([[float(i)] for i in range(n)])], ["vec_id", "label", "q"])
    assert sum(b.num_rows for b in negatives.paired(Held, iter([batch]))) == negatives.POSITIVES
    Held.value.positives = [[4999, 4997, 4995, 4993, 4991]]
    keys = [k for b in negatives.paired(Held, iter([batch])) for k in b.column(0).to_pylist()]
    assert len(keys) <= negatives.POSITIVES + negatives.POSITIVES * negatives.NEGATIVES


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    told = con.execute(negatives.ORACLE_SQL)
    df = negatives.op11_hard_negatives(spark, sf)
    assert df.columns == [d[0] for d in told.description]
    assert sorted(tuple(r) for r in df.collect()) == sorted(told.fetchall()) != []
