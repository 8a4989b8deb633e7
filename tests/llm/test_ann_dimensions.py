"""Recall of the nearest neighbours where there are few and many dimensions, unlike and clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def vectors(kind, n, dimension):
    rng = np.random.default_rng(dimension)
    x = rng.normal(size=(n, dimension))
    if kind == "clustered":
        x = rng.normal(size=(n // 40, dimension))[rng.integers(0, n // 40, n)] + 0.3 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["unlike", "clustered"])
@pytest.mark.parametrize("dimension", [64, 256, 768])
def test_recall(spark, monkeypatch, dimension, kind):
    monkeypatch.setattr(ann, "SAMPLE_QUERIES", 32)
    n = 2000
    x = vectors(kind, n, dimension)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    seen, chosen = [], ann.chosen
    monkeypatch.setattr(ann, "chosen", lambda *a: seen.append(chosen(*a)) or seen[-1])
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    hit = 0
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 200 and hit >= 0.9 * 200
    hashing, probes, share = seen[0]
    # what has been measured decides: hashing only where it finds enough
    assert hashing is None or share >= ann.LEAST and probes <= ann.MOST_PROBES
    if kind == "clustered":
        assert hashing is not None


def test_exact_blocks(spark, monkeypatch):
    """Without a hashing that finds enough all queries are answered exactly, block by block."""
    monkeypatch.setattr(ann, "BLOCK", 3)
    monkeypatch.setattr(ann, "LEAST", 2.0)
    x = vectors("unlike", 300, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 30 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()}
    for q in range(0, 300, 30):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [rows[q, k] for k in range(1, 11)] == [(int(i), pytest.approx(d[i], rel=1e-12)) for i in np.argsort(d, kind="stable")[:10]]
    assert ann.nearest(df, F.lit(False)).count() == 0
