"""Toxicity: the models against plain Kneser-Ney in Python, odd inputs, held-out accuracy."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sequences(word):
    """(context and byte) of each byte of a word, and of the blank after it."""
    padded = b" " + word + b" "
    return [padded[max(0, i + 1 - toxicity.ORDER) : i + 1] for i in range(1, len(padded))]


def words_of(text):
    return WORD.findall((text or "").encode().translate(LOW))


class Plain:
    """The two models with dictionaries."""

    def __init__(self, toxic, ordinary):
        self.own = [collections.Counter(s for t in texts for w in words_of(t) for s in sequences(w)) for texts in (toxic, ordinary)]
        self.lower = []
        now = set(self.own[0]) | set(self.own[1])
        while rest := collections.Counter(s[1:] for s in now if len(s) > 1):
            self.lower.append(rest)
            now = set(rest)

    def spread(self, counts, s):
        after = {k: n for k, n in counts.items() if k[:-1] == s[:-1]}
        total = sum(after.values())
        if not total:
            return 0.0, 1.0
        d = toxicity.DISCOUNT
        return max(0, after.get(s, 0) - d) / total, 1 - sum(max(0, n - d) for n in after.values()) / total

    def shared(self, s, level=0):
        if not s:
            return 1 / 256
        own, left = self.spread(self.lower[level], s) if level < len(self.lower) else (0.0, 1.0)
        return own + left * self.shared(s[1:], level + 1)

    def ratio(self, s):
        p = []
        for counts in self.own:
            own, left = self.spread(counts, s)
            p.append(own + left * self.shared(s[1:]))
        return math.log(p[0] / p[1])

    def evidence(self, text):
        said = [math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(sum(map(self.ratio, sequences(w))))) for w in words_of(text)]
        return sum(said) / len(said) if said else 0.0


def model_of(toxic, ordinary):
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(toxic) + [0] * len(ordinary), pa.int32()), pa.array([*toxic, *ordinary])], ["toxic", "text"])
    counts = [r for b in toxicity.counted(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns])]
    keys, a, b = (np.array(c) for c in zip(*sorted(counts)))
    return toxicity.KneserNey.of(keys.astype(np.uint64), a, b)


def test_models_against_plain_python(monkeypatch):
    rng = random.Random(5)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))
    toxic = [make("abcX", 20) for _ in range(4)] + ["Äb é  a\tb"]
    ordinary = [make("abdy", 30) for _ in range(6)]
    plain, model = Plain(toxic, ordinary), model_of(toxic, ordinary)
    texts = [*toxic, *ordinary, make("abcdxyz", 50), "", None, " \n", "unseen 日本 words", "A"]
    assert np.allclose(model.evidence(pa.array(texts)), [plain.evidence(t) for t in texts], atol=1e-9)
    # however blocks and pieces fall
    before = toxicity.pieces
    monkeypatch.setattr(toxicity, "pieces", lambda c: before(c, 16))
    long = " ".join(texts[:10])
    assert np.allclose(model.evidence(pa.array([long * 3])), [plain.evidence(long * 3)], atol=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(["aab ab", "ba"], ["abb", "b aa bb"])
    for context in (b" ", b" a", b" aa", b"aab", b"zzzz"):
        for counts in plain.own:
            total = 0.0
            for byte in range(256):
                s = context + bytes([byte])
                own, left = plain.spread(counts, s)
                total += own + left * plain.shared(s[1:])
            assert total == pytest.approx(1)


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeioulmnr") for _ in range(6)) for _ in range(300)]
    bad = ["".join(rng.choice("xyzqk") for _ in range(6)) for _ in range(8)]
    rows, labels = [], []
    for i in range(400):
        said = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if i % 4 == 0:
            said[rng.randrange(len(said))] = rng.choice(bad).upper()
        rows.append((i, " ".join(said)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learned(docs.where("doc_id < 300"), marks, F.col("doc_id") % 3 == 1)
    got = {r.doc_id: r.toxicity_score for r in toxicity.scored(docs, model).collect()}
    right = [(got[i] >= 0.5) == bool(t) for i, t in labels if i >= 300]
    assert np.mean(right) >= 0.97
    odd = toxicity.scored(odd_docs.withColumn("Toxicity_Score", F.lit("z")), model)
    assert odd.columns == [*odd_docs.columns, "toxicity_score"]
    out = odd.collect()
    assert len(out) == odd_docs.count() and all(0 <= r.toxicity_score <= 1 for r in out)
    assert len({r.toxicity_score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.scored(no_docs, model).count() == 0
    # of one kind of label only, or of none, nothing is learned
    assert toxicity.learned(docs, marks.where("toxic = 1"), F.lit(False)) is None
    assert toxicity.learned(no_docs, marks, F.lit(False)) is None
    assert {r.toxicity_score for r in toxicity.scored(odd_docs, None).collect()} == {0.0}
    # nothing held back: the counted rows set the threshold
    assert toxicity.learned(docs, marks, F.lit(False)).cut > 0


def test_learning_is_bounded_and_repeatable(spark):
    rows = [(i, f"{'xq' if i % 2 else 'ab'}{i % 50} common words here {i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    whole = toxicity.learned(docs, labels, F.col("doc_id") % 5 == 1)
    few = toxicity.learned(docs, labels, F.col("doc_id") % 5 == 1, most_grams=60)
    assert 0 < len(few.grams) <= 60 < len(whole.grams)
    again = toxicity.learned(docs.repartition(7), labels.repartition(3), F.col("doc_id") % 5 == 1)
    assert np.array_equal(again.grams, whole.grams) and np.allclose(again.ratio, whole.ratio) and again.cut == pytest.approx(whole.cut)
    # copies count once: the same counts from three times the rows
    thrice = docs.unionByName(docs).unionByName(docs)
    assert np.allclose(toxicity.learned(thrice, labels, F.col("doc_id") % 5 == 1).ratio, whole.ratio)


def test_toxicity_holds_out(spark):
    """At sf0.01 the held-out rows with labels are few; most are told right, and ordinary ones are left alone."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op12_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert np.mean([p == t for p, t in held]) >= 0.95
    assert np.mean([p for p, t in held if t == 0]) <= 0.05
