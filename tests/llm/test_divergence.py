"""Source divergence: run-length sums against plain counting, against SQL, on odd inputs."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, ranks=50):
    """rows of (lang, source, text)."""
    docs, n, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(LOW) for t in TERM.findall(text or "")]
        docs[lang].update(set(found))
        n[lang, source].update(found)
    kept = {lang: sorted(t for t, d in docs[lang].items() if d >= least) for lang, _ in groups}

    def shares(counts, terms):
        below = sum(counts[t] for t in terms) + 5 * len(terms)
        return {t: 1 + 10**9 * (counts[t] + 5) // below for t in terms}

    out = set()
    for lang, source in groups:
        terms = kept[lang]
        p = shares(n[lang, source], terms)
        whole = shares(sum((c for (at, _), c in n.items() if at == lang), collections.Counter()), terms)
        pairs = []
        for at, other in groups:
            if at == lang and other != source:
                q = shares(n[lang, other], terms)
                pairs.append((other, sum(abs(p[t] - q[t]) for t in terms)))
        over = [(t, p[t] - whole[t]) for t in terms if n[lang, source][t] and p[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", over, ranks)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i) for i, (item, value) in enumerate(found, 1)}
    return out


def rows_of(df):
    out = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_plain_counting(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    monkeypatch.setattr(divergence, "HELD", 50)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "été", "日本", "Straße"]
    rows = []
    for i in range(200):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "é", None, "z"])
        text = " ".join(rng.choice(vocabulary[: rng.choice([5, 30, 64])]).upper() + rng.choice(["", "!", "1x"]) for _ in range(rng.randrange(30)))
        rows.append((lang, source, rng.choice([None, "", text, text, text])))
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert rows_of(divergence.audit(df, least_documents=4, term_ranks=6)) == brute(rows, 4, 6)


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert rows_of(divergence.audit(odd_docs, least_documents=1)) == brute(rows, 1)
    # nothing is kept: pairs differ by 0, there are no terms
    found = rows_of(divergence.audit(odd_docs))
    assert found == brute(rows, 30) and {r[4] for r in found} == {0} and {r[2] for r in found} == {"pair"}
    assert divergence.audit(no_docs).count() == 0
    assert divergence.audit(odd_docs).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_run_length_columns():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50):
        a, b = (np.sort(rng.integers(0, 4, n)) for _ in range(2))
        assert divergence.difference(divergence.encoded(a), divergence.encoded(b), n) == int(np.abs(a - b).sum())
    starts, values = divergence.encoded(np.array([3, 3, 0, 0, 0, 3]))
    assert starts.tolist() == [0, 2, 5] and values.tolist() == [3, 0, 3]


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    counts = [0, 7, 10**13 + 1, 3 * 10**17]
    total, size = sum(counts), 4
    exact = [1 + 10**9 * (c + 5) // (total + 5 * size) for c in counts]
    assert divergence.shares(np.array(counts), total, size).tolist() == exact
    df = spark.createDataFrame([(c,) for c in counts], "c long")
    assert [r.p for r in df.select(divergence.share(F.col("c"), F.lit(total), F.lit(size)).alias("p")).collect()] == exact


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    told = con.execute(divergence.ORACLE_SQL)
    names = [d[0] for d in told.description]
    wanted = {tuple(dict(zip(names, r))[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in told.fetchall()}
    assert rows_of(divergence.op13_divergence(spark, sf)) == wanted and {r[2] for r in wanted} == {"pair", "term"}
