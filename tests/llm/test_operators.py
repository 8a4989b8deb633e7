"""Each operator on odd inputs, and against plain brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, decontaminate, language, line_dedup, lm, mixing, near_dup, pii, quality, token_counts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOW))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# words


def test_words_and_hashes():
    texts = ["Hello wOrld", "abc", "", None, "def  x\n", " q", "É é", "hello"]
    for limit in (1, 7, 1000):
        seen = []
        for b in words.blocks(pa.array(texts), limit):
            s, e, o = b.words()
            h = b.hashes(s, e)
            seen += [list(zip([bytes(b.data[i:j]).decode() for i, j in zip(s[x:y], e[x:y])], h[x:y].tolist())) for x, y in zip(o[:-1], o[1:])]
        assert [[w for w, _ in d] for d in seen] == [WORD.findall(t or "") for t in texts]
        assert seen[0][0][1] == seen[7][0][1] != seen[1][0][1]
    assert not list(words.blocks(pa.array([], pa.string())))


# 1 language


def test_language(spark, odd_docs, no_docs):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, make("abcdeo" if i % 2 else "strnmu"), "one" if i % 2 else "two") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, vectors = language.profiles(docs.where("doc_id < 40"))
    got = by_id(language.identify(docs, names, vectors))
    assert names == ["one", "two"] and all(got[i].lang_pred == lang for i, _, lang in rows)
    odd = language.identify(odd_docs, names, vectors).collect()
    assert len(odd) == odd_docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in odd if r.doc_id in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in odd)
    assert language.identify(no_docs, names, vectors).count() == 0
    names, vectors = language.profiles(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, names, vectors).collect()} == {"und"}


def test_language_against_brute_force(spark):
    """Bundles and cosines trigram by trigram in plain Python."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1200 and lang is not null").orderBy("doc_id").limit(60)
    docs = [(r.doc_id, r.text, r.lang) for r in rows.collect()] + [(-1, "日本語の文と ünï", "xx"), (-2, "12 !", "xx")]

    def bundle(text):
        letters = [((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " ") for c in f"  {text}  "]
        runs = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
        grams = collections.Counter(zip(runs, runs[1:], runs[2:], strict=False))
        out = np.zeros(language.DIMENSIONS)
        for (a, b, c), n in grams.items():
            if b != " ":
                v = [language.letter_vector(ord(x)).astype(float) for x in (a, b, c)]
                out += math.sqrt(n) * np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out / (np.linalg.norm(out) or 1)

    vectors = {i: bundle(t) for i, t, _ in docs}
    langs = sorted({g for i, _, g in docs if i % 3})
    shapes = {g: sum(vectors[i] for i, _, x in docs if i % 3 and x == g) for g in langs}
    shapes = {g: v / np.linalg.norm(v) for g, v in shapes.items()}
    middle = sum(shapes.values()) / len(shapes)
    near = {g: (v - middle) / np.linalg.norm(v - middle) for g, v in shapes.items()}
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = by_id(language.identify(table, *language.profiles(table.where("doc_id % 3 <> 0"))))
    for i, v in vectors.items():
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        mine = (v - middle) / np.linalg.norm(v - middle)
        cos = {g: float(mine @ x) for g, x in near.items()}
        assert got[i].score == pytest.approx((1 + max(cos.values())) / 2, abs=1e-4)
        assert cos[got[i].lang_pred] >= max(cos.values()) - 1e-4


def test_language_of_a_very_long_text_of_many_letters():
    import tracemalloc

    rng = random.Random(2)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000))
    language._trigrams(["a"])
    tracemalloc.start()
    found = language.text_vectors([text, "short one"], language.Codebook())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.any(1).all() and peak < 500e6


def test_language_holds_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.op1_language(spark, "/root/testdata/sf0.001").join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


# 2 near duplicates


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_duplicates(spark, monkeypatch, chunk):
    """Families of copies with more and more words changed; small chunks make large buckets meet in pieces."""
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts, n = {}, 0
    for family in range(6):
        base = [f"w{family}{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 4, 5))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts[n] = " ".join(copy)
            n += 1
    wanted, sets = brute_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = by_id(near_dup.near_duplicates(docs))
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (wanted[i] == i) for i in texts)


@pytest.mark.parametrize("own", [25, 14])
def test_unlike_members_of_one_bucket(spark, own):
    """2,000 texts that share most of their words and link with none: the keys that are left grow with their number, not its square."""
    rng = random.Random(own)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(base + [f"o{i}x{rng.randrange(10**6)}" for _ in range(own)]) for i in range(2000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = docs.mapInArrow(near_dup._sets, "node bigint, shingles array<bigint>").withColumn("label", F.col("node"))
    assert near_dup.rare_shingles(rows, (85, 100)).count() == 0
    got = near_dup.near_duplicates(docs)
    assert got.where("kept").count() == 2000


def test_rare_shingles_lose_no_link(spark):
    """Every link of random families shares a key whose sizes allow it."""
    rng = random.Random(4)
    sets = {}
    for n in range(240):
        size = rng.choice((5, 20, 60))
        s = set(range(1000 * (n % 6), 1000 * (n % 6) + size))
        for _ in range(rng.randrange(5)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(10**6, 10**9))
        sets[n] = s
    rows = spark.createDataFrame([(n, n, sorted(s)) for n, s in sets.items()], "node long, label long, shingles array<long>")
    keys = collections.defaultdict(dict)
    for r in near_dup.rare_shingles(rows, (85, 100)).collect():
        keys[r.key][r.node] = (r.size, r.most)
    met = {(u, v) for k in keys.values() for u in k for v in k if u < v and k[u][0] <= k[v][1] and k[v][0] <= k[u][1]}
    links = {(u, v) for u in sets for v in sets if u < v and 100 * len(sets[u] & sets[v]) >= 85 * len(sets[u] | sets[v])}
    assert links and links <= met


def test_one_of_each_keeps_different_texts_of_an_id(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(20))
    rows = [(1, text("a"), "x"), (1, text("b"), "y"), (1, text("b"), "z"), (2, text("c"), "x"), (3, text("b"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = near_dup.one_of_each(docs).collect()
    assert sorted((r.doc_id, r.text[0]) for r in got) == [(1, "a"), (1, "b"), (2, "c")]
    assert sorted(map(tuple, got)) == sorted(map(tuple, near_dup.one_of_each(docs.repartition(3)).collect()))


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    got = near_dup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    one = {r.doc_id: r for r in got}
    assert [one[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(one[i].component_id == i and one[i].kept for i in (1, 2, 3))
    assert one[5].component_id == 4 and one[8].component_id == 7 and one[7].n_shingles == 1 and one[6].n_shingles == 1
    assert one[None].component_id is None and not one[None].kept
    assert near_dup.near_duplicates(no_docs).count() == 0
    left = near_dup.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 10, 12]  # 11 repeats most of 10


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 300)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = near_dup.components(spark.createDataFrame(edges, "u long, v long"))
    rows = {r.node: r.label for r in got.collect()}
    assert all(rows.get(i, i) == x for i, x in label.items())


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    bits, k = near_dup.SKETCH_WORDS * 64, near_dup.BANDS * near_dup.ROWS
    for share in (0.85, 0.9, 0.97):
        n = 2000
        both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        values = np.concatenate([both, own[0], both, own[1]])
        samples = near_dup.minhashes(values, np.array([0, len(both) + len(own[0]), len(values)]))
        s = near_dup.odd_sketches(samples)
        ones = int(np.bitwise_count(s[0] ^ s[1]).sum())
        estimate = 1 + bits / (4 * k) * math.log(1 - 2 * ones / bits)
        assert abs(estimate - share) < 0.12
        assert ones <= near_dup.most_ones()


# 3 quality


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(60)).capitalize() + "."
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! ") * 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(250, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learned(docs, labels)
    got = by_id(quality.scored(docs, model))
    assert sum((got[i].quality_score >= 0.7) == (i % 3 > 0) for i in range(200, 300)) >= 98
    odd = quality.scored(odd_docs, model)
    assert odd.count() == odd_docs.count() and odd.columns[-1] == "quality_score"
    found = {r.doc_id: r.quality_score for r in odd.collect()}
    assert found[1] == found[2] and all(0 <= s <= 1 for s in found.values())
    assert quality.scored(no_docs, model).count() == 0
    none = quality.learned(docs, labels.where("quality = 1"))
    assert {r.quality_score for r in quality.scored(docs, none).collect()} == {0.7}


def test_quality_sample_is_bounded(spark, monkeypatch):
    """Repeated labels and documents don't swell what is learned from, and a label given twice counts once."""
    docs = spark.createDataFrame([(i % 10, f"text number {i} of this table" + "!" * (5 * (i % 2))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "BradleyTerry", lambda x, good: seen.append((len(x), int(good.sum()))))
    quality.learned(docs, labels, sample_rows=30)
    quality.learned(docs, labels)
    assert seen[0][0] <= 30 and seen[1] == (400, 200)


def test_quality_features_against_plain_python():
    texts = ["Hello WORLD, 12 it's | a a a!", "", None, "ÀÉ xx\nline two " + "y" * 25, "one"]
    got = quality.features(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        b, w = (t or "").encode(), (t or "").split()
        n, some = max(len(b), 1), max(len(w), 1)
        low = [x.translate(LOW) for x in w]
        marks = sum(chr(c) in ".,;:'\"?-()" for c in b)
        other = sum(33 <= c < 127 and not chr(c).isalnum() for c in b) - marks
        wanted = [
            sum(c.isupper() for c in t or "") / n, sum(97 <= c < 123 for c in b) / n, sum(48 <= c < 58 for c in b) / n, marks / n, other / n, sum(c > 127 for c in b) / n,
            b.count(b"!") / some, b.count(b"|") / some, min(len(b) / some, 50), sum(len(x.encode()) > 20 for x in w) / some, len(set(low)) / some,
            len(set(zip(low, low[1:], strict=False))) / max(len(w) - 1, 1), math.log1p(len(w)), math.log1p(len(w) / (b.count(b"\n") + 1)),
        ]
        assert row == pytest.approx(wanted)


def test_quality_weights_against_another_optimiser():
    """The same pairs by plain gradient descent; the threshold against all thresholds; scores from both."""
    rng = np.random.default_rng(11)
    n = 300
    good = rng.random(n) < 0.7
    x = rng.normal(size=(n, quality.FEATURES)) * rng.uniform(0.5, 3, quality.FEATURES) + good[:, None] * rng.normal(size=quality.FEATURES) * 0.6
    model = quality.BradleyTerry(x, good)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    win, lose = np.flatnonzero(good), np.flatnonzero(~good)
    bad = np.repeat(lose, quality.PAIRS)
    d = z[win[np.random.default_rng(5).integers(0, len(win), len(bad))]] - z[bad]
    w = np.zeros(quality.FEATURES)
    step = 1 / (0.25 * np.linalg.eigvalsh(d.T @ d / len(d)).max() + quality.RIDGE)
    for _ in range(20_000):
        w -= step * (quality.RIDGE * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0))
    assert np.allclose(model.weights, w, atol=1e-4)
    strength = z @ w
    wrong = lambda cut: (strength[good] < cut).mean() + (strength[~good] >= cut).mean()
    assert wrong(model.cut) <= min(wrong(c) for c in np.quantile(strength, np.linspace(0, 1, 1001))) + 0.02
    shift = math.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-(4 * (strength - model.cut) / strength.std() + shift))), atol=1e-3)


def test_quality_holds_out(spark):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").join(lab, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


# 4 line dedup


def test_line_dedup(spark, odd_docs, no_docs):
    out = line_dedup.drop_recurring(odd_docs)
    assert set(out.columns) == set(odd_docs.columns)
    got = {r.doc_id: r for r in out.select("doc_id", "text", F.col("n_lines").alias("l"), F.col("n_dropped").alias("d"), "n_chars").collect()}
    assert got[10].text.count("shared by many") == 1 and "shared by many" not in got[11].text
    assert got[11].text == "last words of eleven" and got[11].n_chars == len("last words of eleven")
    assert got[1].text is None and got[1].l == 0 and got[2].text == "" and got[2].l == 1
    assert got[9].text.startswith("über") and got[12].d == 0
    assert line_dedup.drop_recurring(no_docs).count() == 0


def test_line_templates_generalise_fields(spark):
    lines = [f"connection from host {i}.example.com port {7 * i} closed after a while by the peer" for i in range(5)]
    near = "the quick brown fox jumps over one lazy dog and then it sleeps until the {} morning comes again"
    rows = [(i, f"{chr(97 + i) * 3} begins a text of its own that no other document has\n{lines[i]}\n{near.format('abcde'[i])}") for i in range(5)]
    got = by_id(line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[0].n_dropped == 0
    assert all(got[i].n_dropped == 2 and got[i].text.endswith("no other document has") for i in range(1, 5))


def test_line_dedup_of_very_many_sentences(spark):
    shared = "This sentence of ten words is found in both documents."
    own = "A first sentence of its own. And then a second one."
    rows = [(1, shared), (2, "b. " * (1 << 20) + shared + "\n" + own)]
    got = by_id(line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[2].n_dropped == 1 and got[2].text == ("b. " * (1 << 20)).strip() + "\n" + own


def test_line_with_unit_separators_keeps_them(spark):
    shared = "This sentence of ten words is found in both documents."
    rows = [(1, shared), (2, f"own\x1fwords here. {shared} more\x1fwords there.")]
    got = by_id(line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[2].text == "own\x1fwords here. more\x1fwords there."


def test_line_families_behind_a_dominant_line(spark):
    """Two templates of equal length and opening, of which the other one is found more often."""
    main = "please see our terms of use for what is allowed here today"
    lines = {i: f"please see our {w} and tell all your friends about this site" for i, w in enumerate(("cat", "dog", "owl"))}
    rows = [(i, f"{main}\n{chr(97 + i) * 3} is only here") for i in range(10, 14)] + [(i, f"{x}\n{chr(97 + i) * 3} is only here") for i, x in lines.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(line_dedup.drop_recurring(docs))
    assert {i for i, r in got.items() if r.n_dropped} == {1, 2, 11, 12, 13} and got[0].text.startswith(lines[0])


def test_passages_amid_sentences(spark, odd_docs, no_docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeinrstuo") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    short = " ".join(f"{word()} {word()}." for _ in range(30))
    own = {i: [" ".join(word() for _ in range(20)) for _ in range(2)] for i in range(5)}
    texts = {i: f"{own[i][0]} {passage if i < 3 else short}\t{own[i][1]}" for i in own} | {5: " \n " + passage, 6: None, 7: ""}
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = by_id(line_dedup.drop_passages(docs))
    assert all(got[i].text == texts[i] for i in (0, 3, 6, 7))
    for i in (1, 2, 4):
        assert got[i].text.startswith(own[i][0]) and got[i].text.endswith(own[i][1]) and got[i].n_chars == len(got[i].text)
        assert len(got[i].text.split()) <= 40 + 20
    assert len(got[5].text.split()) <= 15
    odd = line_dedup.drop_passages(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count() and line_dedup.drop_passages(no_docs).count() == 0


# 5 language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 10), (1, 5), (5, 5), (1000, 10**6), (1000, 1 << 64), (300, 50)):
        v = np.sort(rng.integers(0, min(u, (1 << 64) - 1), n, dtype=np.uint64))
        data = lm.EliasFano.of(v, u).to_bytes()
        back, used = lm.EliasFano.from_bytes(memoryview(data))
        assert used == len(data) and (back.values() == v).all()
        if n and u < 1 << 60:
            at = rng.integers(0, n, 200)
            assert (back.access(at) == v[at]).all()
            wanted = np.concatenate([v, rng.integers(0, u, 300, dtype=np.uint64), [np.uint64(u - 1), np.uint64(0)]])
            found = back.find(wanted)
            assert ((found >= 0) == np.isin(wanted, v)).all() and (v[found[found >= 0]] == wanted[found >= 0]).all()


def test_memory_of_a_level():
    """A level's coded successors take under 4 bytes each where ids of 8 bytes would do; reading decodes none of it."""
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 200_000 * 100_000, 1_000_000, dtype=np.uint64))
    ef = lm.EliasFano.of(v, 200_000 * 100_000)
    assert len(ef.low) + len(ef.high) < 4 * len(v)
    ef.find(v[:10])
    assert ef._words.nbytes + ef._ones.nbytes + ef._zeros.nbytes < len(v)


def brute_lm(texts, held):
    tok = {i: [*tokens(t), "\0end"] for i, t in texts.items()}
    c = [collections.Counter() for _ in range(3)]
    for i, t in tok.items():
        if not held[i]:
            for k in range(3):
                c[k].update(tuple(t[j : j + k + 1]) for j in range(len(t) - k))
    n, v = sum(c[0].values()), len(c[0])

    def p(h, w):
        if not h:
            return (c[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        low, seen = p(h[1:], w), c[len(h) - 1][h]
        share = lm.SHORTER[len(h) - 1]
        return (1 - share) * c[len(h)][(*h, w)] / seen + share * low if seen else low

    out = {}
    for i, t in tok.items():
        base = sum(math.log10(p((), w)) for w in t)
        out[i] = (len(t), sum(c[0][(w,)] > 0 for w in t), n, base, sum(math.log10(p(tuple(t[max(0, j - 2) : j]), w)) for j, w in enumerate(t)))
    return out


def test_language_model(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for i in range(80)} | {80: None, 81: "ZZ zz qq"}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    docs = spark.createDataFrame([(i, t, held[i]) for i, t in texts.items()], "doc_id long, text string, held boolean")
    wanted = brute_lm(texts, held)
    for block_bytes, grams in ((600, 50), (1 << 20, 10**6)):
        got = by_id(lm.score_documents(docs, block_bytes=block_bytes, bucket_grams=grams))
        for i, (n, known, total, base, score) in wanted.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[i])
            assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) <= 0.001 * n
    odd = lm.score_documents(odd_docs.select("doc_id", "text", F.lit(False).alias("held"))).collect()
    assert len(odd) == odd_docs.count() and {r.n_tokens for r in odd if r.doc_id in (1, 2, 3)} == {1}
    none = lm.score_documents(docs.withColumn("held", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in none)
    assert lm.score_documents(no_docs.select("doc_id", "text", F.lit(False).alias("held"))).count() == 0


def test_language_model_of_one_row_many_times(spark, monkeypatch):
    """Copies of a row are one row of a block, count as often as they stand, and all come back."""
    monkeypatch.setattr(lm, "COPIES", 7)
    texts = {i: f"alpha beta w{i % 9} gamma w{i % 4} w{i % 3}" for i in range(40)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    held[3], held[4] = False, True
    times = {3: 500, 4: 300, 5: 2}
    rows = [(i, t, held[i]) for i, t in texts.items() for _ in range(times.get(i, 1))] + [(None, None, False)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(5)
    block_bytes = 4_000
    rows_of, _, repeated = lm.folded(docs, block_bytes)
    assert repeated and {(r.doc_id, r.copies) for r in rows_of.where("copies > 1").collect()} == {(3, 500), (4, 300), (None, 200)}
    # each row by itself, under ids of its own, is what the brute-force model learns from
    wanted = brute_lm({j: t for j, (_, t, _) in enumerate(rows)}, {j: h for j, (_, _, h) in enumerate(rows)})
    of = {i: wanted[j] for j, (i, _, _) in enumerate(rows)}
    got = lm.score_documents(docs, block_bytes=block_bytes, bucket_grams=50).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _, _ in rows)
    for r in got:
        n, known, total, base, score = of[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) <= 0.001 * n


def test_counts_of_any_size_are_packed():
    for counts in ([], [0, 5, 70_000], [1, 2**32 - 1], [3, 2**32, 2**45]):
        data = lm._packed(np.array(counts, np.int64))
        back, used = lm._unpacked(memoryview(data + b"more"))
        assert back.tolist() == counts and used == len(data)


# 6 personal data

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text)]
    found += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in PATTERNS[2].finditer(text):
        d = re.sub("[ -]", "", m[0])
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PATTERNS[3].finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..11 2-+()_é9") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    long = "1" * 200_000 + "." + "a" * 200_000 + "@"
    assert pii.base_spans(long) == []


def test_personal_data(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.trained(pii.labelled_sentences())
    told = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_personal(docs, model).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert set(told(base).split(",")) <= set(r.spans.split(","))
    fused = spark.createDataFrame([(1, "thing in the Rely of thth +1 (605) 555-9305 4078918989542222 on thwh hawh and then")], "doc_id long, text string")
    r = pii.find_personal(fused, model).first()
    assert r.n_card == 0 and "card:" in r.spans and r.n_added >= 1
    odd = pii.find_personal(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(r.spans == "" for r in odd)
    assert pii.find_personal(no_docs, model).count() == 0
    assert pii.find_personal(fused, pii.trained([])).first().n_added == 0


def added_figures(model, seed):
    """Precision and recall of the added spans on sentences of another seed, and by kind how many of those due are found."""
    hit = found = due = 0
    for text, spans in pii.labelled_sentences(500, seed):
        block = next(words.blocks(pa.array([text])))
        w = pii.Words(block)
        base = pii.base_spans(text)
        more = pii.added_spans(w, model.decode(w), 0, text, base)
        want = {s for s in spans if not any(a < s[2] and s[0] < b for a, _, b in base)}
        hit, found, due = hit + len(want & set(more)), found + len(more), due + len(want)
    return hit / found, hit / due


def test_added_spans_are_right():
    began = time.perf_counter()
    model = pii.trained(pii.labelled_sentences())
    took = time.perf_counter() - began
    precision, recall = added_figures(model, 2)
    assert precision >= 0.9 and recall >= 0.85, (precision, recall)
    assert took < 20


def test_crf_gradient(monkeypatch):
    """With a step taken, the likelihood of the labels rises; posteriors by brute force on one window."""
    monkeypatch.setattr(pii, "STEPS", 1)
    rows = [("call 605-555-9305 now", [(5, 3, 17)])] * 2
    model = pii.trained(rows)
    w = pii.Words(next(words.blocks(pa.array([rows[0][0]]))))
    e = model.evidence(model.rows(w.shape, w.columns))
    assert e[1].argmax() == 4 and e[0].argmax() == 0 == e[2].argmax()


@pytest.mark.parametrize("seed", range(12))
def test_crf_decodes_the_best_path(seed):
    rng = np.random.default_rng(seed)
    model = pii.CRF()
    model.learned = True
    model.tables = [rng.normal(0, 1, (1, 5)), *[rng.normal(0, 1, (w, 5)) for w in pii.WIDTHS]]
    model.tables[3][1, 0] += seed  # plain words are more and more surely none
    model.moves = rng.normal(0, 1, (5, 5)) + 2 * np.eye(5) * (seed % 3)
    for text in ("a 1 b@c +2 (3)", "x", "9.9 Q q 1-1 12 abc", "a b 1-1 c 2-2", "1-1 a b c d e", "a b c d 3"):
        block = next(words.blocks(pa.array([text])))
        w = pii.Words(block)
        e = model.evidence(model.rows(w.shape, w.columns))
        paths = [()]
        for _ in range(len(e)):
            paths = [(*p, k) for p in paths for k in range(5)]
        score = lambda p: sum(e[i, k] + model.moves[q, k] for i, (q, k) in enumerate(zip((0, *p), p))) + model.moves[p[-1], 0]
        best = max(paths, key=score)
        wanted = best if score(best) - score((0,) * len(e)) >= pii.MARGIN else (0,) * len(e)
        # segments between settled words are judged by themselves, so a path may be kept in part
        got = tuple(model.decode(w))
        settled = model.settled(e[:, 0] - e[:, 1:].max(1), w.offsets)
        assert all(best[i] == 0 for i in np.flatnonzero(settled))
        assert got == wanted if not settled.any() else all(g in (0, x) for g, x in zip(got, best, strict=True))


# 7 decontamination


def brute_hits(text, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOW))
    doc, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


def test_fm_index():
    rng = np.random.default_rng(0)
    for n, s in ((0, 1), (7, 3), (50, 2), (500, 5), (300, 1)):
        t = np.append(rng.integers(1, s + 1, n), 0)
        order = decontaminate.suffix_order(t, s + 1)
        assert list(order) == sorted(range(n + 1), key=lambda i: list(t[i:]))
        index = decontaminate.FMIndex(t, s + 1)
        for size in (1, 2, 3):
            for p, a, b in zip(phrases := rng.integers(1, s + 1, (20, size)), *index.ranges(phrases)):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n + 1 - size) if list(t[i : i + size]) == list(p)]


def test_decontaminate(spark, odd_docs, no_docs):
    rng = random.Random(4)
    phrase = lambda n: " ".join(rng.choice(("aa", "b1", "Cc", "dé")) for _ in range(n))
    items = [(i, phrase(rng.choice((3, 12, 13, 14, 20)))) for i in range(12)] + [(90, None), (91, "...")] + [(92, "one two")]
    texts = {i: " ".join([phrase(rng.randint(0, 30)), rng.choice(items)[1] or "", phrase(5)]) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 30):  # many blocks of items, each seen in turn
        got = by_id(decontaminate.find_hits(docs, bench, block_bytes=size).withColumn("hit", decontaminate.n_hit()))
        for i, t in texts.items():
            assert (got[i].n_words, got[i].hit, got[i]["items"]) == brute_hits(t, items)
    odd = decontaminate.find_hits(odd_docs, bench)
    rows = {r.doc_id: r for r in odd.collect()}
    assert odd.count() == odd_docs.count() and odd.columns[-3:] == ["n_words", "spans", "items"]
    assert rows[7]["items"] == ["92"] and rows[1].n_words == 0 and rows[3].n_words == 0
    assert decontaminate.find_hits(no_docs, bench).count() == 0
    none = decontaminate.find_hits(docs, bench.where("false"))
    assert none.where(F.size("items") > 0).count() == 0 and none.count() == 60


def test_decontaminate_items_longer_than_a_block(spark):
    """Pieces of a long item share its windows; many blocks are stored on the way; nothing is lost or added."""
    rng = random.Random(8)
    long = " ".join(rng.choice(("ähm", "B2", "cc", "DD", "e")) for _ in range(300))
    words_of = long.split()
    for limit in (40, 200, 1_000, 10_000):
        parts = [p.split() for p, _ in decontaminate.pieces(long, limit, 13)]
        got = {tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)}
        assert got == {tuple(words_of[i : i + 13]) for i in range(288)} and all(len(p) >= 13 for p in parts)
    assert [p for p, _ in decontaminate.pieces("a b", 2, 13)] == ["a b"] and list(decontaminate.pieces("....", 2, 13)) == []
    items = [(1, long), (2, "one two three"), (3, None), (4, "..." * 200), (5, " ".join(words_of[100:140]))]
    texts = {i: " ".join([f"x{i}", *words_of[9 * i : 9 * i + rng.randint(5, 40)], "one two three"[: 13 if i % 2 else 7]]) for i in range(25)}
    docs = spark.createDataFrame([*texts.items(), (99, long)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.find_hits(docs, bench, block_bytes=150).withColumn("hit", decontaminate.n_hit()))
    for i, t in [*texts.items(), (99, long)]:
        assert (got[i].n_words, got[i].hit, got[i]["items"]) == brute_hits(t, items)


# 8 token counts


def test_rollup(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rows = lambda *r: spark.createDataFrame(list(r), "source string, lang string, tokenizer_version string, docs long, tokens long, batch string")
    rollup.commit("1", rows(("a", "en", "v", 1, 10, "z"), ("a", "en", "v", 1, 5, "z"), (None, None, "v", 1, 7, "z")))
    rollup.commit("2", rows(("a", "en", "v", -1, -5, "z"), (None, None, "v", -1, -7, "z")))
    for _ in range(2):
        rollup.commit("3", rows(("a", "en", "v", 0, 3, "z")))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 13)]


def test_rollup_of_lost_writes_and_compaction(spark, tmp_path, monkeypatch):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rows = lambda *r: spark.createDataFrame(list(r), "source string, lang string, tokenizer_version string, docs long, tokens long")
    assert rollup.totals().count() == 0
    rollup.commit("a/b", rows(("a", "en", "v", 1, 10)))
    with monkeypatch.context() as m:  # the writer is lost between its sums and the manifest
        m.setattr(token_counts.Rollup, "_swap", lambda *a: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            rollup.commit("a/b", rows(("a", "en", "v", 1, 99)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 10)]
    rollup.commit("empty", rows())
    rollup.compact()
    assert rollup.commit("a/b", rows(("a", "en", "v", 1, 10))) is False
    assert rollup.commit("more", rows(("a", "en", "v", 1, 1))) is True
    rollup.compact()
    assert [tuple(r) for r in token_counts.Rollup(spark, str(tmp_path / "r")).totals().collect()] == [("a", "en", "v", 2, 11)]


def test_token_counts_of_odd_rows(spark, no_docs):
    assert token_counts.kept_up(no_docs).totals().count() == 0
    rows = [(1, "a", "en", "a !!! b"), (None, "a", "en", "a !!! b"), (None, "a", "en", "c"), (None, "a", "en", "c"), (2, None, None, None), (3, "a", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.kept_up(docs).totals().where("tokenizer_version = 'words'").collect()}
    assert got == {("a", "en"): (4, 4), (None, None): (1, 0)}


def test_token_counts(spark, odd_docs, no_docs):
    got = by_id(token_counts.with_token_counts(odd_docs.drop("n_tokens").withColumn("n_tokens", F.lit("clash"))))
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[7].n_tokens == got[8].n_tokens > 0
    assert token_counts.with_token_counts(no_docs).count() == 0


def test_token_counts_of_long_runs(spark, monkeypatch):
    """Runs of a million, and shorter ones counted both ways."""
    path = token_counts.Path(token_counts.TOKENIZER)
    encoder = token_counts._encoder(path.stem, path.read_bytes())
    shapes = ["x" + " " * 300 + "y", " " * 250, "a\n" + "\n " * 130 + "b c", "\u00a0" * 220 + "!", "a" + " " * 201, " " * 400 + "q" + "\t" * 300 + "r s", "", "ab cd"]
    whole = [len(encoder.encode_ordinary(t)) for t in shapes]
    monkeypatch.setattr(token_counts, "LONG_BLANKS", 200)
    monkeypatch.setattr(token_counts, "_BLANK_RUN", re.compile(r"\s{200,}"))
    assert [token_counts.n_tokens(encoder, t) for t in shapes] == whole
    monkeypatch.undo()
    n = 1_000_000
    texts = [" " * n + "a", "a" * n, "!" * n, "\n" * n + "b", "ab " * (n // 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_tokens for r in token_counts.with_token_counts(df).collect()}
    assert got[0] == len(encoder._encode_single_piece(" " * (n - 1))) + len(encoder.encode_ordinary(" a"))
    assert all(got[i] == len(encoder.encode_ordinary(texts[i])) for i in (1, 2, 4)) and got[3] > 0


def test_token_counts_query(spark):
    import base64

    import tiktoken

    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.TOKENIZER, "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first, wanted = {}, collections.defaultdict(lambda: [0, 0])
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    for r in rows:
        if first.setdefault(r.text, r.doc_id) != r.doc_id:
            continue
        bpe = len(encoder.encode_ordinary(re.sub(token_counts.RUNS, "", r.text)))
        for version, n in (("byte_bpe_50k", bpe), ("words", len(WORD.findall(re.sub(token_counts.RUNS, "", r.text))))):
            wanted[r.source, r.lang, version][0] += 1
            wanted[r.source, r.lang, version][1] += n
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in token_counts.op8_token_counts(spark, sf).collect()}
    assert got == dict(wanted)


# 9 mixing


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        t = {s: left * weight[s] / w for s in open_}
        if not (over := [s for s in t if t[s] > 2 * size[s] + 1e-9]):
            return fixed | t
        fixed |= {s: 2.0 * size[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "ä", None, "Z", "c"][: 2 + seed]), " ".join(["x"] * rng.randint(0, 12)) if i % 17 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += len(tokens(t))
    wanted, taken = brute_targets(size), collections.Counter()
    first = by_id(mixing.mix(docs))
    for i, s, t in rows:
        r = first[i]
        assert (r.size, r.source_size) == (len(tokens(t)), size[s]) and r.target == pytest.approx(wanted[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in size)
    again = by_id(mixing.mix(docs.repartition(7)))
    assert {i: r.taken for i, r in first.items()} == {i: r.taken for i, r in again.items()}


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    size = {f"host{i}.example": rng.choice((0, 1, 5, 40, 1000, 10**6)) for i in range(500)} | {None: 77}
    totals = spark.createDataFrame([(s, n, 1) for s, n in size.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.source_targets(totals.repartition(3), mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS).collect()}
    wanted = brute_targets(size)
    assert len(got) == 501 and all(got[s] == pytest.approx(wanted[s], abs=1e-6) for s in size)


def test_quality_weights_follow_the_classifier(spark):
    """What the rule weighs less the trained classifier scores less, and they agree on most documents."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", mixing.n_words(F.col("text")))
    weight = docs.select("doc_id", mixing.quality_weight(F.col("text"), F.col("size")).alias("w"))
    rows = weight.join(quality.op3_quality(spark, sf), "doc_id").collect()
    by_weight = {w: [r.score for r in rows if r.w == w] for w in (1.0, 2.0, 4.0)}
    means = [np.mean(v) for v in by_weight.values()]
    assert all(by_weight.values()) and means[0] < 0.5 and means[1] < 0.5 and means[2] > 0.7
    assert np.mean([(r.w == 4) == (r.score >= 0.7) for r in rows]) >= 0.9


def test_quality_weights(spark):
    texts = ["plain words of some kind", "LOUD WORDS HERE", "a|b c!! d&& e%", "THE!! A!! AS!!", "x" * 40, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.w for r in df.select(mixing.quality_weight(F.col("text"), mixing.n_words(F.col("text"))).alias("w")).collect()]
    assert got == [4.0, 2.0, 2.0, 1.0, 2.0, 2.0, 2.0]


def test_mixing_odd(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, keep=("key", "text")).collect()
    assert len(got) == odd_docs.count() and all(r.taken <= 2 * r.size and r.key == "z" for r in got)
    assert mixing.mix(no_docs).count() == 0
    wordless = mixing.mix(odd_docs.where("doc_id < 4")).collect()
    assert all(r.target == 0 and r.taken == 0 for r in wordless)


# 10 nearest neighbours


def brute_nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    return [(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


@pytest.mark.parametrize(("n", "scaled", "chunk"), [(2500, False, 4096), (1500, True, 4096), (600, False, 3)])
def test_nearest(spark, n, scaled, chunk):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24)).astype(np.float32).astype(float)
    x /= 1 if scaled else np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[6] = x[0]
    ids = np.arange(n)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, cell=chunk, query_cell=chunk).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for q in range(0, n, 100):
        want = brute_nearest(x, ids, q)
        hit += len({v for v, _ in got[q]} & {v for v, _ in want})
        total += len(want)
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(np.sqrt(((x[v] - x[q]) ** 2).sum()), rel=1e-12) for v, s in got[q])
    assert hit >= 0.9 * total
    assert [v for v, _ in got[0][:2]] == [5, 6]


@pytest.mark.parametrize("n", [1, 2, 4, 8, 11, 12])
def test_few_vectors_are_all_found(spark, n):
    """Fewer than ten candidates, one of them opposite to the query: all are due."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16))
    x[-1] = -x[0] if n > 1 else x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(v, pytest.approx(s, rel=1e-12)) for v, s in brute_nearest(x, np.arange(n), 0)]


def test_nearest_of_clusters_and_copies(spark, monkeypatch):
    """Small cells, shards and blocks; a third of all vectors equal, of which the least ids are due."""
    monkeypatch.setattr(ann, "SHARD", 500)
    monkeypatch.setattr(ann, "NEAR", 1000)
    monkeypatch.setattr(ann, "BLOCK", 3)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.normal(size=(3000, 32))
    x[:1000] = x[0]
    x[2900] = 100 * rng.normal(size=32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = {q: [v for v, _ in brute_nearest(x, np.arange(3000), q)] for q in range(0, 3000, 100)}
    assert all(got[q] == want[q] for q in range(0, 1000, 100)) and all(len(v) == 10 for v in got.values())
    assert sum(len({*got[q]} & {*want[q]}) for q in want) >= 0.9 * 300


def test_hadamard():
    for width in (2, 8, 16, 64):
        h = [[(-1) ** bin(i & j).count("1") for j in range(width)] for i in range(width)]
        x = np.random.default_rng(width).normal(size=(5, width)).astype(np.float32)
        assert np.allclose(ann.hadamard(x.copy()), x @ np.array(h), atol=1e-4)


def test_probes_order_codes_by_what_they_lose():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 6))
    h = ann.CrossPolytope(6, 2, 2, float(np.linalg.norm(x, axis=1).max()))
    for t in range(2):
        codes = h.probes(x, t, 40)
        assert (codes[:, 0] == h.codes(x, t)).all()
        y = h.lifted(x)
        lost = []
        for r in range(2):
            a = h.rotated(y, t, r)
            a = np.concatenate([a, -a], 1)
            lost.append((a.max(1, keepdims=True) - a) ** 2)
        total = lost[0][:, :, None] + lost[1][:, None, :]
        for i in range(5):
            mine = total[i][codes[i, :, 0], codes[i, :, 1]]
            assert (np.diff(mine) >= -1e-6).all() and mine[-1] <= np.sort(total[i].ravel())[39] + 1e-6


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 0.1]), (9, [5.0, 0.1]), (None, [1.0, 1.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("z"))
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 9), (0, 3, 100), (100, 1, 1), (100, 2, 9), (100, 3, 0)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
