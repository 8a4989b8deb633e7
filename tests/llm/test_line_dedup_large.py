"""Line dedup of documents of very many lines, and passages of very short words."""

import random
import time

from pyspark.sql import functions as F

from tidemark.llm import line_dedup


def test_many_lines_that_all_go(spark):
    """Two documents of 200,000 lines of one template each: time grows with the lines, not with lines times drops."""
    n = 200_000
    text = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("the request number "), i.cast("string"), F.lit(" was answered by the server in time"))), "\n").alias("text"))
    docs = spark.range(2).select(F.col("id").alias("doc_id")).crossJoin(text)
    began = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n")).collect()}
    assert (got[0].n_lines, got[0].n_dropped) == (n, 0) and (got[1].n_lines, got[1].n_dropped, got[1].n) == (n, n, 0)
    assert time.monotonic() - began < 30


def test_many_lines_of_which_some_go(spark):
    """Against plain Python: whole lines, single sentences and untouched ones in turn."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghk") for _ in range(6))
    sentence = lambda: " ".join(word() for _ in range(9)) + "."
    shared = [sentence() for _ in range(5)]
    first = "\n".join(shared + [" ".join(shared[:2])])
    second, wanted = [], []
    for i in range(3000):
        own = [sentence(), sentence()]
        if i % 3 == 0:
            second.append(shared[i % 5])
        elif i % 3 == 1:
            second.append(" ".join([own[0], shared[i % 5], own[1]]))
            wanted.append(" ".join(own))
        else:
            second.append(own[0])
            wanted.append(own[0])
    docs = spark.createDataFrame([(1, first), (2, "\n".join(second)), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs).collect()}
    assert got[2].text == "\n".join(wanted) and got[2].n_dropped == 2000
    assert got[1].text == first and (got[3].text, got[3].n_lines, got[4].text, got[4].n_lines) == (None, 0, "", 1)


def test_passage_of_short_words(spark):
    """A passage of which many pieces make PASSAGE characters goes but for the first document."""
    rng = random.Random(7)
    passage = " ".join(rng.choice(["an", "or", "is", "us", "in", "as", "on", "er"]) for _ in range(120))
    own = lambda c: " ".join(c * rng.randrange(3, 9) for _ in range(60))
    texts = {1: f"{own('b')} {passage} {own('c')}", 2: f"{own('d')} {passage} {own('f')}", 3: own("g")}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in line_dedup.drop_passages(docs).collect()}
    assert got[1] == texts[1] and got[3] == texts[3]
    assert passage[60:-60] not in got[2] and len(got[2]) <= len(texts[2]) - len(passage) + 120
    assert got[2].startswith(texts[2][:100])
