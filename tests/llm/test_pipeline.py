"""The pipeline's stages on odd inputs, and its decisions against brute force on a small table."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, SF)
            assert out.columns[:5] == docs.columns, name
            assert out.count() <= rows.count()
            assert name == "mixing" or len(out.columns) == 5


CLASH = ("quality_score", "n_lines", "n_dropped", "n_words", "spans", "items", "size", "source_size", "target", "taken", "key", "keep", "a.b", "c0", "Rest_of_Row")


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_columns_beyond_those_of_documents_go_through(spark, name):
    """Whatever their names; only the mix's own four take the place of others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs
    for i, c in enumerate(CLASH):
        wide = wide.withColumn(c, F.concat(F.lit(f"{i}:"), F.col("doc_id")) if i % 2 else F.col("doc_id") * 100 + i)
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, wide, SF)
    kept = [c for c in CLASH if name != "mixing" or c not in pipeline.MIXED]
    assert out.columns == [*docs.columns, *kept, *(pipeline.MIXED if name == "mixing" else ())]
    rows = out.collect()
    assert rows and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect())
    for r in rows:
        for i, c in enumerate(CLASH):
            if c in kept:
                assert r[c] == (f"{i}:{r.doc_id}" if i % 2 else r.doc_id * 100 + i)
    if name == "mixing":
        assert all(0 < r.taken <= 2 * r.size for r in rows)


def test_run(spark):
    from tests.llm.test_operators import brute_components, brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = dict(pipeline.STAGES)
    good = stage["quality"](spark, docs, SF).cache()
    ids = {r.doc_id for r in good.collect()}
    assert sum((i in ids) == (q == 1) for i, q in labels.items()) >= 0.97 * len(labels)
    lines = stage["line_dedup"](spark, good, SF).cache()
    assert lines.count() == good.count()
    texts = {r.doc_id: r.text for r in lines.collect()}
    label, _ = brute_components(texts)
    single = stage["near_dup"](spark, lines, SF).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, x in label.items() if i == x)
    clean = {r.doc_id for r in stage["decontaminate"](spark, single, SF).collect()}
    for r in single.collect():
        n, hit, _ = brute_hits(r.text, items)
        assert (r.doc_id in clean) == (not (hit and 20 * hit >= n))
    mixed = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in mixed} <= clean and all(0 < r.taken <= 2 * r.size for r in mixed)


def test_near_dup_stage_takes_copies_of_four_fifths(spark):
    from tests.llm.test_operators import shingles

    base = [f"w{i}" for i in range(150)]
    texts = {}
    for n, changed in enumerate(((), (20, 60, 100), (10, 40, 70, 100, 130))):
        texts[n] = " ".join(f"e{i}" if i in changed else w for i, w in enumerate(base))
    near = [len(shingles(texts[0]) & shingles(texts[i])) / len(shingles(texts[0]) | shingles(texts[i])) for i in (1, 2)]
    assert 0.8 <= near[0] < 0.85 and near[1] < 0.8
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(pipeline.STAGES)["near_dup"](spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_mixing_stage_takes_each_row_without_id_by_itself(spark):
    """Equal rows without an id: the taken words are those of the mix, row by row."""
    from tidemark.llm import mixing

    rows = [(None, f"{'one two three ' * 4}", "en", "a", 56)] * 6 + [(None, "x y", "en", None, 3), (None, None, "en", "x y", None)]
    rows += [(i, "some words of another source here", "en", "b", 33) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs).where("taken > 0").collect())
    out = dict(pipeline.STAGES)["mixing"](spark, docs, SF).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in out) == wanted
