"""Corpora read from trees, their summary, the classification of primary documents; discovery that joins before it explodes."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus as ops
from tidemark.operators import filings
from tidemark.sources import corpus as src
from tidemark.sources import listings


def put(root, name, text):
    at = root / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def root(tmp_path):
    """Below folders of the same name, with letters that patterns would take for theirs."""
    root = tmp_path / "corpus" / "a+(b)" / "corpus"
    put(root, "I/F/Metadata.JSON", json.dumps({"form": " 10-K ", "primary_document": "doc.htm", "ticker": "T"}))
    put(root, "I/F/index.json", json.dumps({"directory": {"name": "/d", "item": {"name": "doc.htm", "size": 1.25}}}).replace("1.25", "1.50"))
    put(root, "I/F/doc.htm", "<html>Form 10-K xbrli é")
    put(root, "I/F/corpus/corpus/x.bin", b"\xff\xfe plain")
    put(root, "I/G/metadata.json", json.dumps({"form": "8-K", "primary_document": "gone.htm"}))
    put(root, "J/H/x.xsd", "y" * 100)
    put(root, "J/H/a.txt", "Accession Number 1")
    put(root, "manifest.json", "{}")
    put(root, "I/manifest.json", "{}")
    return root


def test_tree_strips_its_root(spark, root):
    got = {r.path: r.length for r in src.tree(spark, str(root)).collect()}
    assert set(got) == {p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file()} and got["J/H/x.xsd"] == 100
    assert {r.path for r in src.tree(spark, f"file://{root}/").collect()} == set(got)
    plan = src.tree(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # names and sizes only


def test_corpus_from_a_tree(spark, root):
    corpus = src.from_tree(spark, str(root))
    units = {(r.issuer, r.filing): r for r in corpus.units.collect()}
    assert set(units) == {("I", "F"), ("I", "G"), ("J", "H")}
    assert units["I", "F"].files == ["Metadata.JSON", "corpus/corpus/x.bin", "doc.htm", "index.json"] and units["I", "F"].candidates == ["doc.htm"]
    meta = {r.filing: r for r in corpus.metadata.collect()}
    assert (meta["F"].form, meta["F"].ticker, meta["G"].primary_document) == (" 10-K ", "T", "gone.htm") and len(meta) == 2
    index = corpus.indexes.collect()
    assert [(r.filing, r.dir_name, r["items"][0]["name"], r["items"][0]["size"], r.error) for r in index] == [("F", "/d", "doc.htm", "1.50", None)]
    # two discoveries agree
    again = src.from_tree(spark, str(root))
    assert corpus.units.exceptAll(again.units).isEmpty() and again.units.exceptAll(corpus.units).isEmpty()


def test_texts_are_guarded_by_size(spark, root):
    got = {r.relative: r for r in src.texts(spark, str(root), max_bytes=99).collect()}
    assert (got["x.xsd"].content, got["x.xsd"].length) == (None, 100)
    assert got["corpus/corpus/x.bin"].content == "�� plain" and got["doc.htm"].content.endswith("é")
    only = src.texts(spark, str(root), src.any_case("metadata.json"))
    assert sorted(r.relative for r in only.collect()) == ["Metadata.JSON", "metadata.json"]
    assert "length" in src.texts(spark, str(root), max_bytes=99)._jdf.queryExecution().executedPlan().toString()


def test_summary_of_a_tree(spark, root):
    corpus = src.from_tree(spark, str(root))
    documents = src.path_parts(corpus.files.select(F.concat_ws("/", "issuer", "filing", "relative").alias("path"))).where(src.is_candidate(F.col("ext")))
    contents = documents.join(src.texts(spark, str(root)), ["issuer", "filing", "relative"])
    row = ops.summary(corpus.units, corpus.metadata, contents).first()
    assert (row.units, row.with_metadata, row.with_index, row.with_both, row.with_candidates) == (3, 2, 1, 1, 2)
    assert (row.forms, row.by_issuer) == ({"10-K": 1, "8-K": 1}, {"I": 2, "J": 1})
    assert row.by_class == {"html": 1, "text": 1, "likely_inline_xbrl": 1, "likely_filing_document": 2}
    none = ops.summary(corpus.units.where("false"), corpus.metadata.where("false"), contents.where("false")).first()
    assert none.units == 0 and none.forms == {} and none.by_class == {}
    # one pass: the pairs of all inputs are counted by one aggregation, then become a row
    plan = ops.summary(corpus.units, corpus.metadata, contents)
    assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 1


def test_primary_documents_are_classified(spark, root):
    corpus = src.from_tree(spark, str(root))
    chosen = ops.chosen_primary(corpus.metadata, corpus.units)
    got = {r.filing: r for r in ops.classified_primary(chosen, src.texts(spark, str(root))).collect()}
    assert (got["F"].kind, got["F"].inline_xbrl, got["F"].filing_like, got["F"].n_bytes, got["F"].problem) == ("html", True, True, 24, None)
    assert (got["G"].problem, got["G"].kind) == ("missing", None)
    assert (got["H"].chosen, got["H"].kind, got["H"].problem) == ("a.txt", "text", None)
    rows = spark.createDataFrame([("I", "1", "doc", ""), ("I", "2", "doc", "nothing"), ("I", "3", "doc", " <?xml ?>")], "issuer string, filing string, relative string, content string")
    named = rows.select("issuer", "filing", F.col("relative").alias("chosen"))
    assert [r.problem for r in ops.classified_primary(named, rows).orderBy("filing").collect()] == ["empty", "unclassified", None]
    assert [r.problem for r in ops.classified_primary(named, rows, unknown_counts=False).orderBy("filing").collect()] == ["empty", None, None]


def test_written_trees_are_read_alike(spark, tmp_path):
    rows = spark.createDataFrame([(f"I{i % 3}/F{i}/d{i}.htm", "é" * i) for i in range(1, 40)], "path string, content string").repartition(5)
    for _ in range(2):
        src.write_tree(rows, str(tmp_path / "t"))
    assert {r.path: r.length for r in src.tree(spark, str(tmp_path / "t")).collect()} == {f"I{i % 3}/F{i}/d{i}.htm": 2 * i for i in range(1, 40)}


@pytest.mark.parametrize("few", [0, 1000])
def test_discovery_joins_before_it_explodes(spark, monkeypatch, few):
    monkeypatch.setattr(filings, "WATCHED", few)
    doc = lambda cik, n: json.dumps({"cik": cik, "filings": {"recent": {"accessionNumber": [str(i) for i in range(n)] + [" "], "form": ["8-k", "10-K"] * n + ["8-K"], "filingDate": ["d"] * (n + 1), "primaryDocument": ["p"] * (n + 1), "acceptanceDateTime": ["t"]}}})
    documents = spark.createDataFrame([("a", doc("1", 3)), ("b", doc("2", 2)), ("c", doc("3", 1)), ("d", "broken"), ("e", None)], "ticker string, json string")
    watch = spark.createDataFrame([("0000000001", ["8-K"], True), ("0000000002", [], True), ("0000000003", [], False)], "cik string, allowed_forms array<string>, enabled boolean")
    got = filings.discovered(watch, documents)
    plain = filings.watched_filings(watch, listings.recent_filings(listings.submissions(documents)))
    rows = lambda df: sorted(tuple(r) for r in df.select("ticker", "cik", "accession", "form", "acceptance_datetime", "identity").collect())
    assert rows(got) == rows(plain)
    assert [(r[0], r[2], r[3], r[4]) for r in rows(got)] == [("A", "0", "8-K", "t"), ("A", "2", "8-K", ""), ("B", "0", "8-K", "t"), ("B", "1", "10-K", "")]


def test_dry_run_counts_each_repeat(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 1)], "identity string, n int")
    seen = spark.createDataFrame([("z",)], "identity string")
    fresh = lambda **how: filings.tagged(rows, seen, "n", **how).where("fresh").count()
    assert (fresh(dry_run=True), fresh()) == (3, 2)


ODD_INDEXES = [
    ('{"directory":{"name":"/d","parent-dir":"/p","item":[{"name":"b","type":"t","size":1.50},null,{"name":"A","size":"2"}]}}', ("/d", "/p", [("", ""), ("A", "2"), ("b", "1.50")], None)),
    ('{"directory":{"name":7,"item":{"name":"x","size":-0}}}', ("7", "", [("x", "-0")], None)),
    ('{"directory":{"name":"/d","item":[]}}', ("/d", "", [], None)),
    ('{"directory":{"name":"/d","item":"x"}}', ("/d", "", None, None)),
    ('{"directory":{"name":"/d","item":null}}', ("/d", "", None, "directory.item missing")),
    ('{"directory":{"name":"/d"}}', ("/d", "", None, "directory.item missing")),
    ('{"other":1}', ("", "", None, "directory missing")),
    ("broken", ("", "", None, "directory missing")),
    (None, ("", "", None, "directory missing")),
]


def test_index_documents_are_parsed_once(spark):
    """Lists once, single items twice, whatever asks for them: items, their number, a filter on the error."""
    documents = spark.createDataFrame([("I", f"F{i}", j) for i, (j, _) in enumerate(ODD_INDEXES)], "issuer string, filing string, json string").repartition(1)
    parsed = src.index_documents(documents)
    got = [(r.dir_name, r.parent_dir, None if r["items"] is None else [(i.name, i.size) for i in r["items"]], r.error) for r in parsed.orderBy("filing").collect()]
    assert got == [want for _, want in ODD_INDEXES]
    items = src.index_items(parsed)
    assert [(r.filing, r.position, r.name) for r in items.orderBy("filing", "position").collect()] == [("F0", 0, ""), ("F0", 1, "A"), ("F0", 2, "b"), ("F1", 0, "x")]
    for df in (items, parsed.select("filing", "dir_name", F.size("items"))):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json(") <= 2


def test_trees_are_listed_by_tasks(spark, root):
    """As Spark's own listing, without its way through the driver; hidden and empty files are left out, large ones not read."""
    put(root, "K/empty.txt", "")
    put(root, "K/L/.hidden/x.txt", "x")
    put(root, "K/L/_temporary/x.txt", "x")
    put(root, "K/L/_a=1/x.txt", "x")
    own = {(r.path, r.length) for r in src._files(spark, str(root)).select(src.below(spark, str(root)).alias("path"), "length").collect()}
    assert {tuple(r) for r in src.tree(spark, str(root)).collect()} == own and ("K/L/_a=1/x.txt", 1) in own
    corpus = src.from_tree(spark, str(root), max_bytes=50)
    for df in (src.tree(spark, str(root)), src.texts(spark, str(root), "[dD]o*.ht?"), corpus.files, corpus.metadata, corpus.indexes):
        assert "FileScan" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Location" not in plan
    assert [r.content for r in src.texts(spark, str(root), "[dD]o*.ht?").collect()] == ["<html>Form 10-K xbrli é"]
    assert {r.filing: r.form for r in corpus.metadata.collect()} == {"F": None, "G": "8-K"}


def test_discoveries_compared(spark):
    """Missing units count once, differing ones on both sides; no shuffle beyond those that made the units."""
    paths = lambda *p: src.units(src.path_parts(spark.createDataFrame([(x,) for x in p], "path string")))
    one, two = paths("I/F/a.htm", "I/F/b.htm", "I/G/a.htm", "I/H/a.htm"), paths("I/F/b.htm", "I/F/a.htm", "I/G/b.htm", "J/K/a.htm")
    row = ops.discoveries_compared(one, two).first()
    assert (row.units, row.differing) == (3, 4)
    assert tuple(ops.discoveries_compared(one.where("false"), two.where("false")).first()) == (0, 0)


def test_primary_looked_up_in_one_pass(spark):
    meta = spark.createDataFrame([("I", "F", "Doc.HTM"), ("I", "G", "gone"), ("I", "H", "gone"), ("I", "K", "gone"), ("I", "L", None)], "issuer string, filing string, primary_document string")
    items = spark.createDataFrame([("I", "F", "doc.htm"), ("I", "G", "a"), ("I", "G", "B"), ("I", "K", "a"), ("I", "L", "")], "issuer string, filing string, name string")
    known = spark.createDataFrame([("I", "K")], "issuer string, filing string")
    found = ops.primary_not_in_index(meta, items.withColumn("name", F.concat("name", F.lit(""))), known)
    assert [(r.issuer, r.filing, r.name) for r in found.collect()] == [("I", "G", "gone")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3  # items are read once
