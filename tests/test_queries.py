"""Every query with an oracle, at the smallest scale, against DuckDB on the same files."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    told = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, told.fetchall())


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.watched == row.ok + row.failed


def test_press_cards_of_a_very_long_page(spark):
    from pyspark.sql import functions as F

    from tidemark.sources.press import press_cards

    card = '<a class="newsreleaseconsolidatelink" href="/news/a-{0}.html"><h3>Headline {0}</h3></a>'
    pages = spark.createDataFrame([(1, card.format(1) + " " * (3 << 20) + card.format(2)), (2, None)], "page_id long, html string")
    got = press_cards(pages, F.lit("https://www.prnewswire.com")).select("headline").collect()
    assert sorted(r.headline for r in got) == ["Headline 1", "Headline 2"]


def _same(spark, duck, name, folder, pieces=1, **tables):
    """A query and its SQL over tables of which some are given, some the driver's."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        if t in tables:
            at = f"{folder}/{t}.parquet"
            tables[t].repartition(pieces).write.parquet(at)
            at += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    told = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, told.fetchall())


def test_records_are_numbered_by_time_then_id(spark, duck, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/events.parquet")
    again = events.unionByName(events.withColumn("event_id", F.col("event_id") + events.count()))
    _same(spark, duck, "append_records", tmp_path, events=again)


@pytest.fixture
def long_pages(spark):
    """Pages whose path is an id of eight bytes or more; two share it, on different hosts."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    k = F.col("page_id")
    return pages.withColumn("url", F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example.com/en/"), (F.floor(k / 4) + 100000).cast("string"), F.when(k % 2 == 0, "/?x=a-b").otherwise("")))


@pytest.mark.parametrize("name", ["pr_cards", "pr_events", "pr_new", "pr_summary", "body_events"])
def test_release_ids_cut_from_long_urls(spark, duck, tmp_path, long_pages, name):
    _same(spark, duck, name, tmp_path, pages=long_pages)


def test_bodies_of_an_id_that_pages_share(spark, duck, tmp_path, long_pages):
    """Its first page counts, whichever file of the stream comes first."""
    _same(spark, duck, "stream_body", tmp_path, pages=long_pages)


def test_a_round_is_one_try_however_many_files(spark, duck, tmp_path):
    """Documents in many files are written on as many."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents.repartition(12).write.parquet(f"{tmp_path}/many")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        many = spark.read.parquet(f"{tmp_path}/many")
        assert many.rdd.getNumPartitions() == 12
        _same(spark, duck, "stream_signal_retry", tmp_path, pieces=12, documents=many)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
