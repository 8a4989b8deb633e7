"""Scalar functions against cases with known answers."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.sources.corpus import with_quoted_numbers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("320193", "0000320193"), ("0000320193", "0000320193"), (" cik 789019 ", "0000789019"), ("", ""), ("abc", ""), ("12345678901", "12345678901"), (None, "")])
def test_normalize_cik(spark, given, wanted):
    assert value(spark, t.normalize_cik(F.lit(given).cast("string"))) == wanted


def test_identity_and_url(spark):
    assert value(spark, t.filing_identity(F.lit("320193"), F.lit(" 0001-2 "))) == "0000320193:0001-2"
    assert value(spark, t.submissions_url(F.lit("1"))).endswith("CIK0000000001.json")


@pytest.mark.parametrize(
    ("href", "wanted"),
    [
        ("/a/b.html?x=1#y", "https://h.example.com/a/b.html?x=1#y"),
        ("a", "https://h.example.com/a"),
        ("//c.example.com/z", "https://c.example.com/z"),
        ("?q=1", "https://h.example.com?q=1"),
        ("#f", "https://h.example.com#f"),
        ("http://o.example.com/p", "http://o.example.com/p"),
        ("/a/../b/./c/..", "https://h.example.com/b/"),
        ("/../../x", "https://h.example.com/x"),
        ("bad\nlink", ""),
        (None, ""),
    ],
)
def test_resolve_url(spark, href, wanted):
    assert value(spark, t.resolve_url(F.lit("https://h.example.com"), F.lit(href).cast("string"))) == wanted


@pytest.mark.parametrize(("url", "wanted"), [("https://x.example.com/news/big-deal-302123456.html", "302123456"), ("https://x.example.com/news/short-1234567.html", ""), ("https://x.example.com/n-abcdefgh?q=1", "abcdefgh"), ("https://x.example.com", "")])
def test_release_id(spark, url, wanted):
    assert value(spark, t.extract_release_id(F.lit(url))) == wanted


@pytest.mark.parametrize(
    ("text", "mode", "wanted"),
    [
        ("May 10, 2026, 3:04 PM ET", "reference", "2026-05-10 15:04"),
        ("May 10, 2026, 3:04 PM ET", "eastern", "2026-05-10 19:04"),
        ("May 10, 2026, 08:30 ET", "reference", "2026-05-10 00:30"),
        ("May 10, 2026, 09:30 ET", "reference", None),
        ("May 10, 2026, 09:30 ET", "eastern", "2026-05-10 13:30"),
        ("January 2, 2026, 11:30 AM ET", "reference", "2026-01-02 11:30"),
        ("", "reference", None),
        ("soon", "reference", None),
    ],
)
def test_release_time(spark, text, mode, wanted):
    got = value(spark, F.date_format(t.parse_release_time(F.lit(text), mode), "yyyy-MM-dd HH:mm"))
    assert got == wanted


def test_clean_text(spark):
    html = "<html><script>var a='<p>';</style> x <ix:nonFraction a=1>5</ix:nonFraction>&amp;lt;&nbsp;<b>b</b>\t\n c&#39;s</html>"
    assert value(spark, t.clean_text(F.lit(html))) == "x 5 &lt; b c's"


@pytest.mark.parametrize(
    ("name", "content", "kind"),
    [("a.HTM", "", "html"), ("a.xsd", "", "xml"), ("a.txt", "<html", "text"), ("a", " <HTML x", "html"), ("a", "\n<?xml ?>", "xml"), ("a", "<xbrl>", "xml"), ("a", "z Accession Number", "text"), ("a.b/c", "z", "unknown"), ("", "", "unknown")],
)
def test_document_kind(spark, name, content, kind):
    assert value(spark, t.document_kind(F.lit(name), F.lit(content))) == kind


def test_trim_and_first_text(spark):
    assert value(spark, t.trim_unicode(F.lit("  　a b \t"))) == "a b"
    assert value(spark, t.first_text(F.lit("<h1>a<b>b</b> </h1><h1>c</h1>"), r"(?is)<h1[^>]*>(.*?)</h1>")) == "ab"
    assert value(spark, t.first_text(F.lit("none"), r"(?is)<h1[^>]*>(.*?)</h1>")) == ""


def test_rfc3339_and_relative_time(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert value(spark, t.rfc3339(at("2024-01-02 03:04:05.120"))) == "2024-01-02T03:04:05.12Z"
    assert value(spark, t.rfc3339(at("2024-01-02 03:04:00"))) == "2024-01-02T03:04:00Z"
    for s, wanted in (("2024-01-01 23:59:30", "30s ago"), ("2024-01-01 23:01:00", "59m ago"), ("2024-01-01 01:00:00", "23h ago"), ("2023-12-30 00:00:00", "3d ago")):
        assert value(spark, t.relative_time(at(s), at("2024-01-02 00:00:00"))) == wanted


def test_numbers_keep_their_text(spark):
    assert value(spark, with_quoted_numbers(F.lit('{"a": 1.50, "b": "x: 2.5, \\" 3", "c": [-1e5, null]}'))) == '{"a": "1.50", "b": "x: 2.5, \\" 3", "c": ["-1e5", null]}'
