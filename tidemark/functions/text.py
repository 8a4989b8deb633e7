"""Scalar functions as native column expressions; no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the Unicode white space that trimming strips
BLANKS = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
TRIM_PATTERN = f"^[{BLANKS}]+|[{BLANKS}]+$"

# fixed values: tags and blocks that cleaning replaces by a blank, in this order
SCRIPT_STYLE = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
NAMESPACE_TAGS = r"(?is)</?(ix:[^>\s]+|xbrli:[^>\s]+|link:[^>\s]+|dei:[^>\s]+|us-gaap:[^>\s]+)[^>]*>"
ALL_TAGS = r"(?s)<[^>]+>"
# fixed value: tags taken out of what a pattern captured
CAPTURED_TAGS = r"(?is)<[^>]+>"
HTML_SPACE = r"[\t\n\f\r ]+"
# fixed values: the entities decoded, the ampersand last so that one pass is enough
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

# fixed values: what marks a document as inline XBRL, and as a filing
INLINE_MARKERS = ("xmlns:ix", "http://www.xbrl.org/2013/inlinexbrl", "ix:header", "xbrli", "sec/xbrl")
FILING_MARKERS = ("united states securities and exchange commission", "accession number", "form 10-k", "form 10-q", "form 8-k", "<sec-document>")
# fixed value: where a company's submissions document is found
SUBMISSIONS_URL = ("https://data.sec.gov/submissions/CIK", ".json")
# fixed values: layouts of press-release times; the first has a literal 08 for the hour, which stays 0
RELEASE_LAYOUTS = ("MMM d, yyyy, '08':mm 'ET'", "MMM d, yyyy, h:mm a 'ET'", "MMMM d, yyyy, h:mm a 'ET'")


def trim_unicode(x: Column) -> Column:
    return F.regexp_replace(x, TRIM_PATTERN, "")


def blank(x: Column) -> Column:
    """Null and empty text are both absent."""
    return F.coalesce(x, F.lit("")) == ""


def first_filled(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def normalize_cik(x: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", "").when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0"))


def filing_identity(cik: Column, accession: Column) -> Column:
    return F.concat(normalize_cik(cik), F.lit(":"), trim_unicode(F.coalesce(accession, F.lit(""))))


def submissions_url(cik: Column) -> Column:
    return F.concat(F.lit(SUBMISSIONS_URL[0]), normalize_cik(cik), F.lit(SUBMISSIONS_URL[1]))


def normalize_code(x: Column) -> Column:
    """Tickers and forms: trimmed, upper case."""
    return F.upper(trim_unicode(F.coalesce(x, F.lit(""))))


def first_text(x: Column, pattern: str) -> Column:
    """Group 1 of the first match, tags taken out, trimmed; empty without a match."""
    return trim_unicode(F.regexp_replace(F.regexp_extract(x, pattern, 1), CAPTURED_TAGS, ""))


def _without_dots(path: Column) -> Column:
    """A path with `.` and `..` segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, 10_000)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))),
    )
    tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))


def resolve_url(base: Column, href: Column) -> Column:
    """href against a bare origin such as https://host; empty where href can't be a URL."""
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    rooted = F.when(path == "", "").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    clean = F.when(F.concat(rooted, F.lit("/")).contains("/./") | F.concat(rooted, F.lit("/")).contains("/../"), _without_dots(rooted)).otherwise(rooted)
    return (
        F.when(href.isNull() | href.rlike(r"[\x00-\x1F\x7F]"), "")
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .otherwise(F.concat(base, clean, rest))
    )


def extract_release_id(url: Column) -> Column:
    """The last dash-separated piece of the path without .html, if it has eight bytes or more."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "-"), -1)
    piece = F.regexp_replace(last, r"\.html$", "")
    return F.when(F.octet_length(piece) >= 8, piece).otherwise("")


def parse_release_time(x: Column, mode: str = "reference") -> Column:
    """A press release's time. `reference` takes ET as UTC; `eastern` converts, and allows any hour in the first layout."""
    v = trim_unicode(F.regexp_replace(x, " ", " "))
    if mode == "eastern":
        local = F.coalesce(*[F.try_to_timestamp(v, F.lit(f"{m} d, yyyy, {h} 'ET'")) for m in ("MMM", "MMMM") for h in ("HH:mm", "h:mm a")])
        return F.to_utc_timestamp(local, "America/New_York")
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in RELEASE_LAYOUTS])


def decode_entities(x: Column) -> Column:
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def clean_text(html: Column) -> Column:
    """HTML to plain text: scripts, styles and tags to blanks, entities decoded, blanks collapsed."""
    for pattern in (SCRIPT_STYLE, NAMESPACE_TAGS, ALL_TAGS):
        html = F.regexp_replace(html, pattern, " ")
    return trim_unicode(F.regexp_replace(decode_entities(html), HTML_SPACE, " "))


def extension(path: Column) -> Column:
    """The last dot and what follows in the base name, lower case; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def document_kind(name: Column, content: Column) -> Column:
    return kind_of_lowered(name, F.lower(content))


def kind_of_lowered(name: Column, low: Column) -> Column:
    """As document_kind, for content in lower case."""
    ext = extension(name)
    return (
        F.when(ext.isin(".htm", ".html"), "html")
        .when(ext.isin(".xml", ".xsd"), "xml")
        .when(ext == ".txt", "text")
        .when(low.contains("<html"), "html")
        .when(low.rlike(rf"^[{BLANKS}]*(?:<\?xml|<xbrl)"), "xml")
        .when(low.contains("accession number"), "text")
        .otherwise("unknown")
    )


def contains_any(content: Column, markers: Sequence[str]) -> Column:
    return lowered_contains_any(F.lower(content), markers)


def lowered_contains_any(low: Column, markers: Sequence[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | low.contains(m)
    return found


def relative_time(ts: Column, now: Column) -> Column:
    s = F.floor(F.unix_micros(now) / 1_000_000 - F.unix_micros(ts) / 1_000_000)
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def strip_zeros(x: Column) -> Column:
    return F.regexp_replace(x, "^0+", "")


def without_dashes(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("-"), F.lit(""))


def rfc3339(ts: Column) -> Column:
    """UTC text with as many fractional digits as there are, under a UTC session."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ""), F.lit("Z"))
