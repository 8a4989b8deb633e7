"""Press-release list pages and document contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, extract_release_id, first_filled, first_text, parse_release_time, resolve_url

# fixed values: how a list page shows its releases
CARD = r'(?is)<a[^>]*class="[^"]*newsreleaseconsolidatelink[^"]*"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
HEADLINE = r"(?is)<h3[^>]*>(.*?)</h3>"
COMPANY = r'(?is)<a[^>]*class="[^"]*color-inherit[^"]*"[^>]*>(.*?)</a>'
PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"
DOCUMENT_BYTES = 4 << 20


def matches(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """A row per match of a pattern with two groups: pos, href, block."""
    found = lambda g: F.regexp_extract_all(html, F.lit(pattern), F.lit(g))
    cards = F.arrays_zip(found(1).alias("href"), found(2).alias("block"))
    return pages.select("*", F.posexplode(cards).alias("pos", "card")).select("*", F.col("card.href").alias("href"), F.col("card.block").alias("block")).drop("card")


def press_cards(pages: DataFrame, base: Column, *, html: str = "html", company: str = COMPANY, mode: str = "reference") -> DataFrame:
    """Releases of list pages; those without a headline or a URL are dropped."""
    rows = matches(pages, CARD, html)
    out = rows.select(
        "*",
        first_text(F.col("block"), HEADLINE).alias("headline"),
        resolve_url(base, F.col("href")).alias("release_url"),
        first_text(F.col("block"), company).alias("company"),
        parse_release_time(first_text(F.col("block"), PARAGRAPH), mode).alias("published_at"),
    )
    return out.where("headline <> '' and release_url <> ''").withColumn("release_id", first_filled(extract_release_id(F.col("release_url")), F.col("release_url")))


def guarded(documents: DataFrame, html: str = "html", max_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """Documents with n_bytes, an `error` for missing or too large ones, and the clean text of the others."""
    size = F.octet_length(html)
    error = F.when(F.col(html).isNull(), "document missing").when(size > max_bytes, F.concat(F.lit("document too large: "), size.cast("string"), F.lit(f" bytes > {max_bytes}")))
    return documents.withColumn("n_bytes", size).withColumn("error", error).withColumn("clean", F.when(error.isNull(), clean_text(F.col(html))))
