"""Text and links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.pages import in_pages

HREF = 'href="([^"]*)"'


def text_summary(pages: DataFrame, spec: str | None = None) -> DataFrame:
    """(doc_id, pages_scanned, characters) of the pages in a specification."""
    chosen = pages.where(in_pages(F.col("page"), spec))
    return chosen.groupBy("doc_id").agg(F.count("*").alias("pages_scanned"), F.sum(F.length("text")).cast("long").alias("characters"))


def html_links(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, link_ord, uri) of a page's addresses in their order; empty ones are left out."""
    found = F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("link_ord", "uri")
    return pages.select(F.col(doc_id).cast("string").alias("doc_id"), found).where("uri is not null and uri <> ''")
