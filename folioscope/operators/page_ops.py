"""Windows around pages and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import pages as pg
from folioscope.operators.search import first_pages, matching_pages


def _counted(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page").alias("pages"))


def windows(anchors: DataFrame, pages: DataFrame, before: int, after: int) -> DataFrame:
    """(doc_id, page): all pages within the window of an ``anchors`` row (doc_id, anchor), each once.

    The windows are written out and joined on equal page numbers, so there is no range join.
    """
    around = anchors.join(_counted(pages), "doc_id")
    around = around.where("anchor between 1 and pages")
    return around.select("doc_id", F.explode(pg.window_column(F.col("anchor"), F.col("pages"), before, after)).alias("page")).distinct()


def _span(reach: int) -> int:
    """Pages of a bucket that windows are merged in and joined by: few windows fit into one, whatever their width."""
    return min(4096, max(64, 4 * reach))


def intervals(anchors: DataFrame, before: int, after: int) -> DataFrame:
    """(doc_id, first, last): the union of the windows around ``anchors`` (doc_id, anchor), in ranges that do not touch.

    A sweep in two steps: within buckets of pages, then over the first and last range of each bucket only, so that a
    document of any length is no single group. There are never more rows than anchors.
    """
    reach = before + after + 1
    span = _span(reach)

    def swept(rows: DataFrame, *keys: str) -> DataFrame:
        """Rows (first, last) of anchors less than ``reach`` apart become one."""
        order = Window.partitionBy(*keys).orderBy("first", "last")
        opens = F.coalesce(F.col("first") - F.lag("last").over(order) > reach, F.lit(True))
        run = F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        tagged = rows.withColumn("opens", opens).withColumn("run", run)
        return tagged.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")

    points = anchors.select("doc_id", F.col("anchor").alias("first"), F.col("anchor").alias("last"), F.floor(F.col("anchor") / span).alias("bucket"))
    local = swept(points.distinct(), "doc_id", "bucket")
    whole = Window.partitionBy("doc_id", "bucket")
    edge = (F.col("first") == F.min("first").over(whole)) | (F.col("last") == F.max("last").over(whole))
    local = local.withColumn("edge", edge)
    joined = swept(local.where("edge").select("doc_id", "first", "last"), "doc_id")
    merged = joined.unionByName(local.where("not edge").select("doc_id", "first", "last"))
    return merged.select("doc_id", (F.col("first") - before).alias("first"), (F.col("last") + after).alias("last"))


def pages_within(pages: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """The rows of ``pages`` in a range of ``ranges`` (doc_id, first, last), which must not overlap.

    Ranges are joined by the buckets of pages they reach into, about one row for each; ``width`` is what most measure.
    """
    span = _span(width)
    reached = F.sequence(F.floor(F.greatest(F.col("first"), F.lit(0)) / span), F.floor(F.col("last") / span))
    spread = ranges.where("last >= 0").select(F.col("doc_id").alias("d"), "first", "last", F.explode(reached).alias("b"))
    tagged = pages.withColumn("__b", F.floor(F.col("page") / span))
    on = (F.col("doc_id") == F.col("d")) & (F.col("__b") == F.col("b")) & F.col("page").between(F.col("first"), F.col("last"))
    return tagged.join(spread, on).select(*pages.columns)


def context_of_page(pages: DataFrame, anchor: int, before: int = 1, after: int = 1) -> DataFrame:
    """(doc_id, anchor, page, text) around one page number, in every document that has it."""
    anchors = _counted(pages).where(F.col("pages") >= anchor).select("doc_id", F.lit(anchor).alias("anchor"))
    return windows(anchors, pages, before, after).join(pages, ["doc_id", "page"]).select("doc_id", F.lit(anchor).alias("anchor"), "page", "text")


def context_of_keyword(pages: DataFrame, keyword: str, before: int = 1, after: int = 1) -> DataFrame:
    """(doc_id, anchor, page, text) around the first page with the keyword."""
    anchors = first_pages(pages, keyword)
    around = windows(anchors, pages, before, after)
    return around.join(anchors, "doc_id").join(pages, ["doc_id", "page"]).select("doc_id", "anchor", "page", "text")


def matches_with_padding(pages: DataFrame, keywords: list[str], padding: int = 2, spec: str | None = None, case_sensitive: bool = False, whole_words: bool = True) -> DataFrame:
    """(doc_id, page): pages that match, with ``padding`` pages on either side; ``spec`` limits only where to look."""
    pg.window(1, 1, padding, padding)  # refuses what is no number of pages
    scope = pages.where(pg.in_pages(F.col("page"), spec))
    matched = matching_pages(scope, keywords, case_sensitive, whole_words).where("page >= 1").withColumnRenamed("page", "anchor")
    return pages_within(pages.select("doc_id", "page"), intervals(matched, padding, padding), 2 * padding + 1).distinct()
