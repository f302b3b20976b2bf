"""Page plans: (pos, doc_id, page) relations that say which pages a new document holds, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chosen_pages(spark: SparkSession, pages: list[int]) -> DataFrame:
    """(pos, page) of a caller's list: the first of repeated pages counts, the order is kept."""
    distinct = list(dict.fromkeys(pages))
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(distinct)], "pos int, page int")


def select_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, new_page, page, text): the chosen pages of every document, renumbered in the chosen order.

    ``chosen`` comes from a caller's list, so it is as small as that list.
    """
    kept = pages.join(F.broadcast(chosen), "page")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return kept.select("doc_id", number.alias("new_page"), "page", "text")


def first_occurrences(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pos): each value at its first place."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def concatenated(pages: DataFrame, inputs: DataFrame) -> DataFrame:
    """(new_page, src_ord, doc_id, page, text): the documents of ``inputs`` (src_ord, doc_id) after one another.

    A document given twice comes twice. Page counts are summed over the inputs, not over pages, so no task sorts all
    pages.
    """
    counts = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    sized = inputs.join(counts, "doc_id")
    before = F.sum("pages").over(Window.orderBy("src_ord").rowsBetween(Window.unboundedPreceding, -1))
    starts = sized.select("src_ord", "doc_id", F.coalesce(before, F.lit(0)).alias("before"))
    return pages.join(starts, "doc_id").select((F.col("before") + F.col("page")).alias("new_page"), "src_ord", "doc_id", "page", "text")


def islands(pages: DataFrame) -> DataFrame:
    """(doc_id, spec): each document's pages as a compact list such as 1-3,7."""
    distinct = pages.select("doc_id", "page").distinct()
    run = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    runs = distinct.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    parts = F.array_sort(F.collect_list(F.struct("first", part.alias("part"))))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), ",").alias("spec"))
