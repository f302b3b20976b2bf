"""Paged views of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a small table that a task makes files, pages or lists of, about.
TASK_ROWS = 5000


def spread(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of a small table, dealt by ``key`` (hardly ever repeated) to tasks of about ``task_rows``: a scan makes few
    tasks of few bytes, however much work each row is."""
    return rows.repartition(max(1, -(-rows.count() // task_rows)), key)


def line_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line of a text is a page; a null text has one empty page."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("no", "text")
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), lines).select("doc_id", (F.col("no") + 1).alias("page"), "text")


def turn_pages(turns: DataFrame, doc_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Each turn of a conversation is a page; turns count from 0."""
    return turns.select(F.col(doc_id).cast("string").alias("doc_id"), (F.col(turn) + 1).cast("int").alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def whole_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text is a document of one page."""
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.lit(1).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def documents_of(pages: DataFrame, path: Column | None = None) -> DataFrame:
    """documents(doc_id, path, filename, page_count) of a paged table."""
    counted = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    counted = counted.withColumn("path", F.col("doc_id") if path is None else path)
    return counted.select("doc_id", "path", F.regexp_replace("path", "^.*/", "").alias("filename"), "page_count")
