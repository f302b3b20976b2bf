"""Keyword totals over documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import search
from folioscope.sources import files, tables

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving_documents(spark: SparkSession, directory: str) -> DataFrame:
    """(path, page, text, reason) of documents as they appear in a directory."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.[pP][dD][fF]").load(directory)
    return files.document_pages(found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"))


def arriving_texts(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """Line pages of Parquet tables of documents as they appear in a directory."""
    return tables.line_pages(spark.readStream.schema(schema).parquet(directory))


def running_totals(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, total) so far; use output mode complete or update. State holds one row a keyword."""
    return search.page_counts(pages, keywords).groupBy("keyword").agg(F.sum("n").alias("total"))
