"""Orders in which documents are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import naming
from folioscope.plans.ranking import bounds, bucket_of, ranked

#: Positions that are numbered in one task.
PLACES = 100_000


def natural_inputs(documents: DataFrame, name: str = "filename") -> DataFrame:
    """``documents`` with src_ord (from 1) in the natural order of their names."""
    keyed = documents.withColumn("__key", naming.natural_column(name))
    order = [F.col("__key"), F.col(name), F.col("doc_id")]
    key = naming.sortable(F.col("__key"))
    return ranked(keyed, order, bucket_of(key, bounds(keyed, key)), "src_ord").drop("__key")


def numbered_inputs(documents: DataFrame, name: str = "filename") -> DataFrame:
    """Documents named like 12_name, with src_ord by their number, then the natural order of the rest."""
    number, rest = naming.numeric_prefix(name)
    keyed = documents.withColumns({"number": number, "rest": rest}).where("number <> ''").withColumn("__key", naming.natural_column("rest"))
    figures = F.length("number")
    order = [figures, F.col("number"), F.col("__key"), F.col(name), F.col("doc_id")]
    key = F.concat(F.lpad(figures.cast("string"), 10, "0"), "number", naming.sortable(F.col("__key")))
    return ranked(keyed, order, bucket_of(key, bounds(keyed, key)), "src_ord").drop("__key")


def ignored_inputs(documents: DataFrame, name: str = "filename") -> DataFrame:
    """(doc_id, reason) of documents without a number in front."""
    number, _ = naming.numeric_prefix(name)
    return documents.where(number == "").select("doc_id", F.lit("no_numeric_prefix").alias("reason"))


def distinct_paths(documents: DataFrame, path: str = "path", pos: str = "pos") -> DataFrame:
    """(path_key, doc_id, path): paths that differ in case only are one document, named by the first."""
    keyed = documents.select(F.lower(path).alias("path_key"), F.struct(pos, path).alias("first"))
    least = keyed.groupBy("path_key").agg(F.min("first").alias("first"))
    numbered = ranked(least, [F.col("first").getField(pos)], F.floor(F.col("first").getField(pos) / PLACES), "number")
    return numbered.select("path_key", F.concat(F.lit("doc-"), F.col("number")).alias("doc_id"), F.col(f"first.{path}").alias("path"))
