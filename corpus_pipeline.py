"""The training-data pipeline: languages, recurring lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet and read again for the next. All but the last return the columns of documents: extra columns pass through,
whatever their names, since a stage packs its row into one column before an operator adds columns of its own. Null and empty texts have no language and go in the first stage; repeated rows and ties are near
duplicates, of which one row stays; texts of any length are read whole; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontamination, jaccard_join, language_id, line_templates, packing
from folioscope.llm.shared import discard, small, table

#: Documents whose language scores below this are rejected: hardly above a guess among the learned languages.
LEAST_SCORE = 0.3
BROADCAST_ROWS = 500_000


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): what operators read, and the rest of the row in one column, which no name of theirs can meet."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", row.alias("row"))


def _unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows' own columns, some of them changed."""
    known = {"text": F.col("text"), **changed}
    return rows.select(*[(known[c] if c in known else F.col("row").getField(c)).alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters whose language is told with some confidence."""
    said = language_id.identify(_packed(docs), language_id.train(docs))
    return _unpacked(said.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines of recurring templates out of the texts, whatever their share; n_chars, if there, follows the text."""
    cleaned = line_templates.drop_recurring_lines(_packed(docs), whole=True)
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _unpacked(cleaned, docs.columns, **changed)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of similar texts: that of the smallest doc_id (nulls last), then of the smallest hash
    of the text. Rows are told apart by their own numbers, so rows that share an id, or have none, fall one by one."""
    numbered = table(_packed(docs).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = table(jaccard_join.jaccard_components(numbered, doc_id="__row").where("n_shingles > 0"), "found")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "__row")
    groups = found.groupBy("component_id").agg(F.count("*").alias("size")).where("size > 1").select("component_id")
    members = table(found.join(groups, "component_id").select(F.col("doc_id").alias("__row"), "component_id"), "members")
    ranked = numbered.select("__row", rank.alias("rank")).join(small(members, members.count(), BROADCAST_ROWS), "__row")
    first = table(ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.__row").alias("__row")), "first")
    dropped = table(members.join(first, "__row", "left_anti").select("__row"), "dropped")
    discard(found, members, first)
    return _unpacked(numbered.join(small(dropped, dropped.count(), BROADCAST_ROWS), "__row", "left_anti"), docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(decontamination.find_contamination(_packed(docs), benchmark).where(~F.col("contaminated")), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Language identification and packing have no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; returns the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
