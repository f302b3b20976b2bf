"""Keyword search over pages: hits, summaries, totals, corpus ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.errors import ValidationError
from folioscope.functions import keywords as kw
from folioscope.functions import naming
from folioscope.plans.ranking import bounds, bucket_of, ranked, steps

SORTS = ("path", "rank")


def page_counts(pages: DataFrame, keywords: list[str], case_sensitive: bool = False, whole_words: bool = True) -> DataFrame:
    """(doc_id, page, ord, keyword, n): every page and keyword, zeros included, in one pass over the pages."""
    counted = kw.counts("text", keywords, case_sensitive, whole_words)
    return pages.select("doc_id", "page", F.inline(counted))


def hits(pages: DataFrame, keywords: list[str], case_sensitive: bool = False, whole_words: bool = True, snippets: bool = False) -> DataFrame:
    """(doc_id, page, ord, keyword, n[, snippet]) where n > 0."""
    counted = kw.counts("text", keywords, case_sensitive, whole_words)
    if not snippets:
        return pages.select("doc_id", "page", F.inline(counted)).where("n > 0")
    found = pages.select("doc_id", "page", "text", F.inline(counted)).where("n > 0")
    excerpt = F.lit(None).cast("string")
    for i, k in enumerate(keywords):
        excerpt = F.when(F.col("ord") == i, kw.snippet("text", k, case_sensitive, whole_words)).otherwise(excerpt)
    return found.select("doc_id", "page", "ord", "keyword", "n", excerpt.alias("snippet"))


def page_matches(found: DataFrame) -> DataFrame:
    """(doc_id, page, n, keywords_found) of hits, keywords in their order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword"))), lambda x: x["keyword"])
    return found.groupBy("doc_id", "page").agg(F.sum("n").alias("n"), names.alias("keywords_found"))


def document_totals(counted: DataFrame) -> DataFrame:
    """(doc_id, ord, keyword, total) of page counts; keywords without matches stay, with 0."""
    return counted.groupBy("doc_id", "ord", "keyword").agg(F.sum("n").alias("total"))


def document_summary(counted: DataFrame) -> DataFrame:
    """(doc_id, pages_scanned, total_matches, matches, matched_pages) of page counts; one group-by."""
    hit = F.col("n") > 0
    return counted.groupBy("doc_id").agg(
        F.count_if(F.col("ord") == 0).alias("pages_scanned"),
        F.sum("n").alias("total_matches"),
        F.count_if(hit).alias("matches"),
        F.array_sort(F.collect_set(F.when(hit, F.col("page")))).alias("matched_pages"),
    )


def corpus_totals(counted: DataFrame, keywords: list[str]) -> DataFrame:
    """(ord, keyword, total): every keyword has a row, also where there are no pages at all."""
    spark = counted.sparkSession
    wanted = spark.createDataFrame(list(enumerate(keywords)), "ord int, keyword string")
    summed = counted.groupBy("ord").agg(F.sum("n").alias("total"))
    return wanted.join(summed, "ord", "left").select("ord", "keyword", F.coalesce("total", F.lit(0)).alias("total"))


def search_corpus(
    pages: DataFrame,
    documents: DataFrame,
    keywords: list[str],
    case_sensitive: bool = False,
    whole_words: bool = True,
    sort: str = "path",
) -> DataFrame:
    """(doc_id, path, total_matches, matches, matched_pages[, rank]): documents without matches stay.

    ``rank``: most matches first, ties in the natural order of paths, each with a rank of its own.
    """
    if sort not in SORTS:
        raise ValidationError(f"cannot sort by {sort!r}, only by {SORTS}", {"sort": sort})
    summary = document_summary(page_counts(pages, keywords, case_sensitive, whole_words))
    none = F.expr("cast(array() as array<int>)")
    out = documents.join(summary, "doc_id", "left").select(
        "doc_id",
        "path",
        F.coalesce("total_matches", F.lit(0)).alias("total_matches"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.coalesce("matched_pages", none).alias("matched_pages"),
    )
    if sort == "path":
        return out
    key = naming.natural_column("path")
    out = out.withColumn("__key", key)
    order = [F.desc("total_matches"), F.col("__key"), F.col("path"), F.col("doc_id")]
    cuts = bounds(documents, naming.sortable(key))
    bucket = F.struct((-steps(F.col("total_matches"))).alias("t"), F.when(F.col("total_matches") <= 256, bucket_of(naming.sortable(F.col("__key")), cuts)).alias("k"))
    return ranked(out, order, bucket).drop("__key")


def matching_pages(pages: DataFrame, keywords: list[str], case_sensitive: bool = False, whole_words: bool = True) -> DataFrame:
    """(doc_id, page) of pages on which any keyword matches."""
    return pages.where(kw.contains_any("text", keywords, case_sensitive, whole_words)).select("doc_id", "page")


def first_pages(pages: DataFrame, keyword: str) -> DataFrame:
    """(doc_id, anchor): the first page with the keyword, as a whole word in any case."""
    return pages.where(kw.contains("text", keyword)).groupBy("doc_id").agg(F.min("page").alias("anchor"))


def postings(pages: DataFrame) -> DataFrame:
    """Extension: (term, doc_id, n) of lower-cased words."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(kw.WORD + "+"), F.lit(0)))
    return pages.select("doc_id", words.alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))


def bm25(pages: DataFrame, terms: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Extension: the k documents of the highest BM25 score (doc_id, score), ties by id."""
    wanted = sorted({t.lower() for t in terms})
    lengths = pages.select("doc_id", F.regexp_count(F.col("text"), F.lit(kw.WORD + "+")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("length"))
    whole = lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    tf = page_counts(pages, wanted, False, True).groupBy("doc_id", "keyword").agg(F.sum("n").alias("tf")).where("tf > 0")
    df = tf.groupBy("keyword").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "keyword").join(lengths, "doc_id").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.groupBy("doc_id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def ranked_pages(found: DataFrame) -> DataFrame:
    """Hits with the rank of their page within the document by matches."""
    per_page = page_matches(found)
    return per_page.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "page")))
