"""Every registered query that has SQL gives the SQL's rows; operators on small tables."""

from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

from folioscope import queries as engine
from folioscope.functions import naming
from folioscope.operators import merge, search
from folioscope.plans import page_plan, ranking
from folioscope.sources import tables
from folioscope.streaming import ingest

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = engine.queries()[name](spark, str(DATA))
    said = sql.execute(engine.oracle_sql()[name])
    columns = [x[0] for x in said.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in said.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == rows


def test_whole_texts_are_extracted(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join("abcdefgh")), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = engine.queries()["text_extract_all_chars"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["pages_scanned"], r["characters"]) for r in rows) == [("1", 8, 8), ("2", 1, 0)]


def test_keywords_do_not_make_joins(spark):
    pages = spark.createDataFrame([("a", 1, "x y")], "doc_id string, page int, text string")
    plan = search.document_summary(search.page_counts(pages, ["x", "y"]))._jdf.queryExecution().toString()
    assert "Join" not in plan and "PythonUDF" not in plan


def test_corpus_with_nothing(spark):
    pages = spark.createDataFrame([], "doc_id string, page int, text string")
    docs = spark.createDataFrame([("d", "d.pdf")], "doc_id string, path string")
    assert [tuple(r)[2:4] for r in search.search_corpus(pages, docs, ["x"], sort="rank").collect()] == [(0, 0)]
    assert [tuple(r) for r in search.corpus_totals(search.page_counts(pages, ["x"]), ["x"]).collect()] == [(0, "x", 0)]


def test_concatenation_repeats_a_document(spark):
    pages = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 1, "r")], "doc_id string, page int, text string")
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "src_ord int, doc_id string")
    assert [r["text"] for r in page_plan.concatenated(pages, inputs).orderBy("new_page").collect()] == list("pqrpq")


def test_natural_inputs_with_ties(spark):
    docs = spark.createDataFrame([("1", "b10"), ("2", "B2"), ("3", "b2"), ("4", ""), ("5", "10")], "doc_id string, filename string")
    assert [r["doc_id"] for r in merge.natural_inputs(docs).orderBy("src_ord").collect()] == ["4", "5", "2", "3", "1"]


def test_streaming_totals_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha\nbeta alpha"), (2, None), (3, "Alpha")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.running_totals(ingest.arriving_texts(spark, str(tmp_path / "in"), "doc_id long, text string"), ["alpha", "beta"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = search.document_totals(search.page_counts(tables.line_pages(docs), ["alpha", "beta"]))
    want = {r["keyword"]: r["s"] for r in batch.groupBy("keyword").agg({"total": "sum"}).toDF("keyword", "s").collect()}
    assert {r["keyword"]: r["total"] for r in spark.table("totals").collect()} == want == {"alpha": 3, "beta": 1}


def test_ranks_of_names_with_one_beginning(spark):
    paths = [f"/data/corpus/part-{i}.pdf" for i in range(1500)] + ["/data/corpus/part-7.PDF", "a\0!b", "a1", "a"]
    docs = spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)], "doc_id string, filename string")
    key = naming.sortable(naming.natural_column("filename"))
    cuts = ranking.bounds(docs, key)
    sizes = [r["count"] for r in docs.groupBy(ranking.bucket_of(key, cuts)).count().collect()]
    assert len(cuts) == ranking.BOUNDS == len(sizes) - 1 and max(sizes) < 20
    want = [i for _, _, i in sorted((naming.natural_key(p), p, str(i)) for i, p in enumerate(paths))]
    got = merge.natural_inputs(docs).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["src_ord"])] == want and sorted(r["src_ord"] for r in got) == list(range(1, len(paths) + 1))
    assert merge.natural_inputs(docs.limit(0)).count() == 0 and merge.natural_inputs(docs.selectExpr("doc_id", "cast(null as string) filename").limit(2)).count() == 2


def test_steps_ascend(spark):
    counts = [*range(600), 10**4, 10**4 + 1, 10**6, 10**9, 10**15]
    rows = spark.createDataFrame([(n,) for n in counts], "n long").withColumn("s", ranking.steps(F.col("n"))).orderBy("n").collect()
    steps = [r["s"] for r in rows]
    assert steps == sorted(steps) and steps[:257] == list(range(257)) and steps[257] == 257 and steps[-1] < 1000
    pages = spark.createDataFrame([(str(n), 1, "x " * n) for n in (0, 0, 256, 257, 258, 400, 1)], "doc_id string, page int, text string").distinct()
    docs = spark.createDataFrame([(str(n), f"p{n}") for n in (0, 256, 257, 258, 400, 1)] + [("none", "p")], "doc_id string, path string")
    ranks = {r["doc_id"]: r["rank"] for r in search.search_corpus(pages, docs, ["x"], sort="rank").collect()}
    assert sorted(ranks, key=ranks.get) == ["400", "258", "257", "256", "1", "none", "0"]
