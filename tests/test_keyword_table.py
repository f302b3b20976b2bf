"""Keywords as a table count as the column expressions do."""

import random

import pytest

from folioscope.functions.keywords import normalise_keywords
from folioscope.operators import keyword_table, search

TEXTS = ["Alpha beta alpha-beta ALPHA", "the cat. The CAT's hat", "aaaa aa a", "x", "", None, "naïve Naïve NAÏVE naive", "ſtraße STRASSE straße", "ΣΟΦΟΣ σοφος σοφοσ", "İstanbul istanbul ISTANBUL ıI", "foo_bar foo bar", "c++ C++ c++x (c++)", "1,000 1000 １０００", "a.b.c a.b", "漢字 漢 字", "Kelvin Kelvin", "ab ab ab abab", "tail\nnext line\tTAB", "😀 😀😀 x😀y", "ǅ ǆ Ǆ"]
KEYWORDS = ["alpha", "Alpha", " beta ", "alpha-beta", "the cat", "aa", "a", "naïve", "straße", "strasse", "σοφος", "ΣΟΦΟΣ", "istanbul", "İstanbul", "ı", "foo", "foo_bar", "c++", "++", "1000", "1,000", "a.b", "漢", "kelvin", "ab ab", "ab", "😀", "next line", "line\tTAB", ".", "", None, "  ", "alpha", "ǆ", "'s", "no where", "nowhere"]


@pytest.mark.parametrize("case", [False, True])
@pytest.mark.parametrize("whole", [False, True])
def test_counts_equal_the_expressions(spark, case, whole):
    random.seed(int(case) * 2 + whole)
    texts = TEXTS + [" ".join(random.choices([t for t in TEXTS if t], k=6)) for _ in range(30)]
    pages = spark.createDataFrame([(f"d{i // 3}", i % 3 + 1, t) for i, t in enumerate(texts)], "doc_id string, page int, text string").repartition(3)
    distinct = normalise_keywords([k for k in KEYWORDS if k and k.strip()])
    want = {(r["doc_id"], r["page"], r["keyword"], r["n"]) for r in search.hits(pages, distinct, case, whole).collect()}
    table = spark.createDataFrame(list(enumerate(KEYWORDS)), "ord int, keyword string")
    for at_once in (1000, 3):
        found = keyword_table.hits(pages, table, case, whole, at_once)
        rows = found.collect()
        assert {(r["doc_id"], r["page"], r["keyword"], r["n"]) for r in rows} == want and len(rows) == len(want)
        assert {r["ord"] for r in rows if r["keyword"] == "alpha"} <= {0}
    totals = keyword_table.totals(found, table).collect()
    assert sorted(r["keyword"] for r in totals) == sorted(distinct) and any(r["total"] == 0 for r in totals)
    assert {tuple(r) for r in keyword_table.pages_with_any(found).collect()} == {(d, p) for d, p, *_ in want}


def test_words_need_no_python(spark):
    pages = spark.createDataFrame([("a", 1, "x y x")], "doc_id string, page int, text string")
    table = spark.createDataFrame([(1, "x"), (2, "z")], "ord int, keyword string")
    found = keyword_table.hits(pages, table)
    plan = found._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "BroadcastHashJoin" in plan and [tuple(r) for r in found.collect()] == [("a", 1, 1, "x", 2)]


def test_nothing_to_look_for(spark):
    pages = spark.createDataFrame([("a", 1, "x y x")], "doc_id string, page int, text string")
    none = spark.createDataFrame([(1, " "), (2, None)], "ord int, keyword string")
    assert keyword_table.hits(pages, none).count() == 0 and keyword_table.hits(pages.limit(0), spark.createDataFrame([(1, "x y")], "ord int, keyword string")).count() == 0
    assert keyword_table.totals(keyword_table.hits(pages, none), none).count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_more_keywords_are_not_more_looks_at_the_pages(spark, whole):
    pages = spark.createDataFrame([("a", i, f"no {i} no {i + 1} no {i}") for i in range(30)], "doc_id string, page int, text string")
    looks = []
    for n in (20, 200):
        table = spark.createDataFrame([(i, f"no {i}") for i in range(n)], "ord int, keyword string")
        found = keyword_table.hits(pages, table, whole_words=whole, at_once=8)
        looks.append(found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        want = search.hits(pages, [f"no {i}" for i in range(20)], whole_words=whole).select("doc_id", "page", "keyword", "n")
        assert sorted(map(tuple, want.collect())) == sorted(tuple(r)[:2] + tuple(r)[3:] for r in found.where("ord < 20").collect())
    assert looks[0] == looks[1] <= 4


@pytest.mark.parametrize("at_once", [1000, 1])
def test_texts_longer_than_a_stretch(spark, at_once):
    texts = ["ab cd " * 60_000 + "end. of", "x" * (keyword_table.STRETCH - 3) + " ab-cd ab-cd", "aͅb c aιb c ͅ", "short ab cd ab", None]
    assert len(texts[0]) > keyword_table.STRETCH
    words = ["ab cd ab", "cd ab", "end. of", "ab-cd", "d ab", "aιb c", "-", " "]
    pages = spark.createDataFrame(list(enumerate(texts)), "page int, text string").selectExpr("'a' as doc_id", "page", "text").coalesce(1)
    table = spark.createDataFrame(list(enumerate(words)), "ord int, keyword string")
    for whole in (False, True):
        rows = sorted((r["page"], r["keyword"], r["n"]) for r in keyword_table.hits(pages, table, False, whole, at_once).collect())
        assert rows == sorted((r["page"], r["keyword"], r["n"]) for r in search.hits(pages, normalise_keywords(words[:-1]), False, whole).collect())
        assert (0, "ab cd ab", 30_000) in rows


def test_totals_of_many_keywords(spark):
    pages = spark.createDataFrame([("a", i, f"no {i} no {i + 1} no {i}") for i in range(30)], "doc_id string, page int, text string")
    looks = []
    for n in (20, 200):
        table = spark.createDataFrame([(i, f"no {i}") for i in range(n)], "ord int, keyword string")
        totals = keyword_table.totals(keyword_table.hits(pages, table, at_once=8), table)
        looks.append(totals._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        want = [(i, f"no {i}", (i < 30) + (0 < i < 31), 2 * (i < 30) + (0 < i < 31)) for i in range(n)]
        assert sorted(map(tuple, totals.collect())) == want
    assert looks[0] == looks[1] <= 4


@pytest.mark.parametrize("case", [False, True])
@pytest.mark.parametrize("whole", [False, True])
def test_sums_equal_the_totals_of_hits(spark, case, whole):
    random.seed(int(case) * 2 + whole)
    long = ["x" * (keyword_table.STRETCH - 3) + " ab-cd ab-cd", "ab ab " * 50_000]
    texts = TEXTS + [" ".join(random.choices([t for t in TEXTS if t], k=6)) for _ in range(10)] + long
    words = [*KEYWORDS, "ab cd ab", "cd ab", "end. of", "ab-cd", "ab ab ab"]
    # a document and page that stand twice are two pages, as in hits
    pages = spark.createDataFrame([(f"d{i // 3}", i % 2 + 1, t) for i, t in enumerate(texts)], "doc_id string, page int, text string").repartition(3)
    table = spark.createDataFrame(list(enumerate(words)), "ord int, keyword string")
    for at_once in (1000, 3):
        for some in (table, table.where("keyword rlike '^[a-z]+$'")):
            want = keyword_table.totals(keyword_table.hits(pages, some, case, whole, at_once), some)
            found = keyword_table.sums(pages, some, case, whole, at_once)
            assert found.dtypes == want.dtypes and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_sums_look_at_the_pages_once(spark):
    pages = spark.createDataFrame([("a", i, "no 1 no 2 no 1") for i in range(500)], "doc_id string, page int, text string").coalesce(1)
    table = spark.createDataFrame([(i, f"no {i}") for i in range(200)], "ord int, keyword string")
    found = keyword_table.sums(pages, table, at_once=8)
    # one walk over the pages, one over the keywords
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert {(r["keyword"], r["pages"], r["total"]) for r in found.where("total > 0").collect()} == {("no 1", 500, 1000), ("no 2", 500, 500)}
