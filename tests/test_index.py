"""The stored index: postings, pruning, and top-k against exhaustive scoring."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.operators import index


def scan_of(df):
    return df._jdf.queryExecution().toString()


def exhaustive(texts, terms, k, k1=1.2, b=0.75):
    counts = {d: Counter(re.findall(r"\w+", (t or "").lower())) for d, t in texts.items()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    out = defaultdict(float)
    for term in set(terms):
        df = sum(term in c for c in counts.values())
        for d, c in counts.items():
            if tf := c[term]:
                out[d] += math.log(1 + (len(counts) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sum(c.values()) / mean))
    return sorted(((round(s, 9), d) for d, s in out.items()), key=lambda x: (-x[0], x[1]))[:k]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = {f"d{i:05d}": " ".join(random.choices(words, weights, k=random.choice([2, 5, 30, 80]))) for i in range(6000)}
    texts |= {f"c{i:03d}": "rare W0 copy" for i in range(40)} | {"empty": "", "none": None, "hot": "rare " * 300}
    rows = [(d, t) for d, t in texts.items()]
    pages = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.build(pages, path, buckets=8)
    return texts, index.Index(spark, path)


def test_postings_are_those_of_the_texts(corpus):
    texts, ix = corpus
    want = Counter((w, d) for d, t in texts.items() for w in re.findall(r"\w+", (t or "").lower()))
    assert {(r["term"], r["doc_id"]): r["n"] for r in ix.postings().collect()} == want
    blocks = ix.blocks.select(F.max("n").alias("n"), F.max(F.element_at("docs", -1)).alias("far"), F.count("*").alias("c"), F.count_if(F.size("docs") != F.col("n")).alias("odd")).first()
    assert blocks["n"] == index.BLOCK and blocks["far"] < 1 << index.SEGMENT_BITS and blocks["odd"] == 0
    lexicon = {r["term"]: (r["df"], r["cf"]) for r in ix.lexicon.collect()}
    assert lexicon["rare"] == (41, 340) and len(lexicon) == len({w for w, _ in want})


def test_lookup_reads_its_buckets_only(corpus):
    texts, ix = corpus
    found = ix.lookup(["RARE", "w59", "nothing"])
    assert {(r["term"], r["n"]) for r in found.where("doc_id in ('hot', 'c001')").collect()} == {("rare", 300), ("rare", 1)}
    plan = scan_of(found)
    pushed = re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]*\]", plan)
    assert pushed and re.search(r"PushedFilters: \[[^\]]*In\(term", plan)


@pytest.mark.parametrize("k", [1, 10, 100])
def test_top_equals_exhaustive(spark, corpus, k):
    texts, ix = corpus
    asked = {0: ["w0", "w40"], 1: ["w50", "w51", "w52"], 2: ["rare", "w0"], 3: ["copy"], 4: ["w3"], 5: ["missing"], 6: ["missing", "w59"]}
    queries = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in [*ts, ts[0].upper()]] + [(None, "w1"), (7, None)], "query int, term string")
    got = defaultdict(list)
    for r in sorted(ix.top(queries, k).collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r["score"], r["doc_id"]))
    for q, terms in asked.items():
        want = exhaustive(texts, terms, k)
        assert [d for _, d in got[q]] == [d for _, d in want] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in want], abs=2e-9)
    assert 7 not in got


def test_blocks_below_the_threshold_are_not_read(spark, corpus):
    _, ix = corpus
    search = index.Search(ix, spark.createDataFrame([(1, "w0"), (1, "w1"), (2, "rare"), (2, "w0")], "query int, term string"), 5)
    search.top()
    done = {r["query"]: r for r in search.work_done().collect()}
    assert set(done) == {1, 2} and all(0 < r["scored"] <= r["lanes"] and 0 < r["read"] <= r["blocks"] for r in done.values())
    assert done[1]["scored"] < 0.7 * done[1]["lanes"] and done[2]["scored"] < 0.1 * done[2]["lanes"] and done[2]["read"] < 0.3 * done[2]["blocks"], done


def test_pages_as_units_and_nothing_at_all(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "x x"), (None, 1, "x"), ("b", None, "y Y")], "doc_id string, page int, text string")
    index.build(pages, str(tmp_path / "p"), ["doc_id", "page"])
    ix = index.Index(spark, str(tmp_path / "p"))
    assert {(r["term"], r["doc_id"], r["page"], r["n"]) for r in ix.postings().collect()} == {("x", "a", 1, 1), ("y", "a", 1, 1), ("x", "a", 2, 2), ("x", None, 1, 1), ("y", "b", None, 2)}
    top = ix.top(spark.createDataFrame([("q", "y")], "query string, term string"), 1).collect()
    assert [(r["doc_id"], r["page"], r["rank"]) for r in top] == [("b", None, 1)]
    index.build(pages.limit(0), str(tmp_path / "n"))
    none = index.Index(spark, str(tmp_path / "n"))
    assert none.postings().count() == 0 and none.lookup(["x"]).count() == 0
    assert none.top(spark.createDataFrame([("q", "y")], "query string, term string")).count() == 0
    assert ix.top(spark.createDataFrame([], "query string, term string")).count() == 0


def test_blocks_are_cut_across_batches(spark):
    """Runs of one term that end within, at and far beyond an Arrow batch, two segments, lanes and their bounds."""
    sizes = {"a": 1, "b": 6, "c": 7, "d": 300, "e": 1, "é": 129}
    rows = [(t, i * 3, 1 + i % 4, 5 + i % 9) for t, n in sizes.items() for i in range(n)] + [("d", (1 << index.SEGMENT_BITS) + 1, 2, 6)]
    found = spark.createDataFrame(rows, "term string, nr long, tf int, length int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = index._blocks(found, 8.0, 1.2, 0.75).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(list)
    for t, nr, tf, length in sorted(rows):
        want[t, nr >> index.SEGMENT_BITS].append((nr, tf, length))
    want = {(t, s, i // index.BLOCK): p[i : i + index.BLOCK] for (t, s), p in want.items() for i in range(0, len(p), index.BLOCK)}
    assert {(r["term"], r["segment"], r["block"]): [(r["first"] + d, tf, n) for d, tf, n in zip(r["docs"], r["tfs"], r["lengths"])] for r in blocks} == want
    for r in blocks:
        tops = defaultdict(int)
        for nr, tf, length in want[r["term"], r["segment"], r["block"]]:
            lane, share = nr >> index.LANE_BITS, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 8.0))
            tops[lane] = max(tops[lane], math.ceil(share * (index.STEPS / 2.2)))
        assert r["lanes"] == sorted(tops) and r["tops"] == [tops[x] for x in r["lanes"]] and r["n"] == len(r["docs"])


def test_tasks_invert_their_documents_bit_by_bit(spark, tmp_path, monkeypatch):
    """Documents of many pages, cut whenever some postings are gathered and packed in small parts; postings are not shuffled."""
    for name, value in (("TASK_WORDS", 1500), ("GATHERED", 40), ("PACKED", 2000)):
        monkeypatch.setattr(index, name, value)
    random.seed(7)
    texts = {(f"d{i % 300:03d}" if i % 7 else None, i // 300): " ".join(random.choices([f"É{j}" for j in range(300)], k=random.choice([0, 1, 9, 60]))) for i in range(600)}
    rows = [(d, t) for (d, _), t in texts.items()] + [("d001", None), ("none", None), ("long", " ".join(f"v{j}" for j in range(500)))] + [("long", "v1 v2")] * 3
    want = Counter((w, d) for d, t in rows for w in re.findall(r"\w+", (t or "").lower()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        index.build(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ix = index.Index(spark, str(tmp_path / "i"))
    postings = [(r["term"], r["doc_id"], r["n"]) for r in ix.postings().collect()]
    assert len(postings) == len(want) and {(t, d): n for t, d, n in postings} == want
    assert {(r["term"], r["df"], r["cf"]) for r in ix.lexicon.collect()} == {(w, sum(x == w for x, _ in want), sum(n for (x, _), n in want.items() if x == w)) for w, _ in want}
    assert ix.blocks.select("term", "segment", "block").distinct().count() == ix.blocks.count() and ix.units.count() == len({d for d, _ in rows})
    blocks = index._inverted(ix.units.select("nr", "length", F.array(F.lit("x")).alias("terms")), 3.0, 1.2, 0.75)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
