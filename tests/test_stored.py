"""Paged text source, registry of paths, stream of pages, wide windows."""

import hashlib
import os
import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from folioscope.errors import OutputConflictError, PageRangeError, ValidationError
from folioscope.operators import concatenate, layout, page_ops, search
from folioscope.plans import deadline, scan
from folioscope.sources import paged, registry
from folioscope.streaming import register


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_below(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".txt")]


def test_paged_text_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(f"doc/{i} ü?", p, random.choice(["x\ny", "", "ü" * 50, '{"a"}\n'])) for i in range(20) for p in range(1, 12) if (i + p) % 7] + [("doc/1 ü?", 3, "again"), ("long", 10**9, "far")]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string").repartition(5)
    paged.write(df, path, piece_bytes=120)
    assert rows_of(paged.read(spark, path)) == sorted(rows, key=repr) and len(files_below(path)) > 40
    for spec, where in (("2-4,9", None), (None, "page > 3 and page <= 8"), ("1-6", "page in (2, 5, 9)"), (None, "doc_id = 'doc/3 ü?'"), ("3", "doc_id in ('long', 'doc/1 ü?')"), (None, "page = 4 or doc_id = 'long'"), (None, "page between 5 and 6 and text like 'x%'"), (None, "page is null"), (None, "doc_id = 'nobody'")):
        read = paged.read(spark, path, spec)
        wanted = df.where(F.expr(where)) if where else df
        if spec:
            from folioscope.functions.pages import in_pages

            wanted = wanted.where(in_pages(F.col("page"), spec))
        assert rows_of(read.where(where) if where else read) == rows_of(wanted), (spec, where)


def test_filters_reach_the_source(spark, tmp_path):
    path = str(tmp_path / "p")
    paged.write(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 2, "z")], "doc_id string, page int, text string"), path, piece_bytes=1)
    read = paged.read(spark, path).where("page = 2 and doc_id = 'a'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] and "page" in plan.split("BatchScan")[1]
    assert rows_of(read) == [("a", 2, "y")]
    reader = paged.PagedReader(path, "2-5")
    assert sum(len(p.names) for p in reader.partitions()) == 2


@pytest.mark.parametrize("bad", [("b", 5, "a\fb"), (None, 1, "x"), ("b", None, "x")])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "p")
    good = spark.createDataFrame([("a", i, "t" * 40) for i in range(1, 40)], "doc_id string, page int, text string")
    with pytest.raises(Exception, match="page"):
        paged.write(good.unionByName(spark.createDataFrame([bad], good.schema)), path, piece_bytes=50)
    assert files_below(path) == [] and paged.read(spark, path).count() == 0
    paged.write(good, path)
    with pytest.raises(Exception, match="page"):
        paged.write(spark.createDataFrame([bad], good.schema), path, mode="overwrite")
    assert rows_of(paged.read(spark, path)) == rows_of(good)
    paged.write(good.where("page < 3"), path)
    assert paged.read(spark, path).count() == 41
    paged.write(good.where("page < 3"), path, mode="overwrite")
    assert paged.read(spark, path).count() == 2 and len(files_below(path)) == 1


def test_what_an_attempt_left_behind_is_not_read(spark, tmp_path):
    path = str(tmp_path / "p")
    paged.write(spark.createDataFrame([("a", 1, "x")], "doc_id string, page int, text string"), path)
    job = next(d for d in os.listdir(path) if d.startswith("write-"))
    attempt = next(a for a in os.listdir(f"{path}/{job}") if os.listdir(f"{path}/{job}/{a}"))
    os.makedirs(f"{path}/{job}/lost")
    os.link(f"{path}/{job}/{attempt}/{os.listdir(f'{path}/{job}/{attempt}')[0]}", f"{path}/{job}/lost/0000000001_0000000001_x_y.txt")
    assert paged.read(spark, path).count() == 1


def test_registry_keeps_first_ids(spark, tmp_path):
    known = registry.Registry(spark, str(tmp_path / "r"))
    assert known.documents().count() == 0 and known.version() == 0
    one = spark.createDataFrame([(3, "/b/B"), (1, "/a"), (2, "/b/b"), (9, None), (5, "/c")], "pos long, path string")
    assert known.register(one) == 3 and known.register(one) == 0
    two = spark.createDataFrame([(-4, "/new"), (0, "/A"), (7, "/C"), (7, "/d"), (7, "/D2")], "pos long, path string")
    assert known.register(two) == 3
    assert {r["doc_id"]: r["path"] for r in known.documents().collect()} == {"doc-1": "/a", "doc-2": "/b/b", "doc-3": "/c", "doc-4": "/new", "doc-5": "/d", "doc-6": "/D2"}
    assert known.documents(1).count() == 3 and known.version() == 3
    asked = spark.createDataFrame([("doc-2",), ("/B/b ",), ("/nothing",), (None,)], "reference string")
    assert {r["reference"]: r["doc_id"] for r in known.resolve(asked).collect()} == {"doc-2": "doc-2", "/B/b ": "doc-2", "/nothing": None, None: None}


def test_registry_with_concurrent_writers(spark, tmp_path):
    folder, errors = str(tmp_path / "r"), []

    def add(k: int) -> None:
        try:
            registry.Registry(spark, folder).register(spark.createDataFrame([(i, f"/p{i % 30}/{k if i % 3 else 'all'}") for i in range(60)], "pos long, path string"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = registry.Registry(spark, folder).documents().collect()
    assert not errors and len(rows) == len({r["path"].lower() for r in rows}) == 10 + 4 * 20
    assert sorted(r["number"] for r in rows) == list(range(1, len(rows) + 1)) and registry.Registry(spark, folder).version() == 4


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    schema, folder = "doc_id string, page int, text string", str(tmp_path / "s")
    drops = [[("a", 2, "x y x"), ("b", 1, None), (None, 1, "x")], [("a", 1, "X")], [("c", 7, ""), ("a", 3, "y"), ("b", 2, "x")]]
    for rows in drops:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        register.take_in(spark, f"{folder}/in", schema, folder, ["x"])
        register.take_in(spark, f"{folder}/in", schema, folder, ["x"])  # nothing new
    assert rows_of(register.current(spark, folder)) == [("a", 1, 3, 3), ("b", 1, 2, 1), ("c", 7, 1, 0)]


@pytest.mark.parametrize("padding", [0, 1, 3, 40, 5000])
def test_intervals_equal_written_out_windows(spark, padding):
    random.seed(padding)
    marks = [(d, p) for d in "abc" for p in random.sample(range(1, 9000), {"a": 400, "b": 30, "c": 1}[d])] + [("a", p) for p in range(2000, 2400)] + [("e", 64), ("e", 65), ("f", 4095), ("f", 4096)]
    pages = spark.createDataFrame([(d, p) for d in "abcdef" for p in range(1, 9000, 1 if d in "ab" else 7)] + [("e", p) for p in range(1, 150)], "doc_id string, page int").distinct()
    anchors = spark.createDataFrame(marks + marks[:5], "doc_id string, anchor int")
    want = {(d, q) for d, p in marks for q in range(max(1, p - padding), p + padding + 1)}
    ranges = page_ops.intervals(anchors, padding, padding)
    got = ranges.orderBy("doc_id", "first").collect()
    assert all(a["doc_id"] != b["doc_id"] or b["first"] > a["last"] + 1 for a, b in zip(got, got[1:]))
    found = page_ops.pages_within(pages, ranges, 2 * padding + 1).collect()
    assert sorted(tuple(r) for r in found) == sorted(tuple(r) for r in pages.collect() if tuple(r) in want)
    with pytest.raises(PageRangeError):
        page_ops.matches_with_padding(pages.withColumn("text", F.lit("x")), ["x"], -1)


def test_running_sums_in_blocks(spark):
    random.seed(9)
    rows = [(k, p, random.choice([None, 1, 5, -2])) for k, n in (("a", 1000), ("b", 7), ("c", 1)) for p in range(n)]
    df = spark.createDataFrame(rows, "k string, p int, v int").repartition(5)
    want, at = {}, {}
    for k, p, v in rows:
        want[k, p] = at.get(k, 0)
        at[k] = want[k, p] + (v or 0)
    for block in (3, 64, 5000):
        out = scan.running_sum(df, ["k"], "p", "v", block=block)
        assert {(r["k"], r["p"]): r["before"] for r in out.collect()} == want and out.columns == ["k", "p", "v", "before"]


def test_words_stand_after_what_is_before_them(spark, tmp_path):
    lines = spark.createDataFrame([("d", 1, "ab  c"), ("d", 2, None), ("d", 3, " é-x\n_1"), (None, 1, "z"), ("e", 1, "")], "doc_id string, page int, text string")
    wide = lambda t: sum(400 + ord(c) % 400 for c in t)
    words = layout.word_positions(lines)
    got = {(r["doc_id"], r["page"], r["word"]): (r["x"], r["y"], r["wide"]) for r in words.collect()}
    assert got == {
        ("d", 1, "ab"): (0, 0, wide("ab")),
        ("d", 1, "c"): (wide("ab  "), 0, wide("c")),
        ("d", 3, "é"): (wide(" "), 3000, wide("é")),
        ("d", 3, "x"): (wide(" é-"), 3000, wide("x")),
        ("d", 3, "_1"): (wide(" é-x\n"), 3000, wide("_1")),
    }
    layout.store(words, str(tmp_path / "w"))
    boxes = [(1, 0, 0, 10**7, 10), (2, wide(" é-"), 3000, wide(" é-"), 3000), (3, -500, -500, 5, 5), (4, 5, 5, 4, 9), (5, None, 0, 1, 1), (6, 0, 0, 3000, 10**6)]
    found = layout.words_in_boxes(spark, str(tmp_path / "w"), spark.createDataFrame(boxes, "box int, x0 long, y0 long, x1 long, y1 long"))
    want = {(b, *k) for b, x0, y0, x1, y1 in boxes if None not in (x0, y0, x1, y1) for k, (x, y, _) in got.items() if x0 <= x <= x1 and y0 <= y <= y1}
    assert {(r["box"], r["doc_id"], r["page"], r["word"]) for r in found.collect()} == want and found.count() == len(want)
    one = layout.words_in_boxes(spark, str(tmp_path / "w"), spark.createDataFrame(boxes[1:2], "box int, x0 long, y0 long, x1 long, y1 long"))
    assert "cell_y" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_an_answer_names_what_it_covers(spark, tmp_path):
    pages = spark.createDataFrame([(f"d{i}", 1, "x y x") for i in range(200)], "doc_id string, page int, text string")
    path, folder = str(tmp_path / "t"), str(tmp_path / "a")
    deadline.store(pages, path, 5)
    seen = spark.read.parquet(path)
    slow = F.udf(lambda t: (time.sleep(0.15), t)[1])
    late = deadline.answer(spark, path, lambda p: search.hits(p.withColumn("text", slow("text")), ["x"]), folder, seconds=9.0, at_once=1)
    assert not late.complete and sorted([*late.covered, *late.missing]) == list(range(5))
    inside = {r["doc_id"] for r in seen.where(F.col("part").isin(late.covered)).collect()} if late.covered else set()
    assert {r["doc_id"] for r in late.rows.collect()} == inside
    again = deadline.answer(spark, path, lambda p: search.hits(p, ["x"]), folder)
    assert again.complete and again.rows.count() == 200 and set(again.covered) > set(late.covered)
    none = deadline.answer(spark, path, lambda p: search.hits(p, ["x"]), str(tmp_path / "b"), seconds=0.0)
    assert none.rows.count() == len(seen.where(F.col("part").isin(none.covered or [-1])).collect())
    with pytest.raises(Exception, match="(?i)divi"):
        deadline.answer(spark, path, lambda p: search.hits(p.withColumn("page", F.expr("page div 0")), ["x"]), str(tmp_path / "c"))


def test_files_are_joined_by_many_writers(spark, tmp_path):
    random.seed(11)
    texts = {f"d{i}": [random.choice(["", "ü", "line\ntwo", None, "x" * 300]) for _ in range(random.choice([0, 1, 3, 40]))] for i in range(30)}
    pages = spark.createDataFrame([(d, i + 1, t) for d, ts in texts.items() for i, t in enumerate(ts)] + [("d1", None, "nowhere")], "doc_id string, page int, text string").repartition(4)
    order = {"all/of it": [*texts, "d1", "d1"], "one": ["d3"], "none": ["missing"], "twice": ["d5", "d5"]}
    sources = spark.createDataFrame([(o, i + 1, d) for o, ds in order.items() for i, d in enumerate(ds)] + [(None, 1, "d1"), ("one", None, "d2")], "output string, src_ord int, doc_id string")
    for separator in ("\n", "", "-é-"):
        path = str(tmp_path / f"out{separator}")
        want = {o: separator.join(t or "" for d in ds for t in texts.get(d, [])) for o, ds in order.items() if any(texts.get(d) for d in ds)}
        total = concatenate.write(pages, sources, path, separator)
        got = {r["output"]: (r["bytes"], r["md5"]) for r in concatenate.digests(spark, path).collect()}
        assert got == {o: (len(t.encode()), hashlib.md5(t.encode()).hexdigest()) for o, t in want.items() if t}
        assert total == sum(len(t.encode()) for t in want.values())
    with pytest.raises(OutputConflictError):
        concatenate.write(pages, sources, path)
    bad = str(tmp_path / "bad")
    with pytest.raises(Exception, match="(?i)divi"):
        concatenate.write(pages.withColumn("text", F.expr("string(page div (page - 3))")), sources, bad)
    assert [n for n in os.listdir(tmp_path) if n.startswith("bad")] == []
    with pytest.raises(ValidationError):
        concatenate.write(pages, sources, "hdfs://somewhere/out")


def test_words_are_placed_without_a_shuffle_of_words(spark, tmp_path):
    texts = ["", "  ", "a", " b", "c d ", "é𝄞x 𐐷", "x" * 3000 + " y", "\t1_2 ٣"]
    lines = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)] + [("e", 1, "z z z")], "doc_id string, page int, text string").repartition(3)
    wide = lambda t: sum(400 + ord(c) % 400 for c in t)
    want = set()
    for d, some in (("d", texts), ("e", ["z z z"])):
        y = 0
        for page, t in enumerate(some, 1):
            runs = re.findall(r"\w+|\W+", t)
            want |= {(d, page, i, w, wide("".join(runs[:i])), y, wide(w)) for i, w in enumerate(runs) if re.match(r"\w", w)}
            y += 1200 if t.strip(" ") else 1800
    words = layout.word_positions(lines)
    assert {tuple(r) for r in words.collect()} == want
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" not in plan and plan.index("MapInArrow") < plan.index("Window")
    layout.store(words, str(tmp_path / "w"))
    found = layout.words_in_boxes(spark, str(tmp_path / "w"), spark.createDataFrame([(1, 0, 0, 10**8, 10**6)], "box int, x0 long, y0 long, x1 long, y1 long"))
    assert found.count() == len(want) and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_boxes_of_all_sizes_meet_the_words_of_their_cells(spark, tmp_path, monkeypatch, broadcast):
    """Boxes are in the grid of their size, in short lists, and the words of a row of cells in files for many tasks."""
    for name, value in (("FILE_ROWS", 50), ("LIST_BOXES", 20), ("BROADCAST_CELLS", broadcast)):
        monkeypatch.setattr(layout, name, value)
    random.seed(12)
    words = [("d", i, 0, f"w{i}", random.randrange(200_000), random.choice([0, 600, 1200, 1800, 40_000]), 1) for i in range(400)]
    words += [("e", 1, 0, "edge", 2400, 600, 1), ("e", 2, 0, "far", 10**12, 1200, 1)]
    stored = spark.createDataFrame(words, "doc_id string, page int, nth int, word string, x long, y long, wide long").coalesce(1)
    layout.store(stored, str(tmp_path / "w"))
    assert len([n for n in os.listdir(tmp_path / "w" / "cell_y=0") if n.endswith(".parquet")]) >= 6
    sides = [(random.randrange(-5000, 200_000), random.choice([0, 500, 2399, 19_200, 19_201, 10**6]), random.choice([-1, 0, 600, 1200]), random.choice([0, 1, 4800, 10**5])) for _ in range(120)]
    boxes = [(i, x, y, x + w, y + h) for i, (x, w, y, h) in enumerate(sides)] + [(900, 2400, 600, 2400, 600), (901, 0, 0, 10**13, 10**5), (902, 5, 5, 4, 9)]
    found = layout.words_in_boxes(spark, str(tmp_path / "w"), spark.createDataFrame(boxes, "box int, x0 long, y0 long, x1 long, y1 long"))
    want = sorted((b, d, p, n, t, x, y) for b, x0, y0, x1, y1 in boxes for d, p, n, t, x, y, _ in words if x0 <= x <= x1 and y0 <= y <= y1)
    assert sorted(tuple(r) for r in found.collect()) == want
