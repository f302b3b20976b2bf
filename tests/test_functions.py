"""Driver-side parsers and column expressions against Python's own regular expressions."""

import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.errors import PageRangeError, ValidationError
from folioscope.functions import keywords as kw
from folioscope.functions import naming, payloads
from folioscope.functions import pages as pg
from folioscope.operators import merge

EVERY = list(range(1, 6))


@pytest.mark.parametrize(
    "spec, pages",
    [(None, EVERY), ("", EVERY), ("  ", EVERY), ("0", EVERY), ("ALL", EVERY), ("*", EVERY), ("none", []), ("3", [3]), ("5,1, 2 - 3", [1, 2, 3, 5]), ("2-2,2", [2]), (4, [4]), ([3, 1, 3], [1, 3]), ((), [])],
)
def test_page_specifications(spec, pages):
    assert pg.parse_pages(spec, 5) == pages


@pytest.mark.parametrize("spec", [True, 0, 6, -1, "6", "1-6", "3-1", "1,,2", "1,", "x", "1-", "-1", "1.5", "1-999999999", "²", [1, "2"], [1.0], [True], 1.5])
def test_wrong_page_specifications(spec):
    with pytest.raises(PageRangeError):
        pg.parse_pages(spec, 5)


@pytest.mark.parametrize("total", [0, -1, "3", None, True])
def test_document_without_pages(total):
    with pytest.raises(PageRangeError):
        pg.parse_pages(None, total)


@given(st.sets(st.integers(1, 60)))
def test_compact_lists_read_back(pages):
    assert pg.parse_pages(pg.format_pages(pages) or "none", 60) == sorted(pages)


def test_windows_and_padding():
    assert pg.window(1, 5, 2, 1) == [1, 2] and pg.window(5, 5, 1, 9) == [4, 5] and pg.window(3, 5, 0, 0) == [3]
    assert pg.padded([2, 4, 7], 7, 2) == [1, 2, 3, 4, 5, 6, 7] and pg.padded([2, 4, 7], 7, 0) == [2, 4, 7] and pg.padded([], 3) == []
    for wrong in (-1, True, 1.5):
        with pytest.raises(PageRangeError):
            pg.padded([1], 3, wrong)


def test_keyword_normalisation():
    assert kw.normalise_keywords(" a ") == ["a"] and kw.normalise_keywords(["b", "a", "b ", "B"]) == ["b", "a", "B"] and kw.normalise_keywords([5]) == ["5"]
    for wrong in (None, [], "", [" "], 5, [None]):
        with pytest.raises(ValidationError):
            kw.normalise_keywords(wrong)


TEXTS = [
    "alpha beta Alpha ALPHA alphabet", "", None, "á a² ½a a Ⅷa _a a_ a-a", "c++ c++x xc++ #tag a#tag", "café CAFÉ cafés Straße STRASSE", "😀 alpha 😀alpha " * 5,
    "x" * 60 + " alpha\n\t" + "y" * 60, "aaaa aa a", "日本 日本語 привет ПРИВЕТ",
]
WORDS = ["alpha", "a", "c++", "#tag", "café", "aa", "日本", "привет", "²", "alpha beta"]


@pytest.mark.parametrize("case", [False, True])
@pytest.mark.parametrize("whole", [False, True])
def test_matching_is_that_of_python(spark, case, whole):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    cols = [F.struct(kw.count("t", w, case, whole), kw.contains("t", w, case, whole), kw.snippet("t", w, case, whole)).alias(f"w{i}") for i, w in enumerate(WORDS)]
    for row in df.select("i", *cols).collect():
        text = TEXTS[row["i"]] or ""
        for i, w in enumerate(WORDS):
            p = re.compile(rf"\b{re.escape(w)}\b" if whole else re.escape(w), 0 if case else re.I)
            m = p.search(text)
            part = None
            if m:
                a, b = max(0, m.start() - 40), min(len(text), m.end() + 40)
                part = ("..." if a else "") + text[a:b].strip() + ("..." if b < len(text) else "")
            assert tuple(row[f"w{i}"]) == (len(p.findall(text)), m is not None, part), (w, text)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(string.ascii_letters + string.digits + "-_. ", min_size=1, max_size=12), min_size=2, max_size=30))
def test_natural_order(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").withColumn("k", naming.natural_column("n"))
    rows = df.withColumn("c", naming.sortable(F.col("k"))).orderBy("k", "i").collect()
    assert [r["i"] for r in rows] == [i for _, i in sorted((naming.natural_key(n), i) for i, n in enumerate(names))]
    strings = [r["c"].encode() for r in rows]
    assert strings == sorted(strings)


def test_names(spark):
    cases = {"12_chapter.pdf": "12", "chapter.pdf": "", "12-chapter.pdf": "", "12.pdf": "", "3_upper.PDF": "3", "007_bond.pdf": "7", "0_x.pdf": "0"}
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    number, _ = naming.numeric_prefix("n")
    assert {r["n"]: r["x"] for r in df.select("n", number.alias("x")).collect()} == cases
    for name in ("a.b.pdf", ".hidden", "plain", "x/y.z"):
        assert spark.createDataFrame([(name,)], "n string").select(naming.stem_column("n")).first()[0] == naming.stem(name)
    assert naming.page_name("doc", 7) == "doc-page-0007.png"


def test_payloads(spark):
    df = spark.createDataFrame([(b"123456789", "ﬁne oﬃce"), (bytes(300), "plain"), (None, None)], "d binary, t string")
    rows = df.select(payloads.base64_line("d"), payloads.data_uri("d"), payloads.expand_ligatures("t"), F.crc32("d"), payloads.xxh64("d", 0)).collect()
    assert rows[0][0] == "MTIzNDU2Nzg5" and "\n" not in rows[1][0] and rows[0][1].startswith("data:image/png;base64,") and rows[0][2] == "fine office"
    assert rows[0][3] == 0xCBF43926 and rows[2][2] is None and int(rows[0][4]) == 0x8CB841DB40E6AE83
    text = spark.createDataFrame([("é".encode(),), (b"\xff",)], "d binary").select(payloads.strict_utf8("d")).collect()
    assert [r[0] for r in text] == ["é", None]


def test_digits_of_other_scripts_are_numbers_in_both_forms(spark):
    names = ["١٢_b", "٣_a", "5_c", "５_d", "x२", "x10", "x1", "२०२_z.pdf", "²_no", "x²"]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "doc_id string, filename string")
    ranks = {r["filename"]: r["src_ord"] for r in merge.natural_inputs(df).collect()}
    assert sorted(names, key=ranks.get) == sorted(names, key=lambda n: (naming.natural_key(n), n))
    got = {r["filename"]: r["src_ord"] for r in merge.numbered_inputs(df).collect()}
    assert sorted(got, key=got.get) == ["٣_a", "5_c", "５_d", "١٢_b", "२०२_z.pdf"]


def test_page_specifications_as_columns_are_those_of_the_parser(spark):
    specs = [None, "", "  ", "0", "ALL", " all ", "*", "none", "NONE", "3", "5,1, 2 - 3", "2-2,2", "6", "1-6", "3-1", "1,,2", "1,", ",1", "x", "1-", "-1", "1.5", "1-999999999", "1-99999999999999999999999", "²", "٣", "1-2-3", "0,1", "00002", "1 2", "\u20031\u2003", "1 -\t4"]
    totals = [5, 1, 0, -1, None]
    rows = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in specs for t in totals)]
    df = spark.createDataFrame(rows, "i int, spec string, total int")
    got = {r["i"]: r["p"] for r in df.select("i", pg.spec_pages("spec", "total").alias("p")).collect()}
    for i, s, t in rows:
        try:
            want = pg.parse_pages(s, t)
        except PageRangeError:
            want = None
        assert got[i] == want, (s, t)
