"""Fill-in-the-middle: cuts, forms and restoration against plain Python."""

import hashlib

from folioscope.llm import fill_in_middle as fim

TEXTS = ["", None, "plain text", "häßlich über", "漢字かな交じり", "a😀b😀😀ç漢", "😀", "x<P>y", "<M>", "<<P", "S><", "a" * 70_000 + "é" * 30_000 + "漢" * 5, "\n\t ", "éà", "ÿĀ߿ࠀ￿\U00010000"]


def brute(doc_id, text, seed=1, cut=90, suffix_first=20):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return len(t), "plain", None, None, t
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if h4 % 100 < suffix_first:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_equals_brute_force_and_restores(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "mine", None) for i in range(20 * len(TEXTS))] + [(None, "no id", "x", 1), (3, "same id", "y", 2), (3, "same id", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `a.b` int")
    out = fim.fill_in_middle(docs)
    got = out.withColumn("back", fim.restored("output", "form")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *brute(i, t)) for i, t, *_ in rows), key=lambda r: repr(key(r)))
    assert sorted((tuple(r)[:6] for r in got), key=lambda r: repr(key(r))) == want
    texts = {(i, t or "") for i, t, *_ in rows}
    assert {(r["doc_id"], r["back"]) for r in got} == texts and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_shares_follow_the_parameters(spark):
    docs = spark.range(3000).selectExpr("id as key", "'some words here' as body")
    forms = lambda **k: {r["form"]: r["count"] for r in fim.fill_in_middle(docs, "key", "body", **k).groupBy("form").count().collect()}
    said = forms()
    assert 200 < said["plain"] < 400 and 430 < said["spm"] < 650
    assert forms(cut=100, suffix_first=0) == {"psm": 3000} and forms(cut=0) == {"plain": 3000}
    a, b = (fim.fill_in_middle(docs, "key", "body", seed=s).select("output").distinct().count() for s in (1, 2))
    assert a > 50 and b > 50


def test_runs_hold_every_offset(spark):
    for text in filter(None, TEXTS):
        runs = fim.Runs(text.encode())
        places = range(len(text) + 1) if len(text) < 100 else (0, 1, 69_999, 70_000, 70_001, 99_999, 100_000, 100_004, len(text))
        assert [runs.offset(k) for k in places] == [len(text[:k].encode()) for k in places]
    docs = spark.createDataFrame([(1, "aaéé漢b"), (2, None), (3, "abc")], "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in fim.class_runs(docs).collect()}
    assert rows[1] == (6, [0, 2, 4, 5], [0, 2, 6, 9], [1, 2, 3, 1]) and rows[2] == (0, [0], [0], [1]) and rows[3][0] == 3
