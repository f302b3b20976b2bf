"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from folioscope.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        around = sorted((-m, x) for x, m in counts.items() if near(w, x))
        forms[w] = around[0][1] if around and -around[0][0] >= ratio * n else None
        out[w] = (n, len(around), -around[0][0] if forms[w] else None)
    said = {}
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        said[w] = (w, forms[w], root, *out[w])
    return said


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    random.seed(seed)
    letters = ["ab", "abc", "aé漢😀", "abcdefghijklmnopqrstuvwxyz"][seed]
    words = {"".join(random.choices(letters, k=random.randint(0 if seed == 1 else 1, 6 if seed < 3 else 3))) for _ in range(260)}
    words |= {"a" * k for k in range(1, 9)} | {"b", "ba", "prefix" * 50, "prefix" * 50 + "x", "prefix" * 49 + "prefi", "prefix" * 49 + "prefiy"}
    counts = {w: random.choice([1, 1, 2, 5, 25, 25, 130, 700, 4000]) for w in words}
    rows = [(w, n) for w, n in counts.items() if n > 1] + [(w, 1) for w, n in counts.items() if n == 1] + [(None, 7), ("aaaa", None)]
    df = spark.createDataFrame(rows, "word string, n int")
    got = {r["word"]: (r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df).collect()}
    assert got == brute(counts)


def test_many_words_around_one(spark):
    """A word with neighbours at every place, a third of all words below one node; forms chain over three steps."""
    hub = "abcdefgh"
    words = {hub: 100_000, "abcdefg": 900} | {hub[:i] + c + hub[i + 1 :]: 20_000 for i in range(8) for c in "vwxyz"} | {hub[:4] + c + hub[4:]: 5 for c in "éèêë"} | {"vbcdefgy": 4000, "vbcdefgyy": 800, "vbcdefgyyy": 160, "zzzzzz": 5}
    got = {r["word"]: tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == brute(words) and got["vbcdefgyyy"][2] == hub
    df = spark.createDataFrame([("one", 3), ("one", 4), ("ones", 50)], "word string, n long").selectExpr("word", "n", "'x' as form", "1 as `a.b`")
    assert sorted(tuple(r) for r in spelling.spelling_variants(df).collect()) == [("one", "ones", "ones", 7, 1, 50), ("ones", None, "ones", 50, 1, None)]
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)


def test_words_of_texts(spark):
    random.seed(5)
    vocabulary = ["Straße", "STRAßE", "Überall", "überall", "Éclairs", "letters", "LETTERS", "a1b", "x" * 3000, "multi×ply÷ed", "日本語日本語", "short"]
    texts = [" ".join(random.choices(vocabulary, k=60)) for _ in range(40)] + [None, "", "-", "naïve_naïve"]
    docs = spark.createDataFrame([(i if i != 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, word int")
    want = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i == 7 else i}:{low}".encode())
            want[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 19 == 0 else low] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert {r["word"]: r["n"] for r in spelling.counted_words(docs, slip_every=19).collect()} == want and len(want) > 9
    plain = {r["word"]: r["n"] for r in spelling.counted_words(docs).collect()}
    assert "letters" in plain and "LETTERS" not in plain and "x" * 3000 in plain and "short" not in plain
