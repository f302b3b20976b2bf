"""Text operators against brute force, and the edge cases that their docstrings define."""

import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import backoff_scores, blocks, decontamination, language_id, line_templates, pii, quality, queries

SCHEMA = "doc_id long, text string"


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("spans", "n_words", "score", "part", "n", "hits", "row", "token", "__text")}) if extra else df


def prose(rng, n, vocabulary=400):
    return " ".join("w" + "".join(chr(97 + int(d)) for d in str(rng.randrange(vocabulary))) for _ in range(n))


# -- decontamination


def brute_hits(text, items):
    w = decontamination.words(text)
    hit, named = set(), set()
    for item, t in items:
        p = decontamination.words(t)
        for k in range(max(1, len(p) - 9) if p else 0):
            window = p[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    named.add(str(item))
    return len(w), len(hit), sorted(named)


@pytest.mark.parametrize("pass_bytes", [16_000_000, 300])
def test_decontamination(spark, pass_bytes):
    rng = random.Random(1)
    items = [(i, prose(rng, n, 30)) for i, n in enumerate((40, 12, 10, 9, 1, 25, 25))] + [(7, None), (8, " .. "), (9, "One, two-three FOUR"), (10, "one two three four"), (None, "zzz"), (12, "É à")]
    texts = [prose(rng, 300, 30), items[0][1].upper().replace(" ", ".."), items[2][1], None, "", "É_à", "zero one two three Four five", "w1", prose(rng, 30, 4000), (items[1][1] + " ") * 40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find_contamination(docs(spark, texts, extra=True), bench, pass_bytes=pass_bytes).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, named = brute_hits(texts[r["doc_id"]], [x for x in items if x[0] is not None])
        assert (r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), list(r["items"]), r["contaminated"]) == (n, hit, named, hit > 0), r["doc_id"]


def test_items_without_an_id_and_memory(spark):
    rng = random.Random(3)
    long = prose(rng, 30000, 9000)
    items = spark.createDataFrame([(None, "alpha beta gamma"), (1, None), (2, "delta"), (2, "delta")], "item_id long, text string")
    rows = docs(spark, ["x alpha beta gamma y", "delta delta", None, "alpha beta", long + " delta"]).unionAll(docs(spark, ["delta delta"]))
    got = {(r["doc_id"], r["n_words"]): r for r in decontamination.find_contamination(rows, items).collect()}
    assert got[0, 5]["contaminated"] and got[0, 5]["items"] == [None] and got[1, 2]["items"] == ["2"] and got[0, 2]["items"] == ["2"]
    assert not got[3, 2]["contaminated"] and got[4, 30001]["contaminated"] and got[4, 30001]["hits"][0]["start"] == 30000
    search = decontamination.WuManber([(str(i), prose(rng, 300, 9000)) for i in range(200)])
    assert search.size() < 60 * 200 * 291


def test_decontamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontamination.find_contamination(docs(spark, ["a b"]), empty).collect()] == [False]
    assert decontamination.find_contamination(docs(spark, ["a"]).limit(0), empty).count() == 0


# -- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_personal_data(spark):
    rng = random.Random(2)
    texts = [
        "a@b.c_d@e.f x@y.z.w a@b é😀 m.n@o-p.q, 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3.256 4539 1488 0343 6467 4539-1488-0343-6468 +1 (900) 555-2077 +12 3 ++4 44-44-44-44.",
        None, "", "+1((((((", "a" * 50_000, "1" * 50_000, "a@b" + ".c" * 20_000, "@" * 1000 + "+" * 1000, "1.1.1.1 " * 3000,
    ]
    texts += ["".join(rng.choice("ab1239 .@+-()_é\n") for _ in range(400)) for _ in range(30)]
    rows = pii.find_personal_data(docs(spark, texts, extra=True)).select("doc_id", "spans", pii.joined(F.col("spans")).alias("said")).collect()
    for r in rows:
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, texts[r["doc_id"]] or "") if valid(k, m[0])]
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert [s for s in got if s[0] in PATTERNS] == want == got[: len(want)], r["doc_id"]
        assert r["said"] == ",".join(f"{k}:{a}:{b}" for k, a, b in got)


def test_added_personal_data(spark):
    texts = ['my token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" ok', "call mobile 555-123-9876 now", "write to jo.doe (at) example (dot) com", "the total 1234567 of pages and order 99887766 is fine", "we met at noon. then at home"]
    rows = pii.find_personal_data(docs(spark, texts)).select("doc_id", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("clean")).orderBy("doc_id").collect()
    assert [bool(r["spans"]) for r in rows] == [True, True, True, False, False]
    assert "e7fb" not in rows[0]["clean"] and "9876" not in rows[1]["clean"] and rows[3]["clean"] == texts[3]


def test_long_secrets_are_covered_whole(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("0123456789abcdef") for _ in range(400))
    token = "".join(rng.choice("ABCDEFabcdef0123456789xyzuvw") for _ in range(300))
    texts = [f'my token = "{long}" ok', f"the api key {token} ok", "a" * 200_000, "token=" + "a" * 200_000]
    rows = pii.find_personal_data(docs(spark, texts)).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    clean = {r["doc_id"]: r["clean"] for r in rows}
    assert long[-20:] not in clean[0] and clean[0].endswith('" ok') and token[-20:] not in clean[1] and clean[1].endswith(" ok")
    assert clean[2] == texts[2] and len(clean[3]) in (len(texts[3]), len("[secret]"))


def test_feature_twins(spark):
    values = [('token = "abc123DEF"', "my secret "), ("(555) 123-4567", "Phone: "), ("x (AT) y DOT z", "$ "), ("", "")]
    df = spark.createDataFrame(values, "v string, b string")
    for g in pii.GENERATORS:
        rows = df.select(*[c.alias(f"f{i}") for i, c in enumerate(pii._features(F.col("v"), F.col("b"), g))]).collect()
        assert [list(r) for r in rows] == [pii.features_of(v, b, g) for v, b in values]
    x = np.array([pii.features_of(v, b, "number") for v, b in values])
    df = spark.createDataFrame([[float(y) for y in r] for r in x], [f"f{i}" for i in range(x.shape[1])])
    said = [r[0] for r in df.select(pii.model().column([F.col(c) for c in df.columns])).collect()]
    assert np.allclose(sorted(said), sorted(pii.model().margin(x)))


# -- line dedup


def test_lines(spark):
    rng = random.Random(3)
    own = [prose(rng, 30) for _ in range(20)]
    footer = "Copyright {} Acme all rights reserved version {}"
    texts = [f"{own[i]}\n{footer.format(2000 + i, i * 7)}\n{own[i][::-1]}" for i in range(12)]
    texts += [own[12] + "\nshared line of four words"] * 9 + [own[13], None, "", "\n\n", "ok ok"] + [f"a note for {w} and all of the readers\n{prose(rng, 40)}" for w in "abcdefgh"]
    rows = line_templates.drop_recurring_lines(docs(spark, texts, extra=True)).orderBy("doc_id").collect()
    for i in range(12):
        assert rows[i]["text"] == f"{own[i]}\n{own[i][::-1]}" and rows[i]["n_dropped"] == 1 and rows[i]["n_lines"] == 3
    assert all(rows[i]["text"] == texts[i] for i in range(12, 26))  # copies of one text are one text
    assert [r["n_lines"] for r in rows[21:26]] == [1, 0, 1, 3, 1] and all(r["n_dropped"] == 1 for r in rows[26:])


def test_lines_of_copies_stay(spark):
    body = [f"sentence number {i} has these words {'abcdefghij'[i]}" for i in range(10)]
    texts = ["\n".join([*body, f"last one {i} differs by {i * 31 + 7} here {chr(97 + i)}"]) for i in range(15)]
    rows = line_templates.drop_recurring_lines(docs(spark, texts)).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    assert line_templates.drop_recurring_lines(docs(spark, ["a"]).limit(0)).count() == 0


def test_lines_whatever_their_share(spark):
    rng = random.Random(8)
    passage = prose(rng, 60)
    short = [f"{prose(rng, 30, 10**6)}\n{passage}" for _ in range(8)]
    family = "\n".join(prose(rng, 12, 10**6) for _ in range(15))
    texts = short + [f"{family}\n{prose(rng, 5, 10**6)}" for _ in range(8)] + [f"{family}\nlast\n{passage}" for _ in range(2)]
    rows = line_templates.drop_recurring_lines(docs(spark, texts), whole=True).collect()
    said = {r["doc_id"]: r["text"] for r in rows}
    assert [said[i] for i in range(8)] == [t.split("\n")[0] for t in short]
    assert [said[i] for i in range(8, 16)] == texts[8:16]  # near copies have one vote
    assert {said[16], said[17]} == {f"{family}\nlast"} and len(rows) == len(texts)


def test_lines_registered_whole(spark, tmp_path):
    rng = random.Random(14)
    own, passage = lambda n: prose(rng, n, 10**6), prose(rng, 60)
    texts = [f"{own(30)}\n{passage}" for _ in range(2)] + [f"{own(30)}\nNext page" for _ in range(50)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.queries()["op5_whole_lines"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in rows} == {i: (t.split("\n")[0], 2, 1) for i, t in enumerate(texts)}


def test_lines_travel_as_marks(spark, monkeypatch):
    rng = random.Random(15)
    lines = [prose(rng, 40, 30) for _ in range(60)]
    df = docs(spark, ["\n".join(rng.sample(lines, 20)) + f"\nlast {i}" for i in range(300)]).cache()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    said, cost = [], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (10**6, -1):  # with broadcasts, and with every join shuffled
            monkeypatch.setattr(line_templates, "BROADCAST_LEAVES", rows)
            before = written()
            said.append(Counter((bytes(r["tkey"]), r["no"]) for r in line_templates.recurring_lines(df).collect()))
            cost.append(written() - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert said[0] == said[1] and len(said[0]) == 300 * 20
    assert cost[1] - cost[0] < 13 * 300 * 20 * 40  # bytes for a token


def test_lines_of_every_length(spark):
    rng = random.Random(10)
    own = lambda: prose(rng, 80, 10**6)
    passage, middle, rare = prose(rng, 60), prose(rng, 25), prose(rng, 10)
    texts = [f"{own()}\n{passage}" for _ in range(2)] + [f"{own()}\n{middle}\n" for _ in range(3)] + [f"{own()}\n{rare}\nHome" for _ in range(5)]
    texts += [f"{own()}\n\nNext page" for _ in range(50)] + [f"{passage}\n{prose(rng, 12, 10**6)}\n7" for _ in range(2)]
    rows = line_templates.drop_recurring_lines(docs(spark, texts), whole=True).collect()
    said = {r["doc_id"]: r["text"] for r in rows}
    first = lambda i: texts[i].split("\n")[0]
    assert all(said[i] == first(i) for i in range(2)) and all(said[i] == first(i) + "\n" for i in range(2, 5))
    assert all(said[i] == texts[i] for i in range(5, 10)) and all(said[i] == first(i) + "\n" for i in range(10, 60))
    assert all(said[i] == texts[i].split("\n", 1)[1] for i in (60, 61))


# -- language


def test_language(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "and", "ing", "tion", "that", "with"], "de": ["und", "der", "keit", "sch", "über", "ich"], "fr": ["les", "eau", "que", "été", "aux", "oi"]}
    make = lambda l, n: " ".join("".join(rng.choice(parts[l]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(l := rng.choice(list(parts)), rng.randint(20, 200)), l) for i in range(400)]
    rows += [(400, None, "en"), (401, "", None), (402, "123 !!", "de"), (403, make("de", 20_000), None), (404, make("fr", 60), None), (404, make("fr", 60), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    said = language_id.identify(df, language_id.train(df)).withColumn("held", language_id.held_out()).collect()
    assert [r["held"] for r in said] == [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in said] and len(said) == len(rows)
    test = [r for r in said if r["held"] and r["lang"] and r["text"] and len(r["text"]) > 10]
    assert len(test) > 60 and sum(r["lang_pred"] == r["lang"] for r in test) > 0.97 * len(test)
    last = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in said if r["doc_id"] >= 400}
    assert [last[i] for i in (400, 401, 402)] == [("und", 0.0)] * 3 and last[403][0] == "de" and last[404][0] == "fr" and all(0 <= r["score"] <= 1 for r in said)
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(none, language_id.train(none)).collect()} == {"und"}


def test_windows_cover_texts():
    for n in (1, 2, 255, 256, 257, 508, 509, 510, 5000):
        w = language_id.to_windows("a" * n)
        step = language_id.WINDOW - 3
        assert (w[:, :step] > 0).sum() + (w[-1, step:] > 0).sum() >= n and w.shape[1] == language_id.WINDOW


def test_letters_are_letters():
    net = language_id.fit(np.concatenate([language_id.to_windows(t) for t in ("abc" * 30, "xyz" * 30)]), np.array([0, 1]), ["a", "x"], epochs=1)
    for text in ("²", "½ ①", "Ⅷ", "12 ٣", "_", "", None):
        assert net.predict(text) == ("und", 0.0)
    assert net.predict("é")[0] in ("a", "x")


def test_every_language_is_learned(spark):
    rng = random.Random(12)
    rows = [(i, f"{chr(0x4E00 + i % 70) * 5} " * rng.randint(20, 30), f"l{i % 70}") for i in range(70 * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(df)
    assert len(net.labels) == 70 and language_id.identify(df.limit(0), net).count() == 0


# -- scores


def test_backoff_scores(spark, monkeypatch):
    monkeypatch.setattr(backoff_scores, "CHUNK_BYTES", 900)
    monkeypatch.setattr(backoff_scores, "BUCKET_BYTES", 2000)
    rng = random.Random(5)
    texts = [prose(rng, n, 12) for n in (60, 80, 1, 2, 3, 40)] * 2 + [None, "", "   ", "only words of mine", prose(rng, 3000, 50)]
    rows = backoff_scores.backoff_scores(docs(spark, texts, extra=True)).collect()
    split = [(t or "").lower().split() for t in texts]
    grams = [Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)) for w in split]
    corpus, total = sum(grams, Counter()), sum(map(len, split))
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        w, own, want = split[r["doc_id"]], grams[r["doc_id"]], 0.0
        rest = lambda g: corpus[g] - own[g]  # noqa: B023, E731
        for i in range(len(w)):
            share = 1.0
            for k in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    want += np.log(share * (rest(g) or 0.5) / (total - len(w)))
                elif rest(g) > 0:
                    want += np.log(share * rest(g) / rest(g[:-1]))
                    break
                share *= 0.4
        assert r["n_tokens"] == len(w) and abs(r["log_score"] - want) < 1e-6 * max(1, abs(want)) and (r["mean_log_score"] is None) == (not w)
    assert backoff_scores.backoff_scores(docs(spark, ["a"]).limit(0)).count() == 0


def test_backoff_count_tables(spark):
    rng = random.Random(16)
    texts = [prose(rng, 50, 15) for _ in range(8)]
    dealt = blocks.chunks(docs(spark, texts).repartition(3), "doc_id", "text", 200).cache()
    held = [np.unique(np.concatenate([h for h, _ in backoff_scores._ngrams(blocks.texts_of(r["sizes"], r["texts"]))[1]]), return_counts=True) for r in dealt.orderBy("chunk").collect()]
    corpus, chunks = Counter(), Counter()
    for grams, own in held:
        corpus.update(dict(zip(grams.tolist(), own.tolist(), strict=True)))
        chunks.update(grams.tolist())
    want = sorted(corpus[g] for grams, _ in held for g in grams.tolist() if chunks[g] > 1)
    found = [r for i in range(2) for r in backoff_scores.shared_counts(backoff_scores.exploded(dealt, 2, i, 2)).collect()]
    assert len(held) > 3 and want and sorted(t for r in found for t in blocks.unpack(r["totals"], r["n"], 8).tolist()) == want


def test_quality(spark):
    rng = random.Random(6)
    good = [" ".join(f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(80)) for _ in range(300)]
    bad = ["".join(rng.choice("#$%&!*") for _ in range(4)) + " " + prose(rng, 60, 10**6) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(330, None, "en"), (331, "", None), (332, good[0], None), (332, good[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] * 2 + [(300, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels, trained=100).collect()}
    assert sum(got[i]["kept"] for i in range(300)) >= 294 and not any(got[i]["kept"] for i in range(300, 332)) and got[332]["kept"] and got[330]["perplexity"] is None
    none = quality.classify(df, labels.limit(0))
    assert none.count() == len(rows) and none.where("kept").count() == len(rows) - 2 and quality.classify(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("trained", [199, 200])
def test_quality_limits_rest_on_half(spark, monkeypatch, trained):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(80)), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "LEAST", 30)
    limits = {(r["lang"], r["limit"]) for r in quality.classify(df, labels, trained=trained).collect()}
    assert len(limits) == 2 and len({x for _, x in limits}) == 2  # each language has its own


def test_quality_trains_on_half_of_all(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.format_string("a b c w%d", F.col("id") % 7).alias("text"), F.lit("en").alias("lang"))
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    fitted, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda texts: fitted.append(texts.count()) or train(texts))
    rows = quality.classify(df, labels).collect()
    assert 2350 < fitted[0] < 2650 and len(rows) == 5000 and all(r["kept"] and r["n_words"] == 4 for r in rows)


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over strings: the natural log probability of a text."""
    split = [["<s>", "<s>", *t.split()] for t in texts]
    three = Counter(tuple(w[i - 2 : i + 1]) for w in split for i in range(2, len(w)))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *[min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]]

    def level(counts, below):
        d, total, off = discounts(counts), Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3)]

        def p(g):
            if not total[g[:-1]]:
                return below(g[1:])
            c = counts[g]
            return (c - d[min(c, 3)]) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * below(g[1:])

        return p

    whole, d = sum(one.values()), discounts(one)
    uniform = sum(d[min(c, 3)] for c in one.values()) / whole / (len(one) + 1)
    word = lambda g: (one[g] - d[min(one[g], 3)]) / whole + uniform if g in one else uniform
    p = level(three, level(two, word))
    return lambda t: sum(np.log(p(tuple(w[i - 2 : i + 1]))) for w in [["<s>", "<s>", *t.split()]] for i in range(2, len(w)))


@pytest.mark.parametrize("shard_rows", [10**6, 300])
def test_kneser_ney(spark, shard_rows):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(rng.choice(words[: 3 + i % 17]) for _ in range(30)) for i in range(40)]
    asked = [*texts[:9], "w0 w1", "never seen", "w5 w19 w5 w19 new w3", "w1", "", None, "w2 " * 3000, "w1"]
    seen = sorted({w for t in texts for w in t.split()})
    asked += [f"w0 w1 {w}" for w in [*seen, "unseen"]]
    want = brute_kneser_ney(texts)
    df = docs(spark, asked).repartition(3)
    got = {r["doc_id"]: r for r in quality.score(df, quality.train(docs(spark, texts)), shard_rows=shard_rows).collect()}
    assert sorted(got) == list(range(len(asked)))
    for i, t in enumerate(asked):
        assert got[i]["n_words"] == len((t or "").split()) and abs(got[i]["log_p"] - want(t or "")) < 1e-6 * max(1, abs(want(t or "")))
    base = want("w0 w1")
    assert abs(sum(np.exp(got[i]["log_p"] - base) for i in range(17, len(asked))) - 1) < 1e-6


def test_quality_by_groups_and_parts_takes_little_disk(spark, monkeypatch, tmp_path):
    rng = random.Random(12)
    texts = [prose(rng, 300, 2000) for _ in range(1200)] + [None, "", "w1"]
    df = docs(spark, texts).repartition(2)
    trained = df.where("doc_id % 6 = 0")
    df.write.option("compression", "zstd").parquet(str(tmp_path / "docs"))
    bytes_of = lambda path: sum(f.stat().st_size for f in pathlib.Path(path).rglob("*.parquet"))
    alive, peak, table, discard = {}, [], quality.table, quality.discard

    def written(rows, name):
        out = table(rows, name)
        alive[out._folioscope_path] = bytes_of(out._folioscope_path.removeprefix("file:"))
        peak.append(sum(alive.values()))
        return out

    def gone(*tables):
        for t in tables:
            alive.pop(t._folioscope_path)
        discard(*tables)

    monkeypatch.setattr(quality, "table", written)
    monkeypatch.setattr(quality, "discard", gone)
    scored = []
    for size in (10**9, 200_000):
        monkeypatch.setattr(quality, "GROUP_BYTES", size, raising=False)
        peak.clear(), alive.clear()
        scored.append({r["doc_id"]: (r["n_words"], round(r["log_p"], 6)) for r in quality.score(df, quality.train(trained)).collect()})
    assert scored[0] == scored[1] and len(scored[0]) == len(texts)
    want = brute_kneser_ney(texts[:1200:6])
    assert all(abs(scored[1][i][1] - want(texts[i])) < 1e-4 for i in (0, 1, 600, 601, 1202))
    assert max(peak) < 2.5 * bytes_of(tmp_path / "docs")


def test_quality_columns_and_empty_tables(spark):
    rows = [(1, "a b c d", "en"), (1, "a b c d", "en"), (None, "a b", None), (2, None, "en"), (3, "x " * 20000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = df.withColumns({c: F.lit("x") for c in ("row", "n", "v", "w", "uv", "uvw", "k", "x", "trusted", "kept", "limit", "of", "cut")})
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for labelled in (labels, labels.limit(0)):
        out = quality.classify(clash, labelled).collect()
        assert len(out) == len(rows) and sorted(r["n_words"] for r in out) == [0, 2, 4, 4, 20000] and len(quality.classify(df.limit(0), labelled).collect()) == 0


def test_words_are_hashed_alike_by_text_and_by_chunk():
    from folioscope.llm.shingles import runs_of_many, word_hashes

    random.seed(3)
    for _ in range(60):
        texts = ["".join(random.choice(["a", "bé", " ", "\n", "\t", "\x0b", "\x0c", "\r", "漢", " ", "x1"]) for _ in range(random.randint(0, 12))).encode() for _ in range(random.randint(1, 8))]
        (want, _), = runs_of_many([t.split() for t in texts], (1,))
        hashes, n = word_hashes(b"".join(texts), [len(t) for t in texts])
        assert hashes.tolist() == want.tolist() and n.tolist() == [len(t.split()) for t in texts]
