"""Packing, sharding and similarity operators against brute force, and their edge cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import blocks, cap_filters, jaccard_join, packing, sharding
from folioscope.llm.shared import components
from folioscope.llm.shingles import sequences, shingle_set, words_of


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("start", "length", "part", "row", "n", "cls", "grp", "shard", "kept")}) if extra else df


def roots(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# -- packing


def test_packing(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "of", "zebra!", "éà", "x1"]) for _ in range(rng.choice([1, 5, 80, 900, 5000]))) for _ in range(60)]
    texts += [None, "", "a <|endoftext|> b", "日本語 text ⅷ", "same", "same"]
    rows = packing.pack_documents(docs(spark, texts, extra=True)).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == np.array(ids, "<u4").tobytes() and {p["doc_tokens"] for p in pieces} == {len(ids)}
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))] and sum(p["length"] for p in pieces) <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack_documents(docs(spark, texts))).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in rows) and packing.pack_documents(docs(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_the_histogram_up(seed):
    rng = random.Random(seed)
    histogram = {n: rng.choice([1, 2, 30, 10**7]) for n in rng.sample(range(1, 101), rng.randint(1, 60))}
    patterns = packing.shortest_pack_first(histogram, 100)
    used = defaultdict(int)
    for runs, count in patterns:
        assert count > 0 and sum(n * c for n, c in runs) <= 100
        for n, c in runs:
            used[n] += c * count
    assert used == histogram
    for length, first, end, copies, *_ in packing.plan(patterns):
        assert 0 <= first < end <= histogram[length] and copies > 0


# -- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 1000])
def test_permutation(spark, n):
    rows = sharding.permuted(spark.range(n).withColumnRenamed("id", "x"), "x", "y", n).collect()
    assert sorted(r["y"] for r in rows) == list(range(n)) and (n < 100 or sum(r["x"] == r["y"] for r in rows) < n / 10)


def test_walks_leave_the_surplus(spark):
    for n in range(2, 60):
        a, b = sharding.halves(n)
        assert n <= a * b < n + max(a, 4)


def test_shards(spark):
    rows = docs(spark, ["same"] * 40 + [None, ""] + [f"t{i}" for i in range(60)], extra=True).withColumn("doc_id", F.when(F.col("doc_id") < 50, 1).otherwise(F.col("doc_id")))
    rows = rows.withColumn("doc_id", F.when(F.col("text") == "t20", None).otherwise(F.col("doc_id")))
    a = sharding.shard_rows(rows, ["doc_id", "text"]).collect()
    b = sharding.shard_rows(rows.repartition(7, "text"), ["doc_id", "text"]).collect()
    assert len(a) == 102 and sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in a) == sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in b)
    by = defaultdict(list)
    for r in a:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_rows(rows.limit(0), ["doc_id"]).count() == 0


def test_shards_on_disk(spark, tmp_path):
    placed = sharding.shard_rows(docs(spark, [f"t{i}" for i in range(30)]), ["doc_id"])
    sharding.write_shards(placed, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 30 and sorted(r["shard"] for r in back.select("shard").distinct().collect()) == list(range(8))


# -- shingles and components


def test_shingles_are_those_of_words():
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice(["a", "B", "aa", "é", "x.y", "Ä"]) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", "\n\t ", "\x0b"]) for w in words)
        lower = words_of(text)
        runs = [tuple(lower[i : i + 5]) for i in range(max(1, len(lower) - 4))] if lower else []
        assert len(shingle_set(text)) == len(set(runs)) and len(set(zip(runs, sequences(lower, 5).tolist(), strict=True))) == len(set(runs))


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(500, 560)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = roots(600, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked} and components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- Jaccard


def brute_components(texts):
    sets = [frozenset(shingle_set(t).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links)


@pytest.mark.parametrize("group", [256, 3])
def test_jaccard(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(blocks, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(jaccard_join, "RANGE_BYTES", 3000)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    texts = [None, "", "  ", "one", "ONE", "one two", "a b c d", "a b c d e", "a b c d e f", "a  B c d e f g", "a b c d e f g h"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 12, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[word()], [], [copy[at], word()]])
            texts.append(" ".join(copy))
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(n)) for n in (1, 2, 5, 40, 40, 60, 60)]
    texts += ["the very same text of eight words here"] * 30
    sizes, want = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, texts, extra=True)).collect()}
    assert got == {i: (sizes[i], want[i]) for i in range(len(texts))}
    assert len({c for _, c in got.values()}) < len(texts)


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_components(docs(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(rows).collect()), key=str)
    assert got == [(4, 2, 4), (4, 2, 4), (9, 0, 9), (None, 2, 4)]
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(rows, percent=50)


# -- vectors


@pytest.mark.parametrize("together", [1024, 8])
def test_vectors(spark, monkeypatch, together):
    monkeypatch.setattr(cap_filters, "TOGETHER", together)
    rng = np.random.default_rng(5)
    vectors, labels = [], []
    for size, count in ((1, 1), (1, 40), (3, 5), (8, 6)):
        for _ in range(count):
            base = rng.standard_normal(64)
            for _ in range(size):
                vectors.append((base + rng.standard_normal(64) * 0.12 * np.linalg.norm(base) / 8 * (size > 1)).astype(np.float32).tolist())
                labels.append(int(rng.integers(0, 2)) if size == 3 else 0)
    vectors += [vectors[0]] * 20 + [[2 * x for x in vectors[1]]]
    labels += [0] * 21
    vectors += [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64, [], [1.0, 2.0], [1.0, 2.0], vectors[0]]
    labels += [0, 0, 0, 0, 0, 0, 0, 0, None]
    n = len(vectors)
    unit = [np.asarray(v, float) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and labels[i] is not None else None for i, v in enumerate(vectors)]
    links = [(i, j) for i in range(n) for j in range(i) if unit[i] is not None and unit[j] is not None and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= 0.98]
    degree = [sum(i in x for x in links) for i in range(n)]
    want = roots(n, links)
    df = spark.createDataFrame([(i, v, labels[i]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").withColumn("part", F.lit("x"))
    got = {r["vec_id"]: r for r in cap_filters.cap_components(df).collect()}
    assert len(got) == n and sum(got[i]["n_links"] for i in range(n)) >= 0.99 * sum(degree) and all(got[i]["n_links"] <= degree[i] for i in range(n))
    assert sum(got[i]["component_id"] == want[i] for i in range(n)) >= 0.98 * n and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(n))
    assert cap_filters.cap_components(df.limit(0)).count() == 0


def test_list_decoding_is_exhaustive():
    rng = np.random.default_rng(6)
    code = cap_filters.ProductCode(10, expected=20, codes=16)
    v = rng.standard_normal((30, 10))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    turn, blocks, height = code.parts()
    scores = (v @ turn)[:, :5] @ blocks[0].T
    both = scores[:, :, None] + ((v @ turn)[:, 5:] @ blocks[1].T)[:, None, :]
    row, word = code.decode(v)
    best = both.reshape(30, -1).max(axis=1)
    want = {(i, int(w)) for i in range(30) for w in np.flatnonzero(both[i].ravel() >= min(height, best[i] - 1e-12))}
    assert set(zip(row.tolist(), word.tolist(), strict=True)) == want and zlib.crc32(b"") == 0
