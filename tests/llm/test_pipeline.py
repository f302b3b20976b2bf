"""The pipeline's stages and their chain against brute force, on documents with every odd case."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import decontamination, language_id, packing
from folioscope.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def words(rng, n, kind):
    return " ".join("".join(rng.choice(kind) for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, path = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    kinds = {"aa": "abcdefgh", "zz": "стуфхцч"}
    texts = []
    for lang, kind in kinds.items():
        for _ in range(60):
            texts.append((words(rng, rng.randint(40, 120), kind), lang))
    items = [words(rng, 14, "abcdefgh") for _ in range(3)]
    passage = words(rng, 60, "abcdefgh")
    texts += [(f"{words(rng, 50, 'abcdefgh')}\n{passage}\n{words(rng, 50, 'abcdefgh')}", "aa") for _ in range(5)]
    texts += [(f"{words(rng, 40, 'abcdefgh')} {items[1]} {words(rng, 20, 'abcdefgh')}", "aa")]
    base = words(rng, 100, "abcdefgh").split()
    texts += [(" ".join([*base[:i], "changed", *base[i + 1 :]]), "aa") for i in (3, 50, 97)] + [(" ".join(base), "aa")] * 3
    texts += [(None, "aa"), ("", None), ("1234 5678", "aa"), (words(rng, 9000, "стуфхцч"), "zz")]
    rows = [(i, t, lang, "web", len(t or ""), "x") for i, (t, lang) in enumerate(texts)]
    rows += [(None, " ".join(base), None, "web", 1, "x")] * 2 + [(4, texts[7][0], "aa", "web", 1, "x"), (7, texts[4][0], "aa", "web", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def duplicates_dropped(rows):
    """Rows kept, as (doc_id, text): one for each component of similar texts."""
    sets = [set(shingle_set(r["text"]).tolist()) for r in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append((r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return groups


def test_stages(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.schema.names == docs.schema.names
        if name == "language_id":
            net = language_id.train(docs)
            said = [net.predict(r["text"]) for r in before]
            assert Counter(after) == Counter(r for r, (lang, p) in zip(before, said, strict=True) if lang != "und" and p >= corpus_pipeline.LEAST_SCORE)
            assert {r["doc_id"] for r in after} >= set(range(120)) and not any(r["text"] in (None, "", "1234 5678") for r in after)
        elif name == "line_dedup":
            cleaned = {(r["doc_id"], r["text"]) for r in after}
            repeated = Counter(line for t in {r["text"] for r in before} for line in set(t.split("\n")) if len(line.split()) >= 50)
            recurring = {line for line, n in repeated.items() if n > 1}
            assert recurring and len(after) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
            assert cleaned == {(r["doc_id"], "\n".join(x for x in r["text"].split("\n") if x not in recurring)) for r in before}
        elif name == "near_duplicates":
            groups = duplicates_dropped(before)
            kept = Counter((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in after)
            assert len(after) == len(groups) < len(before)
            for g in groups.values():
                ids = min((x[0], x[1]) for x in g)
                assert sum(kept[x] for x in set(g)) == 1 and any(kept[x] and x[:2] == ids for x in set(g))
        elif name == "decontamination":
            items = [decontamination.words(r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
            hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [decontamination.words(t)] for i in range(len(w)))
            assert Counter(after) == Counter(r for r in before if not hit(r["text"])) and len(after) == len(before) - 1
        else:
            from tokenizers import Tokenizer

            exact = Tokenizer.from_file(packing.default_tokenizer())
            ids = defaultdict(bytes)
            for r in sorted(after, key=lambda r: r["start"]):
                ids[r["doc_id"]] += bytes(r["ids"])
            want = [(r["doc_id"], np.array([*exact.encode(r["text"], add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in before]
            shares = Counter(i for i, _ in want)  # two different texts have the ids 4 and 7
            assert {i: b for i, b in ids.items() if shares[i] == 1} == {i: b for i, b in want if shares[i] == 1}
            assert sum(map(len, ids.values())) == sum(len(b) for _, b in want) and set(ids) == set(shares)
        docs = spark.createDataFrame(after, out.schema) if name != "packing" else docs


def test_run_and_empty_tables(spark, tables, tmp_path):
    path, _ = tables
    packed = corpus_pipeline.run(spark, path)
    assert packed.count() > 100 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name


def test_columns_of_any_name_pass_through(spark, tables):
    """Names that operators use for their own columns, and names with dots, come out of every stage as they went in."""
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = ["score", "lang_pred", "n_lines", "n_words", "items", "contaminated", "__row", "__tkey", "__drop", "__tokens", "row", "a.b", "a", "component_id", "Row x"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i} "), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        pick = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
        before, after = Counter(docs.select(*pick).collect()), Counter(out.select(*pick).collect())
        assert after and not after - before, name
        docs = spark.createDataFrame(out.collect(), out.schema)
