"""Files of planes: exact round trips, and the quick encoder against the library."""

import os
import random
import zlib

import numpy as np
import pytest

from folioscope.llm import bit_planes as planes


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(planes.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, planes.END_ID] for x in texts]


def test_encoder_equals_the_library():
    random.seed(1)
    parts = ["it's", "WE'LL", "naïve", "ÀÉÎ", "x²", "½", "µm", "a b", "a\u0085b", "\x1cz\x1d", "\x0b", "\x0c", " ", "　", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "é", "́x", "İstanbul", "ΣΑΣ", "漢字", "😀", "Å", "__x__", "!!!", "'S", "'ſ", "don'T", "\x00", "﻿", "ª", "10,000", "ǅ", "q̣̇", "&amp;", "​", "..", "ß", "ÿ"]
    texts = ["".join(random.choice(parts) + random.choice([" ", "", "\n", "\t\t"]) for _ in range(30)) for _ in range(400)] + parts + ["", " ", "plain words only. And More"]
    coder = planes.WordEncoder(planes.default_tokenizer())
    assert coder.quick
    for _ in range(2):
        assert [np.frombuffer(coder.ids(x.encode()), "<u4").tolist() for x in texts] == [x[:-1] for x in library(texts)]


def test_encoder_forgets_and_relearns(monkeypatch):
    monkeypatch.setattr(planes, "KNOWN_WORDS", 3)
    coder = planes.WordEncoder(planes.default_tokenizer())
    texts = ["one two three four five six one two", "seven one eight two"] * 3
    assert [np.frombuffer(coder.ids(x.encode()), "<u4").tolist() for x in texts] == [x[:-1] for x in library(texts)]
    assert len(coder.known) <= 3 and len(coder.older) <= 3


def test_other_files_are_used_as_they_are():
    import public_tokenizers

    coder = planes.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "  Some Text,\n with  spaces"
    assert not coder.quick and np.frombuffer(coder.ids(text.encode()), "<u4").tolist() == coder.exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", planes.KINDS)
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    for ids in ([], [0], [0] * 9, [2**32 - 1, 0, 5], rng.integers(0, 49_408, 1000), rng.integers(0, 2**32, 77), [255, 256, 65_535, 65_536]):
        ids = np.array(ids, "<u4")
        assert planes.from_planes(planes.to_planes(ids, kind), len(ids), kind).tolist() == ids.tolist()
    assert len(planes.to_planes(np.array([3], "<u4"), "bit")) == 2 and len(planes.to_planes(np.array([256], "<u4"), "byte")) == 2


@pytest.mark.parametrize("kind", planes.KINDS)
def test_files_round_trip(spark, tmp_path, kind):
    random.seed(2)
    texts = [None, "", "a", "tail <|endoftext|> end", "long words " * 900] + [" ".join(random.choices(["the", "Thing", "été", "漢"], k=random.randint(0, 40))) for _ in range(300)]
    rows = [(random.choice([i, i, 5, -i]), t, "x", 1) for i, t in enumerate(texts)] + [(5, "same row", "y", 2)] * 60 + [(None, "no id", "z", 3)]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `a.b` int").repartition(7)
    path = str(tmp_path / "ids")
    planes.write_documents(docs, path, planes=kind, block=64, file_ids=500)
    got = planes.read_documents(spark, path).collect()
    index = planes.index_of(path)
    assert len(index["files"]) > 5 and sum(f["docs"] for f in index["files"]) == len(rows) == len(got)
    assert all(os.path.getsize(f"{path}/{f['name']}") == f["bytes"] for f in index["files"])
    got = sorted(got, key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == [None] + sorted(k for k in keys if k is not None)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist() and index["ids"] == sum(r["n_tokens"] for r in got)
    want = sorted(((k, tuple(ids)) for (k, *_), ids in zip(rows, library([r[1] for r in rows]), strict=True)), key=repr)
    assert sorted(((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got), key=repr) == want
    everything = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    for start, count in ((0, 1), (63, 2), (64, 64), (490, 700), (len(everything) - 3, 10), (len(everything), 4), (5, 0)):
        assert planes.read_span(path, start, count).tolist() == everything[start : start + count].tolist()
    with pytest.raises(Exception, match="already"):
        planes.write_documents(docs, path)


def test_nothing_to_write(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    planes.write_documents(docs, str(tmp_path / "none"))
    out = planes.read_documents(spark, str(tmp_path / "none"))
    assert out.count() == 0 and out.schema["doc_id"].dataType.simpleString() == "string" and planes.read_span(str(tmp_path / "none"), 0, 9).size == 0


def test_a_failed_write_is_not_read(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").repartition(2)
    spark.dataSource.register(planes.Planes)
    bad = docs.selectExpr("doc_id", "if(doc_id = 2, cast(null as binary), cast('aaaa' as binary)) as ids")
    with pytest.raises(Exception, match="."):
        bad.write.format("token_planes").mode("append").save(path)
    assert not os.path.exists(f"{path}/{planes.INDEX}")
    planes.write_documents(docs, path)
    assert planes.read_documents(spark, path).count() == 2


def test_query_equals_the_library(spark):
    from folioscope.llm import queries as llm

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for r, ids in zip(docs, library([r["text"] for r in docs]), strict=True):
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in llm.op13_bit_planes(spark, sf).collect()) == want


def test_packing_encodes_as_its_file_says(tmp_path):
    """The quick path is for files that it understands; any other file's own rules hold."""
    import json

    from folioscope.llm import packing

    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        plain = json.load(file)
    changes = {
        "none": lambda x: None,
        "space": lambda x: x["pre_tokenizer"].update(add_prefix_space=True),
        "lower": lambda x: x.update(normalizer={"type": "Lowercase"}),
        "split": lambda x: x.update(pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, x["pre_tokenizer"]]}),
        "merges": lambda x: x["model"]["merges"].reverse(),
    }
    texts = ["plain words, and More 1234", " leading", "it's\n\n  two", "é 漢"]
    for name, change in changes.items():
        said = json.loads(json.dumps(plain))
        change(said)
        path = str(tmp_path / f"{name}.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(said, file)
        coder = packing.Encoder(path)
        assert (coder.fast is not None) == (name == "none")
        assert [coder.ids(t) for t in texts] == [coder.exact.encode(t, add_special_tokens=False).ids for t in texts]
