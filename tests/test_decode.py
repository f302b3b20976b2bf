"""Decoders: tokens, cross-references, maps, glyph positions, records and whole documents."""

import random
import zlib

import pytest

from folioscope.decode import cmap, document, flate, glyphs, lexer, objects, slab
from folioscope.decode import tables as decoded
from folioscope.errors import UnreadableError


def kinds(data):
    return [(t.type, t.value) for t in lexer.tokens(data)]


def test_tokens():
    assert kinds(b"/Na#20me 12 -3.5 +7 (a(b)\\)c) <4 1> << >> [ ] true % note\nstream endstream } > x") == [
        ("Name", b"/Na#20me"), ("Integer", b"12"), ("Real", b"-3.5"), ("Integer", b"+7"), ("StringLit", b"(a(b)\\)c)"), ("HexStr", b"<4 1>"),
        ("DictStart", b"<<"), ("DictEnd", b">>"), ("ArrayStart", b"["), ("ArrayEnd", b"]"), ("Keyword", b"true"), ("StreamStart", b"stream"), ("StreamEnd", b"endstream"), ("Keyword", b"x"),
    ]
    values = [t.int_val for t in lexer.tokens(b"99999999999999999999 -99999999999999999999 +5")]
    assert values == [2**63 - 1, -(2**63), 5] and list(lexer.tokens(b"")) == [] and kinds(b"(open") == [("StringLit", b"(open")]


def test_tokens_of_noise_end():
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"()<>[]{}/%\\ 12.-abR\n\x00\xff") for _ in range(rng.randint(0, 200)))
        assert sum(1 for _ in lexer.tokens(data)) <= len(data)
    assert len(list(lexer.tokens(b"{" * 1_000_000))) == 0


def test_strings():
    assert lexer.string_bytes(b"(a\\n\\101\\\r\nb\\)\r\nc\\777)") == b"a\nAb)\nc\xff" and lexer.string_bytes(b"<414>") == b"A@"


def test_inflation_is_bounded():
    assert flate.inflate(zlib.compress(b"hello")) == ("ok", b"hello") and flate.inflate(b"junk") == ("bad_data", b"")
    assert flate.inflate(zlib.compress(bytes(10**6)))[0] == "limit_exceeded" and flate.inflate(zlib.compress(b"hello"), 4)[0] == "limit_exceeded"
    assert flate.inflate(zlib.compress(b"hello world")[:-3])[0] == "bad_data"


def test_character_map():
    m = cmap.parse_cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0041> <D83DDE00> <0041> <FB03> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange")
    assert m.map == {0x41: "ffi", 0x10: "a", 0x11: "b", 0x12: "c", 0x20: "x", 0x21: "y"} and m.code_bytes == 2
    assert cmap.parse_cmap(b"1 beginbfchar <41> <D83D> endbfchar 1 beginbfrange <05> <01> <0061> endbfrange").skipped == 2


def near(glyph, **said):
    got = {"code": glyph.code, "x": glyph.trm[4], "y": glyph.trm[5], "a": glyph.trm[0], "advance": glyph.advance}
    return all(abs(got[k] - v) < 1e-3 for k, v in said.items())


def test_glyph_positions():
    g = list(glyphs.Interpreter(lambda f, c: 500).run(b"q 2 0 0 2 5 5 cm BT /F1 10 Tf 1 Tc 2 Tw 50 Tz 3 Ts 10 20 Td (A B) Tj 0 -12 TD T* [(C) 100 (D)] TJ ET Q (x) Tj"))
    assert [x.code for x in g] == [65, 32, 66, 67, 68]
    assert near(g[0], x=25, y=51, a=10, advance=3.5) and near(g[1], x=32, advance=5.5) and near(g[2], x=43)
    assert near(g[3], x=25, y=5 + 2 * (20 - 24) + 6) and near(g[4], x=25 + 2 * (3.5 - 0.5))


def test_glyph_state():
    i = glyphs.Interpreter(lambda f, c: 1000, lambda f: 2)
    g = list(i.run(b"(no) Tj Q BT /F 8 Tf 14 TL 1 0 0 1 3 4 Tm <00410042FF> Tj 2 1 (ab) \" (cd) ' zz ET ]"))
    assert [x.code for x in g] == [0x41, 0x42, 0x6162, 0x6364] and near(g[2], x=3, y=-10) and near(g[3], y=-24)
    assert i.stats["ops_outside_text"] == 1 and i.stats["gstate_underflow"] == 1 and i.stats["ops_unknown"] == 1 and i.stats["unterminated_code_tail"] == 1 and i.stats["stray_array_ends"] == 1
    assert list(i.run(b"BT 5 0 Td (ok) Tj"))[0].font == "F"  # state goes on


def test_slab():
    columns = {"x": [1.0, 2.0], "y": [3.0, 4.0], "w": [1.0, 1.0], "h": [2.0, 2.0], "codepoints": [65, 66], "term_hashes": [2**63, 5]}
    data = slab.build(3, 612, 792, columns, b"post")
    found = slab.read(data)
    assert found["x"] == [1.0, 2.0] and found["term_hashes"] == [5, 2**63] and found["postings"] == b"post" and found["page"] == 3 and data[:4] == b"UPS1"
    assert slab.read(data[:-1]) is None and slab.read(data[:70] + b"\x01" + data[71:]) is None and slab.read(b"") is None


def test_documents_round_trip():
    data = document.from_texts(["alpha (beta)", "line one\nline two", ""], {0: [("http://a.example/x", [1, 2, 3, 4])]})
    d = document.Document(data)
    assert [d.text(i) for i in range(3)] == ["alpha (beta)", "line one\nline two", ""] and d.links(0) == [("http://a.example/x", [1.0, 2.0, 3.0, 4.0])]
    t = objects.locate_trailer(data)
    assert t.root == (1, 0) and data[t.startxref : t.startxref + 4] == b"xref"
    merged, counts = document.assemble([(data, [1, 0]), (data, None)])
    m = document.Document(merged)
    assert counts == [2, 3] and [m.text(i) for i in range(5)] == ["line one\nline two", "alpha (beta)", "alpha (beta)", "line one\nline two", ""]


def test_object_streams_and_cross_reference_streams():
    inner = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Count 1 /Kids [3 0 R]>>"), (3, b"<</Type /Page /Parent 2 0 R>>")]
    head = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for _, b in inner[:i])) for i, (n, _) in enumerate(inner))
    body = zlib.compress(head + b"\n" + b" ".join(b for _, b in inner))
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n<</Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(head) + 1, len(body), body)
    at5 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)]
    x = zlib.compress(b"".join(bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in rows))
    out += b"5 0 obj\n<</Type /XRef /W [1 3 1] /Size 6 /Root 1 0 R /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(x), x, at5)
    found = objects.read_xref(out)
    assert not found.rebuilt and found.entries[2] == objects.Entry("Compressed", container=4, index=1) and document.Document(out).page_count == 1


def test_broken_documents():
    data = document.from_texts(["kept"])
    assert document.Document(data.replace(b"startxref", b"startxxxx")).text(0) == "kept"  # found by looking
    for broken in (b"", b"junk", b"%PDF-1.4 junk", b"%PDF-1.4\n1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type /Pages /Count 0 /Kids []>>\nendobj\ntrailer <</Root 1 0 R>>", data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")):
        with pytest.raises(UnreadableError):
            document.Document(broken)
    rng = random.Random(2)
    for _ in range(60):
        noisy = bytearray(data)
        for _ in range(8):
            noisy[rng.randrange(len(noisy))] = rng.randrange(256)
        try:
            document.Document(bytes(noisy)).text(0)
        except UnreadableError:
            pass


def test_sql_table_functions(spark):
    decoded.register(spark)
    spark.createDataFrame([(1, b"/A 5"), (2, None)], "k int, d binary").createOrReplaceTempView("bytes_of")
    rows = spark.sql("SELECT k, t.type, t.int_val FROM bytes_of, LATERAL lex(d) t ORDER BY k, t.tok").collect()
    assert [tuple(r) for r in rows] == [(1, "Name", 0), (1, "Integer", 5)]


def test_a_map_is_parsed_once():
    doc = document.Document(document.from_texts(["one", "two"]))
    assert doc.cmap(b"1 beginbfchar <41> <0061> endbfchar") is doc.cmap(b"1 beginbfchar <41> <0061> endbfchar")
    assert doc.cmap(b"").map == {}


def test_the_short_way_reads_what_tokens_say():
    random.seed(6)
    parts = [b"/A", b"/B#20c", b"12", b"-3", b"+4", b"1.5", b"-.5", b"3 0 R", b"(a b)", b"(a\\)b)", b"((n))", b"<41>", b"<<", b">>", b"[", b"]", b"true", b"null", b"nullR", b"%c\n", b"{", b"1 2 3 R", b"/", b">", b"endobj"]
    for i in range(4000):
        data = b"".join(random.choice(parts) + random.choice([b" ", b"\n", b""]) for _ in range(random.choice([1, 3, 8])))
        data = data if i % 3 else b"<<" + data + b">>"
        assert repr(objects.parse(data)) == repr(objects._value(objects._Tokens(objects.tokens(data)))), data
    plain = b"<</Type /Page /Kids [3 0 R 4 0 R] /Box [0 0 6.5 -1] /A <</S (x y)>> /B true>>"
    assert objects._plain(plain, 0) == (objects.parse(plain), len(plain))


def test_small_tables_are_dealt_to_tasks(spark, tmp_path):
    """One file of few bytes is one task of a scan, whatever is made of its rows."""
    from folioscope import queries

    n = 12_000
    spark.range(1, n + 1).selectExpr("id as p_partkey", "'a b' as p_name", "5 as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 3001).selectExpr("id as s_suppkey", "'S' as s_name").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    for name, tasks in (("binary_pages", 3), ("binary_search", 3), ("binary_links", 3), ("page_specs", 3), ("lex_tokens", 3)):
        assert queries.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() == tasks, name


def test_inflated_files_of_large_numbers(spark, tmp_path):
    from folioscope import queries

    spark.createDataFrame([(k, "S") for k in (1501, 60_001, 60_002, 60_003, 60_005)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    found = {tuple(r) for r in queries.queries()["inflate_guard"](spark, str(tmp_path)).collect()}
    assert found == {(1501, "ok", 3004), (60_001, "ok", 120_004), (60_002, "ok", 120_006), (60_003, "limit_exceeded", 0), (60_005, "bad_data", 0)}
