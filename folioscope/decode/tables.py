"""Decoders as table functions, and queries that run them on bytes made from the test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.decode.glyphs import COUNTERS
from folioscope.sources.tables import spread

TOKENS = "tok int, pos long, type string, value binary, int_val long, float_val float"
XREF = "object long, kind string, offset decimal(20,0), generation long, container long, idx long"
TRAILER = "startxref decimal(20,0), root_object long, root_generation long, prev decimal(20,0)"
CMAP = "code long, codepoints array<int>"
GLYPHS = "glyph int, code long, font string, trm array<float>, advance float"
STATISTICS = ", ".join(f"{c} long" for c in COUNTERS)
INFLATED = "status string, data binary"
SLAB = "page int, glyphs int, terms int, crc_ok boolean, xs array<float>, hashes array<long>"


#: Bytes of binary values that are handed on at once, about.
BATCH_BYTES = 16 << 20


def exploded(df: DataFrame, key: str, data: str, schema: str, rows: Callable[[bytes], Iterator[tuple[Any, ...]]]) -> DataFrame:
    """(key, columns of ``schema``): the rows that ``rows`` makes of each binary value, in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in _split(schema)]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for k, d in zip(pdf[key], pdf[data], strict=True):
                for row in rows(bytes(d)) if d is not None else ():
                    out.append((k, *row))
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(out, columns=[key, *names])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=[key, *names])

    return df.select(key, data).mapInPandas(run, f"{key} {kind}, {schema}")


def _split(schema: str) -> list[str]:
    """Columns of a schema; a comma in brackets divides nothing."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def token_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from folioscope.decode.lexer import tokens

    for i, t in enumerate(tokens(data)):
        yield i, t.pos, t.type, t.value, t.int_val, t.float_val


def xref_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from decimal import Decimal

    from folioscope.decode.objects import read_xref

    for number, e in sorted(read_xref(data).entries.items()):
        yield number, e.kind, Decimal(e.offset), e.generation, e.container, e.index


def trailer_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from decimal import Decimal

    from folioscope.decode.objects import locate_trailer

    t = locate_trailer(data)
    big = lambda x: None if x is None else Decimal(x)
    yield big(t.startxref), t.root and t.root.number, t.root and t.root.generation, big(t.prev)


def cmap_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from folioscope.decode.cmap import parse_cmap

    for code, text in sorted(parse_cmap(data).map.items()):
        yield code, [ord(c) for c in text]


def glyph_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from folioscope.decode.glyphs import Interpreter

    for i, g in enumerate(Interpreter().run(data)):
        yield i, g.code, g.font, list(g.trm), g.advance


def statistics_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from folioscope.decode.glyphs import Interpreter

    interpreter = Interpreter()
    for _ in interpreter.run(data):
        pass
    yield tuple(interpreter.stats[c] for c in COUNTERS)


def inflated_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from folioscope.decode.flate import inflate

    yield inflate(data)


def slab_rows(data: bytes) -> Iterator[tuple[Any, ...]]:
    from folioscope.decode.slab import read

    found = read(data)
    if found is None:
        yield None, None, None, False, [], []
    else:
        yield found["page"], len(found["x"]), len(found["term_hashes"]), True, found["x"], found["term_hashes"]


def register(spark: SparkSession) -> None:
    """SQL table functions lex, xref, cmap and glyphs, each of one binary argument."""
    from pyspark.sql.functions import udtf

    for name, schema, rows in (("lex", TOKENS, token_rows), ("xref", XREF, xref_rows), ("cmap", CMAP, cmap_rows), ("glyphs", GLYPHS, glyph_rows)):
        maker = type(name, (), {"eval": lambda self, data, f=rows: f(bytes(data)) if data is not None else iter(())})
        spark.udtf.register(name, udtf(maker, returnType=schema.replace("decimal(20,0)", "decimal(20,0)")))


def _suppliers(spark: SparkSession, sf_dir: str, data: Column) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"), "s_suppkey", 1000)
    return rows.select("s_suppkey", F.encode(data, "UTF-8").alias("data"))


def lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("/F1 12 Tf % note\n"), F.col("s_suppkey").cast("string"), F.lit(" 2.5 Td ("), F.col("s_name"), F.lit(") Tj"))
    found = exploded(_suppliers(spark, sf_dir, text), "s_suppkey", "data", TOKENS, token_rows)
    return found.select("s_suppkey", "tok", "pos", "type", F.decode("value", "UTF-8").alias("value"), "int_val", F.col("float_val").cast("double").alias("float_val"))


def glyph_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("BT /F1 12 Tf 10 "), F.col("s_suppkey").cast("string"), F.lit(" Td ("), F.col("s_name"), F.lit(") Tj ET"))
    found = exploded(_suppliers(spark, sf_dir, text), "s_suppkey", "data", GLYPHS, glyph_rows)
    at = lambda i: F.element_at("trm", i).cast("double")
    return found.select("s_suppkey", "glyph", "code", "font", at(1).alias("a"), at(5).alias("x"), at(6).alias("y"), F.col("advance").cast("double").alias("advance"))


def glyph_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing, scale, rise, leading, saved states and matrices, and all four operators that show strings."""
    key = F.col("s_suppkey").cast("string")
    first = F.concat(F.lit("q 2 0 0 3 5 7 cm BT /F1 10 Tf 1 Tc 4 Tw 50 Tz 20 TL 2 Ts 1 0 0 1 10 "), key, F.lit(" Tm (A B) Tj [(C) -100 (D)] TJ T* (E) ' 3 1 (F ) \" ET Q "))
    text = F.concat(first, F.lit("BT /F2 8 Tf 0 "), key, F.lit(" Td (G) Tj ET"))
    found = exploded(_suppliers(spark, sf_dir, text), "s_suppkey", "data", GLYPHS, glyph_rows)
    at = lambda i: F.element_at("trm", i).cast("double")
    return found.select("s_suppkey", "glyph", "code", "font", at(1).alias("a"), at(4).alias("d"), at(5).alias("x"), at(6).alias("y"), F.col("advance").cast("double").alias("advance"))


def glyph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("] >> /A /B Tf 1 2 3 4 5 6 7 8 9 10 Td BT ("), F.col("s_name"), F.lit(")(b) Tj [(c) 5 (d)] TJ Q xx ET"))
    return exploded(_suppliers(spark, sf_dir, text), "s_suppkey", "data", STATISTICS, statistics_rows)


def _small_file() -> Column:
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<</K "), F.col("s_suppkey").cast("string"), F.lit(">>\nendobj\n"))
    tail = "xref\n0 2\n0000000000 65535 f \n0000000009 00000 n \ntrailer\n<</Size 2/Root 1 0 R>>\nstartxref\n"
    return F.concat(body, F.lit(tail), F.length(body).cast("string"), F.lit("\n%%EOF\n"))


def xref_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exploded(_suppliers(spark, sf_dir, _small_file()), "s_suppkey", "data", XREF, xref_rows)
    return found.withColumn("offset", F.col("offset").cast("long")).select("s_suppkey", "object", "kind", "offset", "generation")


def xref_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an update: by turns a second table, a cross-reference stream, or no usable start, so that objects are looked for."""

    def build(data: bytes) -> Iterator[tuple[Any, ...]]:
        one, two = b"1 0 obj\n<</K %s>>\nendobj\n" % data, b"2 0 obj\n<</L 1>>\nendobj\n"
        out = b"%PDF-1.4\n" + one + two
        start = len(out)
        out += b"xref\n0 3\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \ntrailer\n<</Size 3/Root 1 0 R>>\n" % (9, 9 + len(one))
        out += b"startxref\n%d\n%%%%EOF\n" % start
        at, form = len(out), int(data) % 3
        out += b"1 0 obj\n<</K 0>>\nendobj\n"
        last = len(out)
        if form == 1:  # object 1 anew, object 2 as member 1 of object 9
            rows = bytes([1]) + at.to_bytes(4, "big") + bytes([0, 2]) + (9).to_bytes(4, "big") + bytes([1])
            out += b"3 0 obj\n<</Type/XRef/Size 4/Root 1 0 R/W[1 4 1]/Index[1 2]/Prev %d/Length 12>>\nstream\n%s\nendstream\nendobj\n" % (start, rows)
        else:
            out += b"xref\n1 1\n%010d 00000 n \ntrailer\n<</Size 3/Root 1 0 R/Prev %d>>\n" % (at, start)
        yield ((out + b"startxref\n%d\n%%%%EOF\n" % last) if form < 2 else out.replace(b"startxref", b"elsewhere"),)

    files = exploded(_suppliers(spark, sf_dir, F.col("s_suppkey").cast("string")), "s_suppkey", "data", "file binary", build)
    found = exploded(files, "s_suppkey", "file", XREF, xref_rows)
    return found.withColumn("offset", F.col("offset").cast("long"))


def trailer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exploded(_suppliers(spark, sf_dir, _small_file()), "s_suppkey", "data", TRAILER, trailer_rows)
    return found.select("s_suppkey", F.col("startxref").cast("long").alias("startxref"), "root_object", "root_generation", F.col("prev").cast("long").alias("prev"))


def cmap_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.lpad(F.hex((F.col("s_suppkey") % 200 + 32).cast("long")), 4, "0"))
    text = F.concat(F.lit("1 beginbfchar <41> <"), low, F.lit("> endbfchar 2 beginbfrange <50> <52> <0061> <60> <61> [<FB01> <0078>] endbfrange"))
    found = exploded(_suppliers(spark, sf_dir, text), "s_suppkey", "data", CMAP, cmap_rows)
    return found.select("s_suppkey", "code", F.array_join(F.transform("codepoints", lambda c: c.cast("string")), ",").alias("codepoints"))


def cmap_redefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later definition of a code holds, whichever way either is written."""
    low = F.lower(F.lpad(F.hex((F.col("s_suppkey") % 200 + 32).cast("long")), 4, "0"))
    text = F.concat(F.lit("1 beginbfchar <41> <0061> endbfchar 1 beginbfrange <41> <42> <"), low, F.lit("> endbfrange 1 beginbfchar <42> <007A> endbfchar"))
    found = exploded(_suppliers(spark, sf_dir, text), "s_suppkey", "data", CMAP, cmap_rows)
    return found.select("s_suppkey", "code", F.array_join(F.transform("codepoints", lambda c: c.cast("string")), ",").alias("codepoints"))


def inflate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    def squeeze(data: bytes) -> Iterator[tuple[Any, ...]]:
        import zlib

        n = int(data)
        # a code of its own for each byte, so what is to pass is far from the guard's ratio however long it is
        engine = zlib.compressobj(strategy=zlib.Z_HUFFMAN_ONLY if n % 3 else zlib.Z_DEFAULT_STRATEGY)
        raw = b"ab" * (n + 1) if n % 3 else b"z" * 100_000
        yield (engine.compress(raw) + engine.flush() if n % 5 else b"not zlib",)

    packed = exploded(_suppliers(spark, sf_dir, F.col("s_suppkey").cast("string")), "s_suppkey", "data", "packed binary", squeeze)
    found = exploded(packed, "s_suppkey", "packed", INFLATED, inflated_rows)
    return found.select("s_suppkey", "status", F.length("data").cast("long").alias("bytes"))


def slab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(data: bytes) -> Iterator[tuple[Any, ...]]:
        from folioscope.decode.slab import build as made

        n = int(data) % 7
        xs = [float(i) for i in range(n)]
        yield (made(int(data), 612, 792, {"x": xs, "y": xs, "w": xs, "h": xs, "codepoints": [65] * n, "term_hashes": [9, 3, int(data)]}),)

    packed = exploded(_suppliers(spark, sf_dir, F.col("s_suppkey").cast("string")), "s_suppkey", "data", "slab binary", build)
    found = exploded(packed, "s_suppkey", "slab", SLAB, slab_rows)
    return found.select("s_suppkey", "page", "glyphs", "terms", "crc_ok", F.array_min("hashes").alias("least"), F.array_max("hashes").alias("most"))


QUERIES = {f.__name__: f for f in (
    lex_tokens, glyph_positions, glyph_state, glyph_statistics, xref_entries, xref_chain, trailer_records, cmap_map, cmap_redefined, inflate_guard, slab_round_trip,
)}

ORACLES = {
    "lex_tokens": """SELECT s_suppkey, CAST(tok AS INTEGER) AS tok, CAST(pos AS BIGINT) AS pos, type, value, CAST(int_val AS BIGINT) AS int_val, CAST(float_val AS DOUBLE) AS float_val
        FROM (SELECT *, CAST(s_suppkey AS VARCHAR) AS k, length(CAST(s_suppkey AS VARCHAR)) AS n FROM supplier),
        LATERAL (VALUES (0, 0, 'Name', '/F1', 0, 0), (1, 4, 'Integer', '12', 12, 0), (2, 7, 'Keyword', 'Tf', 0, 0), (3, 17, 'Integer', k, s_suppkey, 0),
        (4, 18 + n, 'Real', '2.5', 0, 2.5), (5, 22 + n, 'Keyword', 'Td', 0, 0), (6, 25 + n, 'StringLit', '(' || s_name || ')', 0, 0),
        (7, 28 + n + length(s_name), 'Keyword', 'Tj', 0, 0)) t(tok, pos, type, value, int_val, float_val)""",
    "glyph_positions": """SELECT s_suppkey, CAST(i AS INTEGER) AS glyph, CAST(ascii(substr(s_name, i + 1, 1)) AS BIGINT) AS code, 'F1' AS font, 12.0::DOUBLE AS a,
        (10 + 12 * i)::DOUBLE AS x, s_suppkey::DOUBLE AS y, 12.0::DOUBLE AS advance FROM (SELECT *, CAST(unnest(range(0, length(s_name))) AS INTEGER) AS i FROM supplier)""",
    # text space to the page: x = 2 * (10 + moved) + 5, y = 3 * (line + rise) + 7; a glyph moves by 10 * 50 % + 1, a space by 4 (then 3) more
    "glyph_state": """SELECT s_suppkey, CAST(i AS INTEGER) AS glyph, CAST(ascii(c) AS BIGINT) AS code, 'F1' AS font, 10.0::DOUBLE AS a, 30.0::DOUBLE AS d,
        (2 * (10 + moved) + 5)::DOUBLE AS x, (3 * (s_suppkey - down + 2) + 7)::DOUBLE AS y, (CASE WHEN c <> ' ' THEN 6 WHEN down = 0 THEN 10 ELSE 9 END)::DOUBLE AS advance
        FROM supplier, (VALUES (0, 'A', 0.0, 0), (1, ' ', 6.0, 0), (2, 'B', 16.0, 0), (3, 'C', 22.0, 0), (4, 'D', 28.5, 0), (5, 'E', 0.0, 40), (6, 'F', 0.0, 60), (7, ' ', 6.0, 60)) t(i, c, moved, down)
        UNION ALL SELECT s_suppkey, CAST(8 AS INTEGER), CAST(71 AS BIGINT), 'F2', 8.0, 8.0, 0.0, s_suppkey::DOUBLE, 8.0 FROM supplier""",
    "glyph_statistics": "SELECT s_suppkey, " + ", ".join(
        f"CAST({n} AS BIGINT) AS {c}"
        for c, n in {
            "ops_dispatched": 8, "ops_unknown": 1, "ops_outside_text": 1, "operand_overflows": 4, "strings_shown": 3, "glyphs_emitted": "length(s_name) + 2", "tj_arrays_replayed": 1,
            "tj_number_adjustments": 1, "unterminated_code_tail": 0, "gstate_overflow": 0, "gstate_underflow": 1, "stray_array_ends": 1, "stray_dict_ends": 1, "stray_stream_tokens": 0,
        }.items()
    ) + " FROM supplier",
    "xref_entries": """SELECT s_suppkey, CAST(object AS BIGINT) AS object, kind, CAST(o AS BIGINT) AS "offset", CAST(generation AS BIGINT) AS generation
        FROM supplier, (VALUES (0, 'Free', 0, 65535), (1, 'InUse', 9, 0)) t(object, kind, o, generation)""",
    "xref_chain": """SELECT s_suppkey, CAST(object AS BIGINT) AS object, kind, CAST(o AS BIGINT) AS "offset", CAST(generation AS BIGINT) AS generation, CAST(container AS BIGINT) AS container,
        CAST(i AS BIGINT) AS idx FROM (SELECT s_suppkey, length(CAST(s_suppkey AS VARCHAR)) AS n, s_suppkey % 3 AS form FROM supplier), LATERAL (VALUES
        (0, 'Free', 0, 65535, 0, 0, form < 2), (1, 'InUse', 175 + n, 0, 0, 0, true), (2, 'InUse', 32 + n, 0, 0, 0, form <> 1), (2, 'Compressed', 0, 0, 9, 1, form = 1))
        t(object, kind, o, generation, container, i, said) WHERE said""",
    "trailer_records": """SELECT s_suppkey, CAST(9 + 8 + 5 + length(CAST(s_suppkey AS VARCHAR)) + 10 AS BIGINT) AS startxref, CAST(1 AS BIGINT) AS root_object,
        CAST(0 AS BIGINT) AS root_generation, CAST(NULL AS BIGINT) AS prev FROM supplier""",
    "cmap_map": """SELECT s_suppkey, CAST(code AS BIGINT) AS code, points AS codepoints FROM supplier,
        LATERAL (VALUES (65, CAST(s_suppkey % 200 + 32 AS VARCHAR)), (80, '97'), (81, '98'), (82, '99'), (96, '102,105'), (97, '120')) t(code, points)""",
    "cmap_redefined": """SELECT s_suppkey, CAST(code AS BIGINT) AS code, points AS codepoints FROM supplier,
        LATERAL (VALUES (65, CAST(s_suppkey % 200 + 32 AS VARCHAR)), (66, '122')) t(code, points)""",
    "inflate_guard": """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'bad_data' WHEN s_suppkey % 3 = 0 THEN 'limit_exceeded' ELSE 'ok' END AS status,
        CAST(CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 0 ELSE 2 * (s_suppkey + 1) END AS BIGINT) AS bytes FROM supplier""",
    "slab_round_trip": """SELECT s_suppkey, CAST(s_suppkey AS INTEGER) AS page, CAST(s_suppkey % 7 AS INTEGER) AS glyphs, CAST(3 AS INTEGER) AS terms, true AS crc_ok,
        CAST(least(3, s_suppkey) AS BIGINT) AS least, CAST(greatest(9, s_suppkey) AS BIGINT) AS most FROM supplier""",
}
