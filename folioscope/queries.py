"""Registered queries of the page engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.decode import tables as decoded
from folioscope.functions import naming, payloads
from folioscope.functions.pages import in_pages, spec_pages
from folioscope.operators import concatenate, content, index, keyword_table, layout, merge, page_ops, search
from folioscope.plans import deadline, page_plan
from folioscope.sources import files, paged, registry, stored
from folioscope.sources import tables as src
from folioscope.streaming import register

Query = Callable[[SparkSession, str], DataFrame]
KEYWORDS = ["the", "de", "la", "zebra"]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _sql[key] = " ".join(sql.split())
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.turn_pages(_read(spark, sf_dir, "conversations"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.line_pages(_read(spark, sf_dir, "documents"))


def _names(spark: SparkSession, sf_dir: str, table: str, key: str, name: str) -> DataFrame:
    return _read(spark, sf_dir, table).select(F.col(key).cast("string").alias("doc_id"), F.col(name).alias("filename"))


TURNS = "SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INTEGER) AS page, coalesce(text, '') AS text FROM conversations"
LINES = """SELECT doc_id, CAST(page AS INTEGER) AS page, lines[page] AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id,
    string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS page FROM documents)"""


def _sql_count(keyword: str, case_sensitive: bool = False, whole_words: bool = True, text: str = "text") -> str:
    low = (lambda x: x) if case_sensitive else (lambda x: f"lower({x})")
    if whole_words:
        return f"len(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: {low('x')} = '{keyword}'))"
    return f"((length({low(text)}) - length(replace({low(text)}, '{keyword}', ''))) // {len(keyword)})"


def _sql_counts(pages: str, keywords: list[str] = KEYWORDS, case_sensitive: bool = False, whole_words: bool = True) -> str:
    """(doc_id, page, ord, keyword, n) for every page and keyword."""
    each = (f"SELECT doc_id, page, {i} AS ord, '{k}' AS keyword, CAST({_sql_count(k, case_sensitive, whole_words)} AS BIGINT) AS n FROM p" for i, k in enumerate(keywords))
    return f"(WITH p AS ({pages}) " + " UNION ALL ".join(each) + ")"


for _case, _whole in ((False, True), (True, True), (False, False), (True, False)):
    _name = f"search_hits_{'cs' if _case else 'ci'}_{'word' if _whole else 'sub'}"

    def _hits(spark: SparkSession, sf_dir: str, case: bool = _case, whole: bool = _whole) -> DataFrame:
        return search.hits(_lines(spark, sf_dir), KEYWORDS, case, whole)

    _query(f"SELECT doc_id, page, ord, keyword, n FROM {_sql_counts(LINES, KEYWORDS, _case, _whole)} WHERE n > 0", _name)(_hits)


@_query(f"""SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS n, string_agg(keyword, ',' ORDER BY ord) AS keywords_found
    FROM {_sql_counts(LINES)} WHERE n > 0 GROUP BY doc_id, page""")
def search_page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.page_matches(search.hits(_lines(spark, sf_dir), KEYWORDS))
    return found.withColumn("keywords_found", F.array_join("keywords_found", ","))


@_query(f"SELECT doc_id, ord, keyword, CAST(sum(n) AS BIGINT) AS total FROM {_sql_counts(TURNS)} GROUP BY doc_id, ord, keyword")
def search_totals_zero_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_totals(search.page_counts(_turns(spark, sf_dir), KEYWORDS))


@_query(f"SELECT doc_id, page, ord, keyword, n FROM {_sql_counts(LINES)} WHERE n > 0 AND (page BETWEEN 1 AND 2 OR page = 4)")
def search_scoped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _lines(spark, sf_dir)
    return search.hits(pages.where(in_pages(F.col("page"), "1-2,4")), KEYWORDS)


@_query(f"""SELECT doc_id, page, keyword, n,
    CASE WHEN st > 40 THEN '...' ELSE '' END
    || regexp_replace(regexp_replace(substr(text, greatest(st - 40, 0) + 1, least(st + 4 + 40, length(text)) - greatest(st - 40, 0)), '^\\s+', ''), '\\s+$', '')
    || CASE WHEN st + 4 + 40 < length(text) THEN '...' ELSE '' END AS snippet
    FROM (SELECT doc_id, page, 'tion' AS keyword, CAST({_sql_count('tion', True, False)} AS BIGINT) AS n, instr(text, 'tion') - 1 AS st, text
    FROM ({LINES})) WHERE n > 0""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(_lines(spark, sf_dir), ["tion"], True, False, snippets=True).drop("ord")


@_query(f"""SELECT doc_id, CAST(count(*) FILTER (ord = 0) AS BIGINT) AS pages_scanned, CAST(sum(n) AS BIGINT) AS total_matches,
    CAST(count(*) FILTER (n > 0) AS BIGINT) AS matches, coalesce(string_agg(DISTINCT page, ',' ORDER BY page) FILTER (n > 0), '') AS matched_pages
    FROM {_sql_counts(TURNS)} GROUP BY doc_id""")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.document_summary(search.page_counts(_turns(spark, sf_dir), KEYWORDS))
    return out.withColumn("matched_pages", F.array_join("matched_pages", ","))


@_query(f"SELECT ord, keyword, CAST(sum(n) AS BIGINT) AS total FROM {_sql_counts(LINES)} GROUP BY ord, keyword")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corpus_totals(search.page_counts(_lines(spark, sf_dir), KEYWORDS), KEYWORDS)


def _corpus(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    pages = _turns(spark, sf_dir)
    documents = src.documents_of(pages, F.concat(F.lit("talk-"), F.col("doc_id"), F.lit(".pdf")))
    out = search.search_corpus(pages, documents, KEYWORDS, sort=sort)
    return out.withColumn("matched_pages", F.array_join("matched_pages", ","))


_CORPUS = f"""SELECT doc_id, 'talk-' || doc_id || '.pdf' AS path, CAST(sum(n) AS BIGINT) AS total_matches,
    CAST(count(*) FILTER (n > 0) AS BIGINT) AS matches, coalesce(string_agg(DISTINCT page, ',' ORDER BY page) FILTER (n > 0), '') AS matched_pages
    FROM {_sql_counts(TURNS)} GROUP BY doc_id"""


@_query(f"SELECT *, row_number() OVER (ORDER BY total_matches DESC, CAST(doc_id AS BIGINT)) AS rank FROM ({_CORPUS})")
def corpus_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, "rank")


@_query(_CORPUS)
def corpus_zero_docs_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, "path")


@_query(f"""SELECT doc_id, CAST({_sql_count('zebra')} + {_sql_count('and')} AS BIGINT) AS total_matches,
    row_number() OVER (ORDER BY {_sql_count('zebra')} + {_sql_count('and')} DESC, CAST(doc_id AS BIGINT)) AS rank
    FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents)""")
def corpus_rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = src.whole_pages(_read(spark, sf_dir, "documents"))
    documents = pages.select("doc_id", F.col("doc_id").alias("path"))
    return search.search_corpus(pages, documents, ["zebra", "and"], sort="rank").select("doc_id", "total_matches", "rank")


@_query(f"SELECT doc_id, page FROM {_sql_counts(LINES)} GROUP BY doc_id, page HAVING sum(n) > 0")
def any_keyword_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching_pages(_lines(spark, sf_dir), KEYWORDS)


@_query(f"WITH p AS ({TURNS}) SELECT doc_id, 2 AS anchor, page, text FROM p WHERE page BETWEEN 1 AND 4")
def context_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.context_of_page(_turns(spark, sf_dir), 2, before=1, after=2)


@_query(f"""WITH p AS ({LINES}), a AS (SELECT doc_id, min(page) AS anchor FROM p WHERE {_sql_count('und')} > 0 GROUP BY doc_id)
    SELECT p.doc_id, a.anchor, p.page, p.text FROM p JOIN a ON p.doc_id = a.doc_id AND p.page BETWEEN a.anchor - 1 AND a.anchor + 1""")
def context_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.context_of_keyword(_lines(spark, sf_dir), "und")


_MATCHED = f"""WITH p AS ({LINES}), m AS (SELECT doc_id, page AS anchor FROM p WHERE {_sql_count('que')} + {_sql_count('von')} > 0)
    SELECT DISTINCT p.doc_id, p.page FROM p JOIN m ON p.doc_id = m.doc_id AND p.page BETWEEN m.anchor - %d AND m.anchor + %d"""


@_query(_MATCHED % (2, 2))
def matches_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.matches_with_padding(_lines(spark, sf_dir), ["que", "von"], padding=2)


@_query(_MATCHED % (0, 0))
def matches_padded_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.matches_with_padding(_lines(spark, sf_dir), ["que", "von"], padding=0)


@_query(_MATCHED % (10_000, 10_000))
def matches_padded_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.matches_with_padding(_lines(spark, sf_dir), ["que", "von"], padding=10_000)


@_query(f"""WITH p AS ({LINES}), m AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM p WHERE {_sql_count('the')} > 0),
    r AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM m GROUP BY doc_id, run)
    SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM r GROUP BY doc_id""")
def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_plan.islands(search.matching_pages(_lines(spark, sf_dir), ["the"]))


def _selected(pages: list[int]) -> str:
    distinct = list(dict.fromkeys(pages))
    rows = ", ".join(f"({i}, {p})" for i, p in enumerate(distinct))
    return f"""WITH p AS ({TURNS}), c(pos, n) AS (VALUES {rows})
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS new_page, page, text FROM p JOIN c ON p.page = c.n"""


def _select(pages: list[int]) -> Query:
    return lambda spark, sf_dir: page_plan.select_pages(_turns(spark, sf_dir), page_plan.chosen_pages(spark, pages))


for _name, _pages in (("cut_multi_range", [1, 2, 5, 7, 8]), ("select_reordered", [7, 2, 1]), ("dedup_first", [3, 1, 3, 2, 1])):
    _query(_selected(_pages), _name)(_select(_pages))


@_query(f"""WITH p AS ({TURNS}), d AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS BIGINT) DESC) AS src_ord, count(*) AS pages FROM p GROUP BY doc_id),
    s AS (SELECT doc_id, src_ord, coalesce(sum(pages) OVER (ORDER BY src_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
    SELECT CAST(before + page AS BIGINT) AS new_page, src_ord, p.doc_id, page, text FROM p JOIN s ON p.doc_id = s.doc_id""")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _turns(spark, sf_dir)
    names = src.documents_of(pages).withColumn("filename", (F.lit(1_000_000_000) - F.col("doc_id").cast("long")).cast("string"))
    return page_plan.concatenated(pages, merge.natural_inputs(names).select("src_ord", "doc_id"))


_FILES = "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-') ELSE p_size || '_' || replace(p_name, ' ', '-') END || '.pdf' AS filename FROM part"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    name = F.when(F.col("p_partkey") % 3 == 0, name).otherwise(F.concat_ws("_", "p_size", name))
    return part.select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat(name, F.lit(".pdf")).alias("filename"))


@_query(f"""WITH f AS ({_FILES}) SELECT row_number() OVER (ORDER BY size, regexp_extract(filename, '^[0-9]+_(.+)\\.pdf$', 1), doc_id) AS src_ord, doc_id, filename
    FROM f WHERE regexp_matches(filename, '^[0-9]+_.')""")
def merge_numeric_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.numbered_inputs(_files(spark, sf_dir)).select("src_ord", "doc_id", "filename")


@_query(f"WITH f AS ({_FILES}) SELECT doc_id, 'no_numeric_prefix' AS reason FROM f WHERE NOT regexp_matches(filename, '^[0-9]+_.')")
def merge_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.ignored_inputs(_files(spark, sf_dir))


@_query("""SELECT doc_id, filename, row_number() OVER (ORDER BY lower(w), num, filename, doc_id) AS src_ord FROM (SELECT CAST(p_partkey AS VARCHAR) AS doc_id,
    p_name || '-' || (p_partkey * 7919) % 1000 AS filename, p_name || '-' AS w, (p_partkey * 7919) % 1000 AS num FROM part)""")
def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("p_partkey") * 7919) % 1000
    names = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat_ws("-", "p_name", number).alias("filename"))
    return merge.natural_inputs(names).select("doc_id", "filename", "src_ord")


@_query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, regexp_replace(s_name || '.tar.gz', '\\.[^.]+$', '') AS stem, 'Supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.a' AS safe FROM supplier""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return names.select("doc_id", naming.stem_column(F.concat("filename", F.lit(".tar.gz"))).alias("stem"), naming.safe_name(F.concat(F.lit("._"), "filename", F.lit(".a."))).alias("safe"))


@_query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS pages_scanned, CAST(sum(length(text)) AS BIGINT) AS characters FROM ({LINES}) WHERE page <= 5 GROUP BY doc_id")
def text_extract_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.text_summary(_lines(spark, sf_dir), "1-5")


@_query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS pages_scanned, CAST(sum(length(text)) AS BIGINT) AS characters FROM ({LINES}) GROUP BY doc_id")
def text_extract_all_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.text_summary(_lines(spark, sf_dir))


_LINKS = """SELECT doc_id, CAST(i - 1 AS INTEGER) AS link_ord, uris[i] AS uri FROM (SELECT *, unnest(range(1, len(uris) + 1)) AS i FROM
    (SELECT CAST(page_id AS VARCHAR) AS doc_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS uris FROM pages)) WHERE uris[i] <> ''"""


@_query(_LINKS)
def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.html_links(_read(spark, sf_dir, "pages"))


@_query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS links FROM ({_LINKS}) WHERE CAST(doc_id AS BIGINT) BETWEEN 10 AND 19 GROUP BY doc_id")
def links_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").where(in_pages(F.col("page_id"), "10-19"))
    return content.html_links(pages).groupBy("doc_id").agg(F.count("*").alias("links"))


@_query("""SELECT lower(p_name) AS path_key, 'doc-' || row_number() OVER (ORDER BY min(p_partkey)) AS doc_id,
    arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey) AS path FROM part GROUP BY lower(p_name)""")
def registry_dedup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return merge.distinct_paths(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), path.alias("path")))


@_query(f"""SELECT term, doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM ({TURNS})) GROUP BY term, doc_id""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_turns(spark, sf_dir))


@_query(f"""WITH p AS ({LINES}), l AS (SELECT doc_id, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS length FROM p GROUP BY doc_id),
    t AS (SELECT doc_id, keyword, sum(n) AS tf FROM {_sql_counts(LINES, ['avec', 'from'])} GROUP BY doc_id, keyword HAVING sum(n) > 0),
    f AS (SELECT keyword, count(*) AS df FROM t GROUP BY keyword), w AS (SELECT count(*) AS docs, avg(length) AS mean FROM l)
    SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
    FROM t JOIN f USING (keyword) JOIN l USING (doc_id), w GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_lines(spark, sf_dir), ["avec", "from"]).withColumn("score", F.round("score", 6))




@_query("SELECT s_suppkey, to_base64(encode(s_name)) AS payload, 'data:image/png;base64,' || to_base64(encode(s_name)) AS uri FROM supplier")
def payload_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("s_name", "UTF-8")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", payloads.base64_line(data).alias("payload"), payloads.data_uri(data).alias("uri"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name || 'é' END AS text FROM supplier")
def text_strict_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file ends within a character, so it is no UTF-8 text."""
    data = F.encode(F.concat("s_name", F.lit("é")), "UTF-8")
    cut = F.when(F.col("s_suppkey") % 3 > 0, data).otherwise(F.substring(data, 1, F.octet_length("s_name") + 1))
    return _read(spark, sf_dir, "supplier").select("s_suppkey", cut.alias("data")).select("s_suppkey", payloads.strict_utf8("data").alias("text"))


@_query("SELECT p_partkey, 'ffi' || p_name || 'st ' || p_name AS text FROM part")
def ligatures_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\ufb03"), "p_name", F.lit("\ufb06 "), "p_name")
    return _read(spark, sf_dir, "part").select("p_partkey", payloads.expand_ligatures(text).alias("text"))


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a document of two pages and two links for each part; every tenth is broken."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from folioscope.decode.document import from_texts

        for pdf in batches:
            made = []
            for key, name in zip(pdf["p_partkey"], pdf["p_name"], strict=True):
                links = {0: [(f"https://example.org/{key}", [1.0, 2.0, 3.0, 4.0])], 1: [(f"https://example.org/{key}/a", [0.0, 0.0, 9.0, 9.0])]}
                made.append(b"%PDF-1.4 nothing" if key % 10 == 0 else from_texts([name, f"{name} ({key})\nfrom {key % 7} from"], links))
            yield pd.DataFrame({"path": pdf["p_partkey"].astype(str), "content": made})

    return src.spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").mapInPandas(run, "path string, content binary")


_BINARY = """SELECT CAST(p_partkey AS VARCHAR) AS path, page, CASE page WHEN 1 THEN p_name ELSE p_name || ' (' || p_partkey || ')' || chr(10) || 'from ' || (p_partkey % 7) || ' from' END AS text
    FROM part, (VALUES (1), (2)) v(page) WHERE p_partkey % 10 > 0"""


@_query(f"SELECT path, page, text, CAST(NULL AS VARCHAR) AS reason FROM ({_BINARY}) UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, 'unreadable_pdf' FROM part WHERE p_partkey % 10 = 0")
def binary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.document_pages(_binary(spark, sf_dir))


@_query(f"SELECT path AS doc_id, page, 'from' AS keyword, CAST(2 AS BIGINT) AS n FROM ({_BINARY}) WHERE page = 2")
def binary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.document_pages(_binary(spark, sf_dir)).where("reason is null").withColumnRenamed("path", "doc_id")
    return search.hits(pages, ["from", "fro"]).select("doc_id", "page", "keyword", "n")


@_query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(page AS INTEGER) AS page, CAST(0 AS INTEGER) AS link_ord, 'https://example.org/' || p_partkey || tail AS uri, wide AS x1
    FROM part, (VALUES (1, '', 3.0::DOUBLE), (2, '/a', 9.0::DOUBLE)) v(page, tail, wide) WHERE p_partkey % 10 > 0""")
def binary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.document_links(_binary(spark, sf_dir))
    return found.select("path", "page", "link_ord", "uri", F.get("rect", F.lit(2)).alias("x1"))


_POSTED = """SELECT term, doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM (%s)) %s GROUP BY term, doc_id"""
LOOKED_UP = ["the", "orre", "que", "Éque", "zebra", "tion"]


def _indexed(spark: SparkSession, pages: DataFrame) -> index.Index:
    path = stored.fresh(spark, "index")
    index.build(pages, path)
    return index.Index(spark, path)


@_query(_POSTED % (TURNS, ""))
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings of a stored index, decoded from its blocks."""
    return _indexed(spark, _turns(spark, sf_dir)).postings()


@_query(_POSTED % (LINES, f"WHERE term IN ({', '.join(repr(t.lower()) for t in LOOKED_UP)})"))
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, _lines(spark, sf_dir)).lookup(LOOKED_UP)


@_query(f"""SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM
    (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM ({LINES})) GROUP BY term""")
def index_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, _lines(spark, sf_dir)).lexicon.select("term", "df", "cf")


#: Queries of several terms, common and rare ones.
TOP_QUERIES = ["avec from", "the of and", "de la que", "orre thatin", "und der mente", "éque éai les", "heit keit von", "that with this from", "zebra tion", "ado para los mente"]

_TOP = """WITH p AS ({pages}), t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM p) GROUP BY doc_id, term),
    l AS (SELECT doc_id, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS length FROM p GROUP BY doc_id), w AS (SELECT count(*) AS docs, avg(length) AS mean FROM l),
    q AS ({queries}), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    s AS (SELECT query, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 9) AS score
        FROM q JOIN t USING (term) JOIN f USING (term) JOIN l USING (doc_id), w GROUP BY query, doc_id),
    r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


@_query(_TOP.format(pages=LINES, k=10, queries=" UNION ALL ".join(f"SELECT {i} AS query, unnest(string_split('{q}', ' ')) AS term" for i, q in enumerate(TOP_QUERIES))))
def index_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of ten queries, by blocks whose bounds reach them."""
    wanted = spark.createDataFrame([(i, t) for i, q in enumerate(TOP_QUERIES) for t in q.split()], "query int, term string")
    return _indexed(spark, _lines(spark, sf_dir)).top(wanted, 10).withColumn("score", F.round("score", 6))


@_query(_TOP.format(pages=TURNS, k=3, queries="SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark"))
def index_top_for_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three conversations nearest to each benchmark text, all of its words being the query."""
    wanted = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(index.terms_of("text")).alias("term"))
    return _indexed(spark, _turns(spark, sf_dir)).top(wanted, 3).withColumn("score", F.round("score", 6))


def _keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and runs of two and three words of the benchmark, and the names of parts, suppliers and customers."""
    words = index.terms_of("text")
    runs = F.array(*[F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> slice(w, i, {k}))") for k in (1, 2, 3)])
    grams = _read(spark, sf_dir, "benchmark").select(words.alias("w")).where("size(w) >= 3").select(F.explode(F.flatten(runs)).alias("g"))
    grams = grams.where("size(g) = 1 or g[0] <> element_at(g, -1)").select(F.array_join("g", " ").alias("keyword"))
    named = [_read(spark, sf_dir, t).select(F.col(c).alias("keyword")) for t, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))]
    for n in named:
        grams = grams.unionByName(n)
    return grams.select(F.length("keyword").alias("ord"), "keyword")


_GRAMS = """SELECT unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' '))) AS keyword, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: {k} > 1 AND w[i] = w[i + {k} - 1])) AS same
    FROM (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark) WHERE len(w) >= 3"""
_KEYWORDS = "SELECT DISTINCT keyword FROM (" + " UNION ALL ".join(_GRAMS.format(k=k) for k in (1, 2, 3)) + ") WHERE NOT same UNION SELECT p_name FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer"
_KEYWORD_HITS = f"""WITH k AS ({_KEYWORDS}), x AS (SELECT doc_id, page, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS x FROM ({LINES})),
    i AS (SELECT doc_id, page, x, unnest(range(1, len(x) + 1)) AS i FROM x),
    g AS (SELECT doc_id, page, array_to_string(x[i : i + size - 1], '') AS said FROM i, (VALUES (1), (3), (5)) v(size) WHERE i + size - 1 <= len(x) AND regexp_matches(x[i], '^[\\p{{L}}\\p{{N}}_]'))
    SELECT doc_id, page, keyword, CAST(count(*) AS BIGINT) AS n FROM g JOIN k ON lower(keyword) = said GROUP BY doc_id, page, keyword"""


@_query(_KEYWORD_HITS)
def keyword_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_table.hits(_lines(spark, sf_dir), _keyword_table(spark, sf_dir)).drop("ord")


@_query(f"""WITH h AS ({_KEYWORD_HITS}) SELECT keyword, CAST(count(n) AS BIGINT) AS pages, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM ({_KEYWORDS}) LEFT JOIN h USING (keyword) GROUP BY keyword""")
def keyword_table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of keywords with the pages and matches of each, none of them left out."""
    keywords = _keyword_table(spark, sf_dir)
    return keyword_table.sums(_lines(spark, sf_dir), keywords).drop("ord")


@_query(f"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM benchmark), p AS ({TURNS})
    SELECT doc_id, page, keyword, CAST((length(text) - length(replace(text, keyword, ''))) // length(keyword) AS BIGINT) AS n FROM p, k WHERE contains(text, keyword)""")
def keyword_table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's words within the words of conversations, in their own case."""
    words = F.explode(F.regexp_extract_all("text", F.lit(index.WORD + "+"), F.lit(0)))
    keywords = _read(spark, sf_dir, "benchmark").select(F.lit(0).alias("ord"), words.alias("keyword"))
    return keyword_table.hits(_turns(spark, sf_dir), keywords, case_sensitive=True, whole_words=False).drop("ord")


def _paged(spark: SparkSession, sf_dir: str) -> str:
    path = stored.fresh(spark, "paged")
    paged.write(_turns(spark, sf_dir), path)
    return path


@_query(TURNS)
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written to the paged text format and read back."""
    return paged.read(spark, _paged(spark, sf_dir))


@_query(f"SELECT * FROM ({TURNS}) WHERE (page BETWEEN 2 AND 4 OR page >= 7) AND page <= 9")
def paged_source_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page specification and a filter, both decided by the source."""
    return paged.read(spark, _paged(spark, sf_dir), "2-4,7-999999").where("page <= 9")


@_query(f"""SELECT doc_id, CAST(min(page) AS INTEGER) AS first_page, CAST(count(*) FILTER (ord = 0) AS BIGINT) AS pages, CAST(sum(n) AS BIGINT) AS total FROM {_sql_counts(TURNS)} GROUP BY doc_id""")
def stream_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive in three drops, each taken in by a stream that starts anew from its checkpoint."""
    folder = stored.fresh(spark, "stream")
    for drop in range(3):
        _turns(spark, sf_dir).where(F.col("page") % 3 == drop).write.mode("append").parquet(f"{folder}/arriving")
        register.take_in(spark, f"{folder}/arriving", "doc_id string, page int, text string", folder, KEYWORDS)
    return register.current(spark, folder)


@_query("""WITH b AS (SELECT p_partkey % 2 AS batch, p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || (p_partkey // 4) ELSE p_name || (p_partkey // 3) END AS path FROM part),
    f AS (SELECT lower(path) AS k, min(batch) AS batch FROM b GROUP BY 1), g AS (SELECT k, f.batch, min(pos) AS pos, arg_min(path, pos) AS path FROM f JOIN b ON k = lower(path) AND b.batch = f.batch GROUP BY ALL)
    SELECT 'doc-' || row_number() OVER (ORDER BY batch, pos) AS doc_id, path FROM g""")
def registry_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of paths with overlaps, committed one after the other: known paths keep their first ids."""
    key = F.col("p_partkey")
    path = F.when(key % 2 == 0, F.concat(F.upper("p_name"), F.floor(key / 4))).otherwise(F.concat("p_name", F.floor(key / 3)))
    paths = _read(spark, sf_dir, "part").select(key.alias("pos"), path.alias("path"))
    known = registry.Registry(spark, stored.fresh(spark, "registry"))
    for batch in range(2):
        known.register(paths.where(F.col("pos") % 2 == batch))
    return known.documents().select("doc_id", "path")


_POSITIONS = f"""WITH l AS ({LINES}), t AS (SELECT doc_id, page, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS t FROM l),
    u AS (SELECT doc_id, page, unnest(range(0, len(t))) AS nth, unnest(t) AS word FROM t),
    w AS (SELECT *, CAST(list_sum(list_transform(string_split(word, ''), lambda c: 400 + ord(c) % 400)) AS BIGINT) AS wide FROM u),
    x AS (SELECT *, coalesce(sum(wide) OVER (PARTITION BY doc_id, page ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM w),
    y AS (SELECT doc_id, page, coalesce(sum(CASE WHEN trim(text) = '' THEN 1800 ELSE 1200 END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM l)
    SELECT doc_id, page, CAST(nth AS INTEGER) AS nth, word, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, wide FROM x JOIN y USING (doc_id, page) WHERE regexp_matches(word, '^[\\p{{L}}\\p{{N}}_]')"""


@_query(_POSITIONS)
def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pen's place at each word of each text, by running sums over its lines and over the parts of each line."""
    return layout.word_positions(_lines(spark, sf_dir))


@_query(f"""WITH w AS ({_POSITIONS}), b AS (SELECT s_suppkey AS box, s_suppkey * 7919 % 90000 AS x0, s_suppkey * 104729 % 60000 AS y0, s_suppkey * 7919 % 90000 + 500 * (s_suppkey % 40) AS x1, s_suppkey * 104729 % 60000 + 1200 * (s_suppkey % 5) AS y1 FROM supplier)
    SELECT box, doc_id, page, nth, word, w.x, w.y FROM b JOIN w ON w.x BETWEEN x0 AND x1 AND w.y BETWEEN y0 AND y1""")
def words_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that begin within a box drawn from each supplier's number, over all texts."""
    path = stored.fresh(spark, "layout")
    layout.store(layout.word_positions(_lines(spark, sf_dir)), path)
    k = F.col("s_suppkey")
    boxes = _read(spark, sf_dir, "supplier").select(k.alias("box"), (k * 7919 % 90000).alias("x0"), (k * 104729 % 60000).alias("y0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 500 * (F.col("box") % 40), "y1": F.col("y0") + 1200 * (F.col("box") % 5)})
    return layout.words_in_boxes(spark, path, boxes)


@_query("""WITH s AS (SELECT p_partkey AS key, p_size AS total, p_partkey % 7 + 1 AS a, p_partkey % 7 + 1 + p_partkey % 4 AS b, p_partkey % 30 AS c FROM part)
    SELECT key, CASE WHEN c = 0 THEN array_to_string(range(1, total + 1), ',') WHEN b <= total AND c <= total THEN array_to_string(list_sort(list_distinct(list_append(range(a, b + 1), c))), ',') END AS pages FROM s""")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification and a number of pages in each row, and the pages it chooses; null where it is refused."""
    k = F.col("p_partkey")
    spec = F.when(k % 30 == 0, F.lit(" All")).otherwise(F.concat((k % 7 + 1), F.lit(" - "), (k % 7 + 1 + k % 4), F.lit(", "), (k % 30)))
    part = src.spread(_read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = part.select(k.alias("key"), F.col("p_size").alias("total"), spec.alias("spec"))
    return rows.select("key", F.array_join(spec_pages("spec", "total").cast("array<string>"), ",").alias("pages"))


@_query(f"""WITH p AS ({TURNS}), d AS (SELECT doc_id, CAST(doc_id AS BIGINT) % 10 AS output, row_number() OVER (PARTITION BY CAST(doc_id AS BIGINT) % 10 ORDER BY CAST(doc_id AS BIGINT) DESC) AS src_ord FROM p GROUP BY doc_id),
    j AS (SELECT output, string_agg(text, chr(10) ORDER BY src_ord, page) AS said FROM p JOIN d USING (doc_id) GROUP BY output)
    SELECT CAST(output AS VARCHAR) AS output, CAST(strlen(said) AS BIGINT) AS bytes, md5(said) AS md5 FROM j""")
def concatenated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files of conversations, the latest first, written by many tasks and read again."""
    turns = _turns(spark, sf_dir)
    number = F.col("doc_id").cast("long")
    docs = src.documents_of(turns).select("doc_id", (number % 10).alias("output"))
    sources = docs.select("output", (F.lit(1_000_000_000) - number).alias("src_ord"), "doc_id")
    path = stored.fresh(spark, "joined")
    concatenate.write(turns, sources, path)
    return concatenate.digests(spark, path)


@_query(f"SELECT doc_id, page, ord, keyword, n FROM {_sql_counts(LINES)} WHERE n > 0")
def search_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search part by part; without a deadline every part is answered."""
    path = stored.fresh(spark, "parts")
    deadline.store(_lines(spark, sf_dir), path, 6)
    return deadline.answer(spark, path, lambda pages: search.hits(pages, KEYWORDS), stored.fresh(spark, "answer")).rows


_queries.update(decoded.QUERIES)
_sql.update(decoded.ORACLES)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
