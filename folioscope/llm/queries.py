"""The registered queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import backoff_scores, bit_planes, cap_filters, decontamination, fill_in_middle, jaccard_join, language_id, line_templates, packing, pii, quality, sharding, spelling
from folioscope.llm.shared import shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.cap_components(_read(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = language_id.train(docs)
    said = language_id.identify(docs.select("doc_id", "text"), net)
    return said.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.joined(of(*pii.BASE)), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op5_whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the cuts that OP5 fixes: any share of a text, lines of any length, texts needed by length."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs, whole=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = sharding.shard_rows(rows, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = backoff_scores.backoff_scores(_read(spark, sf_dir, "documents"))
    # sums of thousands of logarithms: their last digits depend on the order of summing
    return said.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = fill_in_middle.fill_in_middle(_read(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    digests = sha(F.col("output")).alias("output_sha256"), sha(fill_in_middle.restored("output", "form")).alias("restored_sha256")
    return said.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_words(_read(spark, sf_dir, "documents"), slip_every=199)
    return spelling.spelling_variants(words)


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/folioscope-ids-{uuid.uuid4().hex}"
    bit_planes.write_documents(_read(spark, sf_dir, "documents"), path)
    return bit_planes.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_cap_filters, op3_language_id, op4_pii, op5_line_templates, op5_whole_lines, op6_decontamination, op7_jaccard_join, op8_sharding, op9_quality, op10_backoff_scores, op11_fill_in_middle, op12_spelling, op13_bit_planes)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
    r AS (WITH RECURSIVE r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.root) SELECT id, min(root) AS root FROM r GROUP BY id)
    SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN r ON id = vec_id
    LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON a = vec_id"""

OP5 = r"""WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
    s AS (SELECT text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM t),
    l AS (SELECT text, no, list_transform(string_split(trim(string_split(text, chr(10))[no], ' ' || chr(9) || chr(13)), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens FROM s),
    i AS (SELECT text, no, len(tokens) AS n, tokens, concat_ws(' ', len(tokens), tokens[1], tokens[2], tokens[3]) AS leaf FROM l WHERE len(tokens) >= 4),
    v AS (SELECT leaf FROM i GROUP BY leaf HAVING count(DISTINCT text) >= 6),
    e AS (SELECT text, no, n, leaf, pl, tokens[pl] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS pl FROM i WHERE leaf IN (SELECT leaf FROM v))),
    f AS (SELECT leaf, pl, token FROM e GROUP BY leaf, pl, token HAVING count(DISTINCT text) >= 6),
    k AS (SELECT text, no, n, leaf, string_agg(pl || ' ' || token, ' ' ORDER BY pl) AS shape FROM e JOIN f USING (leaf, pl, token) GROUP BY text, no, n, leaf HAVING count(*) FILTER (token <> '<*>') >= 0.6 * n),
    o AS (SELECT leaf, shape FROM k GROUP BY leaf, shape HAVING count(DISTINCT text) >= 6),
    d AS (SELECT text, sum(n) AS held, list(no) AS gone FROM k JOIN o USING (leaf, shape) GROUP BY text),
    x AS (SELECT text, gone FROM d WHERE held <= 0.5 * (length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1)),
    y AS (SELECT x.text, len(gone) AS dropped, array_to_string(list_filter(list_transform(range(1, len(string_split(x.text, chr(10))) + 1), lambda j: CASE WHEN list_contains(gone, j) THEN NULL ELSE string_split(x.text, chr(10))[j] END), lambda z: z IS NOT NULL), chr(10)) AS kept FROM x)
    SELECT doc_id, CASE WHEN y.text IS NULL THEN documents.text ELSE kept END AS text, CAST(coalesce(len(string_split(documents.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(dropped, 0) AS BIGINT) AS n_dropped
    FROM documents LEFT JOIN y ON y.text = documents.text"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""WITH i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    p AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    q AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
    h AS (SELECT doc_id, item_id, k, n FROM q JOIN p USING (n, win)),
    c AS (SELECT doc_id, count(*) AS hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pl FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP7 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
    r AS (WITH RECURSIVE r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.root) SELECT id, min(root) AS root FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM d JOIN r ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


OP10 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    t AS (SELECT sum(len(w)) AS tokens FROM d),
    p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    g AS (SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN array_to_string(w[i - 1 : i], ' ') END AS b, CASE WHEN i > 2 THEN array_to_string(w[i - 2 : i], ' ') END AS c,
        CASE WHEN i > 1 THEN w[i - 1] END AS ha, CASE WHEN i > 2 THEN array_to_string(w[i - 2 : i - 1], ' ') END AS hb FROM p),
    o AS (SELECT r, x, count(*) AS own FROM (SELECT r, a AS x FROM g UNION ALL SELECT r, b FROM g UNION ALL SELECT r, c FROM g) WHERE x IS NOT NULL GROUP BY r, x),
    e AS (SELECT r, x, sum(own) OVER (PARTITION BY x) - own AS n FROM o),
    s AS (SELECT g.r, CASE WHEN c.n > 0 THEN c.n / greatest(hb.n, 1) WHEN b.n > 0 THEN if(i > 2, 0.4e0, 1e0) * b.n / greatest(ha.n, 1)
        ELSE if(i > 2, 0.4e0, 1e0) * if(i > 1, 0.4e0, 1e0) * if(a.n > 0, a.n, 0.5e0) / greatest((SELECT tokens FROM t) - (SELECT len(w) FROM d WHERE d.r = g.r), 1) END AS q
        FROM g JOIN e a ON a.r = g.r AND a.x = g.a LEFT JOIN e b ON b.r = g.r AND b.x = g.b LEFT JOIN e c ON c.r = g.r AND c.x = g.c
        LEFT JOIN e ha ON ha.r = g.r AND ha.x = g.ha LEFT JOIN e hb ON hb.r = g.r AND hb.x = g.hb),
    l AS (SELECT r, sum(ln(q)) AS said FROM s GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(said, 0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(said / len(w), 6) END AS mean_log_score
    FROM d LEFT JOIN l ON l.r = d.r"""


_H = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"

OP11 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    c AS (SELECT doc_id, t, n, {_H.format(1)} % (n + 1) AS x, {_H.format(9)} % (n + 1) AS y, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H.format(17)} % 100 >= 90 THEN 'plain'
        WHEN {_H.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM c),
    s AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM p)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""

#: The crc32 of a string of characters below U+0100, bit by bit: a byte and seven zeros for each byte.
_CRC = """xor(list_reduce(flatten(list_transform(flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)), lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))::BIGINT[],
        lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::BIGINT), 4294967295)"""

OP12 = rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
    l AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM r WHERE length(w) >= 6 GROUP BY 1, 2),
    h AS (SELECT w, k, {_CRC.format("(CAST(doc_id AS VARCHAR) || ':' || w)")} AS h FROM l),
    c AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, length(word) AS m FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    g AS (SELECT word, m, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, m, unnest(range(1, m + 1)) AS i FROM v)),
    p AS (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.m = b.m AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT g.word, v.word FROM g JOIN v ON v.word = g.rest UNION SELECT v.word, g.word FROM g JOIN v ON v.word = g.rest),
    q AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS n FROM p JOIN v ON word = b GROUP BY a),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN q.n >= 5 * v.n THEN b END AS form, CASE WHEN q.n >= 5 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON a = word),
    t AS (WITH RECURSIVE t(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.tip WHERE f.form IS NOT NULL) SELECT t.word, tip FROM t JOIN f ON f.word = tip WHERE form IS NULL)
    SELECT f.word, form, tip AS root, n, n_near, form_n FROM f JOIN t ON t.word = f.word"""


def oracle_sql() -> dict[str, str]:
    """For the queries that plain SQL can express; the others are tested against brute force."""
    return {"op2_cap_filters": OP2, "op5_line_templates": OP5, "op6_decontamination": OP6, "op7_jaccard_join": OP7, "op10_backoff_scores": OP10, "op11_fill_in_middle": OP11, "op12_spelling": OP12}
