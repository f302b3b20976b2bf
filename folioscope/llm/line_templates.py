"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line descends by its token count, then by its leading tokens, where tokens that hold a
digit stand as one wildcard. In a leaf, the tokens that few documents have at their place are variable fields and
become wildcards too; what is left is the line's template. Templates that recur across documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import components, discard, small, table

#: A template recurs if so many different texts have it, and its lines have so many tokens.
DOCUMENTS = 6
TOKENS = 4
#: With the whole asked for: (tokens from, texts needed), longest first; lines of no characters are no templates.
NEEDED = ((50, 2), (20, 3), (TOKENS, DOCUMENTS), (1, 50))
#: Leading tokens that the tree descends by, and the least part of a template's tokens that are not variable.
LEADING = 3
CONSTANT = 0.6
#: Unless the whole is asked for, a text of which more than this part recurs stays as it is.
LARGEST_SHARE = 0.5
#: Near copies, which have one vote: similarity of their sets of SHINGLE words, found by BANDS of two minima.
ALIKE = 0.75
SHINGLE = 5
BANDS = 16
BROADCAST_PAIRS = 500_000
BROADCAST_LEAVES = 1_000_000
WILDCARD = "<*>"


def _count(text: Column, *characters: str) -> Column:
    """How often single-byte characters occur."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _needed(whole: bool) -> Column:
    """How many texts must have a template of ``n`` tokens."""
    if not whole:
        return F.lit(DOCUMENTS)
    return F.coalesce(*[F.when(F.col("n") >= n, texts) for n, texts in NEEDED])


def _texts(docs: DataFrame, text: str, whole: bool) -> DataFrame:
    """(tkey, masked, and with ``whole`` text) of each different text, once; tokens of masked that hold a digit are wildcards."""
    each = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    masked = F.regexp_replace("text", r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", WILDCARD)
    tkey = F.unhex(F.md5(F.encode("text", "UTF-8")))
    return table(each.select(tkey.alias("tkey"), masked.alias("masked"), *["text"] * whole), "texts")


def _lines(texts: DataFrame, whole: bool) -> DataFrame:
    """(tkey, no, n, line, leaf) of every masked line with TOKENS tokens or more, or with ``whole`` of every line that is
    not empty; tokens stand between single spaces."""
    lines = texts.select("tkey", F.posexplode(F.split("masked", "\n", -1)).alias("no", "line"))
    lines = lines.select("tkey", "no", F.btrim("line", F.lit(" \t\r")).alias("line"))
    lines = lines.select("tkey", "no", (_count(F.col("line"), " ") + 1).alias("n"), "line").where((F.col("line") != "") if whole else (F.col("n") >= TOKENS))
    return lines.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", LEADING)))


def _shingles(text: Column) -> Column:
    """Hashes of runs of SHINGLE words, or of all words if there are fewer; the words are split once for each text."""
    words = F.split(F.btrim(text, F.lit(" \t\r\n")), "[ \t\r\n]+", -1)
    places = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
    hashed = lambda w: F.transform(places(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))
    return F.get(F.transform(F.array(words), hashed), F.lit(0))


def near_copies(texts: DataFrame) -> DataFrame:
    """(node, root) of the near copies among ``texts`` (tkey, text), which hold each text once; others have no row.

    In each band a text is compared, by its whole sets, with the least text that has the same two minima.
    """
    each = texts.select("tkey", F.explode(_shingles(F.col("text"))).alias("h"))
    half = lambda k: F.min(F.when(F.pmod("h", F.lit(2)) == k, F.col("h")))
    bands = each.groupBy("tkey", F.pmod(F.shiftright("h", 1), F.lit(BANDS)).alias("band")).agg(F.xxhash64(half(0), half(1)).alias("minima"))
    bands = table(bands.select("tkey", F.xxhash64("band", "minima").alias("key")), "bands")
    least = bands.groupBy("key").agg(F.min("tkey").alias("least"), F.count("*").alias("texts")).where("texts > 1").select("key", "least")
    pairs = table(bands.join(least, "key").where("tkey != least").select("tkey", "least").distinct(), "pairs")
    ends = pairs.select("tkey").union(pairs.select("least")).distinct()
    wanted = table(ends, "wanted")
    sets = texts.join(small(wanted, wanted.count(), BROADCAST_PAIRS), "tkey", "left_semi").select("tkey", F.array_distinct(_shingles(F.col("text"))).alias("set"))
    sets = table(sets, "sets")
    both = sets.join(small(pairs, pairs.count(), BROADCAST_PAIRS), "tkey").join(sets.toDF("least", "other"), "least")
    common = F.size(F.array_intersect("set", "other"))
    found = components(both.where(common >= ALIKE * (F.size("set") + F.size("other") - common)).select("tkey", "least"), "tkey", "least")
    discard(bands, pairs, wanted, sets)
    return found


def recurring_lines(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """(template, tkey, no, n), a written table: lines whose template DOCUMENTS different texts or more have. ``tkey`` is the text's md5.

    With ``whole``, near copies count as one text, and NEEDED texts make a template recur.
    """
    texts, needed = _texts(docs, text, whole), _needed(whole)
    lines = _lines(texts, whole)
    leaves = lines.select("leaf", "n", "tkey").distinct().groupBy("leaf", "n").agg(F.count("*").alias("texts"))
    leaves = table(leaves.where(F.col("texts") >= needed).select("leaf"), "leaves")
    # a row for each leaf of a text, with each line's tokens as marks of leaf, place and token; wildcards' marks are odd
    inside = lines.join(small(leaves, leaves.count(), BROADCAST_LEAVES), "leaf").groupBy("tkey", "leaf", "n").agg(F.collect_list(F.struct("no", "line")).alias("lines"))
    mark = lambda x, at: F.xxhash64("leaf", at, x).bitwiseAND(F.lit(-2)).bitwiseOR((x == WILDCARD).cast("long"))
    marks = lambda line: F.transform(F.split(line, " ", -1), mark)
    inside = inside.select("tkey", "leaf", "n", F.transform("lines", lambda x: F.struct(x["no"].alias("no"), marks(x["line"]).alias("marks"))).alias("lines"))
    inside = table(inside.withColumn("id", F.monotonically_increasing_id()), "inside")
    # a text counts once for a token at its place, however often its lines have it
    fixed = inside.select("n", F.explode(F.array_distinct(F.flatten("lines.marks"))).alias("mark")).groupBy("n", "mark").agg(F.count("*").alias("texts"))
    fixed = table(fixed.where(F.col("texts") >= needed).select("mark"), "fixed")
    # a token travels as its mark and the number of its line, which is looked up for the few lines that are left
    each = inside.select("id", "n", F.posexplode("lines.marks").alias("line", "marks")).select("id", "line", "n", F.explode("marks").alias("mark"))
    kept = each.join(small(fixed, fixed.count(), BROADCAST_LEAVES), "mark")
    shape = kept.groupBy("id", "line", "n").agg(F.count_if(F.col("mark").bitwiseAND(F.lit(1)) == 0).alias("constant"), F.bit_xor("mark").alias("shape"))
    shaped = table(shape.where(F.col("constant") >= CONSTANT * F.col("n")).select("id", "line", "shape"), "shaped")
    named = inside.select("id", "tkey", "leaf", F.col("n").cast("long").alias("n"), F.posexplode("lines.no").alias("line", "no"))
    shape = named.join(small(shaped, shaped.count(), BROADCAST_LEAVES), ["id", "line"])
    shape = table(shape.select("tkey", "no", "n", F.xxhash64("leaf", "shape").alias("template")), "shapes")
    discard(leaves, inside, fixed, shaped)
    often = shape.select("template", "n", "tkey").distinct().groupBy("template", "n").agg(F.count("*").alias("texts"))
    often = table(often.where(F.col("texts") >= needed).select("template"), "often")
    found = table(shape.join(small(often, often.count(), BROADCAST_LEAVES), "template"), "found")
    discard(shape, often)
    if not whole:
        discard(texts)
        return found
    holders = table(found.select("tkey").distinct(), "holders")
    held = table(texts.join(small(holders, holders.count(), BROADCAST_PAIRS), "tkey", "left_semi").select("tkey", "text"), "held")
    discard(texts, holders)
    votes = found.select("template", "n", "tkey").distinct().join(near_copies(held), F.col("tkey") == F.col("node"), "left")
    votes = votes.select("template", "n", F.coalesce("root", "tkey").alias("vote")).distinct().groupBy("template", "n").agg(F.count("*").alias("votes"))
    voted = table(votes.where(F.col("votes") >= needed).select("template"), "voted")
    recurring = table(found.join(small(voted, voted.count(), BROADCAST_LEAVES), "template"), "recurring")
    discard(held, found, voted)
    return recurring


def drop_recurring_lines(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates, with n_lines and n_dropped (long).

    A text whose recurring lines hold more than LARGEST_SHARE of its tokens stays as it is (n_dropped 0), as do lines
    of fewer than TOKENS tokens. With ``whole``, recurring lines go whatever their share and length, by the texts that
    NEEDED asks for, and near copies count once, so that what only they have in common stays. A null text stays null with no lines; an empty text has one empty line; texts of
    any length are read whole; equal texts are treated alike and count once; columns named n_lines and n_dropped are replaced, others pass through.
    """
    docs = docs.drop("n_lines", "n_dropped")
    recurring = recurring_lines(docs, text, whole)
    drops = recurring.groupBy("tkey").agg(F.sum("n").alias("__tokens"), F.collect_set("no").alias("__drop")).withColumnRenamed("tkey", "__tkey")
    drops = table(drops, "drops")  # so that adaptive execution can split a text that many rows have
    discard(recurring)
    apart = F.encode(F.monotonically_increasing_id().cast("string"), "UTF-8")  # null texts meet nothing
    every = docs.withColumn("__tkey", F.coalesce(F.unhex(F.md5(F.encode(F.col(text), "UTF-8"))), apart))
    joined = every.join(drops, "__tkey", "left")
    total = _count(F.col(text), " ", "\n") + 1
    dropped = F.col("__drop").isNotNull()
    if not whole:
        dropped = dropped & (F.col("__tokens") <= LARGEST_SHARE * total)
    lines = F.split(F.col(text), "\n", -1)
    kept: Column = F.filter(lines, lambda _, i: ~F.array_contains("__drop", i))
    return joined.select(
        *[F.when(dropped, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(dropped, F.size("__drop")).otherwise(0).cast("long").alias("n_dropped"),
    )
