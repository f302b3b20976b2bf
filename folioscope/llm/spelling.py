"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

The nodes of the words' trie are their prefixes, as rows. Below each node the child with most words is heavy, the others
are light, so a word lies in at most log2(words) light subtrees. Each such place gives errata entries of the word with
one character replaced, skipped or, for the heavy child's, put before it; light words whose entries coincide, and words
that an entry spells, are one edit apart. All is joins and grouping of rows; no pair is found twice, and a word that many
are near to only meets them one group at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import discard, table

#: Runs of these characters are words.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Prefixes shared by more than one in so many words are joined by a broadcast: at most so many for each length of a prefix.
HOT_SHARE = 256
#: Stands for the replaced character in an entry; no word holds it.
_ANY = "\u0000"


def counted_words(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    slip_every: int | None = None,
) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of at least ``least_chars`` characters and ``least_count`` places.

    With ``slip_every`` a run loses a character where the crc32 h of ``id:run`` is divisible by it: the one at h modulo
    its length (planted misspellings that are the same in every run). A null text has no words, a null id counts as empty.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # shorter runs are never long enough, so the pattern leaves them out
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0)))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.col(text)).select("key", found.alias("run"))
    word = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", upper, lower))
    words = runs.select("key", word.alias("word"))
    if slip_every:
        said = words.withColumn("h", F.crc32(F.encode(F.concat("key", F.lit(":"), "word"), "UTF-8")))
        cut = F.concat(F.expr("substring(word, 1, int(h % length(word)))"), F.expr("substring(word, int(h % length(word)) + 2)"))
        words = said.select(F.when(F.col("h") % slip_every == 0, cut).otherwise(F.col("word")).alias("word"))
    long = words.where(F.length("word") >= least_chars)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def light_places(words: DataFrame) -> DataFrame:
    """(word, n, at, heavy): the nodes at which a word leaves its heavy path (or ends), and the heavy child's character.

    A node is known by the hash of its prefix. Were two to share one, they would share a heavy character, and which one
    is called heavy decides the work, never the pairs.
    """
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    node = F.xxhash64("at", F.expr("substring(word, 1, at)"))
    places = places.withColumns({"node": node, "next": F.expr("substring(word, at + 1, 1)")})
    edges = places.groupBy("node", "next").agg(F.count("*").alias("size"))
    size = F.when(F.col("next") != "", F.col("size"))
    nodes = edges.groupBy("node").agg(F.max(F.struct(size.alias("size"), "next")).alias("top"), F.count("*").alias("ways"), F.sum("size").alias("words"))
    heavy = table(nodes.where("ways > 1").select("node", F.col("top.next").alias("heavy"), "words"), "heavy")
    many = words.count() / HOT_SHARE
    hot = heavy.where(F.col("words") > many).select("node", "heavy")
    rest = heavy.where(F.col("words") <= many).select("node", "heavy")
    # a node that a large share of the words pass meets them without a shuffle; these nodes are few at any size
    over_hot = places.join(F.broadcast(hot), "node")
    under = places.join(F.broadcast(hot.select("node")), "node", "left_anti").join(rest, "node")
    light = over_hot.unionByName(under).where(F.col("next") != F.col("heavy"))
    out = table(light.select("word", "n", "at", "heavy"), "light")
    discard(heavy)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): for each of the distinct ``words`` (word, n) with words one edit away, their number
    and the most frequent of them (of equals the first in code-point order)."""
    light = light_places(words)
    mine = F.struct((-F.col("n")).alias("less"), "word")
    before, after, there = F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"), F.expr("substring(word, at + 1)")
    inside = light.where(F.col("at") < F.length("word"))
    # words that only differ in the character at this node: they meet in one group, with the heavy child's if it exists
    replaced = inside.groupBy(F.concat(before, F.lit(_ANY), after).alias("entry"), F.concat(before, "heavy", after).alias("target"))
    replaced = replaced.agg(F.collect_list(mine).alias("group")).drop("entry")
    # without its character here; where the next one equals it, the two words part further down
    skipped = inside.where(F.expr("substring(word, at + 1, 1) <> substring(word, at + 2, 1)")).select(F.concat(before, after).alias("target"), F.array(mine).alias("group"))
    put = light.select(F.concat(before, "heavy", there).alias("target"), F.array(mine).alias("group"))
    asked = replaced.unionByName(skipped).unionByName(put)
    known = words.select(F.col("word").alias("target"), (-F.col("n")).alias("less"))
    met = asked.join(known, "target", "left")
    with_target = F.when(F.col("less").isNull(), F.col("group")).otherwise(F.concat("group", F.array(F.struct("less", F.col("target").alias("word")))))
    groups = met.select(F.array_sort(with_target).alias("group")).where("size(group) > 1")
    each = F.transform("group", lambda x, i: F.struct(x["word"].alias("word"), (F.size("group") - 1).cast("long").alias("near"), F.get("group", F.when(i == 0, 1).otherwise(0)).alias("best")))
    found = groups.select(F.inline(each)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Group spelling variants of ``words`` (word, n).

    One row a word: word, form (its most frequent near word, if that is ``ratio`` times as frequent as the word or more;
    else null), root (where following forms ends; the word itself without a form), n, n_near (words exactly one inserted,
    deleted or replaced character away), form_n. Rows with a null word or n are left out; repeated words count as one,
    with the sum of their n; no words, no rows; other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1: forms have to lead to more frequent words")
    given = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = table(given, "words")
    near = near_words(words)
    far = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    said = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("form")).alias("form"),
        F.when(far, F.col("form_n")).alias("form_n"),
    )
    said = table(said, "forms")
    # each round doubles the forms followed; frequencies grow by the ratio, so rounds are about log2(log_ratio(largest n))
    ways = table(said.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        next_of = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(next_of, "root", "left_semi").isEmpty():
            break
        before = ways
        ways = table(ways.join(next_of, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "ways")
        discard(before)
    out = said.join(ways, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
