"""N-gram Jaccard join by a token-group matrix.

Shingle tokens are counted over the whole corpus, so that each set can be read from its rarest token on. The signature
of a set of n tokens holds its n - ceil(t n) + depth(n) rarest ones; two sets of similarity t share at least as many
signature tokens as the depth of the smaller one. Tokens of a single document cannot be shared and are left out, and a
set that keeps too few of its signature is linked with nothing.

The other sets form classes of equal sets. Classes that share a least shingle are compared in blocks, each with one
pivot of its key, and what is linked so becomes a group of similar classes; a few more least shingles join groups by
their representatives. The matrix holds each group's union of signature tokens. The overlap of two groups' unions
bounds that of their classes, so only groups that share the depth of the smallest set that could be linked are opened:
there the smaller group's sets are compared exactly with the larger one's. Groups are connected already, so no link
within one is lost; what is returned are spanning links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import PLACE_BITS, by_span, chunks, pack, texts_of, unpack
from folioscope.llm.shared import components, discard, small, spanning, table
from folioscope.llm.shingles import WORDS, shingle_set

PERCENT = 75
#: Signature tokens that linked sets must share: DEPTH at least, and one for each STEP tokens of the smaller set.
DEPTH = 3
STEP = 16
GROUP = 256
#: Least shingles by which classes are put into groups: the first for all classes, the others for representatives.
KINS = 4
_ORDERS = [np.uint64(2 * x + 1) for x in np.random.Generator(np.random.PCG64(11)).integers(1, 2**62, KINS)]
#: Tokens are counted by so many leading bits; where two meet, both count as more frequent, which orders them later
#: and loses nothing. A range of the count tables takes the tokens of about RANGE_BYTES of text.
COUNT_BITS = 40
RANGE_BYTES = 4_000_000
BROADCAST_ROWS = 500_000


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def depth(n: int) -> int:
    """Signature tokens that a set of ``n`` tokens shares with every linked set that is no smaller."""
    return max(DEPTH, n // STEP)


def _sets(sizes: list[int], texts: bytes, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sets of a chunk's texts, its distinct leading bits (sorted) and in how many sets each occurs."""
    sets = [shingle_set(t, k) for t in texts_of(sizes, texts)]
    each = [np.unique(s >> np.uint64(64 - COUNT_BITS)) for s in sets]
    return sets, *np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_counts=True)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes on a scale of eighths of a doubling; 0 for 1."""
    return np.minimum(255, np.ceil(8 * np.log2(counts))).astype(np.uint8)


def token_levels(dealt: DataFrame, size: int, k: int) -> DataFrame:
    """(chunk, levels): the frequency level over all chunks of each of the chunk's distinct leading bits, in order."""
    spans = max(1, size // RANGE_BYTES).bit_length()

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"span": pa.int64(), "chunk": pa.int64(), "n": pa.int64(), "tokens": pa.binary(), "counts": pa.binary()}
        for batch in batches:
            for chunk, sizes, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                _, key, count = _sets(sizes, texts.as_py(), k)
                rows = [
                    (span, chunk, b - a, pack(np.diff(key[a:b], prepend=np.uint64(0)), COUNT_BITS // 8), pack(count[a:b], 4))
                    for span, a, b in by_span(key, COUNT_BITS, spans)
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    def count(pdf):
        import pandas as pd

        key = np.concatenate([np.cumsum(unpack(t, n, COUNT_BITS // 8), dtype=np.uint64) for t, n in zip(pdf["tokens"], pdf["n"], strict=True)])
        weight = np.concatenate([unpack(c, n, 4) for c, n in zip(pdf["counts"], pdf["n"], strict=True)])
        _, at = np.unique(key, return_inverse=True)
        level = _levels(np.bincount(at, weight))[at]
        ends = np.cumsum(pdf["n"].to_numpy())
        levels = [pack(level[e - n : e], 1) for e, n in zip(ends, pdf["n"], strict=True)]
        return pd.DataFrame({"span": pdf["span"], "chunk": pdf["chunk"], "n": pdf["n"], "levels": levels})

    blocks = dealt.select("chunk", "sizes", "texts").mapInArrow(spread, "span long, chunk long, n long, tokens binary, counts binary")
    return blocks.groupBy("span").applyInPandas(count, "span long, chunk long, n long, levels binary")


def signatures(docs: DataFrame, doc_id: str, text: str, percent: int, k: int) -> DataFrame:
    """Per document: row, doc_id, set_key, n; and where links are possible kins (its least shingles in KINS orders),
    signature and tokens (the whole set, for the first document of a chunk that has it)."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    dealt = table(chunks(docs, doc_id, text), "chunks")
    levels = table(token_levels(dealt, size, k), "levels")
    back = levels.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("span", "n", "levels"))).alias("parts"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, ids, sizes, texts, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                sets, key, _ = _sets(sizes, texts.as_py(), k)
                level = np.concatenate([np.empty(0, np.uint64), *[unpack(p["levels"], p["n"], 1) for p in parts.as_py() or ()]])
                keys, kins, signs, tokens, met = [], [], [], [], set()
                for s in sets:
                    n = len(s)
                    keys.append(name := blake2b(s.tobytes(), digest_size=16).digest())
                    first = name not in met
                    met.add(name)
                    often = level[np.searchsorted(key, s >> np.uint64(64 - COUNT_BITS))]
                    sign = s[np.lexsort((s, often))[: n - least_overlap(n, percent) + depth(n)]] if n >= DEPTH else s[:0]
                    sign = sign[often[np.searchsorted(s, sign)] > 0]
                    if n < DEPTH or len(sign) < depth(least_overlap(n, percent)):
                        kins.append(None)
                        signs.append(None)
                        tokens.append(None)
                        continue
                    kins.append(np.array([(s * x).min() for x in _ORDERS], np.uint64).view(np.int64))
                    signs.append(sign.view(np.int64))
                    tokens.append(s.tobytes() if first else None)
                numbers = pa.list_(pa.int64())
                columns = [
                    pa.array((chunk << PLACE_BITS) + np.arange(len(sets))), ids.values, pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(kins, numbers), pa.array(signs, numbers), pa.array(tokens, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "set_key", "n", "kins", "signature", "tokens"])

    schema = f"row long, doc_id {kind}, set_key binary, n long, kins array<long>, signature array<long>, tokens binary"
    rows = dealt.join(back, "chunk", "left").select("chunk", "ids", "sizes", "texts", "parts")
    signed = table(rows.mapInArrow(run, schema), "signatures")
    discard(dealt, levels)
    return signed


def _matrix(classes: DataFrame, grouped: DataFrame) -> DataFrame:
    """(token, comp, fewest, most): signature tokens of two groups or more; sizes of the sets that have the token."""
    tokens = classes.select("cls", "signature").join(grouped.select("cls", "comp", "n"), "cls")
    tokens = tokens.select("comp", "n", F.explode("signature").alias("token"))
    tokens = table(tokens.groupBy("token", "comp").agg(F.min("n").alias("fewest"), F.max("n").alias("most")), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    matrix = table(tokens.join(often.select("token"), "token"), "matrix")
    discard(tokens)
    return matrix


def _least_shared(low: str, low2: str, percent: int) -> Column:
    """Signature tokens that any two linked sets share of groups whose smallest sets have ``low`` and ``low2`` tokens."""
    least = lambda own, other: F.greatest(F.col(own), F.ceil(F.lit(percent) * F.col(other) / 100))
    smaller = F.least(least(low, low2), least(low2, low))
    return F.greatest(F.lit(DEPTH), F.floor(smaller / STEP))


def _by_key(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, no, role, cls): classes of a key (key, cls) in blocks of about GROUP, the key's least class in each block.

    Also the keys of two classes or more: key, pivot, blocks.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("pivot")).where("size > 1")
    sizes = table(sizes.select("key", "pivot", F.ceil(F.col("size") / GROUP).alias("blocks")), "keys")
    others = keys.join(small(sizes, sizes.count(), BROADCAST_ROWS), "key").where("cls != pivot")
    others = others.select(F.col("key").alias("grp"), F.pmod(F.xxhash64("cls"), "blocks").alias("no"), F.lit(0).alias("role"), "cls")
    pivots = sizes.select(F.col("key").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("no"), F.lit(0).alias("role"), F.col("pivot").alias("cls"))
    return others.unionByName(pivots), sizes


def open_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning links (a, b) of the classes in each block; ``rows``: bucket, block, role, cls, tokens."""

    def run(pdf):
        import pandas as pd

        out: list[tuple[int, int]] = []
        for _, block in pdf.groupby("block", sort=False):
            cls, role = block["cls"].to_numpy(), block["role"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in block["tokens"]]
            if len(sets) < 2:
                continue
            sizes = np.array([len(s) for s in sets])
            codes, at = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), sizes)
            often = np.bincount(at, minlength=len(codes))
            shared = np.flatnonzero(often > 1)
            both = np.zeros((len(sets), len(sets)), np.float64)
            keep = often[at] > 1
            column, row = np.searchsorted(shared, at[keep]), owner[keep]
            for first in range(0, len(shared), 4096):
                inside = (column >= first) & (column < first + 4096)
                m = np.zeros((len(sets), min(4096, len(shared) - first)), np.float32)
                m[row[inside], column[inside] - first] = 1
                both += m @ m.T
            union = sizes[:, None] + sizes[None, :] - both
            linked = (100 * both >= percent * union) & (role[:, None] <= role[None, :])
            linked &= ~((role[:, None] == 1) & (role[None, :] == 1))
            linked = linked | linked.T
            np.fill_diagonal(linked, False)
            out += [(cls[i], cls[j]) for i, j in spanning(linked)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket").applyInPandas(run, "a long, b long")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = WORDS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    Null, empty and wordless texts have an empty set and are linked with nothing; equal sets are always linked;
    repeated rows each give a row, null ids count for no minimum; texts of any length are read whole (a text longer than
    a chunk is a chunk of its own); an empty table gives no rows; other columns are not read. Every pair of similarity
    of at least ``percent`` (67 to 100) is found (set elements are 64-bit hashes).
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be 67 to 100: below, sets of two shingles can be linked with others")
    signed = signatures(docs, doc_id, text, percent, k)
    # classes of equal sets, of those that can be linked with others; cls is the row of the first document
    can_link = F.col("signature").isNotNull() | F.col("n").between(1, DEPTH - 1)
    classes = table(signed.where(can_link).groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("row").alias("cls")), "classes")
    reps = table(classes.select("cls").join(signed.where("signature is not null").withColumnRenamed("row", "cls"), "cls").select("cls", "n", "kins", "signature"), "reps")
    sets = table(classes.select("cls").join(signed.where("tokens is not null").select(F.col("row").alias("cls"), "tokens"), "cls"), "sets")

    def opened(blocks: DataFrame) -> DataFrame:
        """Links (a, b) found in blocks (grp, no, role, cls)."""
        rows = table(blocks, "blocks")
        block = F.xxhash64("grp", "no")
        bucket = F.pmod(block, F.lit(max(1, rows.count() // 500)))
        inside = rows.join(sets, "cls").select(bucket.alias("bucket"), block.alias("block"), "role", "cls", "tokens")
        links = table(open_blocks(inside, percent), "opened")
        discard(rows)
        return links

    # groups of similar classes: by the first least shingle, then by the others of one class for each group and key
    first_key = F.xxhash64(F.col("kins")[0])
    rows, sizes = _by_key(reps.select(first_key.alias("key"), "cls"))
    found = components(opened(rows))
    roots = found.withColumnRenamed("node", "cls")
    keys = reps.join(roots, "cls", "left").select(F.coalesce("root", "cls").alias("comp"), "cls", F.posexplode(F.slice("kins", 2, KINS - 1)).alias("j", "kin"))
    keys = keys.groupBy(F.xxhash64("j", "kin").alias("key"), "comp").agg(F.min("cls").alias("cls")).select("key", "cls")
    tied = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(tied.unionByName(opened(_by_key(keys)[0])))
    # a class without links stays with the block in which it has been compared
    roots = found.withColumnRenamed("node", "cls")
    kept = reps.join(roots, "cls", "left").withColumn("key", first_key)
    kept = kept.join(small(sizes.select("key", "blocks"), sizes.count(), BROADCAST_ROWS), "key", "left")
    own_block = F.xxhash64("key", F.pmod(F.xxhash64("cls"), F.coalesce("blocks", F.lit(1))))
    grouped = table(kept.select("cls", "n", F.coalesce("root", own_block).alias("comp"), F.col("root").isNotNull().alias("tied")), "groups")
    # pairs of groups whose unions share enough tokens of sets of fitting sizes (by a factor of t at most)
    matrix = _matrix(reps, grouped)
    other = matrix.select("token", F.col("comp").alias("comp2"), F.col("fewest").alias("fewest2"), F.col("most").alias("most2"))
    alike = (100 * F.col("most") >= percent * F.col("fewest2")) & (100 * F.col("most2") >= percent * F.col("fewest"))
    pairs = matrix.join(other, "token").where((F.col("comp") < F.col("comp2")) & alike)
    pairs = table(pairs.groupBy("comp", "comp2").agg(F.count("*").alias("bound")).where(f"bound >= {DEPTH}"), "pairs")
    members = table(grouped.groupBy("comp").agg(F.count("*").alias("members"), F.max("tied").alias("tied"), F.min("n").alias("low")), "members")
    near = pairs.join(members, "comp").join(members.toDF("comp2", "members2", "tied2", "low2"), "comp2").where(F.col("bound") >= _least_shared("low", "low2", percent))
    # blocks: up to GROUP classes of the larger group, with up to GROUP classes of smaller ones
    one, two = F.struct("members", "comp", "tied"), F.struct(F.col("members2").alias("members"), F.col("comp2").alias("comp"), F.col("tied2").alias("tied"))
    near = near.select(F.least(one, two)["comp"].alias("ask"), F.greatest(one, two).alias("to"))
    near = near.select("ask", "to.comp", "to.tied", F.ceil(F.col("to.members") / GROUP).alias("parts"))
    asks = table(grouped.select(F.col("comp").alias("ask"), "cls").join(near, "ask").drop("ask"), "asks")
    discard(matrix, pairs)
    part = F.pmod(F.xxhash64("cls", F.lit(1)), F.ceil(F.col("members") / GROUP))
    parted = grouped.select("comp", "cls").join(members, "comp").select(F.xxhash64("comp", part).alias("grp"), "cls")

    def blocks(asks: DataFrame, chosen: F.Column) -> DataFrame:
        """The asking classes with the ``chosen`` parts of ``comp``."""
        asking = asks.select("cls", "comp", F.explode(chosen).alias("part"))
        asking = table(asking.select("cls", F.xxhash64("comp", "part").alias("grp")), "asking")
        asked = table(asking.groupBy("grp").agg(F.ceil(F.count("*") / GROUP).alias("blocks")), "asked")
        there = asking.join(asked, "grp").select("grp", F.pmod(F.xxhash64("cls"), "blocks").alias("no"), F.lit(1).alias("role"), "cls")
        no = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("no")
        return parted.join(asked, "grp").select("grp", no, F.lit(0).alias("role"), "cls").unionByName(there)

    # a class asks one part of each linked group first, and then the others if it is not connected with that group
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    first = F.array(F.pmod(F.xxhash64("cls"), "parts"))
    tied = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(tied.unionByName(opened(blocks(asks, F.when(F.col("tied"), first).otherwise(every)))))
    left = asks.where("tied and parts > 1").join(found.toDF("cls", "r1"), "cls", "left").join(found.toDF("comp", "r2"), "comp", "left")
    left = table(left.where(F.coalesce("r1", "cls") != F.coalesce("r2", "comp")).select("cls", "comp", "parts"), "asks")
    if not left.isEmpty():
        tied = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = components(tied.unionByName(opened(blocks(left, F.array_except(every, first)))))
    ids = table(classes.join(found, F.col("cls") == F.col("node"), "left").select("set_key", "least", F.coalesce("root", "cls").alias("root")), "ids")
    roots = table(ids.groupBy("root").agg(F.min("least").alias("component")), "roots")
    named = table(ids.join(roots, "root").select("set_key", "component"), "named")
    discard(classes, reps, sets, grouped, members, asks, left, ids, roots)
    alone = signed.where(~can_link).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return signed.where(can_link).join(named, "set_key").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(alone)
