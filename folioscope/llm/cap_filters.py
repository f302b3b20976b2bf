"""Embedding near-dedup by spherical-cap filters.

The filters are the words of a random product code: the rotated space is cut into blocks, each with random unit code
vectors, and a filter is one code vector from each block. A vector is list-decoded to all filters whose direction it
exceeds the cap's height in (a branch-and-bound over the blocks), vectors of one label are joined on filters, and
every pair met is verified by its cosine in double precision. A pair met in several filters counts in the first only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import components, spanning, table

COSINE = 0.98
BLOCKS = 2
CODES = 128
#: Filters a vector is expected to fall in; the cap's height follows from it.
EXPECTED = 40
#: Vectors of one filter compared at once; a fuller filter is compared block by block.
TOGETHER = 1024
SEED = 11


@dataclass(frozen=True)
class ProductCode:
    """Random rotation and block codes for vectors of ``size`` components."""

    size: int
    expected: int = EXPECTED
    codes: int = CODES
    seed: int = SEED

    def parts(self) -> tuple[np.ndarray, list[np.ndarray], float]:
        rng = np.random.default_rng([self.seed, self.size])
        turn, _ = np.linalg.qr(rng.standard_normal((self.size, self.size)))
        count = min(BLOCKS, self.size)
        blocks = []
        for width in (len(x) for x in np.array_split(np.arange(self.size), count)):
            c = rng.standard_normal((self.codes, width))
            blocks.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(count))
        share = min(0.5, self.expected / self.codes**count)
        return turn, blocks, NormalDist().inv_cdf(1 - share) / np.sqrt(self.size)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each row exceeds; each row's best filter is always among them."""
        turn, blocks, height = self.parts()
        turned, rows, words, sums, start = unit @ turn, np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit)), 0
        scores = []
        for c in blocks:
            scores.append(turned[:, start : start + c.shape[1]] @ c.T)
            start += c.shape[1]
        best = np.sum([s.max(axis=1) for s in scores], axis=0)
        height = np.minimum(height, best - 1e-12)
        rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
        for i, s in enumerate(scores):
            after = rest[i + 1] if i + 1 < len(scores) else np.zeros(len(unit))
            at, code = np.nonzero(sums[:, None] + s[rows] + after[rows, None] >= height[rows, None])
            rows, words, sums = rows[at], words[at] * s.shape[1] + code, sums[at] + s[rows[at], code]
        return rows, words


def _vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Vectors that can be linked: label and components not null, all finite, not all zero."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine)


def cap_components(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """One row per vector: vec_id, n_links (others linked directly), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
    nothing; so do vectors of different length. Equal vectors of one label are compared once and counted for each
    row; ids should be unique and not null (a null id joins no component). An empty table gives no rows.
    """
    sound = _vectors(df, vec_id, embedding, label)
    reps = table(
        sound.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id()),
        "vectors",
    )

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cls = batch.column(0).to_numpy()
            vectors = [np.asarray(x) for x in batch.column(1).to_pylist()]
            lengths = np.array([len(v) for v in vectors])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                raw = np.stack([vectors[i] for i in at])
                raw = raw / np.abs(raw).max(axis=1, keepdims=True)
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                for first in range(0, len(at), 512):
                    row, word = ProductCode(int(size)).decode(unit[first : first + 512])
                    yield pa.RecordBatch.from_arrays([pa.array(cls[at[first + row]]), pa.array(word), pa.array(np.full(len(row), size, np.int64))], ["cls", "word", "size"])

    hits = reps.select("cls", "v").mapInArrow(decode, "cls long, word long, size long").join(reps.select("cls", "label"), "cls")
    hits = table(hits.select("cls", F.xxhash64("label", "size", "word").alias("bucket")), "hits")
    sizes = hits.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    of = hits.groupBy("cls").agg(F.sort_array(F.collect_set("bucket")).alias("filters"))
    met = hits.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / TOGETHER))
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    # a filter with several blocks of vectors becomes a group for each two of its blocks
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("cls", "bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine")
    loads = reps.select("cls", "v", "copies").join(of, "cls")
    rows = met.join(loads, "cls").withColumn("part", F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(max(1, sizes.agg(F.sum("n")).first()[0] or 1) // 2000 + 1)))

    def compare(pdf):
        import pandas as pd

        ends_a, ends_b, node, links = [], [], [], []
        for (bucket, x, y), block in pdf.groupby(["bucket", "x", "y"], sort=False):
            if len(block) < 2:
                continue
            cls, mine, copies = block["cls"].to_numpy(), block["mine"].to_numpy(), block["copies"].to_numpy()
            v = np.stack(block["v"].to_numpy())
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            close = v @ v.T >= cosine
            np.fill_diagonal(close, False)
            if x != y:
                close &= mine[:, None] != mine[None, :]
            if not close.any():
                continue
            at = np.flatnonzero(close.any(axis=1))
            close = close[np.ix_(at, at)]
            # filters before this one, as columns: a pair that shares any was counted there
            earlier = [np.asarray(f)[np.asarray(f) < bucket] for f in block["filters"].to_numpy()[at]]
            codes, column = np.unique(np.concatenate(earlier), return_inverse=True)
            member = np.zeros((len(at), len(codes)), np.float32)
            member[np.repeat(np.arange(len(at)), [len(e) for e in earlier]), column] = 1
            close &= member @ member.T == 0
            node.append(cls[at])
            links.append(close @ copies[at])
            for i, j in spanning(close):
                ends_a.append(cls[at[i]])
                ends_b.append(cls[at[j]])
        counts = pd.DataFrame({"node": np.concatenate([np.empty(0, np.int64), *node]), "links": np.concatenate([np.empty(0, np.int64), *links])})
        counts = counts.groupby("node", as_index=False)["links"].sum()
        tree = pd.DataFrame({"node": np.array(ends_a, np.int64), "other": np.array(ends_b, np.int64)})
        return pd.concat([counts.assign(other=-1), tree.assign(links=0)])[["node", "other", "links"]].astype("int64")

    found = table(rows.groupBy("part").applyInPandas(compare, "node long, other long, links long"), "links")
    direct = found.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other >= 0"), "node", "other").withColumnRenamed("node", "cls")
    known = reps.join(direct, F.col("cls") == F.col("node"), "left").join(roots, "cls", "left")
    known = table(known.select("cls", "label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "known")
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    known = known.join(least, "root").select("label", "v", "n_links", "component")
    every = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("v"))
    out = every.join(known, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
