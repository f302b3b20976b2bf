"""Ranks over all rows without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows looked at for bounds, about, and bounds taken from them. They decide how even the buckets are, never the ranks.
LOOKED_AT = 20_000
BOUNDS = 200


def bounds(df: DataFrame, key: Column) -> list[str]:
    """At most BOUNDS values that cut the rows into buckets of about one size in the order of ``key``, a string."""
    keys = df.select(key.alias("key")).where("key is not null")
    rows = keys.count()
    if rows > LOOKED_AT:
        keys = keys.where(F.rand(7) < LOOKED_AT / rows)
    seen = sorted((r["key"] for r in keys.collect()), key=lambda k: k.encode("utf-8"))
    return list(dict.fromkeys(seen[i * len(seen) // (BOUNDS + 1)] for i in range(1, BOUNDS + 1))) if seen else []


def bucket_of(key: Column, cuts: list[str]) -> Column:
    """How many of the bounds are not above ``key``; 0 for null. The key is made once, not for each bound."""
    above = lambda k: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= k))
    return F.get(F.transform(F.array(key), above), F.lit(0)) if cuts else F.lit(0)


def steps(n: Column) -> Column:
    """A bounded number of values that ascend as ``n`` (0 or more) does: each up to 256, then 16 for each doubling."""
    return F.when(n <= 256, n).otherwise(257 + F.floor(16 * (F.log2(n.cast("double")) - 8))).cast("long")


def ranked(df: DataFrame, order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """``df`` with gapless ranks from 1 in ``order``; ties must be told apart by it.

    ``bucket`` has to sort (ascending) as ``order`` does, in fewer values: buckets are sized by a group-by, their
    sizes summed up in one small window, and rows ranked within their bucket.
    """
    tagged = df.withColumn("__bucket", bucket)
    sizes = tagged.groupBy("__bucket").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    placed = tagged.withColumn("__within", within).join(starts, F.col("__bucket").eqNullSafe(F.col("__b")))
    return placed.withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__bucket", "__b", "__before", "__within")
