"""Sharding by a Feistel permutation over global row numbers.

Rows get gapless numbers in the order of their keys; a keyed Feistel network over Z_a x Z_b (a * b >= rows, by less
than a) permutes the numbers, walking the cycle while it leaves the range. A row's shard and slot are the remainder
and quotient of its new number, so both can be computed from the number alone and shards differ by one row at most.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import table

ROUNDS = 6
SEED = 20_240_601
SHARDS = 8
#: monotonically_increasing_id() counts a partition's rows in so many low bits.
LOW_BITS = 33


def halves(rows: int) -> tuple[int, int]:
    """The two moduli: a is about the square root of ``rows``, b just large enough."""
    a = max(2, isqrt(max(rows - 1, 0)) + 1)
    return a, max(2, -(-rows // a))


def round_key(seed: int, k: int) -> int:
    return seed * 1_000 + k


def _added(x: Column, y: Column, key: Column, modulus: int) -> Column:
    return F.pmod(x + F.pmod(F.xxhash64(y, key), F.lit(modulus)), F.lit(modulus))


def _walk(value: Column, rows: int, seed: int, rounds: int) -> Column:
    """Apply the network until the value is below ``rows``. A walk meets each point beyond the range at most once,
    so a * b - rows + 1 passes always do; fewer than one row in a needs any."""
    a, b = halves(rows)

    def turn(s: Column, k: Column) -> Column:
        even = k % F.lit(2) == 0
        left, right = _added(s["l"], s["r"], k, a), _added(s["r"], s["l"], k, b)
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    def once(v: Column) -> Column:
        start = F.struct(F.pmod(v, F.lit(a)).alias("l"), F.call_function("div", v, F.lit(a)).alias("r"))
        keys = F.array(*[F.lit(round_key(seed, k)).cast("long") for k in range(rounds)])
        return F.aggregate(keys, start, turn, lambda s: s["r"] * F.lit(a) + s["l"])

    passes = F.sequence(F.lit(0).cast("long"), F.lit(a * b - rows).cast("long"))
    return F.aggregate(passes, value, lambda v, _: F.when(v < F.lit(rows), v).otherwise(once(v)))


def permuted(df: DataFrame, number: str, to: str, rows: int, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with ``to``: the permuted ``number`` (long, 0 <= number < rows), itself in 0 .. rows-1."""
    a, b = halves(rows)
    df = df.withColumns({"__l": F.pmod(F.col(number), F.lit(a)).cast("long"), "__r": F.expr(f"{number} div {a}L")})
    for k in range(rounds):
        key = F.lit(round_key(seed, k)).cast("long")
        x, y, m = ("__l", "__r", a) if k % 2 == 0 else ("__r", "__l", b)
        df = df.withColumn(x, _added(F.col(x), F.col(y), key, m))
    value = F.col("__r") * F.lit(a) + F.col("__l")
    df = df.withColumn(to, value.cast("long"))
    walked = F.when(F.col(to) < F.lit(rows), F.col(to)).otherwise(_walk(F.col(to), rows, seed, rounds))
    return df.withColumn(to, walked).drop("__l", "__r")


def numbered(rows: DataFrame, order_by: list[str], to: str = "row_number") -> DataFrame:
    """``rows`` with gapless numbers from 0 in the order of ``order_by`` (nulls first; rows that tie in any order).

    Ranges are sorted each for itself; only each range's size (one row a range) is summed up over all of them.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(*order_by, "__tie").sortWithinPartitions(*order_by, "__tie").drop("__tie")
    written = table(ranges.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, nth = F.shiftright("__at", LOW_BITS), F.col("__at").bitwiseAND((1 << LOW_BITS) - 1)
    sizes = written.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0).cast("long")).alias("__before"))
    # one row for each range of the shuffle above, so as many as its partitions at most
    return (
        written.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(to, F.col("__before") + nth)
        .drop("__part", "__before", "__at")
    )


def shard_rows(rows: DataFrame, order_by: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with row_number, place (the permuted number), shard (int) and slot (long, gapless from 0 in a shard).

    ``order_by`` should tell rows apart by content: then the result depends on the rows alone, not on how they are
    stored. Rows equal in it are interchangeable and all kept; nulls come first; an empty table stays empty; columns
    named like the four results are replaced; all others pass through.
    """
    n = rows.count()
    placed = permuted(numbered(rows.drop("row_number", "place", "shard", "slot"), order_by), "row_number", "place", max(n, 1), seed)
    return placed.withColumns({"shard": F.pmod("place", F.lit(shards)).cast("int"), "slot": F.expr(f"place div {shards}L")})


def write_shards(placed: DataFrame, path: str) -> None:
    """Write one folder a shard, its files in the order of the slots."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
