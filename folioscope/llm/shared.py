"""Helpers of the training-data operators: shared tables, connected components and bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may go without it (tests)."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="folioscope-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return _local_dir[0]


#: Spark's setting by which an execution's shuffle files go as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    The shuffle files behind it are removed once it is written; ``discard`` removes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``table`` whose rows have been consumed: nothing may read them afterwards."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._folioscope_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``most``, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= most else df


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A tree of links for each component of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], reached = False, [start]
        while reached:
            i = reached.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            reached += new.tolist()
            out += [(i, int(j)) for j in new]
    return out


def _stars(pairs: DataFrame) -> bool:
    """Whether every u of the distinct ``pairs`` (u > v) has one v, which is no u itself: then each v is a root."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where("down > 1 or down = 1 and up = 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``links`` by alternating large-star and small-star rounds.

    Returns (node, root): every node that has a link to another node, with the smallest node reachable. Links with a
    null end and self-links are ignored. A hub's least neighbour is a written table, so that adaptive execution can split
    the hub's rows among tasks in the join with it; a round's tables are deleted when the next one is written.
    """
    pairs = table(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # large-star: every larger neighbour of u is tied to the least node around u
        large = (
            both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.distinct()
        # small-star: u and its smaller neighbours are tied to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = (
            large.join(down, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        before, pairs = pairs, table(tied, "links")
        discard(before, least)
    return (
        pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        .unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")))
        .distinct()
    )
