"""Answers by a deadline: what is finished by then counts, names what it covers, and can be gone on with.

A stored table is worked off part by part (its partition values), some parts at once, each a job of its own that writes
its rows and then an entry in a ledger. At the deadline the jobs still running are cancelled by their tag. The answer
reads the parts of the ledger only, so it is exact for those; another call with the same folder does the others.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.stored import delete, names_in, read_text, write_text

AT_ONCE = 4


def store(pages: DataFrame, path: str, parts: int, key: str = "doc_id", part: str = "part") -> None:
    """Write ``pages`` by the hash of ``key``: documents stay whole, parts come out about even."""
    placed = pages.withColumn(part, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    # several tasks write a part if its rows are many: the range goes on within the part
    placed.repartitionByRange(part, key).write.partitionBy(part).parquet(path)


@dataclass(frozen=True)
class Answer:
    """``rows`` of the parts in ``covered``; ``missing`` parts were not finished by the deadline."""

    rows: DataFrame
    covered: list
    missing: list

    @property
    def complete(self) -> bool:
        return not self.missing


def answer(
    spark: SparkSession,
    path: str,
    work: Callable[[DataFrame], DataFrame],
    folder: str,
    seconds: float | None = None,
    part: str = "part",
    at_once: int = AT_ONCE,
) -> Answer:
    """``work`` applied to each part of the table at ``path``, as far as ``seconds`` go (None: all of it).

    ``work`` must not mix rows of different parts. An error of a part is raised once the others have ended; parts that
    are in the ledger by then stay there.
    """
    until = None if seconds is None else time.monotonic() + seconds
    whole = spark.read.parquet(path)
    schema = work(whole.drop(part)).schema
    parts = sorted(r[0] for r in whole.select(part).distinct().collect())  # of the listing alone, no row is read
    done = {json.loads(read_text(spark, f"{folder}/ledger/{n}"))["part"] for n in names_in(spark, f"{folder}/ledger")}
    tag, lock, stopped = f"deadline-{uuid.uuid4().hex}", threading.Lock(), threading.Event()
    context = spark.sparkContext

    def one(value) -> None:
        if stopped.is_set():
            return
        context.addJobTag(tag)
        try:
            began, out = time.monotonic(), f"{folder}/rows/{part}-{value}"
            work(whole.where(F.col(part) == value).drop(part)).write.mode("overwrite").parquet(out)
            with lock:
                if not stopped.is_set():  # what ends after the deadline is not answered, even if it ends well
                    write_text(spark, f"{folder}/ledger/{part}-{value}.json", json.dumps({"part": value, "seconds": round(time.monotonic() - began, 3)}))
                    done.add(value)
        except Exception:
            if not stopped.is_set():
                raise
        finally:
            context.removeJobTag(tag)

    def stop() -> None:
        with lock:
            stopped.set()
        # again and again: a thread may be about to start its next job
        for _ in range(3):
            context.cancelJobsWithTag(tag)
            time.sleep(0.2)

    timer = None if until is None else threading.Timer(max(0.0, until - time.monotonic()), stop)
    if timer is not None:
        timer.start()
    try:
        with ThreadPoolExecutor(at_once) as pool:
            for future in [pool.submit(inheritable_thread_target(spark)(one), p) for p in parts if p not in done]:
                future.result()
    finally:
        if timer is not None:
            timer.cancel()
    covered = [p for p in parts if p in done]
    read = spark.read.schema(schema)
    rows = read.parquet(*[f"{folder}/rows/{part}-{p}" for p in covered]) if covered else spark.createDataFrame([], schema)
    return Answer(rows, covered, [p for p in parts if p not in done])


def forget(spark: SparkSession, folder: str) -> None:
    """Delete the rows and the ledger of an answer that is not needed any more."""
    delete(spark, folder)
