"""A register of documents whose pages keep arriving: state per document, kept through restarts.

Each document's state is one row: the first page seen, the pages so far and the matches so far. A micro-batch brings a
document's new pages together, adds them up and gives its new totals; Spark keeps the state in its checkpoint, so a
restart goes on where the last committed batch ended and counts no page twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioscope.functions import keywords as kw

STATE = "first_page int, pages long, total long"
ROWS = "doc_id string, first_page int, pages long, total long"
#: Spark's state store that keyed state of this kind needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Totals(StatefulProcessor):
    """(doc_id, first_page, pages, total) of a document after each batch that brought pages of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", STATE)

    def _added(self, parts: Iterator[tuple[int, int, int]]) -> tuple[int, int, int]:
        """The new state; ``parts`` are (first page, pages, total) of some rows each."""
        first, pages, total = self.state.get() if self.state.exists() else (None, 0, 0)
        for page, n, matches in parts:
            first = page if first is None else min(first, page)
            pages, total = pages + n, total + matches
        self.state.update((first, pages, total))
        return first, pages, total

    def handleInputRows(self, key: tuple, rows: Iterator, timer: Any) -> Iterator:
        import pandas as pd

        # pandas batches of one document's rows, however many
        parts = ((int(p["first_page"].min()), int(p["pages"].sum()), int(p["total"].sum())) for p in rows)
        first, pages, total = self._added(parts)
        yield pd.DataFrame({"doc_id": [key[0]], "first_page": [first], "pages": [pages], "total": [total]}).astype({"first_page": "int32"})

    def close(self) -> None:
        pass


def running_totals(pages: DataFrame, keywords: list[str], case_sensitive: bool = False, whole_words: bool = True) -> DataFrame:
    """(doc_id, first_page, pages, total) of a stream of (doc_id, page, text): use output mode update.

    Matches are counted by the scan's own tasks, so only numbers are shuffled. A null document is left out.
    """
    matches = sum((kw.count("text", k, case_sensitive, whole_words) for k in keywords), F.lit(0).cast("long"))
    counted = pages.where("doc_id is not null").select("doc_id", F.col("page").alias("first_page"), F.lit(1).cast("long").alias("pages"), matches.alias("total"))
    return counted.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Totals(), outputStructType=ROWS, outputMode="update", timeMode="none")


def take_in(spark: SparkSession, source: str, schema: str, folder: str, keywords: list[str]) -> None:
    """Take in what has arrived in ``source`` (Parquet files of ``schema``) since the last call, then stop.

    ``folder`` holds the checkpoint and what each batch gave; a batch that is run again replaces its own rows.
    """
    spark.conf.set(*STORE)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    totals = running_totals(spark.readStream.schema(schema).parquet(source), keywords)
    query = totals.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, first_page, pages, total) as of the last batch taken in."""
    rows = spark.read.schema(ROWS + ", batch long").parquet(f"{folder}/totals")
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch")))
    return rows.withColumn("nth", last).where("nth = 1").select("doc_id", "first_page", "pages", "total")
