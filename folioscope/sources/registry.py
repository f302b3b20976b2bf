"""The catalog as a table: paths and the ids they were first given, for any number of documents and writers.

The folder holds the rows of each commit in files of their own and one small log entry a commit. A commit is made by
creating the next entry, which only one writer can; another one that meant to create it starts again from what is there
now. Rows are never changed, so readers see the commits up to some entry, each of them whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.ranking import ranked
from folioscope.sources.stored import names_in, read_text

SCHEMA = "number long, path string, path_key string"
#: Buckets that new paths are numbered in.
BUCKETS = 256
ATTEMPTS = 50


class Registry:
    """Paths differ by more than their case; an id is ``doc-`` and a number, given once, in order of arrival."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    def _entries(self) -> list[dict]:
        return [json.loads(read_text(self.spark, f"{self.folder}/log/{n}")) for n in names_in(self.spark, f"{self.folder}/log")]

    def _commit(self, version: int, entry: dict) -> bool:
        """Whether this writer made entry ``version``: a rename never replaces a file that is there."""
        final, own = (self._path(f"{self.folder}/log/{n}") for n in (f"{version:010d}.json", f".{uuid.uuid4().hex}"))
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        made = self._exclusive(own, final)
        if not made:
            self._fs.delete(own, False)
        return made

    def _exclusive(self, own, final) -> bool:
        if self._fs.getScheme() == "file":  # whose rename would replace the file: a hard link does not
            import os

            try:
                os.link(own.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            self._fs.delete(own, False)
            return True
        return not self._fs.exists(final) and self._fs.rename(own, final)

    def _rows(self, entries: list[dict]) -> DataFrame:
        parts = [f"{self.folder}/rows/{e['rows']}" for e in entries if e["rows"]]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def documents(self, version: int | None = None) -> DataFrame:
        """(doc_id, path, filename, number) after the latest commit, or the first ``version`` of them."""
        entries = self._entries()
        rows = self._rows(entries if version is None else entries[:version])
        return rows.select(F.concat(F.lit("doc-"), F.col("number")).alias("doc_id"), "path", F.regexp_replace("path", "^.*/", "").alias("filename"), "number")

    def version(self) -> int:
        return len(self._entries())

    def register(self, paths: DataFrame) -> int:
        """Give ids to the paths of ``paths`` (pos, path) that have none, by the order of ``pos``; how many were new.

        Of paths equal but for case the first one's spelling stays. Null paths are left out.
        """
        said = paths.where("path is not null").select("pos", "path", F.lower("path").alias("path_key"))
        first = said.groupBy("path_key").agg(F.min(F.struct("pos", "path")).alias("x"))
        first = first.select("path_key", F.col("x.pos").alias("pos"), F.col("x.path").alias("path"))
        for _ in range(ATTEMPTS):
            entries = self._entries()
            before = entries[-1]["next"] if entries else 0
            new = first.join(self._rows(entries).select("path_key"), "path_key", "left_anti")
            low, high = new.agg(F.min("pos"), F.max("pos")).first()
            rows = None
            if low is not None:
                step = max(1, -(-(high - low + 1) // BUCKETS))
                bucket = F.floor((F.col("pos") - low) / step)
                numbered = ranked(new, [F.col("pos"), F.col("path_key")], bucket, "number")
                rows = uuid.uuid4().hex
                numbered.select((F.col("number") + before).alias("number"), "path", "path_key").write.parquet(f"{self.folder}/rows/{rows}")
            count = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/rows/{rows}").count() if rows else 0
            if self._commit(len(entries), {"rows": rows, "count": count, "next": before + count}):
                return count
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def resolve(self, references: DataFrame) -> DataFrame:
        """``references`` (reference) with doc_id and path: by id, or by path in any case; null where unknown."""
        known = self.documents()
        key = lambda c: F.lower(c)
        names = known.select(key("path").alias("key"), "doc_id", "path").unionByName(known.select(key("doc_id").alias("key"), "doc_id", "path"))
        return references.select("reference", key(F.trim("reference")).alias("key")).join(names, "key", "left").select("reference", "doc_id", "path")
