"""Documents joined into files by many writers: sizes first, then every task writes its own stretch of each file.

The place of a page in its file is the sum of the bytes before it, a running sum over sources and over pages. Pages are
dealt by file and place, and a task writes them where they belong into a folder that is not there yet; a page written
twice, by a repeated task, is the same bytes in the same place. Renaming the folder is the commit, so a failed write
leaves nothing. It needs a folder that all executors reach by the same local path (a mounted file system).
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.errors import OutputConflictError, ValidationError
from folioscope.plans.scan import running_sum

#: Bytes that a digest reads at once.
READ_BYTES = 1_000_000


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file:"):
        raise ValidationError(f"files are written in place, which {path} does not allow")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)


def placed(pages: DataFrame, sources: DataFrame, separator: str = "\n") -> DataFrame:
    """(output, data, at): the bytes of each page with the separator before it, and where they lie in their output.

    ``sources`` (output, src_ord, doc_id) name the documents of each output in the order of src_ord (whole numbers,
    about gapless), one of them as often as it is to be repeated; ``pages`` are (doc_id, page from 1, text). A null text is an empty page; sources without pages add
    nothing; rows with a null key are left out.
    """
    rows = sources.where("output is not null and src_ord is not null").join(pages.where("page is not null"), "doc_id")
    said = F.encode(F.concat(F.lit(separator), F.coalesce("text", F.lit(""))), "UTF-8")
    rows = rows.select("output", "src_ord", "page", said.alias("data")).withColumn("size", F.octet_length("data").cast("long"))
    within = running_sum(rows, ["output", "src_ord"], "page", "size", "inside")
    sizes = rows.groupBy("output", "src_ord").agg(F.sum("size").alias("size"))
    starts = running_sum(sizes, ["output"], "src_ord", "size", "start").select("output", "src_ord", "start")
    # the first page of an output has no separator before it
    lead = len(separator.encode())
    at = F.col("start") + F.col("inside") - lead
    data = F.when(at < 0, F.expr(f"substring(data, {lead + 1}, length(data))")).otherwise(F.col("data"))
    return within.join(starts, ["output", "src_ord"]).select("output", data.alias("data"), F.greatest(at, F.lit(0)).alias("at"))


def write(pages: DataFrame, sources: DataFrame, path: str, separator: str = "\n") -> int:
    """Write each output as a file of the new folder ``path``; the bytes written. An output without pages has no file."""
    target = _local(path)
    if os.path.exists(target):
        raise OutputConflictError(f"there is something at {target} already", {"output": target})
    own = f"{target}.writing-{uuid.uuid4().hex}"
    os.makedirs(own)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, file, total = None, -1, 0
        try:
            for batch in batches:
                for output, data, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    if output != name:
                        if file >= 0:
                            os.close(file)
                        name, file = output, os.open(f"{own}/{quote(output, safe='')}", os.O_WRONLY | os.O_CREAT, 0o644)
                    rest = memoryview(data.as_buffer())
                    total += len(rest)
                    while len(rest):
                        done = os.pwrite(file, rest, at)
                        rest, at = rest[done:], at + done
        finally:
            if file >= 0:
                os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["bytes"])

    try:
        rows = placed(pages, sources.withColumn("output", F.col("output").cast("string")), separator)
        dealt = rows.repartitionByRange("output", "at").sortWithinPartitions("output", "at")
        written = dealt.mapInArrow(run, "bytes long").agg(F.sum("bytes")).first()[0] or 0
        os.rename(own, target)
        return written
    except Exception:
        shutil.rmtree(own, ignore_errors=True)
        raise


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(output, bytes, md5) of the files of a folder; each is read in small pieces by one task."""
    folder = _local(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                seen, size = hashlib.md5(), 0
                with open(f"{folder}/{name}", "rb") as file:
                    while part := file.read(READ_BYTES):
                        seen.update(part)
                        size += len(part)
                rows.append((unquote(name), size, seen.hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["output", "bytes", "md5"])

    names = spark.createDataFrame([(n,) for n in sorted(os.listdir(folder))], "name string")
    return names.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "output string, bytes long, md5 string")
