"""Files: directory scans and binary documents, read by Spark's own file sources."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import naming

PAGES = "path string, page int, text string, reason string"


def find_documents(spark: SparkSession, directory: str, exclude: Iterable[str] = (), recursive: bool = False, suffix: str = "pdf") -> DataFrame:
    """(path, filename, length, content) of files with the suffix in any case, without those excluded.

    Paths are compared in lower case. Order is by `naming.natural_column` of filename where it matters; ``content`` is
    read only where it is used.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    found = files.load(directory if recursive else directory.rstrip("/") + "/*")
    path = F.regexp_replace("path", "^file:/+", "/")
    found = found.select(path.alias("path"), F.regexp_replace("path", "^.*/", "").alias("filename"), "length", "content")
    dropped = [x.lower() for x in exclude]
    return found.where(~F.lower("path").isin(dropped)) if dropped else found


def read_paths(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, content) of the files with these very names: brackets and stars in them are no patterns."""
    read = spark.read.format("binaryFile").load([re.sub(r"([][{}*?\\])", r"\\\1", p) for p in paths])
    return read.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def page_counts(files: DataFrame) -> DataFrame:
    """(path, page_count) of binary documents; null for a file that is unreadable."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from folioscope.decode.document import Document
        from folioscope.errors import UnreadableError

        for pdf in batches:
            counts = []
            for content in pdf["content"]:
                try:
                    counts.append(Document(bytes(content)).page_count)
                except UnreadableError:
                    counts.append(None)
            yield pd.DataFrame({"path": pdf["path"], "page_count": pd.array(counts, dtype="Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, page_count int")


def document_pages(files: DataFrame) -> DataFrame:
    """(path, page, text, reason): the pages of binary documents; one row with a reason for a file that is unreadable."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from folioscope.decode.document import Document
        from folioscope.errors import UnreadableError

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    doc = Document(bytes(content))
                    rows += [(path, i + 1, doc.text(i), None) for i in range(doc.page_count)]
                except UnreadableError:
                    rows.append((path, None, None, "unreadable_pdf"))
            out = pd.DataFrame(rows, columns=["path", "page", "text", "reason"])
            yield out.astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def document_links(files: DataFrame) -> DataFrame:
    """(path, page, link_ord, uri, rect): links with an address of readable documents."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from folioscope.decode.document import Document
        from folioscope.errors import UnreadableError

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    doc = Document(bytes(content))
                    rows += [(path, i + 1, k, uri, rect) for i in range(doc.page_count) for k, (uri, rect) in enumerate(doc.links(i))]
                except UnreadableError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "page", "link_ord", "uri", "rect"]).astype({"page": "int32", "link_ord": "int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, link_ord int, uri string, rect array<double>")


def text_file(spark: SparkSession, path: str) -> str:
    """A text file, decoded strictly as UTF-8."""
    from folioscope.errors import ValidationError

    rows = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not rows:
        raise ValidationError(f"file not found: {path}")
    try:
        return bytes(rows[0]["content"]).decode("utf-8")
    except UnicodeDecodeError:
        raise ValidationError(f"file is not valid UTF-8: {path}") from None


def numbered_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files named like 12_name.pdf with number and rest, and all others with a reason."""
    number, rest = naming.numeric_prefix("filename")
    tagged = files.withColumns({"number": number, "rest": rest})
    return tagged.where("number <> ''"), tagged.where("number = ''").select("path", F.lit("no_numeric_prefix").alias("reason"))
