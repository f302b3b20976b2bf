"""A data source for paged text documents: ``format("paged_text")``.

Rows are (doc_id, page, text). A document lies in one or more pieces of consecutive pages, each a UTF-8 file: a line of
JSON (doc_id, first and last page) and the pages, parted by form feeds. A piece's name says its pages and a hash of its
document, so pages and documents that are not asked for are left out by the listing alone. A write has a folder of its
own, and each attempt of a task one below it. It counts once its mark is there, which names the attempts that count: readers
see a whole write or nothing of it, and never what a failed or repeated task has left.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from folioscope.errors import ValidationError
from folioscope.functions.pages import ranges

SCHEMA = "doc_id string, page int, text string"
#: A piece ends at about so many bytes; a task reads about so many.
PIECE_BYTES, TASK_BYTES = 32_000_000, 64_000_000
BREAK, MARKS, LAST_PAGE = "\f", "_written", 2**31 - 1
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _opened(path: str):
    """The file system of a folder (local, HDFS, S3, GCS by Arrow) and the folder's name there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def _mark_of(doc_id: str) -> str:
    return hashlib.sha256(doc_id.encode()).hexdigest()[:16]


@dataclass
class Wanted:
    """Which rows a scan asks for: page ranges, all of which a page must be in, and documents."""

    scopes: list[list[tuple[int, int]]] = field(default_factory=list)
    documents: set[str] | None = None

    def narrow(self, filter: ds.Filter) -> bool:
        """Take a filter over, if it can be decided here exactly."""
        kind, name = type(filter).__name__, getattr(filter, "attribute", ())
        if name == ("page",):
            v = getattr(filter, "value", None)
            spans = {
                "EqualTo": lambda: [(v, v)],
                "In": lambda: [(x, x) for x in v if x is not None],
                "GreaterThan": lambda: [(v + 1, LAST_PAGE)],
                "GreaterThanOrEqual": lambda: [(v, LAST_PAGE)],
                "LessThan": lambda: [(-LAST_PAGE, v - 1)],
                "LessThanOrEqual": lambda: [(-LAST_PAGE, v)],
                "IsNotNull": lambda: [(-LAST_PAGE, LAST_PAGE)],
            }
            if kind in spans:
                self.scopes.append(spans[kind]())
                return True
        if name == ("doc_id",) and kind in ("EqualTo", "In", "IsNotNull"):
            if kind != "IsNotNull":
                asked = {filter.value} if kind == "EqualTo" else set(filter.value) - {None}
                self.documents = asked if self.documents is None else self.documents & asked
            return True
        return False

    def page(self, page: int) -> bool:
        return all(any(a <= page <= b for a, b in scope) for scope in self.scopes)

    def piece(self, first: int, last: int, mark: str) -> bool:
        """Whether a piece can hold a wanted row."""
        meets = all(any(a <= last and first <= b for a, b in scope) for scope in self.scopes)
        return meets and (self.documents is None or mark in {_mark_of(d) for d in self.documents})


@dataclass
class Pieces(ds.InputPartition):
    names: list[str]


class PagedReader(ds.DataSourceReader):
    def __init__(self, path: str, spec: str | None):
        self.path, self.wanted = path, Wanted()
        if spec is not None and (found := ranges(spec)) is not None:
            self.wanted.scopes.append(list(found))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        return [f for f in filters if not self.wanted.narrow(f)]

    def partitions(self) -> list[Pieces]:
        from pyarrow.fs import FileSelector

        fs, folder = _opened(self.path)
        out, size = [Pieces([])], 0
        for mark in sorted(f.base_name for f in fs.get_file_info(FileSelector(f"{folder}/{MARKS}", allow_not_found=True))):
            with fs.open_input_stream(f"{folder}/{MARKS}/{mark}") as file:
                attempts = json.loads(file.read())
            for f in (f for a in attempts for f in fs.get_file_info(FileSelector(f"{folder}/{mark}/{a}"))):
                first, last, document, _ = f.base_name.split("_", 3)
                if not self.wanted.piece(int(first), int(last), document):
                    continue
                if out[-1].names and size + f.size > TASK_BYTES:
                    out.append(Pieces([]))
                    size = 0
                out[-1].names.append(f.path.removeprefix(f"{folder}/"))
                size += f.size
        return out

    def read(self, partition: Pieces) -> Iterator:
        import pyarrow as pa

        fs, folder = _opened(self.path)
        for name in partition.names:
            with fs.open_input_file(f"{folder}/{name}") as file:
                head, body = file.read().split(b"\n", 1)
            said = json.loads(head)
            if self.wanted.documents is not None and said["doc_id"] not in self.wanted.documents:
                continue
            pages = [(said["first"] + i, t) for i, t in enumerate(body.decode().split(BREAK)) if self.wanted.page(said["first"] + i)]
            columns = pa.array([said["doc_id"]] * len(pages), pa.string()), pa.array([p for p, _ in pages], pa.int32()), pa.array([t for _, t in pages], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "page", "text"])


@dataclass
class Written(ds.WriterCommitMessage):
    attempt: str


class PagedWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, piece_bytes: int):
        self.path, self.overwrite, self.piece_bytes, self.job = path, overwrite, piece_bytes, f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, folder = _opened(self.path)
        attempt = uuid.uuid4().hex
        fs.create_dir(f"{folder}/{self.job}/{attempt}", recursive=True)
        held: list[str] = []
        doc, first, size = None, 0, 0

        def whole() -> None:
            if held:
                last = first + len(held) - 1
                name = f"{first:010d}_{last:010d}_{_mark_of(doc)}_{uuid.uuid4().hex[:12]}.txt"
                with fs.open_output_stream(f"{folder}/{self.job}/{attempt}/{name}") as out:
                    out.write(json.dumps({"doc_id": doc, "first": first, "last": last}).encode() + b"\n" + BREAK.join(held).encode())

        for batch in iterator:
            for key, page, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "page", "text")), strict=True):
                if key is None or page is None or page < 0:
                    raise ValidationError(f"a page needs a document and a number, not {key!r} and {page!r}")
                text = text or ""
                if BREAK in text:
                    raise ValidationError(f"page {page} of {key} holds a form feed, which parts pages here")
                if key != doc or page != first + len(held) or size >= self.piece_bytes:
                    whole()
                    doc, first, size, held = key, page, 0, []
                held.append(text)
                size += len(text)
        whole()
        return Written(attempt)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        fs, folder = _opened(self.path)
        fs.create_dir(f"{folder}/{MARKS}", recursive=True)
        before = [f.base_name for f in fs.get_file_info(FileSelector(f"{folder}/{MARKS}"))] if self.overwrite else []
        with fs.open_output_stream(f"{folder}/{MARKS}/{self.job}") as out:
            out.write(json.dumps([m.attempt for m in messages if m is not None]).encode())
        for mark in before:
            fs.delete_file(f"{folder}/{MARKS}/{mark}")
            fs.delete_dir(f"{folder}/{mark}")

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, folder = _opened(self.path)
        if fs.get_file_info(f"{folder}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{folder}/{self.job}")


class PagedText(ds.DataSource):
    """Options: ``path``; reading: ``pages``, a specification such as "1-5,8"; writing: ``piece_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "paged_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"], self.options.get("pages"))

    def writer(self, schema: StructType, overwrite: bool) -> PagedWriter:
        return PagedWriter(self.options["path"], overwrite, int(self.options.get("piece_bytes", PIECE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark hand it filters."""
    spark.dataSource.register(PagedText)
    spark.conf.set(PUSHDOWN, "true")


def write(pages: DataFrame, path: str, mode: str = "append", piece_bytes: int = PIECE_BYTES) -> None:
    """Write (doc_id, page, text): pages of a document are dealt by ranges, so a large one is written by several tasks.

    A page without a document or number, and a text with a form feed, fail the write, and nothing of it stays; a null
    text is an empty page; rows that repeat a page are kept.
    """
    register(pages.sparkSession)
    rows = pages.selectExpr("cast(doc_id as string) as doc_id", "cast(page as int) as page", "text")
    rows.repartitionByRange("doc_id", "page").sortWithinPartitions("doc_id", "page").write.format("paged_text").mode(mode).option("piece_bytes", piece_bytes).save(path)


def read(spark: SparkSession, path: str, spec: str | None = None) -> DataFrame:
    """(doc_id, page, text); filters on page and doc_id, and the page specification, reach the listing of pieces."""
    register(spark)
    found = spark.read.format("paged_text")
    return (found if spec is None else found.option("pages", spec)).load(path)
