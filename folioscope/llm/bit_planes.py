"""Token ids in binary files of compressed planes.

The ids of all documents, in ascending order of the documents' ids, are one sequence, cut into files and those into blocks
of a fixed number of ids. A block is transposed: its planes hold the first (second, ...) bytes or bits of all its ids, so
that the nearly constant high ones lie together, and each plane is compressed with zstandard (planes of zeros are left
out). A file ends with its chunk index (place, ids and plane sizes of each block) and its documents (id, ids):

    b"FSPLANE1" | blocks of planes | chunk index | documents | footer: 3 x uint64 (length of each, planes' kind) | b"FSPLANE1"

``ids.json`` beside the files names those of the last commit with the ids before each, so what a failed or repeated task
leaves behind is never read. Both tables in a file are Arrow streams, so ids of documents may have any type.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC, INDEX = b"FSPLANE1", "ids.json"
KINDS = ("byte", "bit")
#: Ids in a block; a file ends with the document that reaches so many; a batch of rows read holds about so many.
BLOCK_IDS, FILE_IDS, BATCH_IDS = 65_536, 64_000_000, 1_000_000
END_ID = 2
#: Words whose ids a task remembers, twice (bytes: about 200 for each).
KNOWN_WORDS = 350_000

#: What the quick path takes a tokenizer file to say (fixed by the public vocabulary's format); any other is used as it is.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_tokenizer() -> str:
    """The public word-end BPE vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by a tokenizer file, without special tokens being added, as bytes of little-endian uint32.

    Where the file normalises and splits as the named vocabulary does, white space always parts tokens, so a text is
    encoded by its white-space chunks, and ids of chunks met before are looked up. A chunk of characters below U+0100 is
    split here and its parts given to the library's model, any other to the library as a whole, and so is a text that
    holds an added token's own string. With another file every text goes to the library whole.
    """

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.exact = Tokenizer.from_file(path)
        self.model = self.exact.model
        self.quick = said["normalizer"] == _NORMALIZER and said["pre_tokenizer"] == _PRE_TOKENIZER
        self.special = [x["content"].encode() for x in said.get("added_tokens", [])]
        letters, numbers = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.as_char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.points = {bytes([c]): self.whole(chr(c)) for c in b".,;:!?"}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, chunk: bytes) -> bytes:
        """The ids of a chunk without white space, remembered."""
        if (found := self.older.get(chunk)) is None:
            end = self.points.get(chunk[-1:])
            if end is not None and chunk[-2:-1].isalpha():  # a mark after a letter is a token of its own
                core = chunk[:-1]
                found = (self.known.get(core) or self.learn(core)) + end
            elif max(text := chunk.decode()) < "Ā":
                tokenize = self.model.tokenize
                if chunk.isalpha():
                    ids = [t.id for t in tokenize(text)]
                else:
                    parts = [text.lower()] if text.isalpha() else self.split(text.lower())
                    ids = [t.id for part in parts for t in tokenize(part.encode().decode("latin-1").translate(self.as_char))]
                found = array("I", ids).tobytes()
            else:
                found = self.whole(text)
        if len(self.known) >= KNOWN_WORDS:
            self.older, self.known = self.known, {}
        self.known[chunk] = found
        return found

    def ids(self, text: bytes) -> bytes:
        low = text.lower()  # of ASCII letters only, which may spell an added token that the text itself does not hold
        if not self.quick or any(x in text or x in low for x in self.special):
            return self.whole(text.decode())
        chunks = low.split()  # at ASCII white space
        found = list(map(self.known.get, chunks))
        if None in found:
            found = [self.known.get(c) or self.learn(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
        return b"".join(found)


_encoders: dict[str, WordEncoder] = {}


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the ids of each text and ``end_id``, little-endian uint32; a null text is empty. No shuffle."""
    kind, path = docs.schema[doc_id].dataType.simpleString(), tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if path not in _encoders:  # a worker that serves several tasks keeps what it has learnt
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        for batch in batches:
            first, size, rows = 0, 0, []
            for i, words in enumerate(batch.column(1)):
                buffer = words.as_buffer()
                rows.append(encoder.ids(buffer.to_pybytes() if buffer is not None else b"") + end)
                size += len(rows[-1])
                if size >= 4 * BATCH_IDS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(rows, pa.binary())], ["doc_id", "ids"])
                    first, size, rows = i + 1, 0, []

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, ids binary")


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in ascending order over partitions and within them, null ids first.

    Rows of one id are dealt by their text and place, so that an id that many rows share is split among partitions.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    return rows.repartitionByRange("doc_id", "h", "nth").sortWithinPartitions("doc_id", "h", "nth").select("doc_id", "text")


def _opened(path: str):
    """The file system of a folder (Arrow's: local, HDFS, S3, GCS) and the folder's name there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block up to the last that is not all zero, low ones first."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-bits // 8)]]
    return [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(bits)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
        return out.view("<u4").ravel()
    ids = out.view("<u4").ravel()
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


def _stream(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


class _File:
    """One file being written: holds a block's ids and the index of its blocks and documents."""

    def __init__(self, fs, folder: str, name: str, kind: str, block: int, level: int):
        import zstandard

        self.name, self.kind, self.block, self.out = name, kind, block, fs.open_output_stream(f"{folder}/{name}")
        self.out.write(MAGIC)
        self.zstd, self.pending = zstandard.ZstdCompressor(level=level), bytearray()
        self.at, self.ids, self.docs, self.blocks = len(MAGIC), 0, [], ([], [], [])

    def add(self, ids: bytes) -> None:
        self.pending += ids
        self.ids += len(ids) // 4
        while len(self.pending) >= 4 * self.block:
            self.flush()

    def flush(self) -> None:
        part = np.frombuffer(bytes(self.pending[: 4 * self.block]), "<u4")
        del self.pending[: 4 * self.block]
        planes = [self.zstd.compress(p) for p in to_planes(part, self.kind)]
        for column, x in zip(self.blocks, (self.at, len(part), [len(p) for p in planes]), strict=True):
            column.append(x)
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def end(self) -> tuple[str, int, int, int]:
        """Write the indexes; (name, documents, ids, bytes)."""
        import pyarrow as pa

        if self.pending:
            self.flush()
        columns = [pa.array(c, t) for c, t in zip(self.blocks, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)]
        chunks = _stream(pa.table(columns, ["at", "n", "planes"]))
        docs = pa.Table.from_batches(self.docs)
        said = _stream(docs)
        self.out.write(chunks + said + struct.pack("<3Q", len(chunks), len(said), KINDS.index(self.kind)) + MAGIC)
        self.out.close()
        return self.name, docs.num_rows, self.ids, self.at + len(chunks) + len(said) + 24 + len(MAGIC)


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list


class PlaneWriter(DataSourceArrowWriter):
    def __init__(self, path: str, doc_type: str, overwrite: bool, kind: str, block: int, file_ids: int, level: int):
        if kind not in KINDS:
            raise ValueError(f"planes are {KINDS}, not {kind!r}")
        self.path, self.doc_type, self.kind, self.block, self.file_ids, self.level = path, doc_type, kind, block, file_ids, level
        fs, folder = _opened(path)
        from pyarrow.fs import FileType

        if not overwrite and fs.get_file_info(f"{folder}/{INDEX}").type != FileType.NotFound:
            raise ValueError(f"ids have been written to {path} already")
        fs.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, folder = _opened(self.path)
        part, files, file = TaskContext.get().partitionId(), [], None
        for batch in iterator:
            keys, first = batch.column("doc_id"), 0
            sizes: list[int] = []
            for i, ids in enumerate(batch.column("ids")):
                if file is None:
                    file = _File(fs, folder, f"part-{part:06d}-{len(files):05d}-{uuid.uuid4().hex}.planes", self.kind, self.block, self.level)
                data = ids.as_buffer().to_pybytes()
                file.add(data)
                sizes.append(len(data) // 4)
                full = file.ids >= self.file_ids
                if full or i + 1 == batch.num_rows:
                    file.docs.append(pa.RecordBatch.from_arrays([keys.slice(first, len(sizes)), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"]))
                    first, sizes = i + 1, []
                if full:
                    files.append(file.end())
                    file = None
        if file is not None:
            files.append(file.end())
        return Written(part, files)

    def commit(self, messages: list) -> None:
        """Name the files with the ids before each: one entry a file, made last, so readers see all of it or nothing."""
        fs, folder = _opened(self.path)
        files, start = [], 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for name, docs, ids, size in message.files:
                files.append({"name": name, "start": start, "docs": docs, "ids": ids, "bytes": size})
                start += ids
        with fs.open_output_stream(f"{folder}/{INDEX}.new") as out:
            out.write(json.dumps({"doc_id": self.doc_type, "ids": start, "files": files}).encode())
        fs.move(f"{folder}/{INDEX}.new", f"{folder}/{INDEX}")

    def abort(self, messages: list) -> None:
        fs, folder = _opened(self.path)
        for message in messages:
            for name, *_ in message.files if message is not None else []:
                fs.delete_file(f"{folder}/{name}")


def index_of(path: str) -> dict:
    """What ``ids.json`` says: doc_id (type), ids (in all), files (name, start, docs, ids, bytes) in order."""
    fs, folder = _opened(path)
    with fs.open_input_stream(f"{folder}/{INDEX}") as file:
        return json.loads(file.read())


class PlaneFile:
    """A file opened for reading: its documents and chunk index, and any span of its ids."""

    def __init__(self, fs, name: str):
        import pyarrow as pa
        import zstandard

        self.file, self.zstd = fs.open_input_file(name), zstandard.ZstdDecompressor()
        size, tail = self.file.size(), 24 + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[24:] != MAGIC:
            raise ValueError(f"{name} is no whole file of planes")
        chunks, docs, kind = struct.unpack("<3Q", end[:24])
        read = lambda n, at: pa.ipc.open_stream(self.file.read_at(n, at)).read_all()
        blocks = read(chunks, size - tail - docs - chunks)
        self.docs, self.kind = read(docs, size - tail - docs), KINDS[kind]
        self.at, self.n, self.planes = blocks["at"].to_numpy(), blocks["n"].to_numpy(), blocks["planes"]
        self.ends = np.cumsum(self.n)

    def block(self, i: int) -> np.ndarray:
        n, sizes, planes = int(self.n[i]), self.planes[i].as_py(), []
        data, at = self.file.read_at(sum(sizes), int(self.at[i])), 0
        for size in sizes:
            planes.append(self.zstd.decompress(data[at : at + size], max_output_size=n))
            at += size
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the one that ``start`` ids of this file precede; reads only the blocks that hold them."""
        if count <= 0:
            return np.zeros(0, "<u4")
        first, last = (int(np.searchsorted(self.ends, x, "right")) for x in (start, start + count - 1))
        skipped = start - int(self.ends[first] - self.n[first])
        return np.concatenate([self.block(i) for i in range(first, last + 1)])[skipped : skipped + count]


@dataclass
class Part(InputPartition):
    name: str
    start: int


class PlaneReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(f["name"], f["start"]) for f in index_of(self.path)["files"]] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa

        if not partition.name:
            return
        fs, folder = _opened(self.path)
        file = PlaneFile(fs, f"{folder}/{partition.name}")
        keys, sizes = file.docs["doc_id"].combine_chunks(), file.docs["n_tokens"].to_numpy()
        ends = np.cumsum(sizes)
        held, block, first = np.zeros(0, "<u4"), 0, 0
        while first < len(sizes):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + BATCH_IDS, "right")))
            need, parts, have = int(ends[last - 1]) - before, [held], len(held)
            while have < need:  # blocks are read once, in order
                parts.append(file.block(block))
                block, have = block + 1, have + len(parts[-1])
            all_ids = np.concatenate(parts)
            data, held = all_ids[:need].tobytes(), all_ids[need:]
            cuts = 4 * np.concatenate([[0], ends[first:last] - before])
            ids = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            starts = partition.start + ends[first:last] - sizes[first:last]
            yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.array(starts, pa.int64()), pa.array(sizes[first:last], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
            first = last


class Planes(DataSource):
    """``format("token_planes")``: writes (doc_id, ids) rows in their partitions' order, reads (doc_id, start, n_tokens, ids)."""

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        return f"doc_id {index_of(self.options['path'])['doc_id']}, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> PlaneReader:
        return PlaneReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PlaneWriter:
        o = self.options
        return PlaneWriter(o["path"], schema["doc_id"].dataType.simpleString(), overwrite, o.get("planes", "byte"), int(o.get("block", BLOCK_IDS)), int(o.get("file_ids", FILE_IDS)), int(o.get("level", 3)))


def write_documents(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    planes: str = "byte",
    block: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
) -> None:
    """Write the ids of all documents, in ascending order of their ids, to the folder ``path``, which tasks must reach.

    A null or empty text is the end id alone; null ids come first; rows of one id follow each other in no stated order;
    a text of any length lies in one file; an empty table gives an index without files; other columns are not read.
    ``path`` must hold no ids yet.
    """
    spark = docs.sparkSession
    spark.dataSource.register(Planes)
    rows = encoded(in_order(docs, doc_id, text), "doc_id", "text", tokenizer, end_id)
    rows.write.format("token_planes").mode("append").options(planes=planes, block=block, file_ids=file_ids).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: ``start`` ids of all documents come before; one task a file."""
    spark.dataSource.register(Planes)
    return spark.read.format("token_planes").load(path)


def read_span(path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of the whole sequence on (fewer at its end), of only the blocks that hold them."""
    fs, folder = _opened(path)
    out, end = [], start + count
    for f in index_of(path)["files"]:
        a, b = max(start, f["start"]), min(end, f["start"] + f["ids"])
        if a < b:
            out.append(PlaneFile(fs, f"{folder}/{f['name']}").ids(a - f["start"], b - a))
    return np.concatenate(out) if out else np.zeros(0, "<u4")
