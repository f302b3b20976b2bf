"""Packing by shortest-pack-first over the length histogram.

Documents become token ids, are cut into pieces of at most ``capacity`` ids, and only the histogram of piece lengths
(at most ``capacity`` entries, whatever the corpus) reaches the driver. There lengths are placed longest first, each
into the shortest pack that still has room for it, which yields packing patterns with counts. The patterns are joined
back to the pieces by the rank a piece has among those of its length.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import small, table

CAPACITY = 2048
END_ID = 1
#: UTF-8 bytes of characters below U+0280, which both libraries class alike; texts with others go to the slower library.
PLAIN_BYTES = bytes(range(0xCA))
#: Ranks of a (length, task) pair are broadcast up to so many pairs (24 bytes each), else joined by a shuffle.
BROADCAST_PAIRS = 500_000


def default_tokenizer() -> str:
    """The public byte-level BPE vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _as_ranks(said: dict) -> bool:
    """Whether a tokenizer file says nothing but byte-level pairs merged in the order of the vocabulary."""
    model, split = said["model"], said.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and said.get("normalizer") is None
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(x) for x in odd):
        return False
    made = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
    return all(model["vocab"].get(token) == 256 + i for i, token in enumerate(made))


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file, without special tokens being added.

    Where the file splits as the named one does and its vocabulary is also its merge ranks, texts of plain characters are
    encoded by the faster of the two libraries. Other texts, those that hold an added token's own string, and every text
    with any other file are encoded by the library the file belongs to.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.exact = Tokenizer.from_file(path)
        self.special = [x["content"] for x in said.get("added_tokens", [])]
        self.fast = None
        if not _as_ranks(said):
            return
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or text.encode().translate(None, PLAIN_BYTES) or any(x in text for x in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, copies), ...], count): ``count`` packs hold these pieces in this order."""
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    full: list[tuple[list[tuple[int, int]], int]] = []

    def put(room: int, count: int, runs: list[tuple[int, int]]) -> None:
        if room:
            rooms[room].append((count, runs))
        else:
            full.append((runs, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            fitting = sorted((r for r in rooms if r >= length), reverse=True)
            if not fitting:
                copies = capacity // length if left >= capacity // length else left
                packs = left // copies
                put(capacity - copies * length, packs, [(length, copies)])
                left -= packs * copies
                continue
            room = fitting[0]
            count, runs = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            copies = max(1, (room - (fitting[1] if len(fitting) > 1 else 0)) // length) if room not in rooms else 1
            copies = min(copies, room // length, left)
            packs = min(count, left // copies)
            if count > packs:
                put(room, count - packs, runs)
            more = [*runs[:-1], (length, runs[-1][1] + copies)] if runs[-1][0] == length else [*runs, (length, copies)]
            put(room - copies * length, packs, more)
            left -= packs * copies
    for waiting in rooms.values():
        full += [(runs, count) for count, runs in waiting]
    return full


def plan(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a pack, first sequence, offset of the first copy)."""
    rows, used, sequence = [], defaultdict(int), 0
    for runs, count in patterns:
        offset = 0
        for length, copies in runs:
            first = used[length]
            used[length] = first + copies * count
            rows.append((length, first, used[length], copies, sequence, offset))
            offset += copies * length
        sequence += count
    return rows


def tokenise(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, part, nth); ``nth`` counts a task's pieces of one length."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, seen = Encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            keys, rows = [], []
            for row, words in enumerate(batch.column(1)):
                ids = array("I", encoder.ids(words.as_py() or ""))
                ids.append(end_id)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    n = len(piece)
                    keys.append(row)
                    rows.append((start, n, len(ids), piece.tobytes(), part, seen[n]))
                    seen[n] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], ["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"])

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, part int, nth long"
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start (ids of its document before it), length, doc_tokens (with ``end_id``), ids
    (binary, little-endian unsigned 32-bit), sequence_id and offset. A null or empty text is the end id alone; a long
    text is cut into full pieces and a rest; repeated rows and ids are packed each for itself; an empty table gives no
    rows; other columns are not read.
    """
    pieces = table(tokenise(docs, doc_id, text, tokenizer or default_tokenizer(), end_id, capacity), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("pairs")).collect()
    rows = plan(shortest_pack_first({r["length"]: r["n"] for r in histogram}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slots = docs.sparkSession.createDataFrame(rows, "of long, first long, end long, copies long, sequence long, at long")
    rank = F.col("before") + F.col("nth")
    return (
        pieces.join(small(ranks, sum(r["pairs"] for r in histogram), BROADCAST_PAIRS), ["length", "part"])
        .join(F.broadcast(slots), (F.col("of") == F.col("length")) & (rank >= F.col("first")) & (rank < F.col("end")))
        .withColumn("i", rank - F.col("first"))
        .select(
            "doc_id",
            "start",
            "length",
            "doc_tokens",
            "ids",
            (F.col("sequence") + F.expr("i div copies")).alias("sequence_id"),
            (F.col("at") + F.expr("i % copies") * F.col("length")).alias("offset"),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary) and the pieces in order; at most ``capacity`` ids a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("p"))
        .select(
            "sequence_id",
            F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"),
            F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("pieces"),
        )
    )
