"""A stored inverted index and top-k search that skips blocks.

``build`` writes three tables: ``blocks``, the postings of a term in blocks of at most 128 documents, partitioned by a
bucket of the term's hash and sorted by term; ``lexicon``, one row a term; ``units``, the documents (or pages) with their
numbers and lengths. A block holds its documents as distances from its first one, in Parquet's delta encoding, with how
often the term occurs there and how long they are, the lanes (2**4 consecutive documents) they lie in, and the largest
share of a BM25 score that any of a lane can have, so a search can tell from the small columns which documents it need not
score, and which blocks it need not read.

Texts are shuffled once, by document, and a task numbers and inverts its own documents; what is shuffled by term is blocks
and not postings. Blocks are of one term and segment (2**14 consecutive documents of a task), so a term that every document
holds is many groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.keywords import WORD
from folioscope.sources.stored import drop, kept

BLOCK = 128
#: Documents of a segment and of a lane, the range that bounds are summed for, as powers of two.
SEGMENT_BITS, LANE_BITS = 14, 4
#: Words that a task inverts and that a bucket is made for, about; half as many where cores would be idle.
TASK_WORDS = 1 << 22
#: Postings that are gathered before blocks are cut.
GATHERED = 1 << 22
#: Bytes of blocks that are packed together.
PACKED = 1 << 26
#: Lanes of the highest bounds that give a query its first threshold, at least.
SEEDS = 32
#: A lane's largest share is kept as so many steps up to the most a share can be.
STEPS = 255
#: Query terms and numbers of documents that are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 100_000
K1, B = 1.2, 0.75
LEXICON = "term string, df long, cf long, blocks long, bucket int"
BLOCKS = "term string, segment long, block int, first long, n int, lanes array<long>, tops array<int>, docs array<int>, tfs array<int>, lengths array<int>, bucket int"
#: What sums of a score's shares may differ by, whatever the order of summing.
SLACK = 1e-9


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def term_bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def terms_of(text: Column | str) -> Column:
    """The words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))


def build(pages: DataFrame, path: str, units: Sequence[str] = ("doc_id",), buckets: int | None = None, k1: float = K1, b: float = B) -> None:
    """Index ``pages`` (``units`` and text) into the folder ``path``; a document is all rows with equal ``units``.

    Documents without a word count for the number of documents and their mean length only. A null unit is a document
    of its own kind, as in a group-by.
    """
    units = list(units)
    spark = pages.sparkSession
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD + "+"))
    lengths = kept(pages.select(*units, words.alias("w")).groupBy(*units).agg(F.sum("w").cast("int").alias("length")), "lengths")
    whole = lengths.agg(F.count("*").alias("docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    docs, mean, words = whole["docs"], whole["mean"] or 1.0, whole["words"]
    tasks = max(1, -(-words // TASK_WORDS), min(spark.sparkContext.defaultParallelism, -(-2 * words // TASK_WORDS)))
    # documents of one length lie together, so the bounds of blocks and lanes are close to what their documents reach
    key = F.xxhash64(*units)
    ordered = lengths.repartition(tasks, key).sortWithinPartitions(F.desc("length"))
    ordered.select(F.monotonically_increasing_id().alias("nr"), *units, "length").write.parquet(f"{path}/units")
    drop(lengths)
    numbered = spark.read.parquet(f"{path}/units")

    # a task gets the texts of the documents that were numbered together; a document's number comes before its texts
    unit = F.struct(*units).alias("unit")
    numbers = numbered.select(key.alias("key"), unit, "nr", "length", F.lit(None).cast("string").alias("text"))
    texts = pages.select(key.alias("key"), unit, F.lit(None).cast("long").alias("nr"), F.lit(None).cast("int").alias("length"), "text")
    said = Window.partitionBy("key", "unit").orderBy(F.col("nr").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = numbers.unionByName(texts).repartition(tasks, "key").withColumns({c: F.first(c, ignorenulls=True).over(said) for c in ("nr", "length")})
    blocks = _inverted(dealt.where("text is not null").select("nr", "length", terms_of("text").alias("terms")), mean, k1, b)
    buckets = buckets or max(4, tasks)

    def write(df: DataFrame, name: str, *order: str) -> None:
        written = df.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").option("compression", "zstd").option("parquet.writer.version", "v2")
        written.option("parquet.enable.dictionary#docs.list.element", "false").parquet(f"{path}/{name}")

    # evened out and not by bucket alone: the blocks of a frequent term are written by several tasks
    bucket = term_bucket("term", buckets)
    write(_unpacked(_packed(blocks.withColumn("bucket", bucket)).hint("rebalance", "bucket")), "blocks", "term", "segment", "block")
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    lexicon = stored.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("cf"), F.count("*").alias("blocks"))
    write(lexicon.withColumn("bucket", bucket).hint("rebalance", "bucket"), "lexicon", "term")
    spark.createDataFrame([(docs, float(mean), buckets, k1, b, units)], "docs long, mean double, buckets int, k1 double, b double, units array<string>").coalesce(1).write.parquet(f"{path}/about")


def _cutter(mean: float, k1: float, b: float) -> Callable[..., Iterator]:
    def cut(term, nr: np.ndarray, tf: np.ndarray, length: np.ndarray, fresh: np.ndarray) -> Iterator:
        """Blocks of whole runs of (term, segment); ``fresh``: whether a posting begins a run."""
        import pyarrow as pa

        starts = np.flatnonzero(fresh)
        place = np.arange(len(nr)) - starts[np.cumsum(fresh) - 1]
        begin = np.flatnonzero(place % BLOCK == 0)
        ends = np.append(begin, len(nr)).astype(np.int32)
        of = np.repeat(np.arange(len(begin)), np.diff(ends))
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        lane = nr >> LANE_BITS
        lanes = np.flatnonzero(np.concatenate([[True], (lane[1:] != lane[:-1]) | (of[1:] != of[:-1])]))
        tops = np.ceil(np.maximum.reduceat(share, lanes) * (STEPS / (k1 + 1))).astype(np.int32)
        of_lanes = np.searchsorted(lanes, ends).astype(np.int32)

        def lists(at: np.ndarray, values: np.ndarray, kind) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))

        yield pa.RecordBatch.from_arrays(
            [
                term.take(pa.array(begin)),
                pa.array(nr[begin] >> SEGMENT_BITS),
                pa.array(place[begin] // BLOCK, pa.int32()),
                pa.array(nr[begin]),
                pa.array(np.diff(ends), pa.int32()),
                lists(of_lanes, lane[lanes], pa.int64()),
                lists(of_lanes, tops, pa.int32()),
                lists(ends, nr - nr[begin][of], pa.int32()),
                lists(ends, tf, pa.int32()),
                lists(ends, length, pa.int32()),
            ],
            ["term", "segment", "block", "first", "n", "lanes", "tops", "docs", "tfs", "lengths"],
        )

    return cut


def _inverted(said: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    """The blocks of texts (nr, length, terms), a document's rows being neighbours in one task.

    Postings are gathered in a task and cut into blocks when there are many, all but the last document's, of which more may
    come. So a term and segment may be cut more than once; a block's number is its first document's place in the segment.
    """
    cut = _cutter(mean, k1, b)

    def merged(parts: list) -> tuple:
        """(terms in order, term, nr, tf, length) of the postings of ``parts``, sorted by term and nr, each once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[coded.indices.to_numpy()]
        begin = np.cumsum([0] + [len(p[0]) for p in parts])
        term = np.concatenate([rank[begin[i] + p[1]] for i, p in enumerate(parts)])
        nr, tf, length = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        known, doc = np.unique(nr, return_inverse=True)
        place = term * len(known) + doc
        by = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.diff(place[by], prepend=-1))
        first = by[starts]
        return coded.dictionary.take(pa.array(order)), term[first], nr[first], np.add.reduceat(tf[by], starts), length[first]

    def blocks(terms, term: np.ndarray, nr: np.ndarray, tf: np.ndarray, length: np.ndarray) -> Iterator:
        import pyarrow as pa

        if not len(term):
            return
        fresh = (np.diff(term, prepend=-1) != 0) | (np.diff(nr >> SEGMENT_BITS, prepend=-1) != 0)
        for batch in cut(terms.take(pa.array(term)), nr, tf, length, fresh):
            place = batch.column("first").to_numpy() & ((1 << SEGMENT_BITS) - 1)
            batch = batch.set_column(batch.schema.get_field_index("block"), "block", pa.array(place.astype(np.int32)))
            yield from (batch.slice(i, 10_000) for i in range(0, len(batch), 10_000))

    def run(batches: Iterator) -> Iterator:
        parts, gathered, rest = [], 0, 0
        for batch in batches:
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy().astype(np.int64)
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            nr = batch.column("nr").to_numpy()
            doc = np.cumsum(np.diff(nr, prepend=nr[0]) != 0)
            met, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(nr) + doc[row], return_counts=True)
            at = np.searchsorted(doc, met % len(nr))
            parts.append((words.dictionary, met // len(nr), nr[at], tf, batch.column("length").to_numpy()[at].astype(np.int64)))
            gathered += len(met)
            if gathered < max(GATHERED, 2 * rest):
                continue
            terms, *postings = merged(parts)
            last = postings[1] == nr[-1]
            yield from blocks(terms, *(x[~last] for x in postings))
            parts = [(terms, *(x[last] for x in postings))]
            gathered = rest = int(last.sum())
        if parts:
            yield from blocks(*merged(parts))

    return said.mapInArrow(run, ", ".join(BLOCKS.split(", ")[:-1]))


def _packed(blocks: DataFrame) -> DataFrame:
    """(bucket, packed): the blocks of a task by bucket, compressed together; as rows they took 2.4 times the disk at 0.1 GB."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def pack(some: list) -> Iterator:
            rows = pa.Table.from_batches(some)
            rows = rows.take(pc.sort_indices(rows.column("bucket"))).combine_chunks()
            of = rows.column("bucket").to_numpy()
            ends = [*np.flatnonzero(np.diff(of)) + 1, len(of)]
            for start, end in zip([0, *ends], ends):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.slice(start, end - start))
                yield pa.RecordBatch.from_arrays([pa.array(of[start : start + 1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "packed"])

        some, size = [], 0
        for batch in batches:
            if len(batch):
                some.append(batch)
                size += batch.nbytes
            if size >= PACKED:
                yield from pack(some)
                some, size = [], 0
        if some:
            yield from pack(some)

    return blocks.mapInArrow(run, "bucket int, packed binary")


def _unpacked(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for one in batch.column("packed"):
                yield from (b.slice(i, 10_000) for b in pa.ipc.open_stream(one.as_buffer()) for i in range(0, len(b), 10_000))

    return packed.mapInArrow(run, BLOCKS)


def _blocks(found: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    """The blocks of postings (term, nr, tf, length) wherever they are: sorted by term and number, they are cut batch by batch, a block
    being at most BLOCK neighbours of one term and segment."""
    segment = F.shiftright("nr", SEGMENT_BITS)
    placed = found.withColumn("segment", segment).repartition("term", "segment").sortWithinPartitions("term", "segment", "nr")
    cut = _cutter(mean, k1, b)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        rest = None
        for batch in batches:
            # what a batch's last run lacks may come with the next one
            rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            rest, ready = split(rows, pc)
            if ready is not None:
                yield from cut(*ready)
        if rest is not None:
            yield from cut(*columns(rest, pc))

    def columns(rows, pc) -> tuple:
        term = rows.column("term")
        term = term.combine_chunks() if hasattr(term, "combine_chunks") else term
        nr, tf, length = (rows.column(c).to_numpy() if hasattr(rows.column(c), "chunks") else rows.column(c).to_numpy(zero_copy_only=False) for c in ("nr", "tf", "length"))
        other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[True], other | (nr[1:] >> SEGMENT_BITS != nr[:-1] >> SEGMENT_BITS)])
        return term, nr, tf.astype(np.int64), length.astype(np.int64), fresh

    def split(rows, pc) -> tuple:
        fresh = columns(rows, pc)[-1]
        last = int(np.flatnonzero(fresh)[-1])
        rest = rows.slice(last).combine_chunks().to_batches()[0]
        return rest, columns(rows.slice(0, last), pc) if last else None

    return placed.select("term", "nr", "tf", "length").mapInArrow(run, ", ".join(BLOCKS.split(", ")[:-1]))


class Index:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.about = spark.read.parquet(f"{path}/about").first()
        self.units = spark.read.parquet(f"{path}/units")
        self.lexicon = spark.read.schema(LEXICON).parquet(f"{path}/lexicon")
        self.blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def of_terms(self, table: DataFrame, terms: Sequence[str]) -> DataFrame:
        """The rows of ``table`` (blocks or lexicon) for these terms: a filter on buckets and terms that reaches the scan."""
        terms = sorted(set(terms))
        said = self.spark.createDataFrame([(t,) for t in terms], "term string").select(term_bucket("term", self.about["buckets"]).alias("x"))
        return table.where(F.col("bucket").isin(sorted({r["x"] for r in said.collect()})) & F.col("term").isin(terms))

    def postings(self, blocks: DataFrame | None = None) -> DataFrame:
        """(term, units ..., n): what ``blocks`` (all of them by default) hold, decoded."""
        rows = decoded(self.blocks if blocks is None else blocks, "term")
        return rows.join(self.units, "nr").select("term", *self.about["units"], F.col("tf").cast("long").alias("n"))

    def lookup(self, terms: Sequence[str]) -> DataFrame:
        """(term, units ..., n) of the given terms, compared in lower case; only their buckets are read."""
        return self.postings(self.of_terms(self.blocks, [t.lower() for t in terms]))

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(float(self.about["docs"])) - df + 0.5) / (df + 0.5))

    def top(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query, rank, units ..., score): the k best documents of each query of ``queries`` (query, term), by BM25.

        Scores are compared to nine digits, ties by the units in order. Queries and terms that are null, and terms no
        document holds, count for nothing; a repeated term counts once.
        """
        return Search(self, queries, k).top()


def decoded(blocks: DataFrame, *keep: str) -> DataFrame:
    """(keep ..., nr, tf, length) of each posting."""
    zipped = F.arrays_zip(F.transform("docs", lambda x: F.col("first") + x).alias("nr"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))
    return blocks.select(*keep, F.inline(zipped).alias("nr", "tf", "length"))


class Search:
    """Block-max search of several queries at once.

    From the blocks' small columns each query gets a bound for every lane: the sum over its terms of the largest share
    that a document of the lane has. The lanes of the highest bounds are scored in full,
    and the k-th best score there is a threshold; lanes whose bound lies below it hold no result and their blocks are
    not read. The others are scored in full. Every step is a join or a grouping by (query, lane).
    """

    def __init__(self, index: Index, queries: DataFrame, k: int):
        self.index, self.k = index, k
        wanted = queries.select("query", F.lower("term").alias("term")).where("query is not null and term is not null").distinct()
        wanted = wanted.withColumn("bucket", term_bucket("term", index.about["buckets"]))
        asked = wanted.count()
        self.read_from = sorted(r["bucket"] for r in wanted.select("bucket").distinct().collect())  # at most all buckets
        weighed = self._bucketed(index.lexicon).select("bucket", "term", "df").join(_near(wanted, asked), ["bucket", "term"])
        self.weights = kept(weighed.select("query", "bucket", "term", index.idf(F.col("df")).alias("idf")), "weights")
        self.asked = asked
        heads = self._bucketed(index.blocks).select("bucket", "term", "segment", "block", "lanes", "tops").join(_near(self.weights, asked), ["bucket", "term"])
        heads = heads.select("query", "bucket", "term", "segment", "block", "idf", F.inline(F.arrays_zip("lanes", "tops")).alias("lane", "steps"))
        bound = F.col("idf") * F.col("steps") * ((index.about["k1"] + 1) / STEPS)
        heads = heads.select("query", "bucket", "term", "segment", "block", "lane", bound.alias("bound"))
        self.heads = kept(heads, "heads")
        by_term = self.heads.groupBy("query", "lane", "term").agg(F.max("bound").alias("bound"))
        self.bounds = kept(by_term.groupBy("query", "lane").agg(F.sum("bound").alias("bound")), "bounds")

    def _bucketed(self, table: DataFrame) -> DataFrame:
        """Only the partitions of the queries' terms."""
        return table.where(F.col("bucket").isin(self.read_from)) if self.read_from else table.limit(0)

    def scores(self, lanes: DataFrame) -> DataFrame:
        """(query, nr, score) of every document in the given (query, lane) that holds a term of the query."""
        keys = ["bucket", "term", "segment", "block"]
        wanted = self.heads.join(lanes.select("query", "lane"), ["query", "lane"], "left_semi").select("query", *keys).distinct()
        blocks = self._bucketed(self.index.blocks).join(wanted, keys)
        rows = decoded(blocks, "query", "bucket", "term").withColumn("lane", F.shiftright("nr", LANE_BITS))
        rows = rows.join(lanes.select("query", "lane"), ["query", "lane"], "left_semi").join(_near(self.weights, self.asked), ["query", "bucket", "term"])
        about = self.index.about
        share = F.col("tf") * (about["k1"] + 1) / (F.col("tf") + about["k1"] * (1 - about["b"] + about["b"] * F.col("length") / F.lit(about["mean"] or 1.0)))
        return rows.groupBy("query", "nr").agg(F.round(F.sum(F.col("idf") * share), 9).alias("score"))

    def best(self, scored: DataFrame) -> DataFrame:
        """(query, least): the k-th best score of each query that has k documents."""
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        return scored.select("query", "score", place.alias("place")).where(F.col("place") <= self.k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == self.k).select("query", "least")

    def lanes_left(self) -> DataFrame:
        """(query, lane) that the threshold of the seeds leaves, all lanes of a query with fewer than k scored documents."""
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "lane"))
        seeds = self.bounds.select("query", "lane", place.alias("place")).where(F.col("place") <= max(SEEDS, self.k // 4))
        threshold = self.best(self.scores(seeds))
        left = self.bounds.join(threshold, "query", "left")
        return left.where(F.col("bound") >= F.coalesce(F.col("least"), F.lit(0.0)) - SLACK).select("query", "lane")

    def top(self) -> DataFrame:
        self.left = kept(self.lanes_left(), "lanes")
        scored = kept(self.scores(self.left), "scores")
        # all documents that tie with the k-th get their units before the tie is broken
        found = scored.join(self.best(scored), "query", "left").where(F.col("score") >= F.coalesce(F.col("least"), F.lit(0.0)))
        units = self.index.about["units"]
        named = self.index.units.join(_near(found, found.count()), "nr").select("query", *units, "score")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *units))
        return named.select("query", place.alias("rank"), *units, "score").where(F.col("rank") <= self.k)

    def work_done(self) -> DataFrame:
        """(query, blocks, read, lanes, scored): blocks and lanes that have a query's terms, and how many of them the second
        phase reads and scores; after ``top``."""
        each = self.heads.join(self.left.withColumn("left", F.lit(1)), ["query", "lane"], "left")
        blocks = each.groupBy("query", "term", "segment", "block").agg(F.max("left").alias("left"))
        blocks = blocks.groupBy("query").agg(F.count("*").alias("blocks"), F.count("left").alias("read"))
        lanes = each.groupBy("query", "lane").agg(F.max("left").alias("left"))
        return blocks.join(lanes.groupBy("query").agg(F.count("*").alias("lanes"), F.count("left").alias("scored")), "query")
