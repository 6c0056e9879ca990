"""A stored lexical index: postings in blocks with each block's largest count, searched with early termination.

Chunks are dealt out as texts and numbered within a shard in order of chunk_id.  For each shard and lexeme there is
one row: the ranges of ``RANGE`` chunks that hold it (as gaps), the largest count in each, how many chunks
each has, and one byte of place (the gap to the range's start) and a count of ``width`` bytes for each
posting, and their sum.  For each lexeme a second table has its document frequency, its largest count and its ``DEPTH``-th
largest block maximum: that many chunks reach it, so it bounds the score that a query's last result has.

A search adds up the block maxima of a query's lexemes for each range of a shard.  Ranges are opened in the
order of that bound until it falls below the score of the last result; of the others no posting is decoded.
Results are exact, ties by chunk_id as everywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import lexemes
from ..intermediate import shared_dir
from .retrieval import DEPTH, MOST_TERMS_SENT, top

RANGE = 256
SHARD_CHUNKS = 16_384
SHARD_POSTINGS = 2_000_000
MOST_OPENED_AT_ONCE = 16
DENSE = 16


@dataclass(frozen=True)
class LexicalIndex:
    """postings: (shard, lexeme, gaps, largest, sizes, places, width, counts, nentry) and, with a null lexeme, a shard's chunk_ids;
    vocabulary: (lexeme, ndoc, nentry, most, reached)."""

    postings: DataFrame
    vocabulary: DataFrame

    @property
    def frequency(self) -> DataFrame:
        return self.vocabulary.select("lexeme", "ndoc", "nentry")


def _postings_schema(kind: str) -> str:
    return f"shard long, lexeme string, gaps array<int>, largest array<int>, sizes array<int>, places binary, width int, counts binary, nentry long, chunk_ids array<{kind}>"


def _members(code: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    chosen = np.zeros(n, bool)
    chosen[some] = True
    a, b = np.searchsorted(code, [some[0], some[-1] + 1])  # code is sorted
    return np.flatnonzero(chosen[code[a:b]]) + a


class _Shard:
    """The postings of some chunks, until they are written out."""

    def __init__(self, number: int, kind: pa.DataType):
        self.number, self.kind = number, kind
        self.ids: list = []
        self.lexemes: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: pa.Array, words: pa.ListArray) -> None:
        flat = words.flatten().dictionary_encode()
        codes = np.array([self.lexemes.setdefault(w, len(self.lexemes)) for w in flat.dictionary.to_pylist()], np.int64)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(ids), dtype=np.int64) + len(self.ids), lengths)
        if len(chunk):
            pairs, counts = np.unique(codes[flat.indices.to_numpy(zero_copy_only=False)] << 32 | chunk, return_counts=True)
            self.parts.append((pairs >> 32, pairs & 0xFFFFFFFF, counts))
            self.size += len(pairs)
        self.ids += ids.to_pylist()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Chunks are numbered in order of their ids, however they came."""
        nothing = pa.nulls(1)
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is not None, self.ids[k]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = pa.array([[self.ids[k] for k in order]], pa.list_(self.kind))
        yield self._batch([nothing.cast(k) for k in self.KINDS], ids)
        if not self.parts:
            return
        code, chunk, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        chunk = place[chunk]
        words = np.array(sorted(self.lexemes), object)
        rank = np.empty(len(words), np.int64)
        rank[[self.lexemes[w] for w in words]] = np.arange(len(words))
        code = rank[code]
        order = np.lexsort((chunk, code))
        code, chunk, count = code[order], chunk[order], count[order]
        most = np.maximum.reduceat(count, np.searchsorted(code, np.arange(len(words))))
        widths = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
        for width in np.unique(widths).tolist():  # nearly all lexemes have the least one
            mine = np.flatnonzero(widths == width)
            for some in np.array_split(mine, -(-len(mine) // 4096)):
                of = _members(code, some, len(words))
                yield self._postings(words[some], np.searchsorted(some, code[of]), chunk[of], count[of], width)

    KINDS = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.int64())

    def _postings(self, words: np.ndarray, word: np.ndarray, chunk: np.ndarray, count: np.ndarray, width: int) -> pa.RecordBatch:
        """Rows of ``words`` for postings sorted by (place of the word, chunk)."""
        part = chunk // RANGE
        new = np.ones(len(word), bool)
        new[1:] = word[1:] != word[:-1]
        first = np.flatnonzero(new | np.concatenate(([True], part[1:] != part[:-1])))
        gaps = np.diff(part[first], prepend=0)
        gaps[new[first]] = part[first][new[first]]
        blocks = np.searchsorted(word[first], np.arange(len(words) + 1)).astype(np.int32)
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).astype(np.int32)
        listed = lambda x: pa.ListArray.from_arrays(pa.array(blocks), pa.array(x.astype(np.int32)))
        packed = lambda ends, x: pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
        return self._batch(
            [pa.array(words, pa.string()), listed(gaps), listed(np.maximum.reduceat(count, first)), listed(np.diff(np.append(first, len(word)))), packed(bounds, (chunk % RANGE).astype(np.uint8)), pa.array(np.full(len(words), width, np.int32)), packed(bounds * width, count.astype(f"<u{width}")), pa.array(np.add.reduceat(count, bounds[:-1]))],
            pa.nulls(len(words), pa.list_(self.kind)),
        )

    def _batch(self, columns: list[pa.Array], ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), self.number)), *columns, ids], ["shard", "lexeme", "gaps", "largest", "sizes", "places", "width", "counts", "nentry", "chunk_ids"])


def _number_and_post(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard(number, kind)
        for batch in batches:
            for at in range(0, len(batch), RANGE):
                piece = batch.slice(at, RANGE)
                shard.add(piece.column(0), piece.column(1))
                if shard.size >= SHARD_POSTINGS or len(shard.ids) >= 2 * SHARD_CHUNKS:
                    yield from shard.rows()
                    shard = _Shard(shard.number + 1, kind)
        if shard.ids:
            yield from shard.rows()

    return run


def build(chunks: DataFrame, path: str, words: Column | None = None) -> LexicalIndex:
    """Write the index of ``chunks`` (chunk_id, text) to ``path`` and open it; a text is tokenised once, here."""
    spark = chunks.sparkSession
    words = lexemes(F.col("text")) if words is None else words
    kind = chunks.schema["chunk_id"].dataType
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // SHARD_CHUNKS))
    dealt = chunks.repartition(parts, "chunk_id").select("chunk_id", words.alias("words"))
    dealt.mapInArrow(_number_and_post(to_arrow_type(kind)), _postings_schema(kind.simpleString())).write.parquet(f"{path}/postings")
    rows = spark.read.parquet(f"{path}/postings").where("lexeme is not null")
    ndoc = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, k: n + k)
    totals = rows.groupBy("lexeme").agg(F.sum(ndoc).alias("ndoc"), F.sum("nentry").alias("nentry"), F.max(F.array_max("largest")).alias("most"))
    best = rows.select("lexeme", F.explode(F.slice(F.sort_array("largest", asc=False), 1, DEPTH)).alias("n"))
    times = best.groupBy("lexeme", "n").agg(F.count(F.lit(1)).alias("times"))
    upto = times.withColumn("upto", F.sum("times").over(Window.partitionBy("lexeme").orderBy(F.desc("n"))))
    reached = upto.where(F.col("upto") >= DEPTH).groupBy("lexeme").agg(F.max("n").alias("reached"))
    totals.join(reached, "lexeme", "left").fillna({"reached": 0}).write.parquet(f"{path}/vocabulary")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"))


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, make) -> str:
    """The folder that ``make(path)`` filled for ``name`` earlier in this application, or fills now."""
    from uuid import uuid4

    key = (spark.sparkContext.applicationId, name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if key in _stored:
        mark = jvm.org.apache.hadoop.fs.Path(f"{_stored[key]}/_DONE")
        if mark.getFileSystem(conf).exists(mark):
            return _stored[key]
    path = f"{shared_dir(spark)}/index-{uuid4().hex}"
    make(path)
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_DONE")
    mark.getFileSystem(conf).create(mark).close()
    _stored[key] = path
    return path


class _List:
    """A lexeme's postings in one shard; blocks are decoded when they are first asked for."""

    __slots__ = ("ranges", "largest", "ends", "places", "counts", "open")

    def __init__(self, gaps, largest, sizes, places: bytes, width: int, counts: bytes):
        self.ranges = np.cumsum(gaps)
        self.largest = largest.astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.places, self.counts = np.frombuffer(places, np.uint8), np.frombuffer(counts, f"<u{width}")
        self.open: dict[int, None] = {}

    def add_to(self, scores: np.ndarray, wanted: np.ndarray) -> None:
        """Add the counts of the blocks of the ranges ``wanted`` (sorted) to ``scores``, one row for each range."""
        at = np.searchsorted(self.ranges, wanted)
        for row, i in enumerate(at.tolist()):
            if i < len(self.ranges) and self.ranges[i] == wanted[row]:
                a, b = (self.ends[i - 1] if i else 0), self.ends[i]
                scores[row, self.places[a:b]] += self.counts[a:b]
                self.open[i] = None


def _best_of_shard(lists: list[_List], n_ranges: int, least: int, depth: int) -> list[tuple[int, int]]:
    """(score, -chunk number) of the first ``depth`` chunks of a shard with a score of at least ``least``."""
    bound = np.zeros(n_ranges, np.int64)
    for x in lists:
        bound[x.ranges] += x.largest
    order = np.argsort(-bound, kind="stable")
    order = order[: np.searchsorted(-bound[order], -max(least, 1), "right")]
    heap: list[tuple[int, int]] = []
    a, step = 0, 1
    while a < len(order) and not (len(heap) == depth and bound[order[a]] < heap[0][0]):
        some = np.sort(order[a : a + step])
        a, step = a + step, min(2 * step, MOST_OPENED_AT_ONCE)
        scores = np.zeros((len(some), RANGE), np.int64)
        for x in lists:
            x.add_to(scores, some)
        edge = max(least, 1, heap[0][0] if len(heap) == depth else 1)
        row, place = np.nonzero(scores >= edge)
        for score, chunk in zip(scores[row, place].tolist(), (some[row] * RANGE + place).tolist(), strict=True):
            if len(heap) < depth:
                heapq.heappush(heap, (score, -chunk))
            elif (score, -chunk) > heap[0]:
                heapq.heapreplace(heap, (score, -chunk))
    return heap


def _search_shards(depth: int, query_kind: pa.DataType, chunk_kind: pa.DataType, opened: Accumulator | None, held: Accumulator | None):
    def results(lists: dict[str, _List], asked: dict, least: dict, ids: list) -> pa.RecordBatch:
        out: list[tuple] = []
        n_ranges = -(-len(ids) // RANGE)
        for query, words in asked.items():
            out += [(query, ids[-chunk], score) for score, chunk in _best_of_shard([lists[w] for w in words], n_ranges, least[query], depth)]
        if opened is not None:
            opened.add(sum(len(x.open) for x in lists.values()))
            held.add(sum(len(x.ranges) for x in lists.values()))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], query_kind), pa.array(columns[1], chunk_kind), pa.array(columns[2], pa.int64())], ["query_id", "chunk_id", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists, asked, least, ids = None, {}, {}, {}, []
        for batch in batches:
            names, shards, widths = (batch.column(c).to_pylist() for c in ("lexeme", "shard", "width"))
            blocks = [batch.column(c) for c in ("gaps", "largest", "sizes")]
            at = blocks[0].offsets.to_numpy()
            gaps, largest, sizes = (x.values.to_numpy(zero_copy_only=False) for x in blocks)
            places, counts, queries = (batch.column(c) for c in ("places", "counts", "queries"))
            for k, (name, own) in enumerate(zip(names, shards, strict=True)):
                if own != shard:
                    if lists:
                        yield results(lists, asked, least, ids)
                    shard, lists, asked, least, ids = own, {}, {}, {}, []
                if name is None:
                    ids = batch.column("chunk_ids")[k].as_py()
                    continue
                a, b = at[k], at[k + 1]
                lists[name] = _List(gaps[a:b], largest[a:b], sizes[a:b], places[k].as_py(), widths[k], counts[k].as_py())
                for q in queries[k].as_py():
                    asked.setdefault(q["query_id"], []).append(name)
                    least[q["query_id"]] = q["least"]
        if lists:
            yield results(lists, asked, least, ids)

    return run


def best_positions(index: LexicalIndex, terms: DataFrame, depth: int = DEPTH, opened: Accumulator | None = None, held: Accumulator | None = None) -> DataFrame:
    """(query_id, chunk_id, positions): of each shard the ``depth`` chunks with most matching positions, no fewer
    than a bound that the last result is known to reach.

    terms: (query_id, lexeme), distinct.  They go to the tasks in blocks of about ``MOST_TERMS_SENT``.  The
    accumulators count the blocks that were decoded and those of the lexemes asked for.
    """
    spark = terms.sparkSession
    kinds = terms.schema["query_id"].dataType, index.postings.schema["chunk_ids"].dataType.elementType
    bound = "most" if depth == 1 else "reached" if depth <= DEPTH else "0"
    known = terms.join(index.vocabulary.select("lexeme", F.expr(bound).alias("bound")), "lexeme")
    bounds = known.groupBy("query_id").agg(F.max("bound").alias("least"))
    blocks = max(1, -(-terms.count() // MOST_TERMS_SENT))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for b in range(blocks):
        some = known.drop("bound").join(bounds, "query_id").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        asked = some.groupBy("lexeme").agg(F.collect_list(F.struct("query_id", "least")).alias("queries"))
        rows = index.postings.where("lexeme is not null").join(F.broadcast(asked), "lexeme").select(*index.postings.columns, "queries")
        heads = index.postings.where("lexeme is null").withColumn("queries", F.lit(None).cast(rows.schema["queries"].dataType))
        dealt = rows.unionByName(heads).repartition(parts, "shard").sortWithinPartitions("shard", "lexeme")
        made = dealt.mapInArrow(_search_shards(depth, *map(to_arrow_type, kinds), opened, held), f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, positions long")
        found = made if found is None else found.unionByName(made)
    return found


def search(index: LexicalIndex, terms: DataFrame, depth: int = DEPTH, opened: Accumulator | None = None, held: Accumulator | None = None) -> DataFrame:
    """The same rankings as :func:`retrieval.sparse` over the postings that the index holds."""
    found = best_positions(index, terms, depth, opened, held)
    return top(found.withColumn("score", F.round(F.col("positions") * 0.1, 1)), "sparse", [F.desc("positions"), F.asc("chunk_id")], depth)


def _bags_of_shard(lists: dict[str, tuple[np.ndarray, np.ndarray]], bags: dict[str, np.ndarray], n_chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """(bag, best): the most matching positions that a chunk of a shard has with each bag.

    lists: (chunk numbers, counts) of each lexeme; bags: the bags that hold it.  Lexemes of more than one chunk in
    ``DENSE`` are rows of a matrix that is added up row by row; the others add to single chunks.
    """
    names = sorted(lists, key=lambda w: -len(lists[w][0]))
    n_dense = sum(len(lists[w][0]) * DENSE > n_chunks for w in names)
    dense = np.zeros((n_dense, n_chunks), np.int32)
    for row, name in enumerate(names[:n_dense]):
        chunk, count = lists[name]
        dense[row, chunk] = count
    bag = np.concatenate([bags[w] for w in names])
    word = np.repeat(np.arange(len(names)), [len(bags[w]) for w in names])
    order = np.lexsort((word, bag))
    bag, word = bag[order], word[order]
    first = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1])))
    ends = np.append(first[1:], len(bag))
    best = np.zeros(len(first), np.int64)
    scores = np.empty(n_chunks, np.int32)  # at most the words of a chunk
    for k, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        own = word[a:b]
        cut = int(np.searchsorted(own, n_dense))
        scores[:] = 0
        for row in own[:cut].tolist():
            scores += dense[row]
        for row in own[cut:].tolist():
            chunk, count = lists[names[row]]
            scores[chunk] += count
        best[k] = scores.max()
    return bag[first], best


def _score_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, lists, bags, n_chunks = None, {}, {}, 0

    def results() -> pa.RecordBatch:
        bag, best = _bags_of_shard(lists, bags, n_chunks)
        return pa.RecordBatch.from_arrays([pa.array(bag, pa.int64()), pa.array(best, pa.int64())], ["bag_id", "best"])

    for batch in batches:
        names, shards, widths, ids = (batch.column(c).to_pylist() for c in ("lexeme", "shard", "width", "n_chunks"))
        for k, (name, own) in enumerate(zip(names, shards, strict=True)):
            if own != shard:
                if lists:
                    yield results()
                shard, lists, bags, n_chunks = own, {}, {}, 0
            if name is None:  # sorted first of its shard
                n_chunks = ids[k]
                continue
            ranges = np.cumsum(batch.column("gaps")[k].values.to_numpy(zero_copy_only=False))
            sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False)
            place = np.frombuffer(batch.column("places")[k].as_py(), np.uint8)
            count = np.frombuffer(batch.column("counts")[k].as_py(), f"<u{widths[k]}")
            lists[name] = np.repeat(ranges, sizes) * RANGE + place, count.astype(np.int32)
            bags[name] = batch.column("bags")[k].values.to_numpy(zero_copy_only=False)
    if lists:
        yield results()


def bag_scores(index: LexicalIndex, bags: DataFrame) -> DataFrame:
    """(L, bag, s) as :func:`retrieval.bag_scores`.

    So many bags meet nearly all chunks, and only the best score of each is asked for: a task adds up a shard's
    postings for one bag after the other and returns one row for each, so what is shuffled are the postings once and
    a row for each shard and bag.  Bags go to the tasks in blocks of about ``MOST_TERMS_SENT`` lexemes.
    """
    spark = bags.sparkSession
    named = bags.select((F.col("L").cast("long") * (1 << 32) + F.col("bag").cast("long")).alias("bag_id"), "lexeme")
    blocks = max(1, -(-named.count() // MOST_TERMS_SENT))
    heads = index.postings.where("lexeme is null").select("shard", "lexeme", "gaps", "sizes", "places", "width", "counts", F.size("chunk_ids").alias("n_chunks"), F.lit(None).cast("array<long>").alias("bags"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), heads.count())
    found = None
    for b in range(blocks):
        asked = named.where(F.pmod(F.xxhash64("bag_id"), F.lit(blocks)) == b).groupBy("lexeme").agg(F.collect_list("bag_id").alias("bags"))
        rows = index.postings.where("lexeme is not null").join(F.broadcast(asked), "lexeme").select("shard", "lexeme", "gaps", "sizes", "places", "width", "counts", F.lit(None).cast("int").alias("n_chunks"), "bags")
        dealt = rows.unionByName(heads).repartition(parts, "shard").sortWithinPartitions("shard", "lexeme")
        made = dealt.mapInArrow(_score_bags, "bag_id long, best long")
        found = made if found is None else found.unionByName(made)
    best = found.groupBy("bag_id").agg((F.max("best") * 0.1).alias("s"))
    every = bags.select("L", "bag").distinct().withColumn("bag_id", F.col("L").cast("long") * (1 << 32) + F.col("bag").cast("long"))
    return every.join(best, "bag_id", "left").fillna({"s": 0.0}).select("L", "bag", "s")
