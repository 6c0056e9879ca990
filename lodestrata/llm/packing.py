"""Best-fit packing of documents into sequences of a fixed number of tokens, planned on a length histogram.

1. Every document becomes ids and an end id; a longer one is cut into pieces of ``capacity`` ids, the
   first of which may be shorter.
2. The histogram of piece lengths (at most ``capacity`` rows, however large the corpus) goes to the driver,
   which runs best-fit decreasing over counts: as many pieces of a length as fit go at once into the
   sequences with the least room that holds them.  The plan says for each length which ranks take which
   slots.
3. The plan becomes one row for each slot, and pieces take slots by an equi-join on (length, rank within
   length).  Ranks are counted in salted groups, so that a length with a third of all pieces is spread.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, materialise, tidy
from .token_counts import Encoder

SALT_ROWS = 20_000
SLOT_BLOCK = 1 << 15

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if wanted, ids."""
    schema = T._parse_datatype_string(_PIECES + (", ids array<int>" if keep_ids else ""))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        for batch in batches:
            keys, row = batch.column(0), 0
            for encoded in encoder.batches(batch.column(1)):
                at: list[int] = []
                made: list[tuple[int, int, int, int]] = []
                kept: list[np.ndarray] = []
                for ids in encoded.ids():
                    ids = np.concatenate((ids, end))
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        at.append(row)
                        made.append((k, i, j - i, zlib.crc32(ids[i:j].tobytes())))
                        if keep_ids:
                            kept.append(ids[i:j])
                    row += 1
                piece, start, length, crc = zip(*made, strict=True) if made else ((), (), (), ())
                columns = [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, kept)]).astype(np.int32), np.concatenate([end[:0], *kept]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, ranks a sequence, first sequence, offset).

    Rank r of a length goes to sequence first + (r - first rank) // a, at offset + (r - first rank) % a * length.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by ids left: runs of sequences (first, how many)
    sizes: list[int] = []  # the keys of room, sorted
    opened = 0

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append((first, n))

    def fill(length: int, rank: int, count: int, left: int, first: int, n: int) -> int:
        """Put ranks into n sequences with ``left`` ids of room; how many were put."""
        each = left // length
        whole = min(n, count // each)
        if whole:
            plan.append((length, rank, whole * each, each, first, capacity - left))
            leave(left - each * length, first, whole)
        rest = min(count - whole * each, each - 1) if whole < n else 0
        if rest:
            plan.append((length, rank + whole * each, rest, rest, first + whole, capacity - left))
            leave(left - rest * length, first + whole, 1)
        leave(left, first + whole + bool(rest), n - whole - bool(rest))
        return whole * each + rest

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while count:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[at]
            else:
                left, first, n = capacity, opened, -(-count // (capacity // length))
                opened += n
            put = fill(length, rank, count, left, first, n)
            rank, count = rank + put, count - put
    return plan


def rank_within(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with rank: 0, 1, ... among pieces of the same length, counted in salted groups."""
    salts = max(64, -(-rows // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("n", F.row_number().over(within)).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n") - 1).drop("salt", "n", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with sequence_id and offset.

    Null and empty texts are one piece, the end id alone; repeated rows and rows with a null doc_id are
    each packed; an empty table gives an empty one; other columns of ``docs`` are not looked at.
    ``keep_ids`` adds the ids, from which :func:`sequences` makes the sequences themselves.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = materialise(cut_into_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = plan_best_fit(counts, capacity)
    runs = spark.createDataFrame(plan, "length long, first_rank long, ranks long, each long, first_sequence long, base long")
    blocks = runs.withColumn("block", F.explode(F.expr(f"sequence(0L, (ranks - 1) div {SLOT_BLOCK})")))
    slots = blocks.withColumn("k", F.explode(F.expr(f"sequence(block * {SLOT_BLOCK}, least(ranks, (block + 1) * {SLOT_BLOCK}) - 1)"))).select(
        "length",
        (F.col("first_rank") + F.col("k")).alias("rank"),
        F.expr("first_sequence + k div each").alias("sequence_id"),
        F.expr("base + (k % each) * length").alias("offset"),
    )
    ranked = rank_within(pieces, sum(counts.values()))
    return ranked.join(slots, ["length", "rank"]).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves (sequence_id, ids) of a result with ids; each has at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
