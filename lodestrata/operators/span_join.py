"""Which texts hold which spans: a join on rolling fingerprints, with one pass over the texts.

A span's fingerprint is the hash of its first q bytes, q being the largest power of two that the span has, at
most ``LONGEST``.  The same hashes are rolled over all texts at once: h of 2w bytes at i comes from those of
w bytes at i and at i + w, so each doubling is one step over a batch's bytes.  A bitmap of the spans'
fingerprints, its size in proportion to their number, drops nearly all other places; the rest goes, with as
many bytes as the longest span of its q has, into an equi-join on the fingerprint, where the bytes are
compared.  So hashes only decide what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..intermediate import materialise

LONGEST = 64
BITS_A_SPAN = 32
MOST_BITS = 1 << 30  # 128 MB; with over 2**25 spans more places pass, and the join drops them
PROBES = 3
PIECE_BITS = 1 << 20
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20250301).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolled(data: np.ndarray, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each power of two of ``wanted``, ascending: the hashes of all windows of so many bytes."""
    with np.errstate(over="ignore"):
        h, width, power = _BYTES[data], 1, _BASE
        while len(h):
            if width in wanted:
                yield width, _mixed(h ^ np.uint64(width))
            if width >= max(wanted, default=0) or len(h) <= width:
                return
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an array of strings; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
        yield start, stop
        start = stop


def _span_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle) with its q, its fingerprint and its length in bytes."""
    for batch in batches:
        needles = [n.encode() for n in batch.column(0).to_pylist()]
        widths = [min(1 << (len(n).bit_length() - 1), LONGEST) for n in needles]
        hashes = np.zeros(len(needles), np.uint64)
        for k, (needle, width) in enumerate(zip(needles, widths, strict=True)):
            hashes[k] = next(h for _, h in rolled(np.frombuffer(needle, np.uint8)[:width], [width]))[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(widths, pa.int32()), pa.array(hashes.view(np.int64)), pa.array([len(n) for n in needles], pa.int32())], ["needle", "q", "h", "size"])


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one row for each probe."""
    return np.stack([(h >> np.uint64(21 * k)) * np.uint64(2 * k + 1) + (h >> np.uint64(7 * k)) & np.uint64(bits - 1) for k in range(PROBES)])


def _set_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at // PIECE_BITS).astype(np.int64)), pa.array((at % PIECE_BITS).astype(np.int32))], ["piece", "bit"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of piece: each piece of the bitmap as bytes."""
    held: dict[int, np.ndarray] = {}

    def done(keep: int | None) -> Iterator[pa.RecordBatch]:
        for piece in [p for p in held if p != keep]:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(held.pop(piece), bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    for batch in batches:
        piece, bit = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for p in np.unique(piece).tolist():
            held.setdefault(p, np.zeros(PIECE_BITS, bool))[bit[piece == p]] = True
            yield from done(p)
    yield from done(None)


def bitmap(hashes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The bitmap (bytes, number of bits) of the fingerprints (h) of ``n`` spans, made of pieces in Spark."""
    bits = min(max(1 << (max(n, 1) * BITS_A_SPAN - 1).bit_length(), 1 << 12), MOST_BITS)
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = hashes.select("h").mapInArrow(_set_bits(bits), "piece long, bit int").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in found.repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(_pieces, "piece long, bits binary").toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)[: len(out)]
        out[r["piece"] * PIECE_BITS // 8 :][: len(part)] = part
    return out, bits


def _places(shared, bits: int, reach: dict[int, int], scanned: Accumulator | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if scanned is not None:
                scanned.add(len(batch))
            data, offsets = _flat(batch.column(1))
            for first, stop in _slices(offsets):
                part, ends = data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
                raw = part.tobytes()
                for q, h in rolled(part, sorted(reach)):
                    hit = np.ones(len(h), bool)
                    at = np.arange(len(h))
                    for probe in range(PROBES):  # each probe looks at what the probes before have left
                        bit = _probes(h[at], bits)[probe]
                        at = at[(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    row = np.searchsorted(ends, at, "right") - 1
                    whole = at + q <= ends[row + 1]
                    at, row = at[whole], row[whole]
                    if len(at):
                        texts = [raw[a : min(a + reach[q], b)] for a, b in zip(at.tolist(), ends[row + 1].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(np.full(len(at), q, np.int32)), pa.array(h[at].view(np.int64)), pa.array(texts, pa.binary())], ["chunk_id", "q", "h", "here"])

    return run


def span_places(chunks: DataFrame, spans: DataFrame, scanned: Accumulator | None = None) -> DataFrame:
    """(span_id, chunk_id), distinct: which texts of ``chunks`` (chunk_id, text) hold which of ``spans`` (span_id, needle), byte by byte.

    A null text holds nothing; null or empty needles are left out.  ``scanned`` counts the texts that are read.
    """
    spark = chunks.sparkSession
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    ready = materialise(spans.where("needle <> ''").select("needle").distinct().mapInArrow(_span_hashes, "needle string, q int, h long, size int"), "spans")
    sizes = ready.groupBy("q").agg(F.max("size").alias("reach"), F.count(F.lit(1)).alias("n")).collect()  # one row for each power of two
    table, bits = bitmap(ready, sum(r["n"] for r in sizes))
    shared = spark.sparkContext.broadcast(table)
    found = chunks.select("chunk_id", "text").mapInArrow(_places(shared, bits, {r["q"]: r["reach"] for r in sizes}, scanned), f"chunk_id {kind}, q int, h long, here binary")
    met = found.join(ready, ["q", "h"]).where(F.substring("here", F.lit(1), F.col("size")) == F.col("needle").cast("binary"))
    return met.select("needle", "chunk_id").distinct().join(spans.select("span_id", "needle"), "needle").select("span_id", "chunk_id").distinct()
