"""Exact removal of repeated substrings: every byte covered by a string of ``LENGTH`` bytes that starts twice.

Of the ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes in a window of ``LENGTH`` bytes the one with the least
hash (the first of equals) is the window's anchor.  Equal windows have equal anchors at the same place in
them, and the windows with one anchor follow each other; their bytes together are the anchor's context.
So a window that is repeated is found among the contexts of its anchor's hash, and all but about one in
sixty bytes' worth of index entries is never moved.

1. All anchors, in blocks by hash, are grouped: those that stand alone are done; contexts that stand twice
   are repeated as a whole; hashes with different contexts are put into a bitmap of fixed size.  What a task
   finds twice by itself it marks at once and sends one copy of.
2. The texts are read again, and contexts of anchors in the bitmap are grouped by anchor, one copy of each
   from a batch (the others are marked already); in a group the hashes of all windows are counted, and
   those that stand twice are marked.  An anchor with more than ``HOT`` contexts from all tasks, such as one at the
   edge of a common passage, would make a group without bound: its windows go out by their own hashes, one
   copy of each from a batch.
3. Marked ranges meet their texts, and what they cover is cut out.

This is not a run-length compressed Burrows-Wheeler index; the README says why, with figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, materialise, share, tidy
from .words import _BASE, _INVERSE, mix, powers, slices, text_buffers

LENGTH = 200
GRAM = 64
BUCKET_BYTES = 256 << 10
SEND_BITS = 27
HOT_BITS = 22
HOT = 2000
FLUSH = 500_000

_BYTES = np.random.default_rng(20240623).integers(1, 1 << 63, 256, dtype=np.uint64)
_ANCHOR = np.dtype([("hash", "<u8"), ("context", "<u8"), ("key", "<i8"), ("start", "<i4"), ("stop", "<i4")])
_RANGE = np.dtype([("key", "<i8"), ("start", "<i4"), ("stop", "<i4")])
_WINDOW = np.dtype([("hash", "<u8"), ("key", "<i8"), ("start", "<i4")])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, the first of equals."""
    v, p, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        m = len(v) - step
        if m <= 0:
            return p[:0]
        right = v[step:] < v[:m]
        v, p, size = np.where(right, v[step:], v[:m]), np.where(right, p[step:], p[:m]), size + step
    return p


class Anchors:
    """Anchors of some texts: hash, context hash, text, first and one past the last window start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)
        grams = mix((self.sums[GRAM:] - self.sums[: max(n - GRAM + 1, 0)]) * self.back[: max(n - GRAM + 1, 0)]) if n >= GRAM else np.zeros(0, np.uint64)
        place = _least(grams, LENGTH - GRAM + 1)
        inside = np.zeros(len(place) + 1, np.int64)
        sizes = np.diff(offsets)
        long = sizes >= LENGTH
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        place = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        self.starts, self.stops, self.places = (starts[first], starts[last] + 1, place[first]) if len(starts) else (starts, starts, place)
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.hashes = mix(grams[self.places])  # least hashes are small: mixed anew, they fill all buckets alike
        ends = self.stops + LENGTH - 1
        raw = (self.sums[ends] - self.sums[self.starts]) * self.back[self.starts]
        self.contexts = mix(raw ^ mix(((self.places - self.starts).astype(np.uint64) << np.uint64(32)) + (self.stops - self.starts).astype(np.uint64)))


def bucket_bits(size: int) -> int:
    """So many buckets that each is of about ``BUCKET_BYTES`` of text, between 2**6 and 2**18."""
    return min(18, max(6, (size // BUCKET_BYTES).bit_length()))


def _packed(buckets: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows in binary by bucket."""
    if not len(rows):
        return [], []
    order = np.argsort(buckets, kind="stable")
    rows, buckets = rows[order], buckets[order]
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    return buckets[first].tolist(), [rows[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(rows)), strict=True)]


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _runs(same: np.ndarray) -> np.ndarray:
    """Rows that are the same as the one before or behind; same: of each row but the first."""
    out = np.zeros(len(same) + 1, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _anchor_blocks(bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("ranges", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["context"], rows["hash"]))]
            same = (rows["hash"][1:] == rows["hash"][:-1]) & (rows["context"][1:] == rows["context"][:-1])
            twice = _runs(same) if len(rows) else np.zeros(0, bool)
            ranges = np.zeros(int(twice.sum()), _RANGE)
            ranges["key"], ranges["start"], ranges["stop"] = rows["key"][twice], rows["start"][twice], rows["stop"][twice] + LENGTH - 1
            rows = rows[np.concatenate(([True], ~same))] if len(rows) else rows
            a, anchors = _packed((rows["hash"] >> np.uint64(64 - bits)).astype(np.int64), rows)
            b, marks = _packed(_spread(ranges["key"], bits), ranges)
            return pa.RecordBatch.from_arrays([pa.array(a + b, pa.int32()), pa.array([*anchors, *[None] * len(b)], pa.binary()), pa.array([*[None] * len(a), *marks], pa.binary())], schema=schema)

        for batch in batches:
            texts, keys = batch.column(0), batch.column(1).to_numpy()
            for a, b in slices(texts):
                data, offsets = text_buffers(texts[a:b])
                found = Anchors(data, offsets)
                rows = np.zeros(len(found.starts), _ANCHOR)
                rows["hash"], rows["context"], rows["key"] = found.hashes, found.contexts, keys[a + found.rows]
                rows["start"], rows["stop"] = found.starts - offsets[found.rows], found.stops - offsets[found.rows]
                held.append(rows)
                size += len(rows)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _group_anchors(bits: int):
    def run(group: pa.Table) -> pa.Table:
        """A bucket's ranges that repeat as a whole, and (with key null) its slices of the two bitmaps."""
        rows = np.concatenate([np.zeros(0, _ANCHOR), *(np.frombuffer(x, _ANCHOR) for x in group.column("anchors").drop_null().to_pylist())])
        known = np.concatenate([np.zeros(0, _RANGE), *(np.frombuffer(x, _RANGE) for x in group.column("ranges").drop_null().to_pylist())])
        send, hot = b"", b""
        if len(rows):
            rows = rows[np.lexsort((rows["context"], rows["hash"]))]
            new = np.concatenate(([True], rows["hash"][1:] != rows["hash"][:-1]))
            same = ~new[1:] & (rows["context"][1:] == rows["context"][:-1])
            first = np.flatnonzero(new)
            kinds = np.add.reduceat(np.concatenate(([1], ~same)).astype(np.int64), first)  # different contexts of each hash
            copies = np.diff(np.append(first, len(rows)))  # one of each context from a task
            send, hot = (_bits(rows["hash"][first[chosen]], width, bits) for width, chosen in ((SEND_BITS, kinds > 1), (HOT_BITS, (kinds > 1) & (copies > HOT))))
            whole = rows[_runs(same)]
            more = np.zeros(len(whole), _RANGE)
            more["key"], more["start"], more["stop"] = whole["key"], whole["start"], whole["stop"] + LENGTH - 1
            known = np.concatenate((known, more))
            # A context that one task found twice is marked there, and by these rows wherever else it stands.
        return pa.table(
            {
                "key": pa.array([*known["key"].tolist(), None], pa.int64()),
                "start": pa.array([*known["start"].tolist(), group.column("bucket")[0].as_py()], pa.int32()),
                "stop": pa.array([*known["stop"].tolist(), 0], pa.int32()),
                "send": pa.array([None] * len(known) + [send], pa.binary()),
                "hot": pa.array([None] * len(known) + [hot], pa.binary()),
            }
        )

    return run


def _bits(hashes: np.ndarray, width: int, bits: int) -> bytes:
    """A bucket's slice of a bitmap of 2**width bits; empty where no bit is set."""
    out = np.zeros(1 << (width - bits), bool)
    out[((hashes >> np.uint64(64 - width)) & np.uint64((1 << (width - bits)) - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes() if len(hashes) else b""


def _marked(bitmap: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - width)
    return (bitmap[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _ranges(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows as ranges of bytes, those that follow each other as one."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(new)
    out = np.zeros(len(first), _RANGE)
    out["key"], out["start"] = keys[first], starts[first]
    out["stop"] = starts[np.append(first[1:], len(keys)) - 1] + LENGTH if len(first) else 0
    return out


def _contexts(bitmaps, bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("context", pa.binary()), ("windows", pa.binary()), ("ranges", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send, hot = bitmaps.value
        sent: set[int] = set()  # contexts sent by this task, the last FLUSH or so
        held: list[np.ndarray] = []
        size = 0

        def windows() -> pa.RecordBatch:
            """Windows of hot anchors: one copy of each, and ranges of those that stand twice here."""
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["hash"], kind="stable")]
            same = rows["hash"][1:] == rows["hash"][:-1]
            twice = rows[_runs(same)]
            ranges = _ranges(twice["key"], twice["start"])
            rows = rows[np.concatenate(([True], ~same))]
            a, packed = _packed((rows["hash"] >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits), rows)
            b, marks = _packed(_spread(ranges["key"], bits) + (1 << bits), ranges)
            n = len(a) + len(b)
            return pa.RecordBatch.from_arrays([pa.array(a + b, pa.int32()), *(pa.nulls(n, f.type) for f in list(schema)[1:4]), pa.array([*packed, *[None] * len(b)], pa.binary()), pa.array([*[None] * len(a), *marks], pa.binary())], schema=schema)

        for batch in batches:
            texts, keys = batch.column(0), batch.column(1).to_numpy()
            for a, b in slices(texts):
                data, offsets = text_buffers(texts[a:b])
                found = Anchors(data, offsets)
                chosen = _marked(send, found.hashes, SEND_BITS)
                crowded = chosen & _marked(hot, found.hashes, HOT_BITS)
                take = np.flatnonzero(crowded)
                if len(take):
                    many = found.stops[take] - found.starts[take]
                    at = np.repeat(found.starts[take] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                    row = np.repeat(found.rows[take], many)
                    rows = np.zeros(len(at), _WINDOW)
                    rows["hash"], rows["key"], rows["start"] = mix((found.sums[at + LENGTH] - found.sums[at]) * found.back[at]), keys[a + row], at - offsets[row]
                    held.append(rows)
                    size += len(rows)
                    if size >= 2 * FLUSH:
                        yield windows()
                        held, size = [], 0
                take = np.flatnonzero(chosen & ~crowded)
                pairs, first = np.unique(mix(found.hashes[take]) ^ found.contexts[take], return_index=True)
                pairs = pairs.tolist()
                take = take[np.sort(first[[p not in sent for p in pairs]])]
                sent = sent if len(sent) < FLUSH else set()
                sent.update(pairs)
                starts, stops = found.starts[take], found.stops[take]
                sizes = stops - starts + LENGTH - 1
                ends = np.cumsum(sizes)
                flat = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]
                cuts = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes())
                rows = found.rows[take]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((found.hashes[take] >> np.uint64(64 - bits)).astype(np.int32)),
                        pa.array(keys[a + rows]),
                        pa.array((starts - offsets[rows]).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(take), [None, cuts, pa.py_buffer(flat.tobytes())]),
                        pa.nulls(len(take), pa.binary()),
                        pa.nulls(len(take), pa.binary()),
                    ],
                    schema=schema,
                )
        if size:
            yield windows()

    return run


def _mark_windows(group: pa.Table) -> pa.Table:
    """Ranges of a bucket that windows standing twice cover: of its contexts, or of its windows of hot anchors."""
    found = [np.zeros(0, _RANGE), *(np.frombuffer(x, _RANGE) for x in group.column("ranges").drop_null().to_pylist())]
    windows = [np.frombuffer(x, _WINDOW) for x in group.column("windows").drop_null().to_pylist()]
    if windows:
        rows = np.concatenate(windows)
        rows = rows[np.argsort(rows["hash"], kind="stable")]
        rows = rows[_runs(rows["hash"][1:] == rows["hash"][:-1])]
        found.append(_ranges(rows["key"], rows["start"]))
    contexts = group.column("context").combine_chunks()
    contexts = pa.concat_arrays(contexts.chunks) if isinstance(contexts, pa.ChunkedArray) else contexts
    if contexts.null_count < len(contexts):
        keep = pc.is_valid(contexts)
        found.append(_of_contexts(group.column("key").filter(keep).to_numpy(), group.column("start").filter(keep).to_numpy(), contexts.filter(keep)))
    out = np.concatenate(found)
    return pa.table({"key": out["key"], "start": out["start"], "stop": out["stop"]})


def _of_contexts(keys: np.ndarray, start: np.ndarray, contexts: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(contexts)
    hashes, places = [], []
    for a, b in slices(contexts):
        piece, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * powers(_BASE, len(piece)), out=sums[1:])
        inside = np.zeros(len(piece) + 1, np.int64)
        np.add.at(inside, cuts[:-1], 1)
        np.add.at(inside, cuts[1:] - LENGTH + 1, -1)
        at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        hashes.append(mix((sums[at + LENGTH] - sums[at]) * powers(_INVERSE, len(piece) + 1)[at]))
        places.append(at + offsets[a])
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    twice = np.zeros(len(hashes), bool)
    twice[order[_runs(ranked[1:] == ranked[:-1])]] = True
    places = places[twice]
    row = np.searchsorted(offsets, places, "right") - 1
    return _ranges(keys[row], start[row] + (places - offsets[row]).astype(np.int64))


def cut_ranges(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the ranges, and the number of maximal ranges."""
    kept, at, spans, end = [], 0, 0, -1
    for a, b in sorted(ranges):
        if a > end:
            spans += 1
        if a > at:
            kept.append(text[at:a])
        at, end = max(at, b), max(end, b)
    return b"".join([*kept, text[at:]]), spans


def drop_repeated_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs`` (doc_id, text); kept is binary.

    Null texts count as empty; texts under ``LENGTH`` bytes are never changed; of repeated strings every
    occurrence goes, in repeated rows as well; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    texts = rows.select("text", "key")
    bits = bucket_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    grouped = texts.mapInArrow(tidy(_anchor_blocks(bits)), "bucket int, anchors binary, ranges binary").groupBy("bucket").applyInArrow(_group_anchors(bits), "key long, start int, stop int, send binary, hot binary")
    grouped = materialise(grouped, "anchors")
    send, hot = np.zeros(1 << (SEND_BITS - 3), np.uint8), np.zeros(1 << (HOT_BITS - 3), np.uint8)  # 16.5 MB at any size of corpus
    for r in grouped.where("key is null and length(send) > 0").select("start", "send", "hot").collect():
        for bitmap, part in ((send, r["send"]), (hot, r["hot"])):
            size = len(bitmap) >> bits
            bitmap[r["start"] * size : r["start"] * size + len(part)] = np.frombuffer(part, np.uint8)
    contexts = texts.mapInArrow(tidy(_contexts(share(spark, (send, hot)), bits)), "bucket int, key long, start int, context binary, windows binary, ranges binary")
    marked = contexts.groupBy("bucket").applyInArrow(_mark_windows, "key long, start int, stop int")
    marks = grouped.where("key is not null").select("key", "start", "stop").union(marked)
    ranges = marks.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).withColumnRenamed("key", "other")
    joined = rows.join(ranges, F.col("key") == F.col("other"), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                piece = batch.slice(a, b - a)
                out = []
                for text, found in zip(piece.column(1).cast(pa.binary()).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    kept, spans = cut_ranges(text, [(r["start"], r["stop"]) for r in found]) if found else (text, 0)
                    out.append((len(text), len(text) - len(kept), spans, kept))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
