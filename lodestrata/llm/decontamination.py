"""Benchmark decontamination by templates: passages of a benchmark in texts, also with other numbers and names.

Words are runs of letters and digits, digits apart from letters that follow them (``3x``), and the signs of arithmetic
beside a number.  Each is replaced by a typed placeholder where it is a number, a unit
behind a number, or a name (a capital inside a sentence), and otherwise folded to lower case.  A window of
``WORDS`` canonical words with at least ``LITERALS`` plain ones is a template window.  The benchmark's
windows, in blocks of at most ``BLOCK_WINDOWS`` rows, form a hash table that is sent to the tasks; texts
are streamed against it.

Windows of plain words (nothing replaced) are looked up beside them, for passages whose capitals or stops
differ, such as a title.  An item of fewer than ``WORDS`` words is looked for as a whole, in plain words: it is met where
the same words stand between the ends of sentences or lines, as so few words prove nothing within a sentence.

A text's windows that meet an item's line up by their distance.  Windows of one distance are consistent
when each of the item's placeholder words stands for one word of the text throughout.  An item is in a text
when the consistent windows cover ``SHARE`` of the item's windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, materialise, share, tidy
from .terms import Spans, fold, letters, runs
from .words import mix, shingle_hashes, slices, text_buffers

WORDS = 5
LITERALS = 3
SHARE = 0.5
BLOCK_WINDOWS = 200_000

#: Units of measure that are replaced behind a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "s", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degrees", "mph", "kmh", "volts", "watts", "joules", "newtons",
)

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Signs that are words beside a number; those that also join words need white space around them.
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "+*=^<>"]] = True
_LOOSE_SIGN = np.zeros(256, bool)
_LOOSE_SIGN[[ord(c) for c in "-/"]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True  # line feed ! . : ?
_unit_hashes: list[np.ndarray] = []


def _signs(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places of signs that have words or brackets on both sides, a digit among them, white space left out."""
    at = np.flatnonzero(_SIGN[data] | _LOOSE_SIGN[data])
    at = at[(at > 0) & (at < len(data) - 1)]
    if not len(at):
        return at
    loose = _LOOSE_SIGN[data[at]]
    at = at[~loose | ((data[at - 1] == 32) & (data[at + 1] == 32))]
    left, right = at - 1 - (data[at - 1] == 32), at + 1 + (data[at + 1] == 32)
    there = (left >= 0) & (right < len(data))
    at, left, right = at[there], left[there], right[there]
    ends = lambda x, bracket: inside[x] | (data[x] == bracket)
    return at[(_DIGIT[data[left]] | _DIGIT[data[right]]) & ends(left, ord(")")) & ends(right, ord("("))]


class Canonical:
    """Canonical words of some texts: hashes, kinds (0 plain, 1 number, 2 name, 3 unit), places, bounds."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_buffers(texts)
        data, offsets = self.data, self.offsets
        inside = letters(data)
        if len(data) > 2:  # a point or comma between digits belongs to the number
            at = np.flatnonzero(_DIGIT[data[:-2]] & ((data[1:-1] == 44) | (data[1:-1] == 46)) & _DIGIT[data[2:]]) + 1
            inside[at] = True
        starts, ends = runs(inside, offsets)
        if len(starts):
            glued = np.flatnonzero(_DIGIT[data[starts]] & ~_DIGIT[data[ends - 1]])  # where letters follow digits
            letter = np.flatnonzero(inside & ~_DIGIT[data] & ~np.isin(data, (44, 46)))
            cuts = letter[np.searchsorted(letter, starts[glued])] if len(glued) else glued
            signs = _signs(data, inside)
            starts, ends = np.concatenate((starts, cuts, signs)), np.concatenate((np.delete(ends, glued), cuts, ends[glued], signs + 1))
            starts, ends = np.sort(starts), np.sort(ends)
        self.starts, self.ends = starts, ends
        self.bounds = np.searchsorted(self.starts, offsets)
        self.folded = fold(data)
        self.opens = np.zeros(0, bool)
        hashes = self.words = Spans(self.folded).hash(self.starts, self.ends, 0)
        self.kinds = np.zeros(len(hashes), np.int8)
        if len(hashes):
            number = _DIGIT[data[self.starts]] & _DIGIT[data[self.ends - 1]]
            stops = np.concatenate(([0], np.cumsum(_STOP[data])))
            opens = np.ones(len(hashes), bool)  # the first word of a sentence
            opens[1:] = stops[self.starts[1:]] > stops[self.ends[:-1]]
            opens[self.bounds[:-1][self.bounds[:-1] < len(hashes)]] = True
            self.opens = opens
            capital = (data[self.starts] >= 65) & (data[self.starts] <= 90)
            after = np.zeros(len(hashes), bool)
            after[1:] = number[:-1]
            if not _unit_hashes:
                units = Canonical.plain(UNITS)
                _unit_hashes.append(np.sort(units))
            unit = after & np.isin(hashes, _unit_hashes[0]) & ~opens
            self.kinds[capital & ~opens] = 2
            self.kinds[unit] = 3
            self.kinds[number] = 1
        self.hashes = np.where(self.kinds == 1, _NUMBER, np.where(self.kinds == 2, _NAME, np.where(self.kinds == 3, _UNIT, hashes)))

    @staticmethod
    def plain(words: tuple[str, ...]) -> np.ndarray:
        data, offsets = text_buffers(pa.array(words))
        return Spans(fold(data)).hash(offsets[:-1], offsets[1:], 0)

    def windows(self, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of each window of canonical or plain words, the latter also of a whole
        short text."""
        hashes, places = shingle_hashes(self.words ^ np.uint64(1) if plain else self.hashes, self.bounds, WORDS)
        row = np.repeat(np.arange(len(places) - 1), np.diff(places))
        first = np.arange(len(hashes)) - places[row] + self.bounds[row]
        whole = (np.diff(self.bounds)[row] >= WORDS) | plain
        return hashes[whole], row[whole], first[whole]

    def sentences(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each run of ``n`` plain words between ends of sentences, lines or texts."""
        opens = np.append(self.opens, True)
        first = np.flatnonzero(opens[: max(len(opens) - n, 0)] & opens[n:])
        row = np.searchsorted(self.bounds, first, "right") - 1
        whole = first + n <= self.bounds[row + 1]
        first, row = first[whole], row[whole]
        hashes = np.zeros(len(first), np.uint64)
        for k in range(n):
            hashes = mix(hashes * _NUMBER + self.words[first + k])
        return hashes, row

    def slots(self, first: int) -> list[tuple[int, str]]:
        """The placeholders in the window at ``first``: offset and the word in lower case."""
        return [(k, bytes(self.folded[self.starts[first + k] : self.ends[first + k]]).decode("utf-8", "replace")) for k in range(WORDS) if self.kinds[first + k]]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, plain, pos, total, hash, slots): the plain and template windows of the benchmark's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                canonical = Canonical(texts[a:b])
                kept = np.concatenate(([0], np.cumsum(canonical.kinds == 0)))
                size = np.diff(canonical.bounds)
                for n in range(1, WORDS):  # short items, as wholes: pos is their size
                    hashes, row = canonical.sentences(n)
                    alone = np.unique(np.where(size[row] == n, row, -1))
                    alone = alone[alone >= 0]
                    hashes = hashes[np.searchsorted(row, alone)]
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([ids[a + r] for r in alone], pa.int64()), "plain": pa.array([True] * len(alone), pa.bool_()), "pos": pa.array([-n] * len(alone), pa.int32()), "total": pa.array([1] * len(alone), pa.int32()), "hash": pa.array(hashes.view(np.int64)), "slots": pa.array([[]] * len(alone), pa.list_(pa.struct([("k", pa.int32()), ("word", pa.string())])))})
                for plain in (False, True):
                    hashes, row, first = canonical.windows(plain)
                    if plain:
                        hashes, row, first = (x[size[row] >= WORDS] for x in (hashes, row, first))
                    else:
                        keep = kept[first + WORDS] - kept[first] >= LITERALS
                        hashes, row, first = hashes[keep], row[keep], first[keep]
                    total = np.bincount(row, minlength=b - a)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item_id": pa.array([ids[a + r] for r in row], pa.int64()),
                            "plain": pa.array([plain] * len(row), pa.bool_()),
                            "pos": pa.array(first - canonical.bounds[row], pa.int32()),
                            "total": pa.array(total[row], pa.int32()),
                            "hash": pa.array(hashes.view(np.int64)),
                            "slots": pa.array([[] if plain else [{"k": k, "word": w} for k, w in canonical.slots(f)] for f in first], pa.list_(pa.struct([("k", pa.int32()), ("word", pa.string())]))),
                        }
                    )

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(tidy(run), "item_id long, plain boolean, pos int, total int, hash long, slots array<struct<k:int,word:string>>")


def _scan(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, known, counts, short = table.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                canonical = Canonical(texts[a:b])
                met: dict[int, dict[tuple, list[tuple[int, int, list]]]] = defaultdict(lambda: defaultdict(list))
                for plain in (False, True):
                    hashes, row, first = canonical.windows(plain)
                    maybe = known[(hashes & np.uint64(0xFFFFF)).astype(np.int64)]
                    for h, r, f in zip(hashes[maybe].tolist(), row[maybe].tolist(), first[maybe].tolist(), strict=True):
                        for item, pos, slots in by.get(h, ()):
                            met[r][item, f - pos].append((pos, f, slots))
                found: dict[tuple[int, int], float] = {}
                for n, items in short.items():
                    hashes, row = canonical.sentences(n)
                    for at in np.flatnonzero(np.isin(hashes, items[0])).tolist():
                        for item in items[1][int(hashes[at])]:
                            found[a + int(row[at]), item] = 1.0
                for r, lined in met.items():
                    covered: dict[tuple[int, bool], set[int]] = defaultdict(set)
                    for (item, _), windows in lined.items():
                        stands: dict[str, set[str]] = defaultdict(set)
                        for _, f, slots in windows:
                            if slots:
                                own = dict(canonical.slots(f))
                                for k, word in slots:
                                    stands[word].add(own.get(k, ""))
                        if all(len(v) == 1 for v in stands.values()):
                            covered[item].update(pos for pos, _, _ in windows)
                    for item, p in covered.items():
                        if len(p) >= SHARE * counts[item]:
                            found[a + r, item[0]] = max(len(p) / counts[item], found.get((a + r, item[0]), 0.0))
                if found:
                    at, items = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(items, pa.int64()), pa.array(found.values(), pa.float64())], names=["doc_id", "item_id", "share"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): the benchmark items that stand in each text.

    Null and empty texts hold nothing; items of fewer than ``WORDS`` words are found whole, between ends of
    sentences or lines, with a share of 1; items without words are not found; repeated rows each give their rows; rows with a null doc_id give rows with a null doc_id;
    either table may be empty.  Every text is searched whole, once for each block of the benchmark.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = materialise(item_windows(benchmark), "item-windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    out = spark.createDataFrame([], "doc_id long, item_id long, share double")
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    filled = [r["part"] for r in windows.select(part.alias("part")).distinct().collect()]  # one number for each block
    for block in filled:  # whole items, at most about BLOCK_WINDOWS rows at a time
        by: dict[int, dict] = defaultdict(dict)  # entries as keys, so repeated ones count once
        counts: dict[tuple[int, bool], int] = {}
        whole: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for r in windows.where(part == block).collect():
            item = (r["item_id"], r["plain"])
            if r["pos"] < 0:
                whole[-r["pos"]][r["hash"] % (1 << 64)].append(r["item_id"])
                continue
            by[r["hash"] % (1 << 64)][item, r["pos"], tuple((s["k"], s["word"]) for s in r["slots"])] = None
            counts[item] = max(counts.get(item, 0), r["total"])
        known = np.zeros(1 << 20, bool)
        known[[h & 0xFFFFF for h in by]] = True
        short = {n: (np.array(sorted(h), np.uint64), dict(h)) for n, h in whole.items()}
        if by or short:
            out = out.union(texts.mapInArrow(tidy(_scan(share(spark, ({h: list(entries) for h, entries in by.items()}, known, counts, short)))), "doc_id long, item_id long, share double"))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each doc_id that holds items: item_ids in order and the largest share."""
    return find_leaks(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
