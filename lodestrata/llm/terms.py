"""Hashed terms of many texts at once: words, beginnings and endings of words, and shapes of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import _BASE, _INVERSE, _SPACE, mix, powers, slices, text_buffers

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)  # other characters stand for themselves
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97
_BYTES = np.random.default_rng(20240619).integers(1, 1 << 63, 256, dtype=np.uint64)


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (two bytes, 0xC3 first) in lower case."""
    out = _FOLD[data]
    if len(data) > 1:
        second = data[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:][capital] += 0x20
    return out


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_INVERSE, max(len(data), 1))

    def hash(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) + np.uint64(kind << 32)))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where texts meet."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[offsets[1:]] = False
    return np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters and digits; general punctuation and the no-break space are outside."""
    inside = _LETTER[data]
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        for k in range(3):
            inside[at + k] = False
        at = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
        inside[at] = inside[at + 1] = False
    return inside


def word_terms(texts: pa.Array, prefixes: tuple[int, ...] = (4, 5, 6, 7)) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the texts (first row, number of rows): hashes of words in lower case and of their first
    bytes, each with the row (from the slice's first) it stands in."""
    for a, b in slices(texts):
        data, offsets = text_buffers(texts[a:b])
        starts, ends = runs(letters(data), offsets)
        spans = Spans(fold(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        hashes, rows = [spans.hash(starts, ends, 0)], [row]
        for size in prefixes:
            long = ends - starts > size
            hashes.append(spans.hash(starts[long], starts[long] + size, size))
            rows.append(row[long])
        yield a, b - a, np.concatenate(hashes), np.concatenate(rows)


def shape_terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: hashes of the words between white space as they stand, of their last three
    bytes and of their shapes (runs of a kind of character count once), and one term for each word that
    repeats the word before; their rows; each row's words."""
    for a, b in slices(texts):
        data, offsets = text_buffers(texts[a:b])
        starts, ends = runs(~_SPACE[data], offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        spans = Spans(data)
        kinds = _SHAPE[data]
        first = np.ones(len(data), bool)
        first[1:] = kinds[1:] != kinds[:-1]
        first[starts] = True
        place = np.concatenate(([0], np.cumsum(first)))
        shapes = Spans(kinds[first])
        hashes = [spans.hash(starts, ends, 1), spans.hash(np.maximum(starts, ends - 3), ends, 2), shapes.hash(place[starts], place[ends], 3)]
        again = np.flatnonzero((hashes[0][1:] == hashes[0][:-1]) & (row[1:] == row[:-1])) + 1
        hashes.append(np.full(len(again), 0x3C6EF372FE94F82B, np.uint64))
        yield a, b - a, np.concatenate(hashes), np.concatenate([row, row, row, row[again]]), np.bincount(row, minlength=b - a)
