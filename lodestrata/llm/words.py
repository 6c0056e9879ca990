"""Word and shingle hashes of many texts at once, as numpy operations on their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z folded to a-z.  A text's shingles are
its windows of ``n`` words; a text with 1 to n-1 words has one shingle, the whole sequence; a text without
words has none.  Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
PIECE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD]
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base, np.ones(1, np.uint64))
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an array of strings or binaries; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes each; a longer text stands alone."""
    _, offsets = text_buffers(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + target, "right")) - 1)
        yield start, min(stop, len(texts))
        start = min(stop, len(texts))


def _hash_piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = space
    before[offsets[:-1]] = True
    starts = np.flatnonzero(~space & before[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    after[offsets[1:]] = True
    ends = np.flatnonzero(~space & after[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(_INVERSE, max(len(data), 1))[starts]
    return mix(hashes ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one more entry at the end)."""
    data, offsets = text_buffers(texts)
    if len(data) <= PIECE_BYTES:
        return _hash_piece(data, offsets)
    hashes, counts = [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):  # each long text in pieces that end at white space
        n = 0
        while a < b:
            cut = b
            if b - a > PIECE_BYTES:
                gaps = np.flatnonzero(_SPACE[data[a + PIECE_BYTES : b]])
                cut = a + PIECE_BYTES + int(gaps[0]) if len(gaps) else b
            h, _ = _hash_piece(data[a:cut], np.array([0, cut - a]))
            hashes.append(h)
            n += len(h)
            a = cut
        counts.append(n)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` words, and for each text where its shingles begin."""
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    places = np.concatenate(([0], np.cumsum(made))).astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), places
    weights = powers(0xD6E8FEB86659FD93, n)
    size = max(len(words) - n + 1, 0)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(n):
        rolled[:size] += words[k : k + size] * weights[n - 1 - k]
    keep = np.zeros(len(words), bool)
    mark = np.zeros(len(words) + 1, np.int64)
    long = counts >= n
    np.add.at(mark, bounds[:-1][long], 1)
    np.add.at(mark, bounds[1:][long] - n + 1, -1)
    keep = np.cumsum(mark)[:-1] > 0
    short = (counts > 0) & ~long
    first = bounds[:-1][short]
    for at, count in zip(first, counts[short], strict=True):
        rolled[at] = (words[at : at + count] * weights[n - count :]).sum(dtype=np.uint64) ^ np.uint64(count)
    keep[first] = True
    return mix(rolled[keep]), places


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        hashes, places = shingle_hashes(*word_hashes(texts[a:b]), n)
        for i, j in zip(places[:-1], places[1:], strict=True):
            s = np.sort(hashes[i:j])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out
