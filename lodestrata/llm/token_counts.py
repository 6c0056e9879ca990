"""Token ids and token counts of whole texts by a public tokenizer file.

Texts are split at safe boundaries.  For the byte-level vocabularies every single space that stands
between two characters other than white space ends a pre-token (no pattern of theirs reaches over it), so
the ids of a text are the ids of its pieces one after the other, each piece taking the space before it.
Pieces repeat: a batch of about ``BATCH_BYTES`` is reduced to its distinct pieces by 64-bit hashes, those
met before are looked up in a table that each process keeps (``KEEP_BYTES``, then it starts anew), and
only new ones are encoded.  Files of other kinds go to their library text by text, in batches balanced by
bytes.

New pieces of a byte-level vocabulary whose ids follow the order of its merges go through tiktoken with
ranks made from the same file: the ids are those of tokenizers (the tests compare them) at a fraction of
the time.  Any other file stays with its own library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import bound_batches, tidy
from .words import _BASE, _INVERSE, mix, powers, slices, text_buffers

BATCH_BYTES = 4 << 20
LIBRARY_BYTES = 1 << 20
KEEP_BYTES = 16 << 20

_loaded: dict[str, "Encoder"] = {}
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that are white space or may begin a white-space character; beside them a space is no boundary.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(0x00, 0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of these texts begin: at each text that isn't empty, and at each safe space."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n > 2:
        wide = data >= 0x80
        safe = (data[1:-1] == 0x20) & ~_MAYBE_SPACE[data[2:]] & ~(_MAYBE_SPACE[data[:-2]] & ~wide[:-2])
        two = np.concatenate((np.zeros(1, np.uint8), data[:-3]))  # the byte two before the space
        three = np.concatenate((np.zeros(2, np.uint8), data[:-4])) if n > 3 else np.zeros(n - 2, np.uint8)
        safe &= ~(wide[:-2] & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
        begin[1 : n - 1] = safe
    edge = offsets[1:-1]
    for k in (-1, 0):  # a text's last byte has nothing behind it
        at = edge + k
        begin[at[(at >= 0) & (at <= n)]] = False
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.pieces: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = ranked(path) if path.endswith(".json") else None
        if self.pieces:
            pass  # the library itself isn't needed, nor its memory
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self._batch = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no library for {path}: .json and .model files are read")
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def load(path: str) -> "Encoder":
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def batches(self, texts: pa.Array) -> Iterator["Encoded"]:
        """The texts' ids, in row order; null counts as empty."""
        texts = texts.cast(pa.large_string())
        for a, b in slices(texts, BATCH_BYTES if self.pieces else LIBRARY_BYTES):
            yield self._by_piece(texts[a:b]) if self.pieces else self._by_text(texts[a:b])

    def _by_text(self, texts: pa.Array) -> "Encoded":
        ids = [np.array(x, "<u4") for x in self._batch([t or "" for t in texts.to_pylist()])]
        sizes = np.array([len(x) for x in ids], np.int64)
        return Encoded(np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum(sizes) - sizes, sizes, np.arange(len(ids)), np.arange(len(ids) + 1))

    def _by_piece(self, texts: pa.Array) -> "Encoded":
        hashes, bounds, where = [], [np.zeros(1, np.int64)], []
        total = np.int64(0)
        data_all, offsets_all = text_buffers(texts)
        for a, b in slices(texts):
            data, offsets = data_all[offsets_all[a] : offsets_all[b]], offsets_all[a : b + 1] - offsets_all[a]
            starts = piece_starts(data, offsets)
            ends = np.append(starts[1:], len(data))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=sums[1:])
            h = (sums[ends] - sums[starts]) * powers(_INVERSE, max(len(data), 1))[starts] if len(starts) else np.zeros(0, np.uint64)
            hashes.append(mix(h ^ (ends - starts).astype(np.uint64)) if len(starts) else h)
            where.append(np.stack((starts, ends)) + offsets_all[a])
            bounds.append(total + np.searchsorted(starts, offsets)[1:])
            total += len(starts)
        places = np.concatenate(where, axis=1) if where else np.zeros((2, 0), np.int64)
        distinct, first, index = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        if 24 * len(self.hashes) + 4 * len(self.flat) > KEEP_BYTES:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            raw = data_all.tobytes()
            spans = places[:, first[new]]
            flat, sizes = self.pieces([raw[i:j] for i, j in zip(*spans.tolist(), strict=True)])
            hashes = np.concatenate((self.hashes, distinct[new]))
            order = np.argsort(hashes, kind="stable")
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))[order]
            self.sizes = np.concatenate((self.sizes, sizes))[order]
            self.flat = np.concatenate((self.flat, flat))
            self.hashes = hashes[order]
            at = np.searchsorted(self.hashes, distinct)
        return Encoded(self.flat, self.starts[at], self.sizes[at], index, np.concatenate(bounds))


class Encoded:
    """Ids of some texts: text t has the pieces index[bounds[t]:bounds[t+1]], piece p the ids
    flat[starts[p]:starts[p]+sizes[p]]."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray, bounds: np.ndarray):
        self.flat, self.starts, self.sizes, self.index, self.bounds = flat, starts, sizes, index, bounds

    def counts(self) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(self.sizes[self.index])))
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def ids(self) -> Iterator[np.ndarray]:
        """Each text's ids; some texts are put together at a time."""
        step = 64
        for t in range(0, len(self.bounds) - 1, step):
            cut = self.bounds[t : t + step + 1]
            pieces = self.index[cut[0] : cut[-1]]
            sizes = self.sizes[pieces]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            places = np.arange(total) + np.repeat(self.starts[pieces] - (ends - sizes), sizes)
            ids = self.flat[places]
            edges = np.concatenate(([0], ends))[cut - cut[0]]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                yield ids[i:j]


def ranked(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None:
    """A function from pieces to their ids and numbers of ids, or None where the ids don't follow the merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, pre = data["model"], data["pre_tokenizer"] or {}
    if data["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or data["truncation"] or data["padding"]:
        return None
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or not pre.get("use_regex", True):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in data["added_tokens"]):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merged]
    if ids != sorted(set(ids)) or len(ids) + 256 != len(vocab):
        return None
    # The byte-level pre-tokenizer's fixed pattern.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=vocab, special_tokens=special)
    lengths = np.zeros(max([*vocab.values(), *special.values()]) + 1, np.int64)
    for token, i in vocab.items():
        lengths[i] = len(token)
    for token, i in special.items():
        lengths[i] = len(token.encode())

    def run(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a safe space are encoded as one text, cut again by their bytes."""
        joined = [p[:1] == b" " and p[1:2] not in (b"", b" ") and not _MAYBE_SPACE[p[1]] and p[-1] < 0x80 and not _MAYBE_SPACE[p[-1]] for p in pieces]
        one = encoding.encode_to_numpy(b"".join(p for p, j in zip(pieces, joined, strict=True) if j).decode(), allowed_special="all").astype("<u4")
        ends = np.searchsorted(np.cumsum(lengths[one]), np.cumsum([len(p) for p, j in zip(pieces, joined, strict=True) if j]), "right").astype(np.int64) if len(one) else np.zeros(0, np.int64)
        rest = [encoding.encode_to_numpy(p.decode(), allowed_special="all").astype("<u4") for p, j in zip(pieces, joined, strict=True) if not j]
        joined = np.array(joined, bool)
        order = np.argsort(~joined, kind="stable")  # the joined ones' ids come first in the flat array
        sizes = np.concatenate((np.diff(ends, prepend=0), np.array([len(x) for x in rest], np.int64))).astype(np.int64)
        flat = np.concatenate([one, *rest])
        if joined.all():
            return flat, sizes
        back = np.empty(len(pieces), np.int64)
        back[order] = np.arange(len(pieces))
        starts = (np.cumsum(sizes) - sizes)[back]
        sizes = sizes[back]
        stops = np.cumsum(sizes)
        return flat[np.arange(len(flat)) + np.repeat(starts - (stops - sizes), sizes)], sizes

    return run


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit in place of the text.

    The ids never leave the worker; only lengths do.  Null texts count as empty (0 bytes, 0 tokens);
    repeated rows are each counted; an empty table gives an empty one.  Columns of ``docs`` called like a
    result are replaced; other columns stay.
    """
    out = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in (text, *out)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        for batch in batches:
            column = batch.column(len(kept))
            counts = np.concatenate([np.zeros(0, np.int64), *(e.counts() for e in encoder.batches(column))])
            sizes = np.diff(text_buffers(column)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)], names=[*kept, *out])

    bound_batches(docs.sparkSession)
    return docs.select(*kept, text).mapInArrow(tidy(run), schema)
