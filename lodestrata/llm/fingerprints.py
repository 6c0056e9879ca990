"""Bottom-k sketches of word shingles: mergeable fingerprints of whole texts.

A sketch is the ``k`` smallest of a text's distinct 64-bit shingle hashes, sorted.  Two sketches merge into
that of the union of their sets; they estimate resemblance (exactly, while the union has at most k
shingles), containment and the number of distinct shingles.  As a column a sketch is the base64 text of its
big-endian hashes, so equal texts have equal fingerprints and an empty text has the empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, tidy
from .words import shingle_sets, slices

SHINGLE_WORDS = 5
SKETCH_SIZE = 256
PART_ROWS = 500
MOST_PARTS = 10_000


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated |A n B| / |A u B|; two empty sets are alike, an empty one is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    again = both[1:] == both[:-1]
    firsts = np.flatnonzero(np.concatenate(([True], ~again)))
    if len(firsts) <= k:
        return float(again.sum()) / len(firsts)
    return float(again[: firsts[k] - 1].sum()) / k


def distinct_count(a: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated |A n B| / |A|; an empty set is contained in any."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def add_fingerprints(docs: DataFrame, text: str = "text", n: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> DataFrame:
    """``docs`` with fingerprint and n_shingles (estimated) in place of the text; null texts count as empty."""
    kept = [c for c in docs.columns if c not in (text, "fingerprint", "n_shingles")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [s[:k] for s in shingle_sets(batch.column(len(kept)), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(map(to_text, sketches), pa.string()), pa.array([distinct_count(s, k) for s in sketches], pa.float64())], names=schema.names)

    return docs.select(*kept, text).mapInArrow(tidy(run), schema)


def merge_fingerprints(sketched: DataFrame, key: str, k: int = SKETCH_SIZE) -> DataFrame:
    """One fingerprint for each value of ``key``: merged within each partition first, so that a key with
    most of the rows sends one row from each partition."""
    schema = T.StructType([sketched.schema[key], T.StructField("fingerprint", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict = {}
        for batch in batches:
            for value, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                merged[value] = merge(merged[value], from_text(text or ""), k) if value in merged else from_text(text or "")
            if len(merged) > 100_000:
                yield pa.RecordBatch.from_pydict({key: list(merged), "fingerprint": [*map(to_text, merged.values())]}, schema=batch.schema)
                merged = {}
        if merged:
            yield pa.RecordBatch.from_pydict({key: list(merged), "fingerprint": [*map(to_text, merged.values())]}, schema=batch.schema)

    def finish(group: pa.Table) -> pa.Table:
        sketch = np.zeros(0, np.uint64)
        for text in group.column("fingerprint").to_pylist():
            sketch = merge(sketch, from_text(text), k)
        return pa.table({key: group.column(key).slice(0, 1), "fingerprint": [to_text(sketch)]})

    return sketched.select(key, "fingerprint").mapInArrow(tidy(fold), schema).groupBy(key).applyInArrow(finish, schema)


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (part, borrowed, doc_id, text) such that, with each part sorted, every row of a part but its
    last is followed by its successor in descending doc_id; the last, borrowed, is the first of the next
    part (of the first part, after the end).

    Parts are ranges of doc_id between approximate quantiles; only those (at most ``MOST_PARTS``) and each
    part's largest id go to the driver, and each text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    ids = rows.select("k")
    n = ids.count()
    parts = min(MOST_PARTS, max(1, -(-n // PART_ROWS)))
    found = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(found or []), reverse=True)
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if cuts:
        whole = F.size(F.filter(F.lit([b[-1] for b in blocks]), lambda x: x > F.col("k")))
        rest = F.size(F.filter(F.get(F.array(*[F.lit(b) for b in blocks], F.lit([-(2**63)])), whole), lambda x: x > F.col("k")))
        part = (whole * width + rest).cast("int")
    else:
        part = F.lit(0)
    heads = sorted((r["part"], r["k"]) for r in ids.groupBy(part.alias("part")).agg(F.max("k").alias("k")).collect())
    borrow = spark.createDataFrame([(heads[(i + 1) % len(heads)][1], p) for i, (p, _) in enumerate(heads)], "k long, other int")  # at most MOST_PARTS rows
    own = F.struct(part.alias("part"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("other").alias("part"), F.lit(True).alias("borrowed"))
    placed = rows.join(F.broadcast(borrow), "k", "left").withColumn("p", F.explode(F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, lent))))
    placed = placed.select("p.part", "p.borrowed", "k", "doc_id", "text").repartition("part")
    return placed.sortWithinPartitions("part", "borrowed", F.desc("k"), F.xxhash64("text")).select("part", "borrowed", "doc_id", "text")


def compare_with_next(docs: DataFrame, n: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are by their fingerprints.

    The edited form has the last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document in descending doc_id, after the last the first; a single document is its own next.
    Null texts count as empty.  Rows with one doc_id follow each other by a hash of their texts, and rows
    without doc_id come last.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the row still without successor: part, borrowed, id, text, sketch
        for batch in batches:
            texts = batch.column(3)
            for a, b in slices(texts):
                piece = batch.slice(a, b - a)
                sketches = [s[:k] for s in shingle_sets(piece.column(3), n)]
                rows = list(zip(*(c.to_pylist() for c in piece.columns), sketches, strict=True))
                rows = rows if before is None else [before, *rows]
                pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if not x[1]]
                before = rows[-1]
                edited = [x[3][: len(x[3]) - len(x[3]) // 3] + y[3][: len(x[3]) // 3] for x, y in pairs]
                others = [s[:k] for s in shingle_sets(pa.array(edited, pa.string()), n)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": [x[2] for x, _ in pairs],
                        "n_chars": [len(x[3]) for x, _ in pairs],
                        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                        "fingerprint": [to_text(x[4]) for x, _ in pairs],
                        "edited_fingerprint": [*map(to_text, others)],
                        "near_edited": [resemblance(x[4], s, k) for (x, _), s in zip(pairs, others, strict=True)],
                        "near_next": [resemblance(x[4], y[4], k) for x, y in pairs],
                        "n_shingles": [distinct_count(x[4], k) for x, _ in pairs],
                    },
                    schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64())]),
                )

    bound_batches(docs.sparkSession)
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return with_successors(docs).mapInArrow(tidy(run), schema)
