"""A stored vector index: k-means cells, product-quantised codes, and searches that are exact or nearly so.

Cells and codebooks are fitted on at most ``SAMPLE`` vectors (by hash of the id); every vector is then
assigned to its nearest cell, with its distance to the cell's centre and a code of one byte for each slice
of the vector.  All distances are between unit vectors, where the squared Euclidean distance is twice the
cosine distance, so the triangle inequality holds; zero vectors have a cell of their own that is always read.

:func:`search` reads the codes of the cells next to a query, keeps the ``RERANK`` best by the codes and puts these
in their exact order.  :func:`search_exact` takes the distance of the last of those as a bound: cells whose
centre is further off than the bound and their radius are not read, nor are vectors multiplied whose
distance to the centre differs by more; its rows are those of :func:`retrieval.dense`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..guard import refuse, where
from .retrieval import DEPTH, QUERY_BLOCK_BYTES, _unit, check_widths, top

SAMPLE = 20_000
MOST_CELLS = 4096
SLICES = 16
WORDS = 256
RERANK = 400
PROBES = 8
ROUNDS = 12
ZERO_CELL = -1
SLACK = 1e-6
MOST_ASKED = 2048  # queries at once: a task holds a table of SLICES x WORDS and some RERANK results for each
_WHOLE = 1 << 31


@dataclass(frozen=True)
class VectorIndex:
    """vectors: (chunk_id, cell, apart, code, embedding); cells: (cell, centre, radius, n); codebook: (slice, words)."""

    vectors: DataFrame
    cells: DataFrame
    codebook: DataFrame


def k_means(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of at most ``k`` clusters; a cluster that runs empty starts again at the point furthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        label, distance = nearest(points, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(label, minlength=len(centres))
        np.add.at(sums, label, points)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        empty = np.flatnonzero(~full)
        centres[empty] = points[np.argsort(-distance, kind="stable")[: len(empty)]]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre and the squared distance to it."""
    label, distance = np.zeros(len(points), np.int64), np.zeros(len(points))
    norms = (centres**2).sum(1)
    for a in range(0, len(points), 4096):
        p = points[a : a + 4096]
        d = norms - 2 * p @ centres.T
        label[a : a + 4096] = d.argmin(1)
        distance[a : a + 4096] = np.maximum(d[np.arange(len(p)), label[a : a + 4096]] + (p**2).sum(1), 0)
    return label, distance


def _slices(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(SLICES, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), float).reshape(len(lists), -1)


def _encode(centres: np.ndarray, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            unit = _unit(_matrix(batch.column(1)))
            cell, squared = nearest(unit, centres)
            zero = ~unit.any(1)
            cell[zero] = ZERO_CELL
            codes = np.stack([nearest(unit[:, s], b)[0] for s, b in zip(_slices(unit.shape[1]), books, strict=True)], axis=1).astype(np.uint8)
            columns = [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(squared)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "cell", "apart", "code", "embedding"])

    return run


def build(vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
    """Write the index of ``vectors`` (chunk_id, embedding) to ``path`` and open it; null vectors are left out, and
    vectors of several widths refused.  By default there are as many cells as the square root of the rows, at most ``MOST_CELLS``."""
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null").select("chunk_id", "embedding")
    n = rows.count()
    kind = vectors.schema["embedding"].dataType.simpleString()
    name = vectors.schema["chunk_id"].dataType.simpleString()
    if n:
        check_widths(rows, len(rows.first()["embedding"]))
    share = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(_WHOLE)) < int(_WHOLE * SAMPLE / n))
    sample = _unit(np.array([r["embedding"] for r in share.select("embedding").collect()], float).reshape(-1, len(rows.first()["embedding"]) if n else 1))
    sample = sample[sample.any(1)]
    if not len(sample):
        sample = np.zeros((1, sample.shape[1]))
    centres = k_means(sample, min(cells or int(np.sqrt(n)) + 1, MOST_CELLS))
    books = [k_means(sample[:, s], WORDS) for s in _slices(sample.shape[1])]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = rows.mapInArrow(_encode(centres, books), f"chunk_id {name}, cell int, apart double, code binary, embedding {kind}")
    encoded.repartitionByRange(parts, "cell", "chunk_id").sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
    made = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    measured = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n"))
    made.join(measured, "cell").write.parquet(f"{path}/cells")
    spark.createDataFrame([(k, b.tolist()) for k, b in enumerate(books)], "slice int, words array<array<double>>").write.parquet(f"{path}/codebook")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("vectors", "cells", "codebook")))


def _query_blocks(queries: DataFrame) -> Iterator[tuple[DataFrame, list, np.ndarray]]:
    """The queries with a vector, their ids and unit vectors, in blocks of about ``MOST_ASKED`` and ``QUERY_BLOCK_BYTES`` at most."""
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    first = asked.first()
    if first is None:
        return
    per_block = max(1, min(MOST_ASKED, QUERY_BLOCK_BYTES // (8 * max(len(first["embedding"]), 1))))
    blocks = max(1, -(-asked.count() // per_block))
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = block.collect()
        if rows:
            yield block, [r["query_id"] for r in rows], _unit(np.array([r["embedding"] for r in rows], float))


def _cells(index: VectorIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, centres and radii of the cells that hold vectors; at most ``MOST_CELLS``."""
    rows = index.cells.orderBy("cell").collect()
    return np.array([r["cell"] for r in rows], np.int64), np.array([r["centre"] for r in rows], float), np.array([r["radius"] for r in rows])


def _in_cells(batch: pa.RecordBatch, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch by cell: the cell's place in ``numbers`` (-1 for zero vectors) and the rows."""
    cell = batch.column("cell").to_numpy(zero_copy_only=False)
    for c in np.unique(cell):
        yield (-1 if c == ZERO_CELL else int(np.searchsorted(numbers, c))), np.flatnonzero(cell == c)


class _Kept:
    """The least values of each query with their chunks (and ties with the last), over many batches."""

    def __init__(self, n: int, depth: int):
        self.n, self.depth = n, depth
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
        self.rows = 0

    def add(self, query: np.ndarray, value: np.ndarray, chunk: pa.Array, cell: pa.Array) -> None:
        self.parts.append((query, value, chunk, cell))
        self.rows += len(query)
        if self.rows > max(4 * self.depth * self.n, 1 << 16):
            self.cut()

    def cut(self) -> None:
        query, value = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        chunk, cell = (pa.concat_arrays([p[k] for p in self.parts]) for k in (2, 3))
        order = np.lexsort((value, query))
        query, value = query[order], value[order]
        first = np.searchsorted(query, np.arange(self.n))
        size = np.diff(np.append(first, len(query)))
        last = np.where(size > 0, value[np.minimum(first + np.minimum(size, self.depth) - 1, len(query) - 1)], np.inf)
        keep = value <= last[query]
        taken = pa.array(order[keep])
        self.parts = [(query[keep], value[keep], chunk.take(taken), cell.take(taken))]
        self.rows = int(keep.sum())

    def result(self, ids: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.cut()
            query, value, chunk, cell = self.parts[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), chunk, cell, pa.array(value)], ["query_id", "chunk_id", "cell", name])


def _by_codes(ids: pa.Array, queries: np.ndarray, probed: np.ndarray, numbers: np.ndarray, books: list[np.ndarray], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.stack([queries[:, s] @ np.pad(b, ((0, WORDS - len(b)), (0, 0))).T for s, b in zip(_slices(queries.shape[1]), books, strict=True)], axis=1)
        kept = _Kept(len(ids), depth)
        for batch in batches:
            for place, rows in _in_cells(batch, numbers):
                asking = np.arange(len(ids)) if place < 0 else np.flatnonzero(probed[:, place])
                code = np.frombuffer(b"".join(batch.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                for a in range(0, len(asking), 256):
                    some = asking[a : a + 256]
                    near = np.zeros((len(some), len(rows)))
                    for k in range(code.shape[1]):
                        near -= tables[some, k][:, code[:, k]]
                    edge = np.partition(near, min(depth, len(rows)) - 1, axis=1)[:, min(depth, len(rows)) - 1 : min(depth, len(rows))]
                    q, v = np.nonzero(near <= edge)
                    taken = pa.array(rows[v])
                    kept.add(some[q], near[q, v], batch.column("chunk_id").take(taken), batch.column("cell").take(taken))
        yield from kept.result(ids, "near")

    return run


def _exactly(ids: list, queries: np.ndarray):
    place = {q: k for k, q in enumerate(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = np.array([place[q] for q in batch.column("query_id").to_pylist()])
                score = np.round(1 - np.einsum("ij,ij->i", queries[at], _unit(_matrix(batch.column("embedding")))), 12)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), pa.array(score)], ["query_id", "chunk_id", "score"])

    return run


def _candidates(index: VectorIndex, queries: DataFrame, probes: int, rerank: int, depth: int) -> DataFrame:
    """(query_id, chunk_id, score): exact distances of the vectors that are best by their codes."""
    kinds = {"query_id": queries.schema["query_id"].dataType, "chunk_id": index.vectors.schema["chunk_id"].dataType}
    schema = ", ".join(f"{k} {v.simpleString()}" for k, v in kinds.items())
    nothing = queries.sparkSession.createDataFrame([], f"{schema}, score double")
    if index.vectors.isEmpty():
        return nothing
    numbers, centres, _ = _cells(index)
    books = [np.array(r["words"], float) for r in index.codebook.orderBy("slice").collect()]
    found = None
    for _, ids, unit in _query_blocks(queries):
        probed = np.zeros((len(ids), max(len(numbers), 1)), bool)
        if len(numbers):
            order = np.argsort((centres**2).sum(1) - 2 * unit @ centres.T, axis=1)[:, :probes]
            np.put_along_axis(probed, order, True, axis=1)
        read = [*numbers[probed.any(0)[: len(numbers)]].tolist(), ZERO_CELL]
        codes = index.vectors.where(F.col("cell").isin(read)).select("chunk_id", "cell", "code")
        near = codes.mapInArrow(_by_codes(pa.array(ids, to_arrow_type(kinds["query_id"])), unit, probed, numbers, books, max(rerank, depth)), f"{schema}, cell int, near double")
        best = top(near.withColumnRenamed("near", "score").withColumnRenamed("cell", "at"), "near", [F.asc("score"), F.asc("chunk_id")], max(rerank, depth))
        rows = best.select("query_id", "chunk_id").join(index.vectors.where(F.col("cell").isin(read)).select("chunk_id", "embedding"), "chunk_id")
        exact = rows.mapInArrow(_exactly(ids, unit), f"{schema}, score double")
        found = exact if found is None else found.unionByName(exact)
    return nothing if found is None else found


def search(index: VectorIndex, queries: DataFrame, depth: int = DEPTH, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """The nearest chunks of each query (query_id, embedding) among the ``rerank`` best by code in ``probes`` cells,
    in their exact order; ties by chunk_id."""
    return top(_candidates(index, queries, probes, rerank, depth), "dense", [F.asc("score"), F.asc("chunk_id")], depth)


def _within(ids: pa.Array, queries: np.ndarray, bound: np.ndarray, numbers: np.ndarray, centres: np.ndarray, radii: np.ndarray, depth: int, multiplied: Accumulator | None, all_pairs: Accumulator | None):
    zero = ~queries.any(1)
    far = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * queries @ centres.T, 0)) if len(numbers) else np.zeros((len(ids), 1))
    open_ = (far - (radii[None, :] if len(numbers) else 0) <= bound[:, None] + SLACK) | zero[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(len(ids), depth)
        for batch in batches:
            if all_pairs is not None:
                all_pairs.add(len(batch) * len(ids))
            for place, rows in _in_cells(batch, numbers):
                asking = np.arange(len(ids)) if place < 0 else np.flatnonzero(open_[:, place])
                if not len(asking):
                    continue
                apart = batch.column("apart").to_numpy(zero_copy_only=False)[rows]
                for a in range(0, len(asking), 256):
                    some = asking[a : a + 256]
                    fit = np.ones((len(some), len(rows)), bool) if place < 0 else (np.abs(far[some, place][:, None] - apart[None, :]) <= bound[some][:, None] + SLACK) | zero[some][:, None]
                    used = np.flatnonzero(fit.any(0))
                    if not len(used):
                        continue
                    vectors = _unit(_matrix(batch.column("embedding").take(pa.array(rows[used]))))
                    distance = np.where(fit[:, used], np.round(1 - queries[some] @ vectors.T, 12), np.inf)
                    if multiplied is not None:
                        multiplied.add(int(fit.sum()))
                    cut = min(depth, len(used))
                    q, v = np.nonzero((distance <= np.partition(distance, cut - 1, axis=1)[:, cut - 1 : cut]) & (distance < np.inf))
                    taken = pa.array(rows[used[v]])
                    kept.add(some[q], distance[q, v], batch.column("chunk_id").take(taken), batch.column("cell").take(taken))
        yield from kept.result(ids, "score")

    return run


def search_exact(index: VectorIndex, queries: DataFrame, depth: int = DEPTH, probes: int = PROBES, multiplied: Accumulator | None = None, all_pairs: Accumulator | None = None) -> DataFrame:
    """The rows of :func:`retrieval.dense`.  The accumulators count the pairs of query and vector that were multiplied,
    and those in the cells that some query had to read."""
    kinds = {"query_id": queries.schema["query_id"].dataType, "chunk_id": index.vectors.schema["chunk_id"].dataType}
    schema = ", ".join(f"{k} {v.simpleString()}" for k, v in kinds.items())
    numbers, centres, radii = _cells(index)
    found = None
    for block, ids, unit in _query_blocks(queries) if not index.vectors.isEmpty() else ():
        last = {r["query_id"]: r["score"] for r in search(index, block, depth, probes, depth).where(F.col("rank") == depth).select("query_id", "score").collect()}
        bound = np.array([np.sqrt(2 * max(last[q], 0)) if q in last else np.inf for q in ids])
        far = np.sqrt(np.maximum(1 + (centres**2).sum(1)[None, :] - 2 * unit @ centres.T, 0)) if len(numbers) else np.zeros((len(ids), 0))
        read = numbers[((far - radii[None, :] <= bound[:, None] + SLACK) | ~unit.any(1)[:, None]).any(0)] if len(numbers) else numbers
        rows = index.vectors.where(F.col("cell").isin([*read.tolist(), ZERO_CELL])).select("chunk_id", "cell", "apart", "embedding")
        run = _within(pa.array(ids, to_arrow_type(kinds["query_id"])), unit, bound, numbers, centres, radii, depth, multiplied, all_pairs)
        part = rows.mapInArrow(run, f"{schema}, cell int, score double").drop("cell")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], f"{schema}, score double")
    return top(found, "dense", [F.asc("score"), F.asc("chunk_id")], depth)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, found, n, recall): how many of the exact results of each query the other ranking has."""
    hit = exact.select("query_id", "chunk_id").join(approximate.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("n")).withColumn("recall", F.col("found") / F.col("n"))


def unassigned(index: VectorIndex, vectors: DataFrame) -> None:
    """Refuse an index that lacks a vector of ``vectors``."""
    missing = vectors.where("embedding is not null").join(index.vectors.select("chunk_id"), "chunk_id", "left_anti")
    refuse(where(missing, F.lit(True), F.concat(F.lit("not in the index: "), F.col("chunk_id").cast("string"))))
