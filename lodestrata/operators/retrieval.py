"""Retrieval arms: each returns long rankings (query_id, arm, rank, chunk_id, score).

Questions come in batches.  Every order has a unique last key, so results are the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import lexemes
from ..guard import refuse, where
from ..intermediate import materialise
from .percentiles import exact_percentiles

DEPTH = 50
RRF_K = 60
QUERY_BLOCK_BYTES = 32 << 20
MOST_TERMS_SENT = 1_000_000


def postings(chunks: DataFrame, words: Column | None = None) -> DataFrame:
    """(chunk_id, lexeme, tf): the inverted index as a table; write it once, by lexeme, to search it often.

    Texts are dealt out by chunk once; counting, matching with queries and adding up by (query, chunk) then
    need no further shuffle.  The parts are as many as the session says, as few large ones would be slow.
    """
    words = lexemes(F.col("text")) if words is None else words
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select("chunk_id", words.alias("words")).repartition(parts, "chunk_id")
    return dealt.select("chunk_id", F.explode("words").alias("lexeme")).groupBy("chunk_id", "lexeme").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, words: Column | None = None) -> DataFrame:
    """(query_id, lexeme): the distinct lexemes of each query."""
    words = lexemes(F.col("query")) if words is None else words
    return queries.select("query_id", F.explode(F.array_distinct(words)).alias("lexeme"))


def lexeme_frequency(index: DataFrame) -> DataFrame:
    """(lexeme, ndoc, nentry): chunks and positions of each lexeme."""
    return index.groupBy("lexeme").agg(F.count(F.lit(1)).alias("ndoc"), F.sum("tf").alias("nentry"))


def top(scored: DataFrame, arm: str, order: list[Column], depth: int = DEPTH) -> DataFrame:
    """The first ``depth`` rows of each query; Spark cuts each partition to as many before the shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= depth).select("query_id", F.lit(arm).alias("arm"), "rank", "chunk_id", "score")


def _sent(terms: DataFrame) -> DataFrame:
    """Query terms as the small side of a join where there are at most ``MOST_TERMS_SENT``, counted here: then
    a frequent lexeme is no hot key, and no task gets the postings of all queries that hold it."""
    few = terms.limit(MOST_TERMS_SENT + 1).count() <= MOST_TERMS_SENT
    return F.broadcast(terms) if few else terms


def sparse(index: DataFrame, terms: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Matching positions of any query lexeme, a tenth of a point each; ties by chunk_id."""
    hits = index.join(_sent(terms), "lexeme").groupBy("query_id", "chunk_id").agg(F.sum("tf").cast("long").alias("positions"))
    return top(hits.withColumn("score", F.round(F.col("positions") * 0.1, 1)), "sparse", [F.desc("positions"), F.asc("chunk_id")], depth)


def matching(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id) with any lexeme in common."""
    return index.join(_sent(terms), "lexeme").select("query_id", "chunk_id").distinct()


def check_widths(vectors: DataFrame, width: int) -> None:
    """Refuse vectors that are null or of another width."""
    refuse(where(vectors, F.col("embedding").isNull() | (F.size("embedding") != width), F.concat(F.lit("vector of another width than "), F.lit(str(width)), F.lit(": "), F.col("chunk_id").cast("string"))))


def dense(vectors: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The nearest chunks by cosine distance, exactly; ties by chunk_id.

    vectors: (chunk_id, embedding); queries: (query_id, embedding).  Queries go to the tasks in blocks of a
    fixed number of bytes; each task multiplies batches of vectors with a block, keeps its first ``depth``
    for each query, and returns those at its end.
    """
    kind = vectors.schema["chunk_id"].dataType
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    first = asked.first()
    scored = None
    if first is not None:
        per_block = max(1, QUERY_BLOCK_BYTES // (8 * max(len(first["embedding"]), 1)))
        blocks = max(1, -(-asked.count() // per_block))
        for b in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            if not rows:
                continue
            matrix = np.array([r["embedding"] for r in rows], float)
            found = vectors.where("embedding is not null").select("chunk_id", "embedding").mapInArrow(_nearest(pa.array([r["query_id"] for r in rows], to_arrow_type(queries.schema["query_id"].dataType)), _unit(matrix), depth), f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kind.simpleString()}, score double")
            scored = found if scored is None else scored.union(found)
    if scored is None:
        name = queries.schema["query_id"].dataType.simpleString()
        scored = queries.sparkSession.createDataFrame([], f"query_id {name}, chunk_id {kind.simpleString()}, score double")
    return top(scored, "dense", [F.asc("score"), F.asc("chunk_id")], depth)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return matrix / np.where(norm > 0, norm, 1)


def _nearest(ids: pa.Array, queries: np.ndarray, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # queries' places and distances, of the chunks below
        chunks: list[pa.Array] = []
        rows = 0

        def cut() -> None:
            """Of all that is kept only the first ``depth`` of each query, and ties with the last of them."""
            nonlocal rows
            q, distance = (np.concatenate(x) for x in zip(*kept, strict=True))
            every = pa.concat_arrays(chunks)
            order = np.lexsort((distance, q))
            q, distance = q[order], distance[order]
            first = np.searchsorted(q, np.arange(len(ids)))
            size = np.diff(np.append(first, len(q)))
            last = np.where(size > 0, distance[np.minimum(first + np.minimum(size, depth) - 1, len(q) - 1)], np.inf)
            keep = distance <= last[q]
            kept[:], chunks[:] = [(q[keep], distance[keep])], [every.take(pa.array(order[keep]))]
            rows = int(keep.sum())

        for batch in batches:
            lists = batch.column(1)
            vectors = _unit(np.asarray(lists.flatten(), float).reshape(batch.num_rows, -1))
            for a in range(0, len(ids), 256):
                distance = np.round(1 - queries[a : a + 256] @ vectors.T, 12)
                k = min(depth, batch.num_rows)
                edge = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
                q, c = np.nonzero(distance <= edge)  # ties at the cut stay, for the order by chunk_id
                kept.append((a + q, distance[q, c]))
                chunks.append(batch.column(0).take(pa.array(c)))
                rows += len(q)
            if rows > 4 * depth * len(ids):
                cut()
        if kept:
            cut()
            (q, distance), found = kept[0], chunks[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), found, pa.array(distance)], names=["query_id", "chunk_id", "score"])

    return run


def fuse(rankings: DataFrame, arm: str = "hybrid", k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of the arms in ``rankings``: sum of 1 / (k + rank) over the first ``depth``.

    A chunk that an arm names twice counts once, at its best rank; ranks close up.  Ties by chunk_id; the
    result is not cut.
    """
    best = rankings.groupBy("query_id", "arm", "chunk_id").agg(F.min("rank").alias("rank"))
    again = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "arm").orderBy("rank", "chunk_id"))).where(F.col("rank") <= depth)
    scored = again.groupBy("query_id", "chunk_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))
    return scored.select("query_id", F.lit(arm).alias("arm"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")).alias("rank"), "chunk_id", "score")


def gate(queries: DataFrame, terms: DataFrame, sparse_ranking: DataFrame, taus: DataFrame) -> DataFrame:
    """(query_id, L, s1, tau, fires): whether the lexical arm has no handle on a query.

    taus: (L, tau).  Without lexemes tau is 0 and the gate fires; a length that was not measured is refused.
    """
    counted = terms.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("L"))
    best = sparse_ranking.where("rank = 1").select("query_id", F.col("score").alias("s1"))
    out = queries.select("query_id").distinct().join(counted, "query_id", "left").join(best, "query_id", "left").fillna({"L": 0, "s1": 0.0}).join(F.broadcast(taus), "L", "left")
    refuse(where(out, F.col("tau").isNull() & (F.col("L") > 0), F.concat(F.lit("no threshold was measured for "), F.col("L").cast("string"), F.lit(" lexemes"))))
    tau = F.coalesce("tau", F.lit(0.0))
    return out.select("query_id", "L", "s1", tau.alias("tau"), (F.col("s1") <= tau).alias("fires"))


def gated(sparse_ranking: DataFrame, dense_ranking: DataFrame, gates: DataFrame) -> DataFrame:
    """Fusion of the dense arm alone where the gate fires, and of both arms elsewhere."""
    votes = sparse_ranking.join(gates.where(~F.col("fires")).select("query_id"), "query_id", "left_semi").unionByName(dense_ranking)
    return fuse(votes, "gated")


def draw_bags(vocabulary: list[tuple[str, int]], sizes: list[int], bags: int = 1000, seed: int = 20260820) -> list[tuple[int, int, str]]:
    """(L, bag, lexeme) from a vocabulary small enough for a list; :func:`draw_bags_in_spark` takes any."""
    import random
    from itertools import accumulate

    rng = random.Random(seed)
    words, cumulated = [w for w, _ in vocabulary], list(accumulate(n for _, n in vocabulary))
    out = []
    for size in sorted(sizes):
        if size > len(words):
            raise ValueError(f"{size} distinct lexemes from a vocabulary of {len(words)}")
        for bag in range(bags):
            chosen: dict[str, None] = {}
            while len(chosen) < size:
                chosen[rng.choices(words, cum_weights=cumulated, k=1)[0]] = None
            out += [(size, bag, w) for w in chosen]
    return out


def draw_bags_in_spark(frequency: DataFrame, sizes: DataFrame, bags: int = 1000, seed: int = 20260820) -> DataFrame:
    """(L, bag, lexeme): bags of L distinct lexemes of ``frequency`` (lexeme, ndoc), drawn in proportion to
    their document frequency, for each L of ``sizes``.

    Numbers below the sum of ndoc are drawn by hash and joined by bucket to the lexemes' ranges; each bag
    takes its first L different lexemes, and bags that lack some are drawn further.
    """
    spark = frequency.sparkSession
    parts = frequency.select("lexeme", F.col("ndoc").cast("long").alias("ndoc")).repartitionByRange("lexeme").withColumn("part", F.spark_partition_id())
    parts = materialise(parts, "vocabulary")
    sums = parts.groupBy("part").agg(F.sum("ndoc").alias("n"), F.count(F.lit(1)).alias("words")).orderBy("part").collect()  # one row for each partition
    total, words = sum(r["n"] for r in sums), sum(r["words"] for r in sums)
    refuse(where(sizes, F.col("L") > words, F.concat(F.col("L").cast("string"), F.lit(f" distinct lexemes from a vocabulary of {words}"))))
    before, offsets = 0, []
    for r in sums:
        offsets.append((r["part"], before))
        before += r["n"]
    running = F.sum("ndoc").over(Window.partitionBy("part").orderBy("lexeme"))
    placed = parts.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").withColumn("end", F.col("before") + running).withColumn("start", F.col("end") - F.col("ndoc"))
    width = max(1, total * 8 // max(words, 1))
    ranges = placed.select("lexeme", "start", "end", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("bucket"))
    ranges = materialise(ranges, "ranges")
    asked = sizes.select(F.col("L").cast("int").alias("L")).where("L > 0").distinct().withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    lacking, drawn, first, factor = asked, None, 0, 2
    while True:
        numbers = lacking.withColumn("i", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first) + F.col("L").cast("long") * factor - 1)))
        numbers = numbers.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "L", "bag", "i"), F.lit(total)))
        found = numbers.withColumn("bucket", F.expr(f"u div {width}")).join(ranges, "bucket").where("u >= start and u < end").select("L", "bag", "lexeme", "i")
        drawn = materialise((found if drawn is None else drawn.unionByName(found)).groupBy("L", "bag", "lexeme").agg(F.min("i").alias("i")), "drawn")
        lacking = materialise(asked.join(drawn.groupBy("L", "bag").count(), ["L", "bag"]).where("count < L").select("L", "bag"), "lacking")
        if lacking.isEmpty():
            break
        first, factor = first + (1 << 32), factor * 2  # further numbers come after all earlier ones
    rank = F.row_number().over(Window.partitionBy("L", "bag").orderBy("i"))
    return materialise(drawn.withColumn("rank", rank).where("rank <= L").select("L", "bag", "lexeme"), "bags")


def bag_scores(index: DataFrame, bags: DataFrame) -> DataFrame:
    """(L, bag, s): the best lexical score of each bag of ``bags`` (L, bag, lexeme), 0 where nothing matches."""
    best = index.join(_sent(bags), "lexeme").groupBy("L", "bag", "chunk_id").agg(F.sum("tf").alias("n")).groupBy("L", "bag").agg((F.max("n") * 0.1).alias("s"))
    return bags.select("L", "bag").distinct().join(best, ["L", "bag"], "left").fillna({"s": 0.0})


def null_summary(scores: DataFrame, percentile: float = 0.95) -> DataFrame:
    """(L, bags, tau, min, median, mean, max, zero_scoring_bags); tau is the nearest-rank percentile, by radix selection."""
    taus = exact_percentiles(scores, ["L"], "s", (percentile,)).select("L", F.round("value", 1).alias("tau"))
    rest = scores.groupBy("L").agg(F.count(F.lit(1)).alias("bags"), F.min("s").alias("min"), F.median("s").alias("median"), F.avg("s").alias("mean"), F.max("s").alias("max"), F.count_if(F.col("s") == 0).alias("zero_scoring_bags"))
    return rest.join(taus, "L").select("L", "bags", "tau", "min", "median", "mean", "max", "zero_scoring_bags")


def null_thresholds(index: DataFrame, sizes: DataFrame, bags: int = 1000, seed: int = 20260820, percentile: float = 0.95) -> DataFrame:
    """tau(L) for each L of ``sizes``: the percentile of the best lexical score of random bags."""
    return null_summary(bag_scores(index, draw_bags_in_spark(lexeme_frequency(index), sizes, bags, seed)), percentile)


def gate_counts(gates: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, fired, n): how often the gate fired among the queries of each stratum."""
    return gates.join(strata.select("query_id", "stratum"), "query_id").groupBy("stratum").agg(F.count_if("fires").alias("fired"), F.count(F.lit(1)).alias("n"))


def choose_arm(arm: str, sparse_ranking: DataFrame, dense_ranking: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """The ranking of the arm that is asked for by name, over the arms' recorded rankings."""
    both = sparse_ranking.unionByName(dense_ranking)
    if arm not in ("sparse", "dense", "hybrid", "gated") or arm == "gated" and gates is None:
        raise ValueError(f"no arm {arm}" if gates is not None or arm != "gated" else "the gated arm needs gates")
    return {"sparse": lambda: sparse_ranking, "dense": lambda: dense_ranking, "hybrid": lambda: fuse(both), "gated": lambda: gated(sparse_ranking, dense_ranking, gates)}[arm]()


def call_batches(items: DataFrame, most: int = 200, most_tokens: int = 100_000) -> DataFrame:
    """``items`` (id, tokens) with batch: greedy batches within each partition, a large item alone."""
    from pyspark.sql import types as T

    schema = T.StructType([*items.schema.fields, T.StructField("batch", T.LongType())])
    at = items.columns.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_no, n, total = 0, 0, 0
        for batch in batches:
            numbers = []
            for tokens in batch.column(at).to_pylist():
                if n and (n >= most or total + tokens > most_tokens):
                    batch_no, n, total = batch_no + 1, 0, 0
                n, total = n + 1, total + tokens
                numbers.append(batch_no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=schema.names)

    return items.mapInArrow(run, schema)
