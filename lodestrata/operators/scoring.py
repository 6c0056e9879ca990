"""Scores of retrieval: hit rate at k by arm and stratum, and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import established, rate_columns, wilson
from ..guard import refuse

KS = (1, 3, 5, 10)


def hits_at_k(rankings: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, stratum, arm, k, hit) for each query with gold, each arm and each k.

    An empty ranking is a miss; a query without gold has no row.
    """
    best = rankings.join(gold, ["query_id", "chunk_id"]).groupBy("query_id", "arm").agg(F.min("rank").alias("best"))
    arms = sorted(r["arm"] for r in rankings.select("arm").distinct().collect())  # a handful of names
    grid = queries.select("query_id", "stratum").join(gold.select("query_id").distinct(), "query_id").withColumn("arm", F.explode(F.array(*map(F.lit, arms)).cast("array<string>")))
    scored = grid.join(best, ["query_id", "arm"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return scored.select("query_id", "stratum", "arm", "k", F.coalesce(F.col("best") <= F.col("k"), F.lit(False)).alias("hit"))


def recall(hits: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(arm, k, stratum, hits, n, rate, lo, hi, reportable), with stratum 'pooled' over all."""
    counted = hits.groupingSets([["arm", "k"], ["arm", "k", "stratum"]], "arm", "k", "stratum").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.grouping("stratum").alias("pooled"))
    named = counted.withColumn("stratum", F.when(F.col("pooled") == 1, "pooled").otherwise(F.col("stratum")))
    return named.select("arm", "k", "stratum", *rate_columns("hits", "n", confidence))


def mcnemar(outcomes: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Paired comparison of every two arms: b, c, discordant, concordant, n, rate, lo, hi, established.

    outcomes: (query_id, arm, hit) and the columns ``by``.  Arms that were not asked the same queries are
    refused.
    """
    a = outcomes.select("query_id", *by, F.col("arm").alias("arm_a"), F.col("hit").alias("x"))
    b = outcomes.select("query_id", *by, F.col("arm").alias("arm_b"), F.col("hit").alias("y"))
    sizes = outcomes.groupBy("arm", *by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("d"))
    paired = a.join(b, ["query_id", *by]).where("arm_a < arm_b").groupBy("arm_a", "arm_b", *by).agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"), F.count(F.lit(1)).alias("n"))
    other = sizes.groupBy(*by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("d")).alias("again")) if by else sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("d")).alias("again"))
    refuse(other.where("least <> most or again > 0").select(F.lit("the arms were not asked the same queries").alias("problem")))
    d = F.col("b") + F.col("c")
    lo, hi = wilson(F.col("b"), d, confidence)
    return paired.select("arm_a", "arm_b", *by, "b", "c", d.alias("discordant"), (F.col("n") - d).alias("concordant"), "n", F.when(d > 0, F.col("b") / d).alias("rate"), lo.alias("lo"), hi.alias("hi"), established(lo, hi).alias("established"))


def contexts(rankings: DataFrame, k: int = 5, strict: bool = True) -> DataFrame:
    """(query_id, arm, ids): the first k chunks in order; a shorter list is refused."""
    first = rankings.where(F.col("rank") <= k).groupBy("query_id", "arm").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))
    out = first.select("query_id", "arm", F.transform("r", lambda x: x["chunk_id"].cast("string")).alias("ids"))
    if strict:
        refuse(out.where(F.size("ids") < k).select(F.format_string("%s of %s has fewer chunks than the context holds", F.col("arm"), F.col("query_id").cast("string")).alias("problem")))
    return out


def calls(context: DataFrame) -> DataFrame:
    """(call_id, query_id, ids, arms): one call for each distinct context of a query."""
    from ..functions.text import call_id

    return context.groupBy("query_id", "ids").agg(F.array_sort(F.collect_set("arm")).alias("arms")).select(call_id(F.col("query_id").cast("string"), F.col("ids")).alias("call_id"), "query_id", "ids", "arms")
