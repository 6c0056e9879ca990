"""Frozen query sets and the checks of a run against what it was registered with.

Each check returns a frame of one ``problem`` column, for :func:`lodestrata.guard.refuse`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..guard import duplicates
from .logs import latest_per_key


def composition(queries: DataFrame) -> DataFrame:
    """(stratum, queries, answerable)."""
    return queries.groupBy("stratum").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.coalesce(F.size("gold"), F.lit(0)) > 0).alias("answerable"))


def approvals(decisions: DataFrame, hashes: DataFrame) -> DataFrame:
    """(query_id, sha256, approved, stale): the last decision on each query, bound to the text it was made on.

    decisions: (query_id, verdict, query_sha256, decided_at); a query without a decision is not approved, and
    one whose text has changed since has to be decided again.
    """
    last = latest_per_key(decisions.select("query_id", "verdict", "query_sha256", "decided_at"), ["query_id"], ["decided_at"])
    same = F.col("query_sha256") == F.col("sha256")
    joined = hashes.join(last, "query_id", "left")
    approved = F.coalesce((F.col("verdict") == "approved") & same, F.lit(False))
    return joined.select("query_id", "sha256", approved.alias("approved"), F.coalesce(~same, F.lit(False)).alias("stale"))


def verdict_counts(decisions: DataFrame) -> DataFrame:
    """(verdict, n, ambiguous) of the last decision on each query."""
    last = latest_per_key(decisions, ["query_id"], ["decided_at"])
    return last.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"))


def moved(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """(query_id, how): queries of which the live record isn't the frozen one: changed, removed or added."""
    both = frozen.select("query_id", F.col("sha256").alias("was")).join(live.select("query_id", F.col("sha256").alias("now")), "query_id", "full_outer")
    how = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return both.select("query_id", how.alias("how")).where("how is not null")


def freeze_problems(frozen: DataFrame, digest: str, live: DataFrame, own_digest: str, decided: DataFrame) -> list[DataFrame]:
    """What keeps a frozen set from being used: its own digest first, then what has moved since, then what
    nobody approved.  digest is the recorded one, own_digest that of ``frozen`` as it was read."""
    spark = frozen.sparkSession
    own = spark.createDataFrame([] if digest == own_digest else [("the frozen set isn't what its digest was made of",)], "problem string")
    name = F.col("query_id").cast("string")
    return [
        own,
        moved(frozen, live).select(F.concat(F.col("how"), F.lit(" since the freeze: "), name).alias("problem")),
        frozen.join(decided.where("approved"), "query_id", "left_anti").select(F.concat(F.lit("not approved: "), name).alias("problem")),
    ]


def run_problems(rankings: DataFrame, chunks: DataFrame, queries: DataFrame, arms: list[str]) -> list[DataFrame]:
    """Ids that the store doesn't hold, ids that stand twice in a ranking, and queries without a ranking."""
    named = F.concat_ws(" of ", "arm", F.col("query_id").cast("string"))
    unknown = rankings.join(chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = queries.select("query_id").distinct().withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    missing = wanted.join(rankings.select("query_id", "arm").distinct(), ["query_id", "arm"], "left_anti")
    return [
        unknown.select(F.concat(F.lit("the store has no chunk "), F.col("chunk_id").cast("string")).alias("problem")),
        duplicates(rankings, ["query_id", "arm", "chunk_id"], "ranked chunk"),
        missing.select(F.concat(F.lit("no ranking: "), named).alias("problem")),
    ]


def gated_problems(gates: DataFrame, gated: DataFrame, fused: DataFrame, dense: DataFrame) -> DataFrame:
    """Gated rankings that aren't the dense ranking where the gate fired, nor the fused one elsewhere, and
    queries that only one side has."""
    order = lambda df, name: df.groupBy("query_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), "|"), 256).alias(name))
    rows = gates.select("query_id", "fires").join(order(gated, "own"), "query_id", "full_outer").join(order(fused, "f"), "query_id", "left").join(order(dense, "d"), "query_id", "left")
    name = F.col("query_id").cast("string")
    what = F.when(F.col("fires").isNull(), "no gate decision for ").when(F.col("own").isNull(), "no gated ranking for ").when(F.col("own") != F.when(F.col("fires"), F.col("d")).otherwise(F.col("f")), "the gated ranking isn't its arm's: ")
    return rows.where(what.isNotNull()).select(F.concat(what, name).alias("problem"))


def pinned_problems(artifacts: DataFrame, pins: DataFrame) -> DataFrame:
    """Artifacts (name, sha256) whose digest isn't the pinned one, or that are missing."""
    both = pins.select("name", F.col("sha256").alias("want")).join(artifacts.select("name", F.col("sha256").alias("have")), "name", "left")
    return both.where(~F.col("want").eqNullSafe(F.col("have"))).select(F.concat(F.when(F.col("have").isNull(), "missing: ").otherwise("another digest: "), F.col("name")).alias("problem"))


def resume_problems(done: DataFrame, planned: DataFrame, keys: list[str], digest: str) -> list[DataFrame]:
    """What forbids to go on with a run: records of calls that aren't planned, recorded twice, or whose input
    (column ``digest``) has changed since."""
    name = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    changed = done.select(*keys, F.col(digest).alias("then")).join(planned.select(*keys, F.col(digest).alias("now")), keys).where("then <> now")
    return [
        done.join(planned.select(*keys), keys, "left_anti").select(F.concat(F.lit("not planned: "), name).alias("problem")),
        duplicates(done, keys, "record"),
        changed.select(F.concat(F.lit("asked with another input: "), name).alias("problem")),
    ]


def conditioned(contexts: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, arm, answerable, gold_in_context): whether the recorded context of an arm holds gold."""
    has = gold.select("query_id").distinct().withColumn("answerable", F.lit(True))
    listed = contexts.select("query_id", "arm", F.explode("ids").alias("id")).join(gold.select("query_id", F.col("chunk_id").cast("string").alias("id")), ["query_id", "id"]).select("query_id", "arm").distinct().withColumn("inside", F.lit(True))
    rows = contexts.select("query_id", "arm").join(queries.select("query_id"), "query_id").join(has, "query_id", "left").join(listed, ["query_id", "arm"], "left")
    return rows.select("query_id", "arm", F.coalesce("answerable", F.lit(False)).alias("answerable"), F.coalesce("inside", F.lit(False)).alias("gold_in_context"))


def control_problems(split: DataFrame, published: dict[str, int]) -> DataFrame:
    """Arms whose number of queries with gold in context isn't the published one."""
    spark = split.sparkSession
    want = spark.createDataFrame(sorted(published.items()), "arm string, want long")
    have = split.groupBy("arm").agg(F.count_if("gold_in_context").alias("have"))
    return want.join(have, "arm", "full_outer").where(~F.col("want").eqNullSafe(F.col("have"))).select(F.format_string("%s: gold in context of %s queries, %s published", "arm", F.col("have").cast("string"), F.col("want").cast("string")).alias("problem"))


def prompt_fingerprint(*parts: Column) -> Column:
    """A digest of a prompt's parts, each with its length, so that parts cannot run into each other."""
    return F.sha2(F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p, F.lit("\n")) for p in parts)), 256)
