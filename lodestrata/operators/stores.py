"""Measures of a chunk store and the checks before it is written or read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..guard import duplicates, where
from .percentiles import exact_percentiles


def measure(chunks: DataFrame) -> DataFrame:
    """One row: chunks, filings, tokens, rows without text."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("accession").alias("filings"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.count_if(F.col("text").isNull()).alias("without_text"))


def by_item(chunks: DataFrame, item: str = "item") -> DataFrame:
    return chunks.groupBy(item).agg(F.count(F.lit(1)).alias("chunks"))


def token_distribution(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: total, nearest-rank percentiles (exact, by radix selection), largest."""
    found = exact_percentiles(chunks.select(F.col(tokens).cast("long").alias("tokens")), [], "tokens", (0.5, 0.75, 0.95))
    at = lambda p: F.max(F.when(F.col("share") == p, F.col("value")))
    cuts = found.agg(at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.95).alias("p95"))
    whole = chunks.agg(F.sum(tokens).cast("long").alias("total"), F.max(tokens).alias("largest"))
    both = whole.unionByName(cuts, allowMissingColumns=True)  # one row and one row
    return both.agg(*(F.max(c).alias(c) for c in ("total", "p50", "p75", "p95", "largest")))


def token_coverage(chunks: DataFrame, filings: DataFrame, least: float = 1.0, most: float = 1.5) -> DataFrame:
    """(accession, stored, stated, ratio) of the filings outside the band."""
    stored = chunks.groupBy("accession").agg(F.sum("tokens").cast("long").alias("stored"))
    ratio = F.col("stored") / F.col("stated")
    return filings.select("accession", F.col("tokens").alias("stated")).join(stored, "accession", "left").fillna({"stored": 0}).withColumn("ratio", ratio).where(~F.col("ratio").between(least, most))


def duplicate_texts(chunks: DataFrame) -> DataFrame:
    """(digest, copies, filings) of texts that stand more than once; by digest, so long texts aren't moved."""
    return chunks.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("accession").alias("filings")).where("copies > 1")


def store_problems(chunks: DataFrame, most_tokens: int = 512) -> list[DataFrame]:
    """Repeated ids, empty texts, and chunks over the size that hold more than one block."""
    name = F.col("chunk_id").cast("string")
    return [
        duplicates(chunks, ["chunk_id"], "chunk"),
        where(chunks, F.coalesce(F.trim("text"), F.lit("")) == "", F.concat(F.lit("empty chunk "), name)),
        where(chunks, (F.col("tokens") > most_tokens) & F.contains("text", F.lit("\n")), F.concat(F.lit("oversized chunk "), name)),
    ]
