"""Append-only records: the state they leave, what is still to do, and guarded changes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key; last write wins.  Aggregated before the shuffle, so hot keys are small."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return log.groupBy(*keys).agg(last).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*log.columns)


def undo_target(log: DataFrame, keys: list[str], order: list[str], retracted: Column) -> DataFrame:
    """The most recent record whose key is not retracted by now; at most one row."""
    standing = latest_per_key(log, keys, order).where(~retracted)
    return standing.orderBy(*(F.desc(c) for c in order), *keys).limit(1)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys on the left or the right only."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def merge_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping [start, end) ranges of a group as one; a range without end, read last of its start, reaches no further."""
    ordered = Window.partitionBy(*by).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(ordered)
    return ranges.withColumn("run", run).groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def first_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n)


def seeded_order(seed: int, *keys: str) -> Column:
    """A reproducible shuffle that needs no driver: order by this, then by the keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def without_parents(children: DataFrame, parents_gone: DataFrame, key: str, parent_key: str) -> DataFrame:
    """What a cascading delete leaves of the children."""
    gone = parents_gone.select(F.col(parent_key).alias(key)).distinct()
    return children.join(gone, key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their keys."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.select(*table.columns))
