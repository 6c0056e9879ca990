"""Exact nearest-rank percentiles by radix selection.

Values become 64-bit keys in the same order.  Each round counts, for every group and percentile, the next
``DIGIT`` bits of the keys that share the bits found so far, and takes the digit in which the wanted rank
falls; after the last round the key is the value.  A task never holds more than the counts of 2 ** DIGIT
digits of a group, however many distinct values there are, and rows are added up before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from ..intermediate import materialise

DIGIT = 16
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)
_NAN = int(np.array([np.nan]).view(np.int64)[0])  # Arrow would make it null


def _fold(bits: np.ndarray) -> np.ndarray:
    """Of negative numbers all bits but the sign are turned, which also turns them back."""
    return np.where(bits < 0, bits ^ _LOW, bits)


def _to_keys(values: pd.Series) -> pd.Series:
    plain = values.to_numpy(float) + 0.0  # one zero
    return pd.Series(_fold(np.where(np.isnan(plain), np.nan, plain).view(np.int64)))  # one NaN


def _from_keys(keys: pd.Series) -> pd.Series:
    return pd.Series(_fold(keys.to_numpy(np.int64)).view(float))


def _rank(n: Column, p: float) -> Column:
    """The nearest rank, in decimals: a share of rows that is whole is not rounded up by a float's last bit."""
    return F.greatest(F.lit(1), F.ceil(F.expr(f"CAST('{p}' AS DECIMAL(18,12))") * n.cast("decimal(20,0)"))).cast("long")


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by..., share, value): for each group the observed value at each of ``shares`` (0 to 1); nulls don't count, NaN is
    the largest, and groups without a value have no row.  Integers come back as long, others as double."""
    whole = isinstance(rows.schema[value].dataType, IntegralType)
    if not whole and not isinstance(rows.schema[value].dataType, DoubleType | FloatType):
        raise TypeError(f"percentiles of {rows.schema[value].dataType.simpleString()}")
    key = F.col(value).cast("long") if whole else F.pandas_udf(_to_keys, "long")(F.col(value).cast("double"))
    keyed = rows.where(F.col(value).isNotNull()).select(*by, key.alias("key")).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("times"))
    keyed = materialise(keyed, "keys")  # rows of one value are one row from here on
    groups = keyed.groupBy(*by).agg(F.sum("times").alias("n"))
    wanted = F.array(*(F.struct(F.lit(float(p)).alias("share"), _rank(F.col("n"), p).alias("rank")) for p in shares))
    targets = groups.select(*by, F.explode(wanted).alias("w")).select(*by, "w.share", "w.rank", F.lit(0).cast("long").alias("prefix"))
    for left in range(64 - DIGIT, -1, -DIGIT):
        targets = materialise(targets, "targets")
        before = F.shiftright("key", left + DIGIT) if left + DIGIT < 64 else F.lit(0).cast("long")
        sought = targets.select(*by, "prefix").distinct()
        read = keyed.select(*by, before.alias("prefix"), F.shiftright("key", left).alias("next"), "times")
        counts = _join(read, sought, [*by, "prefix"]).groupBy(*by, "prefix", "next").agg(F.sum("times").alias("times"))
        order = Window.partitionBy(*by, "share").orderBy("next")
        placed = _join(targets, counts, [*by, "prefix"]).withColumn("upto", F.sum("times").over(order))
        found = placed.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("times") < F.col("rank")))
        targets = found.select(*by, "share", (F.col("rank") - F.col("upto") + F.col("times")).alias("rank"), F.col("next").alias("prefix"))
    result = F.col("prefix") if whole else F.when(F.col("prefix") == _NAN, F.lit(float("nan"))).otherwise(F.pandas_udf(_from_keys, "double")(F.col("prefix")))
    return targets.select(*by, "share", result.alias("value"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join that takes null groups for equal."""
    renamed = right.select(*(F.col(c).alias(f"right_{c}") if c in keys else F.col(c) for c in right.columns))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"right_{c}"))
    return left.join(renamed, on).drop(*(f"right_{c}" for c in keys))
