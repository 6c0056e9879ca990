"""Intervals and paired tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}
REPORTABLE = 25


def wilson(hits: Column, n: Column, confidence: float = 0.95, strict: bool = False) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval, within [0, 1]; null where n = 0.

    Strict: bad counts are refused inside the plan.
    """
    z = Z[confidence]
    hits, n = hits.cast("double"), n.cast("double")
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bad = (n <= 0) | (hits < 0) | (hits > n)
    wrap = lambda c: F.when(bad, F.raise_error(F.lit("a rate needs 0 <= hits <= n and n > 0")).cast("double") if strict else F.lit(None)).otherwise(c)
    return wrap(F.greatest(F.lit(0.0), middle - half)), wrap(F.least(F.lit(1.0), middle + half))


def rate_columns(hits: str, n: str, confidence: float = 0.95) -> list[Column]:
    """hits, n, rate, lo, hi, reportable."""
    h, m = F.col(hits), F.col(n)
    lo, hi = wilson(h, m, confidence)
    return [h, m, F.when(m > 0, h / m).alias("rate"), lo.alias("lo"), hi.alias("hi"), (m >= REPORTABLE).alias("reportable")]


def nearest_rank(c: Column, p: float) -> Column:
    """The nearest-rank percentile: a value that was observed."""
    return F.sort_array(F.collect_list(c))[F.greatest(F.ceil(F.count(c) * p) - 1, F.lit(0)).cast("int")]


def established(lo: Column, hi: Column) -> Column:
    """A direction is established where the interval leaves one half out."""
    return F.coalesce((lo > 0.5) | (hi < 0.5), F.lit(False))
