"""Refusals: a run stops with every problem named, instead of going on with a plausible number."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 20


class Refused(ValueError):
    """Raised with all problems that were found."""

    def __init__(self, problems: Iterable[str]):
        self.problems = list(problems)
        super().__init__("\n".join(self.problems))


def refuse(*problems: DataFrame) -> None:
    """Raise if any of the frames of one ``problem`` column has rows; at most SHOWN of each are shown."""
    found: list[str] = []
    for frame in problems:
        rows = [r[0] for r in frame.limit(SHOWN + 1).collect()]
        found += rows[:SHOWN] + (["... and more"] if len(rows) > SHOWN else [])
    if found:
        raise Refused(found)


def where(df: DataFrame, bad: Column, message: Column | str) -> DataFrame:
    """The problems of the rows for which ``bad`` holds."""
    return df.where(bad).select((message if isinstance(message, Column) else F.lit(message)).alias("problem"))


def duplicates(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """A problem for each key that stands more than once."""
    name = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    return df.groupBy(*keys).count().where("count > 1").select(F.concat(F.lit(f"{what} "), name, F.lit(" stands "), F.col("count").cast("string"), F.lit(" times")).alias("problem"))


def coverage(expected: DataFrame, found: DataFrame, keys: list[str], what: str) -> DataFrame:
    """A problem for each key on one side only."""
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    name = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    missing = a.join(b, keys, "left_anti").select(F.concat(F.lit(f"missing {what}: "), name).alias("problem"))
    return missing.union(b.join(a, keys, "left_anti").select(F.concat(F.lit(f"unexpected {what}: "), name).alias("problem")))
