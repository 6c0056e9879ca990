"""How alike short texts are, and where a quotation stands in a text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import anchor_key, normalize

EXACT, CONTAINED, NEARBY, FLOOR = 1.0, 0.90, 0.95, 0.82


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return F.pandas_udf(_ratios, "double")(a, b)


def best_marks(rows: DataFrame) -> DataFrame:
    """(case_id, nth, score): which of a case's marks stands where the anchor stood; no row below ``FLOOR``.

    rows: (case_id, anchor, nth, mark, context).  An equal mark counts most, then a context that holds the
    anchor, then containment either way, then likeness; ties go to the better context, then to the mark of
    nearest length, then to the first.  Figures, currency signs and punctuation don't count.
    """
    key, own, around = (anchor_key(F.coalesce(c, F.lit(""))) for c in ("anchor", "mark", "context"))
    keyed = rows.select("case_id", "nth", key.alias("key"), own.alias("own"), around.alias("around")).where("key <> '' and own <> ''")
    within = F.contains(F.col("key"), F.col("own")) | F.contains(F.col("own"), F.col("key"))
    by_mark = F.when(F.col("own") == F.col("key"), EXACT).when(within, CONTAINED).otherwise(F.col("like_own"))
    by_context = F.when(F.col("around") == "", 0.0).when(F.contains(F.col("around"), F.col("key")), NEARBY).otherwise(F.col("like_around"))
    # Likeness is computed in a step of its own, so that Python sees each pair once.
    liked = keyed.withColumn("like_own", ratio(F.col("key"), F.col("own"))).withColumn("like_around", ratio(F.col("key"), F.col("around")))
    scored = liked.select("case_id", "nth", by_context.alias("c"), F.greatest(by_mark, by_context).alias("score"), (-F.abs(F.length("own") - F.length("key"))).alias("near"))
    best = scored.groupBy("case_id").agg(F.max(F.struct("score", "c", "near", (-F.col("nth")).alias("first"))).alias("b"))
    return best.select("case_id", (-F.col("b.first")).alias("nth"), F.col("b.score").alias("score")).where(F.col("score") >= FLOOR)


def quote_span(text: Column, quote: Column) -> Column:
    """Struct (start, end) of the part of the raw text that is the quotation once both are normalised; null
    where there is none, or where what was found isn't exactly it."""
    needle = normalize(quote)
    plain = F.regexp_replace(needle, r"([^\p{L}\p{N}\s])", r"\\$1")
    for folded, forms in (("\\'", "['‘’]"), ('\\"', '["“”]'), ("\\-", "[-–—]"), (" ", r"\s+")):
        plain = F.replace(plain, F.lit(folded), F.lit(forms))
    pattern = F.when(needle != "", F.concat(F.lit("(?iU)"), plain))
    found = F.regexp_substr(text, pattern)
    start = F.regexp_instr(text, pattern) - 1
    return F.when(normalize(found) == needle, F.struct(start.alias("start"), (start + F.length(found)).alias("end")))
