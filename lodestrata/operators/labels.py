"""Labels of filings: what a record must hold before it is kept, and what is worth a second look.

A label is (accession, ticker, period, field, answer_kind, value, anchor, searched, ambiguous, note).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sum_of
from ..guard import refuse

#: The kinds of answer, and the fields whose value is a figure.
KINDS = ("value", "stated_none", "not_addressed")
NUMERIC = ("employees", "total_assets", "revenue_most_recent_fy", "dividends_declared_per_share", "goodwill_impairment")
MOST_NAME_WORDS = 3


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def figure(c: Column) -> Column:
    """A typed figure: a sum of terms is added up, commas go; null where it is none."""
    return F.coalesce(F.when(F.contains(c, F.lit("+")), sum_of(c)), F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"))


def label_problems(labels: DataFrame) -> DataFrame:
    """(accession, field, problem): each rule that a label breaks.

    The kind is known; a value isn't blank (0 is a value) and is a figure where the field has figures; a value and a
    stated none have an anchor in the filing; "not addressed" names the terms that were searched.
    """
    kind, value = F.col("answer_kind"), F.col("value")
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    stated = F.coalesce(kind.isin("value", "stated_none"), F.lit(False))
    given = (kind == "value") & ~_blank(value)
    terms = F.filter(F.coalesce("searched", F.array().cast("array<string>")), lambda t: ~_blank(t))
    checks = [
        (~known, "unknown kind of answer"),
        ((kind == "value") & _blank(value), "no value"),
        (given & F.col("field").isin(*NUMERIC) & figure(value).isNull(), "a figure is needed, not text"),
        (stated & _blank(F.col("anchor")), "no anchor in the filing"),
        ((kind == "not_addressed") & (F.size(terms) == 0), "no searched terms"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks)))
    return labels.select("accession", "field", F.explode(found).alias("problem"))


def accepted(labels: DataFrame) -> DataFrame:
    """``labels`` as they are kept: refused if any has a problem; figures in canonical form, and no value but for kind "value"."""
    refuse(label_problems(labels).select(F.concat_ws(": ", F.concat_ws(", ", "accession", "field"), "problem").alias("problem")))
    value = F.when(F.col("field").isin(*NUMERIC), figure(F.col("value")).cast("string")).otherwise(F.col("value"))
    return labels.withColumn("value", F.when(F.col("answer_kind") == "value", value))


def overlong_names(labels: DataFrame) -> DataFrame:
    """(ticker, period, words) of names of more than ``MOST_NAME_WORDS`` words, which may be two names run together."""
    words = F.size(F.filter(F.split(F.col("value"), r"(?U)\s+"), lambda w: w != ""))
    return labels.where("field = 'ceo_name' and answer_kind = 'value'").select("ticker", "period", words.alias("words")).where(F.col("words") > MOST_NAME_WORDS)


def unexplained(labels: DataFrame) -> DataFrame:
    """(ticker, period, field) of labels that are marked ambiguous without a note."""
    return labels.where(F.col("ambiguous") & _blank(F.col("note"))).select("ticker", "period", "field")
