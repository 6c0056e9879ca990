"""Outcomes of field extraction: the grid of filings and fields, five outcomes, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import RULES, matches, nullish
from ..functions.stats import REPORTABLE, rate_columns, wilson
from ..guard import coverage, duplicates, refuse

OUTCOMES = ("correct", "wrong_value", "missed", "false_extraction", "correct_abstention")


def grid(filings: DataFrame, fields: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(accession, field) of the filings that fit the context window; the fields are a fixed list."""
    return filings.where("fits_context_window").select("accession", F.explode(F.array(*map(F.lit, fields))).alias("field"))


def align(labels: DataFrame, predictions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Labels with predictions, by key; gaps, extras and repeated keys on either side are refused."""
    keys = ["accession", "field"]
    refuse(duplicates(labels, keys, "label"), duplicates(predictions, keys, "prediction"), coverage(wanted, labels, keys, "label"), coverage(wanted, predictions, keys, "prediction"))
    return labels.join(predictions.select(*keys, F.col("value").alias("prediction")), keys)


def outcome(kind: Column, field: Column, label: Column, prediction: Column) -> Column:
    """The place of one pair on the outcome grid; an unknown kind is refused inside the plan."""
    absent = F.when(nullish(prediction), "missed").when(matches(field, F.lit("0"), prediction), "correct").otherwise("false_extraction")
    value = F.when(nullish(prediction), "missed").when(matches(field, label, prediction), "correct").otherwise("wrong_value")
    silent = F.when(nullish(prediction), "correct_abstention").otherwise("false_extraction")
    bad = F.raise_error(F.concat(F.lit("unknown answer kind "), F.coalesce(kind, F.lit("null")))).cast("string")
    return F.when(kind == "not_addressed", silent).when(kind == "stated_none", absent).when(kind == "value", value).otherwise(bad)


def classify(aligned: DataFrame) -> DataFrame:
    """``aligned`` with outcome; rows that aren't labeled are refused."""
    refuse(aligned.where(F.coalesce(F.col("status"), F.lit("")) != "labeled").select(F.concat(F.lit("not labeled: "), F.concat_ws(", ", "accession", "field")).alias("problem")))
    return aligned.withColumn("outcome", outcome(F.col("answer_kind"), F.col("field"), F.col("value"), F.col("prediction")))


def right() -> Column:
    return F.col("outcome").isin("correct", "correct_abstention")


def by_field(scored: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(field, n, correct, one count for each outcome, accuracy, lo, hi, reportable)."""
    counted = scored.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(right()).alias("correct_n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    lo, hi = wilson(F.col("correct_n"), F.col("n"), confidence)
    return counted.select("field", "n", "correct_n", *OUTCOMES, (F.col("correct_n") / F.col("n")).alias("accuracy"), lo.alias("lo"), hi.alias("hi"), (F.col("n") >= REPORTABLE).alias("reportable"))


def summary(scored: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Rows pooled, macro, excluding_ambiguous and false_extraction: (name, hits, n, rate, lo, hi, reportable)."""
    absent = F.col("answer_kind").isin("stated_none", "not_addressed")
    clear = ~F.coalesce(F.col("ambiguous"), F.lit(False))
    counts = scored.agg(
        F.array(
            F.struct(F.lit("pooled").alias("name"), F.count_if(right()).alias("hits"), F.count(F.lit(1)).alias("n")),
            F.struct(F.lit("excluding_ambiguous").alias("name"), F.count_if(right() & clear).alias("hits"), F.count_if(clear).alias("n")),
            F.struct(F.lit("false_extraction").alias("name"), F.count_if(absent & (F.col("outcome") == "false_extraction")).alias("hits"), F.count_if(absent).alias("n")),
        ).alias("rows")
    ).select(F.inline("rows"))
    macro = by_field(scored, confidence).agg(F.lit("macro").alias("name"), F.lit(None).cast("long").alias("hits"), F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("rate")).select("name", "hits", "n", "rate", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(True).alias("reportable"))
    return counts.select("name", *rate_columns("hits", "n", confidence)).unionByName(macro)


def unstable(runs: DataFrame) -> DataFrame:
    """(field, cases, differing): keys for which repeated runs gave more than one canonical value."""
    number = F.col("value").try_cast("double")
    canonical = F.when(F.col("value").isNull(), "null").when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.col("value"))
    per = runs.groupBy("accession", "field").agg(F.count_distinct(canonical).alias("values"))
    return per.groupBy("field").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("values") > 1).alias("differing"))


def carried_over(labels: DataFrame, stable: tuple[str, ...] = ("company_name", "ticker")) -> DataFrame:
    """(ticker, field, periods): the same value with the same anchor in several periods."""
    return labels.where(~F.col("field").isin(*stable)).groupBy("ticker", "field").agg(F.count_distinct("period").alias("periods"), F.count_distinct("value").alias("values"), F.count_distinct("anchor").alias("anchors")).where("periods >= 2 and values = 1 and anchors = 1").select("ticker", "field", "periods")
