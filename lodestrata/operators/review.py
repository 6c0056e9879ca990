"""Labels and what supports them: passages that may answer a field, anchors, and checks between labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import RULES
from ..functions.text import normalize, squeeze

APART = 320
BEFORE, BEHIND = 80, 320
MOST_PASSAGES = 8
MARK_SIDE = 180


def passages(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(accession, field, nth, start, snippet): where a field's pattern stands, in order; a place within
    ``APART`` characters of the one kept before is left out, and at most ``MOST_PASSAGES`` are listed.

    The list is the feature: a reader is shown the first few places.  Null texts have none.
    """
    import re

    compiled = {field: re.compile(p, re.I) for field, p in patterns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for field, pattern in compiled.items() if body else ():
                    last, nth = -APART - 1, 0
                    for m in pattern.finditer(body):
                        if m.start() - last <= APART:
                            continue
                        last, nth = m.start(), nth + 1
                        rows.append((key, field, nth, m.start(), body[max(0, m.start() - BEFORE) : m.start() + BEHIND]))
                        if nth == MOST_PASSAGES:
                            break
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["accession", "field", "nth", "start", "snippet"])

    return docs.select(F.col("accession").cast("string").alias("accession"), text).mapInArrow(run, "accession string, field string, nth int, start long, snippet string")


def literal_places(docs: DataFrame, needle: str, most: int = MOST_PASSAGES) -> DataFrame:
    """(accession, nth, start): the first places of a literal text, in any case, that don't overlap."""
    size = len(needle)
    parts = F.split(F.lower("text"), F.lit("(?s)" + "".join(f"\\x{{{ord(c):x}}}" for c in needle.lower())))
    ends = F.transform(parts, lambda p: F.length(p) + size)
    listed = docs.select("accession", F.posexplode(F.slice(ends, F.lit(1), F.least(F.size(ends) - 1, F.lit(most)))).alias("at", "step"))
    start = F.sum("step").over(Window.partitionBy("accession").orderBy("at")) - size
    return listed.select("accession", (F.col("at") + 1).alias("nth"), start.alias("start"))


def mark(text: Column, start: Column, end: Column) -> Column:
    """A place with ``MARK_SIDE`` characters on either side: struct of before, marked and after."""
    left = F.greatest(F.lit(0), start - MARK_SIDE)
    return F.struct(F.substring(text, left + 1, start - left).alias("before"), F.substring(text, start + 1, end - start).alias("marked"), F.substring(text, end + 1, F.lit(MARK_SIDE)).alias("after"))


def anchor_supports(field: Column, kind: Column, anchor: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """Whether a label's anchor holds one of its field's keywords; a field without keywords, and what is not
    addressed, needs none."""
    out = F.lit(True)
    folded = normalize(anchor)
    for name, words in keywords.items():
        held = F.lit(False)
        for w in words:
            held = held | F.contains(folded, F.lit(w))
        out = F.when(field == name, held).otherwise(out)
    return F.coalesce((kind == "not_addressed") | out, F.lit(False))


def anchors_missing(labels: DataFrame, filings: DataFrame) -> DataFrame:
    """(accession, field): labels with an anchor that the filing's text doesn't hold, white space aside."""
    held = F.contains(squeeze(F.col("text")), squeeze(F.col("anchor")))
    return labels.where(F.coalesce(F.trim("anchor"), F.lit("")) != "").join(filings.select("accession", "text"), "accession").where(~F.coalesce(held, F.lit(False))).select("accession", "field")


def fields_missing(labels: DataFrame, fields: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(accession, missing): the fields that a labeled filing has no label of."""
    have = labels.groupBy("accession").agg(F.collect_set("field").alias("have"))
    return have.select("accession", F.array_sort(F.array_except(F.array(*map(F.lit, fields)), "have")).alias("missing")).where(F.size("missing") > 0)


def prior_values(labels: DataFrame, order: str) -> DataFrame:
    """(accession, field, prior_period, prior_value): the last label of the same field and ticker in another
    period; of several periods the latest, of several labels of one the last written."""
    last = labels.groupBy("ticker", "field", "period").agg(F.max_by(F.struct("accession", "value"), order).alias("r")).select("ticker", "field", "period", "r.accession", "r.value")
    other = last.select("ticker", "field", F.col("period").alias("prior_period"), F.col("value").alias("prior_value"))
    pairs = last.join(other, ["ticker", "field"]).where("prior_period <> period")
    return pairs.groupBy("accession", "ticker", "field", "period").agg(F.max_by(F.struct("prior_period", "prior_value"), "prior_period").alias("p")).select("accession", "field", "p.prior_period", "p.prior_value")


def split_by(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that go; an unknown condition goes."""
    yes = F.coalesce(keep, F.lit(False))
    return rows.where(yes), rows.where(~yes)


def label_queue(rows: DataFrame, fields: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """``rows`` with place: the order in which they are labeled, by ticker, period and the fields' own order."""
    rank = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("period", rank, "accession")))


def recent(reports: DataFrame, n: int = 20) -> DataFrame:
    """The newest reports."""
    return reports.orderBy(F.desc("upload_date"), "id").limit(n)


def report_detail(reports: DataFrame, extractions: DataFrame, risks: DataFrame) -> DataFrame:
    """Each report with its extraction, if there is one, and its risks in order."""
    listed = risks.groupBy("report_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "risk"))), lambda x: x["risk"]).alias("risks"))
    joined = reports.join(extractions.withColumnRenamed("report_id", "id"), "id", "left").join(listed.withColumnRenamed("report_id", "id"), "id", "left")
    return joined.withColumn("risks", F.coalesce("risks", F.array().cast("array<string>")))


def excerpts(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, arm, rank, chunk_id, accession, text) in the contexts' order; an unknown id is refused."""
    from ..guard import refuse

    listed = contexts.select("query_id", "arm", F.posexplode("ids").alias("at", "chunk_id")).withColumn("rank", F.col("at") + 1)
    found = listed.join(chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "accession", "text"), "chunk_id", "left")
    refuse(found.where("accession is null").select(F.concat(F.lit("the store has no chunk "), F.col("chunk_id")).alias("problem")))
    return found.select("query_id", "arm", "rank", "chunk_id", "accession", "text")


def token_usage(answers: DataFrame) -> DataFrame:
    """One row: calls, prompt_tokens and completion_tokens of a run."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return answers.agg(F.count(F.lit(1)).alias("calls"), total("usage.prompt_tokens").alias("prompt_tokens"), total("usage.completion_tokens").alias("completion_tokens"))


def smoke_chunks(chunks: DataFrame, tickers: tuple[str, ...], words: tuple[str, ...]) -> DataFrame:
    """Chunks of these tickers that hold all of the words."""
    found = F.col("ticker").isin(*tickers)
    for w in words:
        found = found & F.contains(F.lower("text"), F.lit(w))
    return chunks.where(found)
