"""A corpus pipeline over ``documents``: each stage reads what the stage before it kept.

toxicity              texts that the toxicity operator predicts toxic go
line_dedup            later occurrences of three-line windows are cut out of the texts
ngram_jaccard_join    of texts linked at five-word shingles and 0.8, the one with the least doc_id stays
decontamination       texts that hold benchmark items go
packing               the rest is packed into sequences of 2048 tokens

All but the last return the columns of documents.  Rows without doc_id are never linked, so they stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.decontamination import contaminated
from lodestrata.llm.jaccard_join import linked_components
from lodestrata.llm.line_dedup import drop_repeated_windows
from lodestrata.llm.packing import pack
from lodestrata.llm.scratch import materialise, release, table
from lodestrata.llm.token_counts import tokenizer_path
from lodestrata.llm.toxicity import learn, score_texts


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows of these ids; the models that found them are given back before."""
    found = materialise(ids, name)
    release()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = learn(docs, table(spark, sf_dir, "labels"))
    bad = score_texts(docs, index).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    del index
    return _without(docs, bad, "toxic")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(docs).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = linked_components(docs, n_words=5, percent=80)
    others = groups.where("component_id < doc_id").select("doc_id").distinct()
    return _without(docs, others, "others")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).where("doc_id is not null").select("doc_id")
    return _without(docs, leaks, "leaks")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage is a fitted model, which SQL cannot express; the tests compare the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
