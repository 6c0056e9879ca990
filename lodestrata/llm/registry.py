"""The queries of this subpackage, each applying one operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, prefix_trie, quality, quality_rules, resampling
from .decontamination import contaminated
from .fingerprints import compare_with_next
from .html_extraction import extract_main_text
from .jaccard_join import linked_components
from .packing import pack
from .scratch import table
from .substring_dedup import drop_repeated_substrings
from .token_counts import count_tokens, tokenizer_path
from .toxicity import learn, score_texts


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of ``labels``; no grade without a quality, nor for good texts without a toxic mark."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents.  Grades: 0 poor, 1 toxic but sound, 2 good; selected for a grade of 1 or more."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.grade_texts(docs, quality.learn(docs, grades_of(labels), 3))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, learn(docs, table(spark, sf_dir, "labels")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), n_words=4, percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: texts that are labelled good and not toxic."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.with_shared_openings(prefix_trie.turn_sequences(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_document_fingerprints, op2_token_counts, op3_quality_classifier, op4_html_extraction, op5_benchmark_decontamination, op6_toxicity, op7_ngram_jaccard_join, op8_line_dedup, op9_substring_dedup, op10_best_fit_packing, op11_target_resampling, op12_quality_rules, op13_conversation_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_target_resampling": resampling.ORACLE_SQL,
        "op12_quality_rules": quality_rules.ORACLE_SQL,
        "op13_conversation_prefix_trie": prefix_trie.ORACLE_SQL,
    }
