"""Outcomes of grounded answers: strict reading of model responses, evidence checks, and cells by arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate_columns
from ..functions.text import answer_key, normalize
from ..guard import refuse
from ..intermediate import materialise
from .logs import seeded_order
from .scoring import mcnemar

FIELDS = ("answer", "citation", "quote")


def json_kind(c: Column, path: str) -> Column:
    """The JSON type at a path: missing, null, string, integer, number, boolean, object or array."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), f"$.{path}", "variant"))
    named = F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
    return F.coalesce(named.when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array"), F.lit("missing"))


def parse_responses(answers: DataFrame) -> DataFrame:
    """``answers`` with ok, reason, answer, citation and quote; nothing is coerced, other fields may stand.

    A field that is missing or of another type makes the response malformed.
    """
    kind = {f: json_kind(F.col("raw"), f) for f in FIELDS}
    parsed = F.try_parse_json("raw")
    whole = F.schema_of_variant(parsed)
    reason = (
        F.when(parsed.isNull(), "not valid JSON")
        .when(~whole.startswith("OBJECT"), "JSON but not an object")
        .when(F.lit(False) | (kind["answer"] == "missing") | (kind["citation"] == "missing") | (kind["quote"] == "missing"), "missing fields")
        .when(~kind["answer"].isin("string", "null"), "answer is neither string nor null")
        .when(~kind["citation"].isin("integer", "null"), "citation is neither integer nor null")
        .when(~kind["quote"].isin("string", "null"), "quote is neither string nor null")
    )
    get = lambda f, t: F.when(reason.isNull(), F.try_variant_get(parsed, f"$.{f}", t))
    return answers.select("*", reason.isNull().alias("ok"), reason.alias("reason"), get("answer", "string").alias("answer"), get("citation", "long").alias("citation"), get("quote", "string").alias("quote"))


def classify(parsed: DataFrame, chunks: DataFrame, gold: DataFrame, places: DataFrame) -> DataFrame:
    """``parsed`` (query_id, excerpt_ids, ...) with outcome, cited_chunk_id and wrong_filing.

    In order: malformed, abstained (a JSON null only), unsupported (no citation, out of range, no quote, or
    a quote that the cited chunk doesn't hold), supported_gold, supported_nongold.  A wrong filing is cited
    where the chunk holds a gold span but its filing is no gold filing.
    """
    inside = F.col("citation").between(1, F.size("excerpt_ids"))
    cited = F.when(F.col("ok") & F.col("answer").isNotNull() & inside, F.get("excerpt_ids", (F.col("citation") - 1).cast("int")))
    rows = parsed.withColumn("cited_chunk_id", cited)
    texts = chunks.select(F.col("chunk_id").cast("string").alias("cited_chunk_id"), "text", F.col("accession").alias("cited_accession"))
    own = gold.select("query_id", F.col("chunk_id").cast("string").alias("cited_chunk_id"), F.lit(True).alias("is_gold")).distinct()
    where = places.groupBy("query_id").agg(F.collect_list(F.struct("accession", "span")).alias("locations"))
    rows = rows.join(texts, "cited_chunk_id", "left").join(own, ["query_id", "cited_chunk_id"], "left").join(where, "query_id", "left")
    quote = normalize(F.coalesce("quote", F.lit("")))
    held = F.coalesce(F.contains(normalize(F.col("text")), quote), F.lit(False)) & (quote != "")
    outcome = F.when(~F.col("ok"), "malformed").when(F.col("answer").isNull(), "abstained").when(F.col("cited_chunk_id").isNull() | ~held, "unsupported").when(F.coalesce("is_gold", F.lit(False)), "supported_gold").otherwise("supported_nongold")
    spans = F.exists(F.col("locations"), lambda g: F.contains(normalize(F.col("text")), normalize(g["span"])))
    elsewhere = ~F.exists(F.col("locations"), lambda g: g["accession"] == F.col("cited_accession"))
    return rows.withColumn("outcome", outcome).withColumn("wrong_filing", F.coalesce((F.col("outcome") == "supported_nongold") & spans & elsewhere, F.lit(False))).drop("text", "is_gold", "locations", "cited_accession")


def blind_queue(rows: DataFrame, seed: int = 20260821) -> DataFrame:
    """(key, query_id, question, gold_spans, answer): distinct answers without their arms, in seeded order."""
    keyed = rows.where("answer is not null").select(answer_key(F.col("query_id").cast("string"), F.col("answer")).alias("key"), "query_id", "question", "gold_spans", "answer")
    keyed = keyed.repartition("key").distinct()  # by hash: only different answers are put in order for the least
    return keyed.groupBy("key", "query_id", "question", "gold_spans").agg(F.min("answer").alias("answer")).orderBy(seeded_order(seed, "key"), "key")


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` with verdict_correct and ambiguous; an answered, answerable row without verdict is refused.

    verdicts: the latest record of each key, retracted ones left out.
    """
    keyed = rows.withColumn("key", answer_key(F.col("query_id").cast("string"), F.col("answer"))).join(verdicts.select("key", "verdict", "ambiguous"), "key", "left")
    answered = F.col("outcome").isin("unsupported", "supported_gold", "supported_nongold")
    lacking = F.when(answered & F.col("answerable") & F.col("verdict").isNull(), F.col("key"))
    joined = keyed.select(*rows.columns, (F.col("verdict") == "correct").alias("verdict_correct"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), lacking.alias("lacking"))
    written = materialise(joined, "verdicts")  # looked at twice, joined once
    refuse(written.where("lacking is not null").select(F.concat(F.lit("no verdict for "), F.col("lacking")).alias("problem")))
    return written.drop("lacking")


def comparisons(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Paired comparisons of every two arms, on answerable queries by grounded and right answers and on the others by
    abstention: on, and the columns of :func:`scoring.mcnemar`.  Arms that lack a query are refused.

    rows: (query_id, arm, outcome, verdict_correct, ambiguous, answerable), one for each query and arm.
    """
    grounded = (F.col("outcome") == "supported_gold") & F.coalesce("verdict_correct", F.lit(False)) & ~F.col("ambiguous")
    on = F.when(F.col("answerable"), "grounded_correct_answerable").otherwise("abstained_unanswerable")
    hit = F.when(F.col("answerable"), grounded).otherwise(F.col("outcome") == "abstained")
    return mcnemar(rows.select("query_id", "arm", on.alias("on"), hit.alias("hit")), ["on"], confidence)


def cells(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(arm, cell, hits, n, rate, lo, hi, reportable) over rows of

    (query_id, arm, outcome, wrong_filing, verdict_correct, ambiguous, answerable, gold_in_context).
    """
    answered = F.col("outcome").isin("unsupported", "supported_gold", "supported_nongold")
    grounded = (F.col("outcome") == "supported_gold") & F.coalesce("verdict_correct", F.lit(False)) & ~F.col("ambiguous")
    invented = answered & ((F.col("outcome") == "unsupported") | F.coalesce(~F.col("verdict_correct"), F.lit(False)))
    yes, inside, outside = F.col("answerable"), F.col("answerable") & F.col("gold_in_context"), F.col("answerable") & ~F.col("gold_in_context")
    abstained = F.col("outcome") == "abstained"
    families = {
        "grounded_accuracy_given_gold": (grounded, inside),
        "abstained_given_gold": (abstained, inside),
        "abstention_without_gold": (abstained, outside),
        "invention_without_gold": (invented, outside),
        "grounded_end_to_end": (grounded, yes),
        "retrieval_ceiling": (F.col("gold_in_context"), yes),
        "abstention_unanswerable": (abstained, ~yes),
        "malformed": (F.col("outcome") == "malformed", F.lit(True)),
        "wrong_filing": (F.col("wrong_filing"), F.lit(True)),
    }
    counted = rows.groupBy("arm").agg(F.array(*(F.struct(F.lit(name).alias("cell"), F.count_if(hit & of).alias("hits"), F.count_if(of).alias("n")) for name, (hit, of) in families.items())).alias("rows"))
    return counted.select("arm", F.inline("rows")).select("arm", "cell", *rate_columns("hits", "n", confidence))
