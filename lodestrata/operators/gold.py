"""Gold passages: the chunks that hold a query's quoted spans, and checks of query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_words, normalize
from .span_join import span_places

MOST_GOLD = 5
LEAST_WORDS = 12


def locations(queries: DataFrame) -> DataFrame:
    """(query_id, accession, span): one row for each gold location."""
    return queries.select("query_id", F.explode("gold").alias("g")).select("query_id", "g.accession", "g.span")


def span_hits(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(span_id, chunk_id): which chunks hold which spans, both normalised, by one pass over the chunks
    whatever the number of spans (see :mod:`span_join`).

    spans: (span_id, span).  Empty spans are refused.
    """
    from ..guard import refuse, where

    ready = spans.select("span_id", normalize(F.col("span")).alias("needle"))
    refuse(where(ready, F.coalesce(F.col("needle") == "", F.lit(True)), F.concat(F.lit("empty span: "), F.col("span_id").cast("string"))))
    return span_places(chunks.select("chunk_id", normalize(F.col("text")).alias("text")), ready)


def gold_sets(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the union over a query's locations of its filing's chunks that hold the span."""
    spans = places.select("span").distinct().select(F.sha2("span", 256).alias("span_id"), "span")
    hits = span_hits(chunks, spans).join(chunks.select("chunk_id", "accession"), "chunk_id")
    wanted = places.select("query_id", "accession", F.sha2("span", 256).alias("span_id"))
    return hits.join(wanted, ["span_id", "accession"]).select("query_id", "chunk_id").distinct()


def gold_problems(queries: DataFrame, gold: DataFrame, most: int = MOST_GOLD) -> DataFrame:
    """A problem for each answerable query without gold, or with more gold chunks than the cap."""
    counted = queries.where(F.size("gold") > 0).select("query_id").join(gold.groupBy("query_id").count(), "query_id", "left").fillna({"count": 0})
    none = F.concat(F.lit("no chunk holds the span of "), F.col("query_id").cast("string"))
    many = F.concat(F.col("query_id").cast("string"), F.lit(" has "), F.col("count").cast("string"), F.lit(" gold chunks"))
    return counted.where((F.col("count") == 0) | (F.col("count") > most)).select(F.when(F.col("count") == 0, none).otherwise(many).alias("problem"))


def advisories(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, accession, words, short, elsewhere): notes on spans, which never refuse anything."""
    spans = places.select("span").distinct().select(F.sha2("span", 256).alias("span_id"), "span")
    hits = span_hits(chunks, spans).join(chunks.select("chunk_id", F.col("accession").alias("other")), "chunk_id").select("span_id", "other").distinct()
    keyed = places.withColumn("span_id", F.sha2("span", 256))
    elsewhere = keyed.join(hits, "span_id").where("other <> accession").groupBy("query_id", "accession", "span_id").agg(F.array_sort(F.collect_set("other")).alias("elsewhere"))
    words = F.size(F.filter(F.split("span", r"(?U)\s+"), lambda w: w != ""))
    return keyed.join(elsewhere, ["query_id", "accession", "span_id"], "left").select("query_id", "accession", words.alias("words"), (words < LEAST_WORDS).alias("short"), F.coalesce("elsewhere", F.array().cast("array<string>")).alias("elsewhere"))


def query_problems(queries: DataFrame, strata: tuple[str, ...] = ("exact_entity", "conceptual", "unanswerable")) -> DataFrame:
    """Problems of single query records."""
    name = F.col("query_id").cast("string")
    shared = F.exists("gold", lambda g: F.arrays_overlap(content_words(F.col("query")), content_words(g["span"])))
    blank = F.exists("gold", lambda g: (F.coalesce(F.trim(g["accession"]), F.lit("")) == "") | (F.coalesce(F.trim(g["span"]), F.lit("")) == ""))
    answerable = F.col("stratum") != "unanswerable"
    checks: list[tuple[Column, str]] = [
        (~F.col("stratum").isin(*strata) | F.col("stratum").isNull(), "unknown stratum"),
        (F.coalesce(F.trim("query"), F.lit("")) == "", "empty query"),
        (~answerable & (F.coalesce(F.size("gold"), F.lit(0)) > 0), "unanswerable with gold"),
        (answerable & (F.coalesce(F.size("gold"), F.lit(0)) <= 0), "answerable without gold"),
        (blank, "gold without accession or span"),
        ((F.col("stratum") == "conceptual") & shared, "conceptual query shares a content word with its span"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.concat(name, F.lit(f": {m}"))) for c, m in checks)))
    return queries.select(F.explode(found).alias("problem"))


def set_problems(queries: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Repeated ids or texts, and strata of another size than pre-registered."""
    from ..guard import duplicates

    spark = queries.sparkSession
    want = spark.createDataFrame(list(targets.items()), "stratum string, wanted long")
    sizes = want.join(queries.groupBy("stratum").count(), "stratum", "left").fillna({"count": 0}).where("count <> wanted")
    sizes = sizes.select(F.format_string("%s has %d queries, not %d", "stratum", "count", "wanted").alias("problem"))
    return duplicates(queries, ["query_id"], "query").union(duplicates(queries.select(normalize(F.col("query")).alias("text")), ["text"], "query text")).union(sizes)


def query_hash(queries: DataFrame) -> DataFrame:
    """(query_id, sha256) of the canonical JSON of each record: sorted keys, compact, non-ASCII kept."""
    places = F.transform("gold", lambda g: F.struct(g["accession"].alias("accession"), g["span"].alias("span")))
    canonical = F.to_json(F.struct(places.alias("gold"), F.col("query"), F.col("query_id"), F.col("stratum")))
    return queries.select("query_id", F.sha2(canonical, 256).alias("sha256"))


def set_digest(hashes: DataFrame) -> DataFrame:
    """One row: the digest of ``id  sha`` lines in order of id."""
    lines = F.sort_array(F.collect_list(F.struct("query_id", "sha256")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x["query_id"].cast("string"), F.lit("  "), x["sha256"], F.lit("\n"))), "")
    return hashes.agg(F.sha2(text, 256).alias("digest"), F.count(F.lit(1)).alias("queries"))
