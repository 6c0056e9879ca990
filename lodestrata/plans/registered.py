"""The registered queries, each applying operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching, stats, text
from ..functions.english import english_lexemes
from ..intermediate import materialise
from ..operators import answers, extraction, filings, gold, lexical_index, logs, retrieval, scoring, stores, vector_index
from . import records
from .tables import chunks, dealt, queries, table, vectors

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def registered(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def _rates(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if c in ("rate", "lo", "hi", "accuracy") else F.col(c) for c in df.columns))


# -- stores


@registered
def store_measure(spark, d):
    return stores.measure(chunks(spark, d))


@registered
def chunks_by_group(spark, d):
    return stores.by_item(chunks(spark, d))


@registered
def token_percentiles(spark, d):
    return stores.token_distribution(chunks(spark, d))


@registered
def dup_text_groups(spark, d):
    return stores.duplicate_texts(chunks(spark, d))


@registered
def null_scan(spark, d):
    t = table(spark, d, "documents")
    return t.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in t.columns))


@registered
def token_coverage_band(spark, d):
    c = chunks(spark, d)
    stated = c.groupBy("accession").agg(F.sum(F.length(F.split("text", " ")[0]) * 300).alias("tokens"))
    return stores.token_coverage(c, stated).withColumn("ratio", F.round("ratio", 9))


# -- lexical index and retrieval arms


@registered
def postings_df(spark, d):
    return retrieval.postings(chunks(spark, d))


@registered
def lexeme_doc_frequency(spark, d):
    return retrieval.lexeme_frequency(retrieval.postings(chunks(spark, d)))


def _lexical(spark, d, words=None):
    """The stored index of the chunks, built by the first query that searches it."""
    path = lexical_index.stored(spark, f"{d} {'english' if words else 'simple'}", lambda p: lexical_index.build(chunks(spark, d), p, words and words(F.col("text"))))
    return lexical_index.open_index(spark, path)


def _sparse(spark, d):
    return lexical_index.search(_lexical(spark, d), retrieval.query_terms(queries(spark, d)))


def _arms(spark, d):
    """Both arms' rankings, written once (50 rows for each query), as several operators read them."""
    return materialise(_sparse(spark, d), "sparse"), materialise(_dense_of_items(spark, d), "dense")


def _dense_of_items(spark, d):
    v = vectors(spark, d)
    asked = v.join(queries(spark, d).select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "embedding")
    return retrieval.dense(v, asked)


@registered
def sparse_topk(spark, d):
    return _sparse(spark, d)


@registered
def english_sparse(spark, d):
    """As sparse_topk, by the stems of words that aren't stop words; SQL has no such stems."""
    return lexical_index.search(_lexical(spark, d, english_lexemes), retrieval.query_terms(queries(spark, d), english_lexemes(F.col("query"))))


@registered
def sparse_or_match(spark, d):
    found = retrieval.matching(retrieval.postings(chunks(spark, d)), retrieval.query_terms(queries(spark, d)))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))


@registered
def dense_topk(spark, d):
    """Queries: every vector whose id is divisible by 20."""
    v = vectors(spark, d)
    asked = v.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return retrieval.dense(v, asked).select("query_id", "arm", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _cells(spark, d):
    """The stored vector index and the queries of dense_topk."""
    v = vectors(spark, d)
    path = lexical_index.stored(spark, f"{d} vectors", lambda p: vector_index.build(v, p))
    return vector_index.open_index(spark, path), v.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


@registered
def dense_by_cells(spark, d):
    """The rows of dense_topk, by pruned cells."""
    return vector_index.search_exact(*_cells(spark, d)).select("query_id", "arm", "rank", "chunk_id", F.round("score", 6).alias("score"))


@registered
def dense_recall(spark, d):
    """Of each query's exact results, how many the search by codes finds; SQL has no such codes."""
    index, asked = _cells(spark, d)
    return vector_index.recall(vector_index.search(index, asked), vector_index.search_exact(index, asked))


@registered
def hybrid_rrf(spark, d):
    fused = retrieval.fuse(_sparse(spark, d).unionByName(_dense_of_items(spark, d)))
    return fused.withColumn("score", F.round("score", 9))


def _gates(spark, d, ranking):
    """Thresholds for the test: two points for each lexeme, for every number of lexemes that a query has."""
    terms = retrieval.query_terms(queries(spark, d))
    lengths = terms.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("L")).select("L").distinct()
    taus = lengths.select("L", F.round(F.col("L") * 2.0, 1).alias("tau"))
    return retrieval.gate(queries(spark, d), terms, ranking, taus)


@registered
def gate_decisions(spark, d):
    return _gates(spark, d, materialise(_sparse(spark, d), "sparse"))


@registered
def gate_counts(spark, d):
    return retrieval.gate_counts(_gates(spark, d, materialise(_sparse(spark, d), "sparse")), _strata(spark, d))


def _gated(spark, d):
    lexical, nearest = _arms(spark, d)
    return retrieval.choose_arm("gated", lexical, nearest, _gates(spark, d, lexical))


@registered
def gated_rrf(spark, d):
    return _gated(spark, d).withColumn("score", F.round("score", 9))


@registered
def null_threshold(spark, d):
    index = _lexical(spark, d)
    lengths = retrieval.query_terms(queries(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("L"))
    drawn = retrieval.draw_bags_in_spark(index.frequency, lengths.select("L").distinct())
    return retrieval.null_summary(lexical_index.bag_scores(index, drawn))


@registered
def null_summary(spark, d):
    """The summary over bags that are not drawn: each item's own lexemes."""
    terms = retrieval.query_terms(queries(spark, d))
    sized = terms.join(terms.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("L")), "query_id").select("L", F.col("query_id").alias("bag"), "lexeme")
    summed = retrieval.null_summary(lexical_index.bag_scores(_lexical(spark, d), sized))
    return summed.select(*(F.round(c, 6).alias(c) if c in ("tau", "min", "median", "mean", "max") else F.col(c) for c in summed.columns))


# -- gold and scores of retrieval


def _places(spark, d):
    """A query's location: its text as the span, in the filing of the first chunk that holds it."""
    hits = materialise(gold.span_hits(chunks(spark, d), queries(spark, d).select(F.col("query_id").alias("span_id"), F.col("query").alias("span"))), "span-hits")
    first = hits.groupBy("span_id").agg(F.min("chunk_id").alias("chunk_id")).join(chunks(spark, d).select("chunk_id", "accession"), "chunk_id")
    return hits, first.select(F.col("span_id").alias("query_id"), "accession")


def _gold(spark, d):
    hits, places = _places(spark, d)
    return hits.withColumnRenamed("span_id", "query_id").join(chunks(spark, d).select("chunk_id", "accession"), "chunk_id").join(places, ["query_id", "accession"]).select("query_id", "chunk_id")


@registered
def gold_sets(spark, d):
    return _gold(spark, d)


@registered
def gold_cap_violations(spark, d):
    counted = queries(spark, d).select("query_id").join(_gold(spark, d).groupBy("query_id").count(), "query_id", "left").fillna({"count": 0})
    return counted.where((F.col("count") == 0) | (F.col("count") > gold.MOST_GOLD)).select("query_id", F.col("count").alias("gold_chunks"))


@registered
def duplicate_span_flags(spark, d):
    hits, places = _places(spark, d)
    elsewhere = hits.withColumnRenamed("span_id", "query_id").join(chunks(spark, d).select("chunk_id", F.col("accession").alias("other")), "chunk_id").join(places, "query_id").where("other <> accession")
    return elsewhere.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("elsewhere"))


def _strata(spark, d):
    return queries(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, "exact_entity").otherwise("conceptual").alias("stratum"))


def _hits(spark, d):
    lexical, nearest = _arms(spark, d)
    arms = lexical.unionByName(nearest).unionByName(retrieval.choose_arm("hybrid", lexical, nearest))
    hits = scoring.hits_at_k(arms, materialise(_gold(spark, d), "gold"), _strata(spark, d), (1, 5, 10, 50))
    return materialise(hits, "hits")


@registered
def recall_at_k_by_stratum(spark, d):
    return _rates(scoring.recall(_hits(spark, d)))


@registered
def mcnemar_pairs(spark, d):
    return _rates(scoring.mcnemar(_hits(spark, d), ["k"]))


@registered
def context_dedupe(spark, d):
    lexical = materialise(_sparse(spark, d), "sparse")
    top5 = scoring.contexts(lexical.unionByName(retrieval.fuse(lexical)), strict=False)
    return scoring.calls(top5).select("call_id", "query_id", F.array_join("ids", ",").alias("ids"), F.array_join("arms", ",").alias("arms"))


@registered
def wilson_by_group(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    counted = joined.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("hits"), F.count(F.lit(1)).alias("n"))
    return _rates(counted.select("source", *stats.rate_columns("hits", "n")))


# -- extraction


def _extraction(spark, d):
    """Orders as labels of one numeric field; the prediction is the price, altered, zero or missing by rule."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 7 == 0, "not_addressed").when(k % 7 == 1, "stated_none").otherwise("value")
    value = F.when(kind == "value", text.two_places(F.col("o_totalprice")))
    guess = F.when(k % 5 == 0, None).when(k % 5 == 1, F.lit("0")).when(k % 5 == 2, text.two_places(F.col("o_totalprice") * 1.0005)).when(k % 5 == 3, text.two_places(F.col("o_totalprice") * 1.01)).otherwise(text.two_places(F.col("o_totalprice")))
    rows = o.select(k.cast("string").alias("accession"), F.when(k % 2 == 0, "total_assets").otherwise("goodwill_impairment").alias("field"), F.lit("labeled").alias("status"), kind.alias("answer_kind"), value.alias("value"), guess.alias("prediction"), (k % 11 == 0).alias("ambiguous"))
    return extraction.classify(rows)


@registered
def extraction_outcomes(spark, d):
    return _extraction(spark, d).select(F.col("accession").cast("long").alias("accession"), "field", "outcome")


@registered
def field_summary(spark, d):
    return _rates(extraction.by_field(_extraction(spark, d)))


@registered
def extraction_summary(spark, d):
    return _rates(extraction.summary(_extraction(spark, d)).fillna({"hits": -1}))


# -- answers


def _responses(spark, d):
    """Model responses to each benchmark item, one of seven kinds by its id."""
    hits, places = _places(spark, d)
    q = queries(spark, d)
    ids = scoring.contexts(_sparse(spark, d), strict=False).select("query_id", F.col("ids").alias("excerpt_ids"))
    # What is quoted: of each two items one sentence of the chunk, up to its first stop, and something else.
    first = chunks(spark, d).select(F.col("chunk_id").cast("string").alias("c"), F.split_part("text", F.lit("."), F.lit(1)).alias("start"))
    rows = q.join(ids, "query_id").join(first, F.get("excerpt_ids", F.lit(0)) == F.col("c"), "left")
    k = F.col("query_id") % 7
    quote = F.when(F.col("query_id") % 2 == 0, F.col("start")).otherwise("it says something else altogether")
    raw = (
        F.when(k == 0, F.lit("not json"))
        .when(k == 1, F.lit('{"answer": null, "citation": null, "quote": null}'))
        .when(k == 2, F.lit('{"answer": "x", "citation": 9, "quote": "y"}'))
        .when(k == 3, F.lit('{"answer": "x", "citation": true, "quote": "y"}'))
        .when(k == 4, F.lit('{"answer": "x", "citation": 1}'))
        .otherwise(F.to_json(F.struct(F.lit("x").alias("answer"), F.lit(1).alias("citation"), quote.alias("quote"))))
    )
    return rows.select("query_id", "excerpt_ids", raw.alias("raw")), places.join(q, "query_id").select("query_id", "accession", F.col("query").alias("span"))


@registered
def qa_outcomes(spark, d):
    rows, places = _responses(spark, d)
    done = answers.classify(answers.parse_responses(rows), chunks(spark, d), _gold(spark, d), places)
    return done.select("query_id", "ok", "reason", "outcome", F.coalesce(F.col("cited_chunk_id").cast("long"), F.lit(-1)).alias("cited_chunk_id"), "wrong_filing")


@registered
def json_variant_types(spark, d):
    kinds = table(spark, d, "events").select(answers.json_kind(F.col("props"), "k").alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# -- keys, logs and sets


@registered
def grid_gaps(spark, d):
    wanted = table(spark, d, "nation").select("n_nationkey").join(F.broadcast(spark.createDataFrame([(s,) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER")], "segment string")))
    have = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return logs.pending(wanted, have, ["n_nationkey", "segment"])


@registered
def pending_antijoin(spark, d):
    done = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return logs.pending(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@registered
def symmetric_diff(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"))
    b = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("key"))
    return logs.symmetric_difference(a, b, ["key"])


@registered
def latest_per_key(spark, d):
    return logs.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@registered
def latest_turns(spark, d):
    return logs.latest_per_key(table(spark, d, "conversations"), ["conv_id"], ["turn"])


@registered
def undo_target(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return logs.undo_target(e, ["user_id"], ["event_id"], F.col("event_type") == e.agg(F.min("event_type")).first()[0])


@registered
def merged_ranges(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.date_diff("l_shipdate", F.lit("1970-01-01").cast("date")).alias("start"), (F.date_diff("l_shipdate", F.lit("1970-01-01").cast("date")) + F.col("l_linenumber")).alias("end"))
    return logs.merge_ranges(r, ["key"])


@registered
def newest_per_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return logs.first_per_group(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 2)


@registered
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0")
    return logs.without_parents(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


# -- scalar functions over tables


@registered
def span_normalize(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal"))


@registered
def content_word_overlap(spark, d):
    """Items that share topic words, and how many."""
    b = table(spark, d, "benchmark").select("item_id", F.explode(text.content_words(F.col("text"))).alias("word"))
    pairs = b.select(F.col("item_id").alias("a"), "word").join(b.select(F.col("item_id").alias("b"), "word"), "word").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@registered
def numeric_match(spark, d):
    line = table(spark, d, "lineitem")
    a, b = text.two_places(F.col("l_extendedprice")), text.two_places(F.col("l_extendedprice") * (1 - F.col("l_discount") / 50))
    return line.groupBy(matching.match_number(a, b).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@registered
def person_match(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("W. Rodney "), F.col("c_mktsegment")).alias("a"), F.concat(F.lit("Rodney "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, " Jr.").otherwise("")).alias("b"))
    return s.select("k", matching.match_person(F.col("a"), F.col("b")).alias("same"))


@registered
def company_match(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.upper("p_name"), F.lit(" CORP/OH/")).alias("a"), F.concat(F.lit("The "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ", Inc.").otherwise(" Group")).alias("b"))
    return p.select("k", matching.match_company(F.col("a"), F.col("b")).alias("same"))


# -- table functions


@registered
def html_text_stats(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("content"))
    return filings.extract_text(pages).select("page_id", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"), F.size("page_starts").alias("page_rules"))


def _filing_texts(spark, d):
    return chunks(spark, d).select(F.col("chunk_id").cast("string").alias("accession"), F.lit("T").alias("ticker"), F.lit("2024").alias("period"), "text", F.array().cast("array<int>").alias("page_starts"))


@registered
def chunk_pack(spark, d):
    made = filings.chunk_filings(_filing_texts(spark, d))
    return made.select("chunk_id", "accession", "index", "first_page", "last_page", "tokens", F.length("text").alias("n_chars"))


FILLER = "The registrant describes in this part what it does and how it does it, in words that fill the part with more than two hundred characters, so that a heading is backed by a body, as it is in a report and not in a contents table."
PARTS = (("Item 1. Business", "1", "Business"), ("Item 1A. Risk Factors.", "1A", "Risk Factors"), ("ITEM 2 - PROPERTIES", "2", "PROPERTIES"), ("Legal Proceedings", "3", "Legal Proceedings"), ("Items 5 and 6. Market and Data", "5", "Market and Data"), ("Item 7", "7", ""), ("Item 9A. Controls and Procedures", "9A", "Controls and Procedures"), ("Item 15. Exhibits", "15", "Exhibits"))


def _reports(spark, d):
    """Each document as a report: a cover, a contents table, each of PARTS with the document's text, signatures."""
    text_of = F.coalesce("text", F.lit(""))
    body = [x for heading, _, _ in PARTS for x in (F.lit(heading), F.lit(FILLER), text_of)]
    whole = F.concat_ws("\n", F.lit("Annual report"), *(F.lit(h) for h, _, _ in PARTS), *body, F.lit("SIGNATURES"), F.lit("Signed by."))
    return dealt(chunks(spark, d).select("chunk_id", "text")).select(F.col("chunk_id").cast("string").alias("accession"), F.lit("T").alias("ticker"), F.lit("2024").alias("period"), whole.alias("text"), F.array(F.lit(9), F.lit(12)).alias("page_starts"))


@registered
def sections(spark, d):
    return filings.sections(_reports(spark, d)).select("accession", "item", F.array_join("covers", ",").alias("covers"), "title", "start_line", "end_line")


REGISTERED |= records.QUERIES
