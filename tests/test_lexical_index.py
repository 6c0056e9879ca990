import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.text import lexemes
from lodestrata.operators import lexical_index, retrieval
from lodestrata.plans import registered


def corpus(spark, n=6000, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = []
    for i in range(n):
        length = rng.choice([0, 1, 5, 12]) if i % 700 else 400  # a few long texts have the large counts
        rows.append((i * 3 - 500, " ".join(rng.choices(words, weights, k=length)) if length else None))
    rows.append((99_999, "w7 " * 70_000))  # a count of four bytes' width
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def chunks(spark):
    return corpus(spark).cache()


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    return lexical_index.build(chunks, f"file://{tmp_path_factory.mktemp('index')}/x")


def asked(spark):
    rows = [("a", "w0 w1 w2"), ("b", "w7"), ("c", "w290 w3 w299 w299"), ("d", "nothing here"), ("e", ""), ("f", " ".join(f"w{i}" for i in range(300)))]
    return retrieval.query_terms(spark.createDataFrame(rows, "query_id string, query string"))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("depth", [1, 3, 50, 200])
def test_search_equals_the_plain_join(spark, chunks, index, depth):
    want = retrieval.sparse(retrieval.postings(chunks), asked(spark), depth)
    assert rows_of(lexical_index.search(index, asked(spark), depth)) == rows_of(want)


@pytest.mark.parametrize("depth", [1, 2])
def test_blocks_are_skipped_and_counted(spark, index, depth):
    opened, held = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    terms = spark.createDataFrame([("a", "w0"), ("a", "w1")], "query_id string, lexeme string")
    lexical_index.search(index, terms, depth, opened, held).collect()
    assert 0 < opened.value < 0.7 * held.value


def test_the_vocabulary_is_that_of_the_postings(chunks, index):
    assert rows_of(index.frequency.select("lexeme", "ndoc", "nentry")) == rows_of(retrieval.lexeme_frequency(retrieval.postings(chunks)))


def test_small_shards_and_many_blocks_of_queries_change_nothing(spark, chunks, tmp_path, monkeypatch):
    few = chunks.where("chunk_id < 2000")
    monkeypatch.setattr(lexical_index, "SHARD_CHUNKS", 40)
    monkeypatch.setattr(lexical_index, "MOST_TERMS_SENT", 2)
    small = lexical_index.build(few, f"file://{tmp_path}/x")
    assert small.postings.where("lexeme is null").count() > 8
    assert rows_of(lexical_index.search(small, asked(spark))) == rows_of(retrieval.sparse(retrieval.postings(few), asked(spark)))


def test_bags_score_as_before(spark, chunks, index):
    rows = [(n, b, f"w{(n * 7 + b * 3 + i) % 310}") for n in (1, 4) for b in range(20) for i in range(n)]
    bags = spark.createDataFrame(rows, "L int, bag int, lexeme string").distinct()
    got = lexical_index.bag_scores(index, bags).select("L", "bag", F.round("s", 6))
    assert rows_of(got) == rows_of(retrieval.bag_scores(retrieval.postings(chunks), bags).select("L", "bag", F.round("s", 6)))


def test_an_index_of_strings_and_of_nothing(spark, tmp_path):
    texts = spark.createDataFrame([("b", "Cash cash"), ("a", "cash, cash!"), ("c", "flow")], "chunk_id string, text string")
    one = lexical_index.build(texts, f"file://{tmp_path}/one", lexemes(F.col("text")))
    terms = spark.createDataFrame([(1, "cash"), (2, "absent")], "query_id int, lexeme string")
    assert rows_of(lexical_index.search(one, terms)) == [(1, "sparse", 1, "a", 0.2), (1, "sparse", 2, "b", 0.2)]
    none = lexical_index.build(texts.limit(0), f"file://{tmp_path}/none")
    assert lexical_index.search(none, terms).collect() == []


def test_one_index_serves_all_arms(spark, sf_dir, monkeypatch):
    built = []
    build = lexical_index.build
    monkeypatch.setattr(lexical_index, "build", lambda chunks, path, words=None: built.append(path) or build(chunks, path, words))
    monkeypatch.setattr(lexical_index, "_stored", {})
    for name in ("sparse_topk", "hybrid_rrf", "gated_rrf", "null_summary"):
        assert registered.REGISTERED[name](spark, sf_dir).limit(1).collect()
    assert len(built) == 1


def test_bags_are_scored_in_one_row_for_each_shard_and_bag(spark, sf_dir, tmp_path):
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    index = lexical_index.build(chunks, f"{tmp_path}/bags")
    bags = retrieval.draw_bags_in_spark(index.frequency, spark.createDataFrame([(3,), (40,)], "L int"), 50)
    bags = bags.unionByName(spark.createDataFrame([(1, 0, "nosuchlexeme")], "L int, bag int, lexeme string"))
    got = lexical_index.bag_scores(index, bags).select("L", "bag", F.round("s", 6))
    assert got.count() == 101
    assert rows_of(got) == rows_of(retrieval.bag_scores(retrieval.postings(chunks), bags).select("L", "bag", F.round("s", 6)))
    lists = {"many": (np.arange(9), np.ones(9, np.int32)), "one": (np.array([4]), np.array([7], np.int32))}
    bag, best = lexical_index._bags_of_shard(lists, {"many": np.array([5, 2]), "one": np.array([5])}, 40)
    assert bag.tolist() == [2, 5] and best.tolist() == [1, 8]


def test_texts_are_dealt_out_before_they_are_tokenised(spark, chunks, tmp_path):
    """Neither lists of words are shuffled nor texts tokenised twice (for the bounds of ranges), and shards in any order give the same rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        seen.add(1)
        return (text or "").split()

    made = lexical_index.build(chunks, f"file://{tmp_path}/x", words(F.col("text")))
    assert seen.value == chunks.count()
    for row in made.postings.where("lexeme is null").select("chunk_ids").collect():
        assert list(row.chunk_ids) == sorted(row.chunk_ids)
    assert rows_of(lexical_index.search(made, asked(spark))) == rows_of(retrieval.sparse(retrieval.postings(chunks), asked(spark)))


def test_the_bound_of_the_last_result_is_the_block_maximum_of_that_rank(index):
    from collections import defaultdict

    largest = defaultdict(list)
    for r in index.postings.where("lexeme is not null").select("lexeme", "largest").collect():
        largest[r.lexeme] += r.largest
    want = {w: sorted(x, reverse=True)[retrieval.DEPTH - 1] if len(x) >= retrieval.DEPTH else 0 for w, x in largest.items()}
    assert {r.lexeme: r.reached for r in index.vocabulary.collect()} == want
