import pytest

from lodestrata.guard import Refused
from lodestrata.operators import gold, retrieval, scoring


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id int, arm string, rank int, chunk_id string, score double")


def test_fusion_by_hand(spark):
    r = ranking(spark, [(1, "a", i + 1, c, 0.0) for i, c in enumerate("xyz")] + [(1, "b", i + 1, c, 0.0) for i, c in enumerate("yxw")])
    got = retrieval.fuse(r).orderBy("rank").collect()
    assert [x.chunk_id for x in got] == ["x", "y", "w", "z"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62) and got[0].score == pytest.approx(0.032522474881015337)


def test_fusion_cuts_by_depth_and_counts_repeats_once(spark):
    r = ranking(spark, [(1, "a", 1, "x", 0.0), (1, "a", 2, "x", 0.0), (1, "a", 3, "y", 0.0), (1, "a", 4, "z", 0.0)])
    got = {x.chunk_id: x.score for x in retrieval.fuse(r, depth=2).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62)}


def test_sparse_counts_positions_and_breaks_ties_by_id(spark):
    chunks = spark.createDataFrame([("c2", "cash cash flow"), ("c1", "flow flow cash"), ("c3", "none")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "Cash flow, cash?"), (2, "!!")], "query_id int, query string")
    got = retrieval.sparse(retrieval.postings(chunks), retrieval.query_terms(queries)).orderBy("rank").collect()
    assert [(x.query_id, x.chunk_id, x.rank, x.score) for x in got] == [(1, "c1", 1, 0.3), (1, "c2", 2, 0.3)]


def test_dense_is_exact_and_refuses_other_widths(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(7, [3.0, 0.0])], "query_id int, embedding array<double>")
    got = retrieval.dense(v, q, depth=2).orderBy("rank").collect()
    assert [(x.chunk_id, x.score) for x in got] == [("a", 0.0), ("b", 0.0)]
    with pytest.raises(Refused):
        retrieval.check_widths(v, 3)


def test_gate_fires_at_equality_and_refuses_unmeasured_lengths(spark):
    queries = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "!!")], "query_id int, query string")
    terms = retrieval.query_terms(queries)
    sparse = ranking(spark, [(1, "sparse", 1, "x", 3.3), (2, "sparse", 1, "x", 3.4)])
    taus = spark.createDataFrame([(2, 3.3)], "L int, tau double")
    got = {r.query_id: r.fires for r in retrieval.gate(queries, terms, sparse, taus).collect()}
    assert got == {1: True, 2: False, 3: True}
    with pytest.raises(Refused, match="no threshold"):
        retrieval.gate(queries, terms, sparse, spark.createDataFrame([(9, 1.0)], "L int, tau double"))


def test_bags_are_distinct_and_seeded():
    words = [("a", 5), ("b", 1), ("c", 3)]
    first = retrieval.draw_bags(words, [2, 3], bags=5, seed=1)
    assert first == retrieval.draw_bags(words, [3, 2], bags=5, seed=1)
    for size in (2, 3):
        for bag in range(5):
            assert len({w for s, b, w in first if (s, b) == (size, bag)}) == size
    with pytest.raises(ValueError):
        retrieval.draw_bags(words, [4])


def world(spark):
    chunks = spark.createDataFrame([("c1", "A", "Net  Sales were “high” today"), ("c2", "A", "other"), ("c3", "B", "net sales were \"high\" today")], "chunk_id string, accession string, text string")
    queries = spark.createDataFrame([("q1", "exact_entity", "sales?", [("A", "net sales were \"high\"")]), ("q2", "exact_entity", "none?", [("A", "missing words here")])], "query_id string, stratum string, query string, gold array<struct<accession:string,span:string>>")
    return chunks, queries


def test_gold_is_scoped_to_the_filing_and_problems_are_named(spark):
    chunks, queries = world(spark)
    places = gold.locations(queries)
    found = gold.gold_sets(chunks, places)
    assert [tuple(r) for r in found.collect()] == [("q1", "c1")]
    assert [r.problem for r in gold.gold_problems(queries, found).collect()] == ["no chunk holds the span of q2"]
    notes = {r.query_id: r.elsewhere for r in gold.advisories(chunks, places).collect()}
    assert notes == {"q1": ["B"], "q2": []}


def test_query_problems(spark):
    rows = [("a", "exact_entity", "x", []), ("b", "unanswerable", "x", [("A", "s")]), ("c", "conceptual", "goodwill impairment", [("A", "the impairments")]), ("d", "odd", " ", [("A", "s")]), ("e", "exact_entity", "fine", [("A", "span")])]
    q = spark.createDataFrame(rows, "query_id string, stratum string, query string, gold array<struct<accession:string,span:string>>")
    got = sorted(r.problem.split(":")[0] for r in gold.query_problems(q).collect())
    assert got == ["a", "b", "c", "d", "d"]


def test_recall_and_paired_comparison(spark):
    chunks, queries = world(spark)
    g = spark.createDataFrame([(i, "g") for i in range(4)], "query_id int, chunk_id string")
    q = spark.createDataFrame([(i, "s") for i in range(4)], "query_id int, stratum string")
    r = ranking(spark, [(0, "x", 1, "g", 1.0), (1, "x", 1, "o", 1.0), (1, "x", 2, "g", 1.0), (0, "y", 1, "o", 1.0), (2, "y", 1, "g", 1.0)])
    hits = scoring.hits_at_k(r, g, q, (1, 2))
    got = {(x.arm, x.k): (x.hits, x.n) for x in scoring.recall(hits).where("stratum = 'pooled'").collect()}
    assert got == {("x", 1): (1, 4), ("x", 2): (2, 4), ("y", 1): (1, 4), ("y", 2): (1, 4)}
    pair = scoring.mcnemar(hits, ["k"]).where("k = 2").first()
    assert (pair.b, pair.c, pair.discordant, pair.concordant, pair.established) == (2, 1, 3, 1, False)
    with pytest.raises(Refused):
        scoring.mcnemar(hits.where("not (arm = 'y' and query_id = 3)"), ["k"])


def test_contexts_and_calls(spark):
    r = ranking(spark, [(1, arm, i + 1, c, 0.0) for arm, order in (("x", "abcde"), ("y", "abcde"), ("z", "bacde")) for i, c in enumerate(order)])
    c = scoring.calls(scoring.contexts(r)).collect()
    assert sorted(x.arms for x in c) == [["x", "y"], ["z"]]
    with pytest.raises(Refused):
        scoring.contexts(r.where("rank < 5"))


def test_null_thresholds_draw_in_spark(spark):
    frequency = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "lexeme string, ndoc long")
    sizes = spark.createDataFrame([(1,), (3,)], "L int")
    got = retrieval.draw_bags_in_spark(frequency, sizes, 1000).collect()
    assert sorted({(r.L, r.bag) for r in got}) == [(n, b) for n in (1, 3) for b in range(1000)]
    assert len(set(got)) == len(got) == 4000
    share = [sum(r.L == 1 and r.lexeme == w for r in got) / 1000 for w in "abc"]
    assert all(abs(x - y) < 0.06 for x, y in zip(share, (0.6, 0.3, 0.1), strict=True))
    with pytest.raises(ValueError):
        retrieval.draw_bags_in_spark(frequency, spark.createDataFrame([(4,)], "L int"), 5)
