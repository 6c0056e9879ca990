"""Each check passes a sound input and names what is wrong with another."""

import pytest
from pyspark.sql import functions as F

from lodestrata.guard import Refused, refuse
from lodestrata.operators import freeze, gold, retrieval, review, tagged_facts

QUERY = "query_id string, stratum string, query string, gold array<struct<accession:string,span:string>>"


def records(spark):
    rows = [("q1", "exact_entity", "who sells it", [("A", "sold by Ann")]), ("q2", "conceptual", "why", [("B", "as it is")]), ("q3", "unanswerable", "when", [])]
    return spark.createDataFrame(rows, QUERY)


def problems(*frames):
    return sorted(r.problem for f in frames for r in f.collect())


def test_freeze(spark):
    r = records(spark)
    frozen = gold.query_hash(r)
    digest = gold.set_digest(frozen).first().digest
    decided = frozen.select("query_id", F.lit("approved").alias("verdict"), F.col("sha256").alias("query_sha256"), F.lit(1).alias("decided_at"))
    refuse(*freeze.freeze_problems(frozen, digest, frozen, digest, freeze.approvals(decided, frozen)))
    other = gold.query_hash(r.withColumn("query", F.when(F.col("query_id") == "q2", "why not").otherwise(F.col("query"))))
    assert freeze.moved(frozen, other).collect() == [("q2", "changed")]
    with pytest.raises(Refused, match="changed since the freeze: q2"):
        refuse(*freeze.freeze_problems(frozen, digest, other, digest, freeze.approvals(decided, frozen)))
    late = decided.where("query_id = 'q1'").withColumn("verdict", F.lit("rejected")).withColumn("decided_at", F.lit(2))
    state = {x.query_id: (x.approved, x.stale) for x in freeze.approvals(decided.unionByName(late), other).collect()}
    assert state == {"q1": (False, False), "q2": (False, True), "q3": (True, False)}
    assert {x.stratum: (x.queries, x.answerable) for x in freeze.composition(r).collect()} == {"exact_entity": (1, 1), "conceptual": (1, 1), "unanswerable": (1, 0)}


def test_run_checks(spark):
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    ranked = spark.createDataFrame([("q1", "sparse", 1, "c1"), ("q1", "sparse", 2, "c2")], "query_id string, arm string, rank int, chunk_id string")
    asked = spark.createDataFrame([("q1",)], "query_id string")
    assert problems(*freeze.run_problems(ranked, chunks, asked, ["sparse"])) == []
    bad = ranked.unionByName(ranked.limit(1)).unionByName(ranked.limit(1).withColumn("chunk_id", F.lit("c9")))
    assert problems(*freeze.run_problems(bad, chunks, asked, ["sparse", "dense"])) == ["no ranking: dense of q1", "ranked chunk q1, sparse, c1 stands 2 times", "the store has no chunk c9"]


def test_gated_rankings_are_those_of_their_arms(spark):
    arm = lambda name, ids: spark.createDataFrame([(q, name, k, c, 0.0) for q in ("q1", "q2") for k, c in enumerate(ids, 1)], "query_id string, arm string, rank int, chunk_id string, score double")
    lexical, nearest = arm("sparse", ["a", "b"]), arm("dense", ["b", "c"])
    gates = spark.createDataFrame([("q1", True), ("q2", False)], "query_id string, fires boolean")
    fused, alone = (retrieval.fuse(x) for x in (lexical.unionByName(nearest), nearest))
    chosen = retrieval.choose_arm("gated", lexical, nearest, gates)
    assert freeze.gated_problems(gates, chosen, fused, alone).count() == 0
    assert problems(freeze.gated_problems(gates, fused, fused, alone)) == ["the gated ranking isn't its arm's: q1"]
    assert problems(freeze.gated_problems(gates.limit(1), chosen.where("query_id = 'q2'"), fused, alone)) == ["no gate decision for q2", "no gated ranking for q1"]
    with pytest.raises(ValueError, match="no arm x"):
        retrieval.choose_arm("x", lexical, nearest, gates)
    with pytest.raises(ValueError, match="needs gates"):
        retrieval.choose_arm("gated", lexical, nearest)


def test_pins_resumption_and_controls(spark):
    pins = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    assert problems(freeze.pinned_problems(pins, pins)) == []
    assert problems(freeze.pinned_problems(pins.where("name = 'a'").withColumn("sha256", F.lit("9")), pins)) == ["another digest: a", "missing: b"]
    plan = spark.createDataFrame([("c1", "x"), ("c2", "y")], "call string, sha string")
    assert problems(*freeze.resume_problems(plan, plan, ["call"], "sha")) == []
    done = spark.createDataFrame([("c1", "z"), ("c2", "y"), ("c2", "y"), ("c3", "w")], "call string, sha string")
    assert problems(*freeze.resume_problems(done, plan, ["call"], "sha")) == ["asked with another input: c1", "not planned: c3", "record c2 stands 2 times"]
    contexts = spark.createDataFrame([("q1", "sparse", ["g"]), ("q2", "sparse", ["h"]), ("q3", "sparse", ["g"])], "query_id string, arm string, ids array<string>")
    split = freeze.conditioned(contexts, spark.createDataFrame([("q1", "g"), ("q2", "g")], "query_id string, chunk_id string"), spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string"))
    assert sorted(tuple(r) for r in split.collect()) == [("q1", "sparse", True, True), ("q2", "sparse", True, False), ("q3", "sparse", False, False)]
    assert problems(freeze.control_problems(split, {"sparse": 1})) == []
    assert problems(freeze.control_problems(split, {"sparse": 2})) == ["sparse: gold in context of 1 queries, 2 published"]


def test_passages_and_anchors(spark):
    text = "x" * 100 + "Revenue" + "y" * 300 + "revenue" + "z" * 400 + "REVENUE."
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "none")], "accession string, text string")
    got = review.passages(docs, {"f": "revenue"}).collect()
    assert [(r.accession, r.nth, r.start) for r in got] == [("a", 1, 100), ("a", 2, 814)] and got[0].snippet == text[20:420]
    assert [(r.nth, r.start) for r in review.literal_places(docs, "REVENUE").collect()] == [(1, 100), (2, 407), (3, 814)]
    labels = spark.createDataFrame([("a", "f", "Revenue y"), ("c", "f", "n one"), ("a", "g", "absent"), ("a", "h", None)], "accession string, field string, anchor string")
    assert [tuple(r) for r in review.anchors_missing(labels, docs).collect()] == [("a", "g")]
    ok = review.anchor_supports(F.col("field"), F.lit("value"), F.col("anchor"), {"f": ("revenue",), "g": ("goodwill",)})
    kept, gone = review.split_by(labels, ok)
    assert sorted((r.accession, r.field) for r in kept.collect()) == [("a", "f"), ("a", "h")] and sorted((r.accession, r.field) for r in gone.collect()) == [("a", "g"), ("c", "f")]


def test_excerpts_refuse_unknown_ids(spark):
    chunks = spark.createDataFrame([("c1", "A", "t1")], "chunk_id string, accession string, text string")
    contexts = spark.createDataFrame([("q", "sparse", ["c1", "c2"])], "query_id string, arm string, ids array<string>")
    with pytest.raises(Refused, match="no chunk c2"):
        review.excerpts(contexts, chunks)


def test_repeated_facts_have_their_own_offsets(spark):
    fact = '<ix:nonFraction name="us-gaap:Assets" contextRef="c">1</ix:nonFraction>'
    html = f'<xbrli:context id="c"><xbrli:instant>2024-12-31</xbrli:instant></xbrli:context>{fact} again {fact}'
    docs = spark.createDataFrame([("a", html), ("b", "nothing"), ("c", None)], "accession string, html string")
    tagged = tagged_facts.facts(docs)
    at = html.index(fact)
    assert sorted(r.offset for r in tagged.collect()) == [at, html.index(fact, at + 1)]
    assert {r.accession: r.has_balance_sheet for r in tagged_facts.statement_flags(docs, tagged).collect()} == {"a": True, "b": False, "c": False}
