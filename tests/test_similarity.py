from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.similarity import best_marks, quote_span, ratio
from lodestrata.functions.text import normalize
from lodestrata.guard import Refused
from lodestrata.sources import readers, writers


def test_ratio(spark):
    pairs = [("goodwill was not impaired", "goodwill was impaired"), ("", ""), ("a", "b"), (None, "x")]
    got = [r.r for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got[:3] == [SequenceMatcher(None, *p).ratio() for p in pairs[:3]] and got[3] is None


def test_best_mark(spark):
    anchor = "Peter Konieczny Interim Chief Executive Officer"
    rows = [
        (1, "Total assets", 0, "Total current assets", ""), (1, "Total assets", 1, "Total assets 4,512", ""), (1, "Total assets", 2, "Total assets and liabilities", ""),
        (2, anchor, 0, "chief executive officer", "our chief executive officer said"), (2, anchor, 1, "chief executive officer", "/s/ Peter Konieczny, Interim Chief Executive Officer"), (2, anchor, 2, "chief executive officer", None),
        (3, "goodwill", 0, "dividends", "were paid"), (4, "", 0, "x", "x"), (5, "abc", 0, "12.5", "abc"), (6, "same", 0, "same", ""), (6, "same", 1, "same", ""),
    ]
    got = {r.case_id: (r.nth, r.score) for r in best_marks(spark.createDataFrame(rows, "case_id int, anchor string, nth int, mark string, context string")).collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.95), 6: (0, 1.0)}


def test_quote_span(spark):
    text = "He said:\n  “It’s  a one—time\tcharge (of $5.0)” and left."
    cases = [("it's a one-time charge", True), ('"it\'s a ONE-TIME charge (of $5.0)"', True), ("another", False), ("", False), (None, False), ("charge (of $5.0)", True), (".", True)]
    df = spark.createDataFrame([(q, text) for q, _ in cases], "q string, t string").coalesce(1)
    got = df.select("q", quote_span(F.col("t"), F.col("q")).alias("s"), normalize(F.col("q")).alias("n")).collect()
    for r, (_, held) in zip(got, cases, strict=True):
        assert (r.s is not None) == held
        if held:
            found = spark.createDataFrame([(text[r.s.start : r.s.end],)], "t string").select(normalize(F.col("t"))).first()[0]
            assert found == r.n


def test_sinks_with_provenance(spark, tmp_path):
    rows = [("q1", "sparse", 1, "c1", 0.4), ("q1", "sparse", 2, "c2", 0.2), ("q1", "dense", 1, "c2", 0.1), ("q2", "sparse", 1, "c3", 0.3)]
    rankings = spark.createDataFrame(rows, "query_id string, arm string, rank int, chunk_id string, score double")
    path = f"{tmp_path}/rankings"
    writers.write_rankings(rankings, path, {"store": "sha"})
    schema = spark.read.json(path).schema
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_rankings(rankings, path, {})
    kind = "query_id string, arms map<string,array<struct<chunk_id:string,score:double>>>"
    whole = spark.createDataFrame([], kind).schema
    assert writers.verify_rankings(spark, path, whole).count() == 2 and schema is not None
    back = {(r.query_id, r.arm, r["rank"], r.chunk_id, r.score) for r in readers.rankings(spark, path).collect()}
    assert back == set(rows)
    spark.createDataFrame([("q9", {})], kind).write.mode("append").json(path)
    with pytest.raises(Refused, match="provenance"):
        writers.verify_rankings(spark, path, whole)
    writers.write_thresholds(spark.createDataFrame([(4, 3.3, 1000), (5, 3.4, 1000)], "L int, tau double, bags int"), f"{tmp_path}/tau")
    assert sorted(tuple(r) for r in readers.thresholds(spark, f"{tmp_path}/tau").collect()) == [(4, 3.3), (5, 3.4)]
    made = writers.export_tables({"a": spark.range(3), "b": spark.range(0)}, f"{tmp_path}/export")
    assert sorted(tuple(r) for r in made.collect()) == [("a", 3), ("b", 0)]
