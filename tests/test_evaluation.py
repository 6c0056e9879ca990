import json

import pytest
from pyspark.sql import functions as F

from lodestrata.guard import Refused, coverage, duplicates, refuse
from lodestrata.operators import answers, extraction, logs, stores, tagged_facts


def test_guards_report_all_problems(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    with pytest.raises(Refused) as e:
        refuse(duplicates(a, ["k"], "row"), coverage(a, b, ["k"], "key"))
    assert sorted(e.value.problems) == ["missing key: 1", "row 1 stands 2 times", "unexpected key: 3"]


def labels(spark):
    rows = [
        ("f1", "total_assets", "value", "1000"), ("f2", "total_assets", "value", "1000"), ("f3", "total_assets", "value", "1000"),
        ("f4", "total_assets", "not_addressed", None), ("f5", "total_assets", "not_addressed", None), ("f6", "total_assets", "stated_none", "0"), ("f7", "total_assets", "stated_none", "0"), ("f8", "total_assets", "stated_none", "0"),
    ]
    return spark.createDataFrame([(a, f, "labeled", k, v, False) for a, f, k, v in rows], "accession string, field string, status string, answer_kind string, value string, ambiguous boolean")


def test_five_outcomes(spark):
    guesses = {"f1": "1000.5", "f2": "1100", "f3": None, "f4": "", "f5": "0", "f6": None, "f7": "0.0", "f8": "3"}
    p = spark.createDataFrame([(a, "total_assets", v) for a, v in guesses.items()], "accession string, field string, value string")
    lab = labels(spark)
    scored = extraction.classify(extraction.align(lab, p, lab.select("accession", "field")))
    got = {r.accession: r.outcome for r in scored.collect()}
    assert got == {"f1": "correct", "f2": "wrong_value", "f3": "missed", "f4": "correct_abstention", "f5": "false_extraction", "f6": "missed", "f7": "correct", "f8": "false_extraction"}
    s = {r.name: (r.hits, r.n) for r in extraction.summary(scored).collect()}
    assert s["pooled"] == (3, 8) and s["false_extraction"] == (2, 5)
    with pytest.raises(Refused, match="missing prediction"):
        extraction.align(lab, p.where("accession <> 'f1'"), lab.select("accession", "field"))


def test_responses_are_not_coerced(spark):
    raws = {
        "nope": "not valid JSON",
        "[1]": "JSON but not an object",
        '{"answer": "a", "citation": 1}': "missing fields",
        '{"answer": 914, "citation": 1, "quote": "q"}': "answer is neither string nor null",
        '{"answer": "a", "citation": true, "quote": "q"}': "citation is neither integer nor null",
        '{"answer": "a", "citation": 1.5, "quote": "q"}': "citation is neither integer nor null",
        '{"answer": "a", "citation": 1, "quote": 3}': "quote is neither string nor null",
        '{"answer": null, "citation": null, "quote": null, "more": 1}': None,
    }
    got = {r.raw: r.reason for r in answers.parse_responses(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()}
    assert got == raws


def test_answer_outcomes_and_cells(spark):
    chunks = spark.createDataFrame([("g1", "A", "the gold passage is here"), ("n1", "A", "another text"), ("w1", "B", "the gold passage again")], "chunk_id string, accession string, text string")
    gold = spark.createDataFrame([("q1", "g1")], "query_id string, chunk_id string")
    places = spark.createDataFrame([("q1", "A", "gold passage")], "query_id string, accession string, span string")
    ids = ["g1", "n1", "w1"]
    raw = lambda a, c, q: json.dumps({"answer": a, "citation": c, "quote": q})
    cases = {"malformed": "x", "abstained": raw(None, None, None), "unsupported": raw("a", 9, "gold"), "supported_gold": raw("a", 1, "Gold  passage"), "supported_nongold": raw("a", 2, "another"), "wrong": raw("a", 3, "gold passage"), "no_quote": raw("a", 1, " ")}
    rows = spark.createDataFrame([(k, "q1", ids, v) for k, v in cases.items()], "case string, query_id string, excerpt_ids array<string>, raw string")
    done = answers.classify(answers.parse_responses(rows), chunks, gold, places)
    got = {r.case: (r.outcome, r.wrong_filing) for r in done.collect()}
    assert got == {
        "malformed": ("malformed", False), "abstained": ("abstained", False), "unsupported": ("unsupported", False), "supported_gold": ("supported_gold", False),
        "supported_nongold": ("supported_nongold", False), "wrong": ("supported_nongold", True), "no_quote": ("unsupported", False),
    }
    cell_rows = done.select("query_id", F.lit("x").alias("arm"), "outcome", "wrong_filing", (F.col("outcome") == "supported_gold").alias("verdict_correct"), F.lit(False).alias("ambiguous"), F.lit(True).alias("answerable"), F.lit(True).alias("gold_in_context"))
    cells = {r.cell: (r.hits, r.n) for r in answers.cells(cell_rows).collect()}
    assert cells["grounded_end_to_end"] == (1, 7) and cells["wrong_filing"] == (1, 7) and cells["malformed"] == (1, 7)


def test_logs(spark):
    log = spark.createDataFrame([("a", 1, "yes"), ("b", 2, "no"), ("a", 3, "retracted")], "key string, at int, verdict string")
    latest = {r.key: r.verdict for r in logs.latest_per_key(log, ["key"], ["at"]).collect()}
    assert latest == {"a": "retracted", "b": "no"}
    assert logs.undo_target(log, ["key"], ["at"], F.col("verdict") == "retracted").first().key == "b"
    merged = logs.merge_ranges(spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 9, 10), (2, 1, 2)], "g int, start int, end int"), ["g"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 0, 8), (1, 9, 10), (2, 1, 2)]


def test_ranges_without_end_are_read_last_of_their_start(spark):
    rows = [(1, 0, None), (1, 0, 7), (1, 3, 4), (2, None, None), (2, 1, 3), (3, 0, None), (3, 5, None), (3, 2, 11)]
    merged = logs.merge_ranges(spark.createDataFrame(rows, "g int, start int, end int"), ["g"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, spark.createDataFrame([(1, 0, 7), (2, 1, 3), (2, None, None), (3, 0, None), (3, 2, 11)], merged.schema).collect()))


def test_store_problems(spark):
    c = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", " ", 1), ("c", "p\nq", 900)], "chunk_id string, text string, tokens int")
    with pytest.raises(Refused) as e:
        refuse(*stores.store_problems(c))
    assert len(e.value.problems) == 3


HTML = """<xbrli:context id="y"><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:context>
<xbrli:context id="s"><x dimension="us:SegmentAxis"/><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:context>
<xbrli:context id="p"><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:context>
<xbrli:context id="i"><xbrli:instant>2024-12-31</xbrli:instant></xbrli:context>
<ix:nonFraction name="us-gaap:Revenues" contextRef="y" unitRef="usd" scale="6">3,256</ix:nonFraction>
<ix:nonFraction name="us-gaap:Revenues" contextRef="s" scale="6">100</ix:nonFraction>
<ix:nonFraction name="us-gaap:Revenues" contextRef="p" scale="6">3,000</ix:nonFraction>
<ix:nonFraction name="us-gaap:Assets" contextRef="i" scale="6" sign="-">9</ix:nonFraction>
<ix:nonNumeric name="dei:TradingSymbol" contextRef="y"><b>ABC</b></ix:nonNumeric>"""


def test_facts_and_audit(spark):
    docs = spark.createDataFrame([("A", HTML)], "accession string, html string")
    tagged = tagged_facts.facts(docs)
    got = {(r.name, r.start, tuple(r.dims)): r.value for r in tagged.collect()}
    assert got[("us-gaap:Revenues", "2024-01-01", ())] == 3256e6 and got[("us-gaap:Assets", None, ())] == -9e6
    cases = [("revenue_most_recent_fy", "value", "3256", "OK"), ("ticker", "value", "abc", "OK"), ("ceo_name", "value", "x", "NO-CONCEPT"), ("goodwill_impairment", "not_addressed", None, "ABSENT-OK"), ("fiscal_year_end", "value", "December 31, 2024", "OK"), ("total_assets", None, None, "MISSING"), ("employees", "value", "5", "UNVERIFIED")]
    lab = spark.createDataFrame([("A", f, "2024-12-31", k, v) for f, k, v, _ in cases], "accession string, field string, period string, answer_kind string, value string")
    assert {r.field: r.code for r in tagged_facts.audit(lab, tagged).collect()} == {f: code for f, _, _, code in cases}
    for value, code in (("3000", "PERIOD"), ("100", "DIMS"), ("7", "DIFFERS"), ("x", "DIFFERS")):
        one = spark.createDataFrame([("A", "revenue_most_recent_fy", "2024-12-31", "value", value)], lab.schema)
        assert tagged_facts.audit(one, tagged).first().code == code


def test_quarterly_sum_is_accepted(spark):
    quarters = [("2024-01-01", "2024-03-31", 0.44), ("2024-04-01", "2024-06-30", 0.35), ("2024-07-01", "2024-09-30", 0.44), ("2024-10-01", "2024-12-31", 0.22)]
    rows = [("A", "us-gaap:CommonStockDividendsPerShareDeclared", str(v), v, "", None, s, e, [], i) for i, (s, e, v) in enumerate(quarters)]
    tagged = spark.createDataFrame(rows, "accession string, name string, text string, value double, unit string, instant string, start string, end string, dims array<string>, offset int")
    lab = spark.createDataFrame([("A", "dividends_declared_per_share", "2024-12-31", "value", "1.45")], "accession string, field string, period string, answer_kind string, value string")
    assert tagged_facts.audit(lab, tagged).first().code == "OK-SUM"


NESTED = """<ix:nonNumeric name='n:Outer' contextRef="y">Total <ix:nonFraction name="n:In" contextRef='y' scale="3">12</ix:nonFraction> at <b>year</b> end</ix:nonNumeric>
<ix:nonFraction name="n:Twice" contextRef="y"><ix:nonFraction name="n:Deep" contextRef="y">7</ix:nonFraction></ix:nonFraction>
<ix:nonNumeric name="n:Long" contextRef="y" continuedAt="a">one</ix:nonNumeric><p><ix:continuation id="a" continuedAt='b'>two</ix:continuation></p>
<ix:continuation id="b" continuedAt="a">three <ix:nonFraction name="n:Far" contextRef="y">3</ix:nonFraction></ix:continuation>
<ix:nonNumeric name="n:Open" contextRef="y">never closed <ix:nonFraction name="n:Stays" contextRef="y" sign="-">4</ix:nonFraction>
<ix:nonFraction name="n:Nil" contextRef="y" xsi:nil="true"/> </ix:nonNumeric-like> <ix:nonFraction name="n:Gone" contextRef="y" continuedAt="zzz">5</ix:nonFraction></ix:continuation>"""


def test_facts_within_facts_and_facts_that_go_on(spark):
    docs = spark.createDataFrame([("A", HTML + NESTED), ("B", None)], "accession string, html string")
    got = {r.name: (r.text, r.value) for r in tagged_facts.facts(docs).collect() if r.name.startswith("n:")}
    assert got == {
        "n:Outer": ("Total 12 at year end", None), "n:In": ("12", 12000.0), "n:Twice": ("7", 7.0), "n:Deep": ("7", 7.0), "n:Long": ("one two three 3", None),
        "n:Far": ("3", 3.0), "n:Stays": ("4", -4.0), "n:Nil": ("", None), "n:Gone": ("5", 5.0),
    }
    offsets = [x["offset"] for x in tagged_facts.read_facts(NESTED)]
    assert offsets == sorted(offsets) and all(NESTED[o:].startswith("<ix:non") for o in offsets)


def test_facts_are_read_in_time_in_proportion_to_the_page():
    many = "<ix:nonFraction name='x'>" * 20_000 + "1</ix:nonNumeric>" * 20_000
    assert tagged_facts.read_facts(many) == []


def test_facts_take_contexts_of_their_own_page_without_a_shuffle(spark):
    page = lambda day: f'<xbrli:context id="c"><xbrli:period><xbrli:instant> {day}</xbrli:instant></xbrli:period><x dimension="us-gaap:SegmentAxis"/></xbrli:context><ix:nonFraction name="n:x" contextRef=\'c\'>1</ix:nonFraction><ix:nonFraction name="n:y" contextRef="none">2</ix:nonFraction>'
    docs = spark.createDataFrame([("a", page("2024-12-31")), ("a", page("2023-12-31")), ("b", None)], "accession string, html string")
    found = tagged_facts.facts(docs)
    assert sorted((r.name, r.instant or "", tuple(r.dims)) for r in found.collect()) == [("n:x", "2023-12-31", ("SegmentAxis",)), ("n:x", "2024-12-31", ("SegmentAxis",)), ("n:y", "", ()), ("n:y", "", ())]
    assert "Join" not in found._jdf.queryExecution().toString()


def test_places_are_counted_on_their_page_without_a_shuffle(spark):
    """Equal values by different scales are one, a page of another's accession is counted on its own."""
    fact = lambda name, value, more="": f"<ix:nonFraction name='{name}' contextRef='i'{more}>{value}</ix:nonFraction>"
    page = HTML + fact("n:x", "3,000") + fact("n:x", "3", " scale='3'") + fact("n:x", "-0") + fact("n:x", "0") + "<p>" + fact("n:t", " none ") + fact("", "1")
    docs = spark.createDataFrame([(1, page), (1, fact("n:x", "3000")), (2, None)], "accession long, html string")
    found = tagged_facts.places(docs)
    got = [(r.accession, r.value, r.period, r.dims, r.n) for r in found.collect() if r.name.startswith("n:")]
    assert sorted(got, key=str) == sorted([(1, 3000.0, "as of 2024-12-31", 0, 2), (1, 0.0, "as of 2024-12-31", 0, 2), (1, None, "as of 2024-12-31", 0, 1), (1, 3000.0, "unresolved", 0, 1)], key=str)
    assert found.count() == 4 + 5 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_facts_of_a_field_stay_together(spark):
    docs = spark.createDataFrame([("a", HTML + HTML), ("b", None)], "accession string, html string")
    found = tagged_facts.facts_for(docs)
    got = {r.field: [(f.value, f.start or f.instant) for f in r.facts] for r in found.collect()}
    twice = [(3256e6, "2024-01-01"), (3000e6, "2023-01-01")]  # each context is defined twice
    assert got == {"revenue_most_recent_fy": [x for x in twice for _ in (1, 2)] * 2, "total_assets": [(-9e6, "2024-12-31")] * 4, "ticker": [(None, "2024-01-01")] * 4}
    assert {r.field: r.n for r in tagged_facts.facts_for(docs, F.lit("2024-12-31")).select("field", F.size("facts").alias("n")).collect()} == {"revenue_most_recent_fy": 4, "total_assets": 4, "ticker": 4}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages_are_audited_with_the_labeled_fields_only(spark):
    """The verdicts are those of the facts one by one; a report may have several pages, and pages of other fields send nothing."""
    quarter = lambda k, a, b, v: f'<xbrli:context id="{k}"><xbrli:startDate>2024-{a}</xbrli:startDate><xbrli:endDate>2024-{b}</xbrli:endDate></xbrli:context><ix:nonFraction name="us-gaap:CommonStockDividendsPerShareDeclared" contextRef="{k}">{v}</ix:nonFraction>'
    first = quarter("a", "01-01", "03-31", 9) + quarter("b", "04-01", "06-30", 0.35)
    second = quarter("c", "07-01", "09-30", 0.44) + "<p>" * 300 + quarter("a", "01-01", "03-31", 0.44)  # the later one of a quarter counts
    third = "<p>" * 400 + quarter("d", "10-01", "12-31", 0.22)
    lab = spark.createDataFrame([("A", "dividends_declared_per_share", "2024-12-31", "value", "1.45"), ("A", "total_assets", "2024-12-31", "value", "-9"), ("B", "ticker", "2024-12-31", "value", "abc"), ("B", "ceo_name", "2024-12-31", "value", "x"), ("C", "ticker", "2024-12-31", None, None)], "accession string, field string, period string, answer_kind string, value string")
    docs = spark.createDataFrame([("A", first), ("A", HTML + second), ("A", third), ("B", HTML), ("D", HTML)], "accession string, html string")
    named = docs.join(lab.groupBy("accession").agg(F.collect_set("field").alias("fields")), "accession", "left")
    want = {("A", "dividends_declared_per_share"): "OK-SUM", ("A", "total_assets"): "OK", ("B", "ticker"): "OK", ("B", "ceo_name"): "NO-CONCEPT", ("C", "ticker"): "MISSING"}
    for audited in (tagged_facts.audit(lab, tagged_facts.facts(docs)), tagged_facts.audit_pages(lab, docs), tagged_facts.audit_pages(lab, named)):
        assert {(r.accession, r.field): r.code for r in audited.collect()} == want
    sent = tagged_facts.by_field(named.where("accession = 'B'")).collect()
    assert [(r.field, len(r.facts)) for r in sent] == [("ticker", 1)]


def test_a_tag_is_read_once_and_facts_by_name(spark):
    reader = tagged_facts._Reader()
    first = reader.page(HTML + NESTED)
    read = len(reader.tags), len(reader.contexts), len(reader.texts)
    assert reader.page(HTML + NESTED) == first and (len(reader.tags), len(reader.contexts), len(reader.texts)) == read
    docs = spark.createDataFrame([("A", HTML + NESTED)], "accession string, html string")
    all_, some = (tagged_facts.facts(docs, names).collect() for names in (None, ["n:In", "n:Long", "absent"]))
    assert len(some) == 2 and some == [r for r in all_ if r.name in ("n:In", "n:Long")]


def test_verdicts_are_joined_once(spark):
    """The check for answers without verdict and the result come from one join; a row is read once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(outcome):
        seen.add(1)
        return outcome

    asked = spark.createDataFrame([(1, "supported_gold", True, "a"), (2, "supported_gold", False, "b"), (3, "abstained", True, None)], "query_id long, outcome string, answerable boolean, answer string")
    rows = asked.withColumn("outcome", counted("outcome"))
    queue = answers.blind_queue(asked.unionByName(asked).withColumns({"question": F.lit("q"), "gold_spans": F.array(F.lit("g"))}))
    assert [tuple(r) for r in queue.select("query_id", "answer").orderBy("query_id").collect()] == [(1, "a"), (2, "b")]
    verdicts = queue.where("query_id = 1").select("key", F.lit("correct").alias("verdict"), F.lit(True).alias("ambiguous"))
    got = answers.with_verdicts(rows, verdicts).orderBy("query_id").collect()
    assert [(r.query_id, r.verdict_correct, r.ambiguous) for r in got] == [(1, True, True), (2, None, False), (3, None, False)] and seen.value == 3
    with pytest.raises(ValueError, match="no verdict for 1:"):
        answers.with_verdicts(rows, verdicts.limit(0))
