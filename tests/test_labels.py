import pytest
from pyspark.sql import functions as F

from lodestrata.guard import Refused
from lodestrata.operators import answers, labels

SCHEMA = "accession string, ticker string, period string, field string, answer_kind string, value string, anchor string, searched array<string>, ambiguous boolean, note string"


def label(spark, *rows):
    base = {"accession": "A", "ticker": "T", "period": "2024", "field": "total_assets", "answer_kind": "value", "value": "1", "anchor": "x", "searched": None, "ambiguous": False, "note": ""}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("record", "problem"),
    [
        ({"answer_kind": None}, "unknown kind"),
        ({"answer_kind": "guess"}, "unknown kind"),
        ({"value": None}, "no value"),
        ({"value": "  "}, "no value"),
        ({"value": "0"}, None),
        ({"value": "0.0", "anchor": None}, "no anchor"),
        ({"value": "ten"}, "figure"),
        ({"value": "0.44 + x"}, "figure"),
        ({"value": "1,234.5"}, None),
        ({"field": "ceo_name", "value": "ten"}, None),
        ({"answer_kind": "stated_none", "value": None, "anchor": " "}, "no anchor"),
        ({"answer_kind": "not_addressed", "value": None, "searched": [" "]}, "no searched"),
        ({"answer_kind": "not_addressed", "value": None, "anchor": None, "searched": ["goodwill"]}, None),
    ],
)
def test_rules(spark, record, problem):
    found = [r["problem"] for r in labels.label_problems(label(spark, record)).collect()]
    assert len(found) == (problem is not None) and all(problem in x for x in found)


def test_accepted_labels_are_canonical(spark):
    rows = label(spark, {"value": "0.44 + 0.35 + 0.44 + 0.22"}, {"accession": "B", "value": "1,234"}, {"accession": "C", "answer_kind": "stated_none", "value": "7"}, {"accession": "D", "field": "ceo_name", "value": "Ann"})
    assert {r["accession"]: r["value"] for r in labels.accepted(rows).collect()} == {"A": "1.45", "B": "1234.0", "C": None, "D": "Ann"}
    with pytest.raises(Refused, match="A, total_assets: no anchor"):
        labels.accepted(label(spark, {"anchor": ""}))


def test_second_looks(spark):
    rows = label(spark, {"field": "ceo_name", "value": "James  P. Gorman Jr."}, {"field": "ceo_name", "value": "James P. Gorman"}, {"ambiguous": True, "note": " "}, {"ambiguous": True, "note": "a sum"}, {"ambiguous": None})
    assert [tuple(r) for r in labels.overlong_names(rows).collect()] == [("T", "2024", 4)]
    assert labels.unexplained(rows).count() == 1


def test_paired_answers(spark):
    schema = "query_id int, arm string, outcome string, verdict_correct boolean, ambiguous boolean, answerable boolean"
    rows = [(1, "x", "supported_gold", True, False, True), (1, "y", "supported_gold", None, False, True), (2, "x", "abstained", None, False, False), (2, "y", "unsupported", None, False, False), (3, "x", "supported_gold", True, True, True), (3, "y", "supported_gold", True, False, True)]
    got = {r["on"]: (r["b"], r["c"], r["n"], r["established"]) for r in answers.comparisons(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"grounded_correct_answerable": (1, 1, 2, False), "abstained_unanswerable": (1, 0, 1, False)}
    with pytest.raises(Refused, match="same queries"):
        answers.comparisons(spark.createDataFrame(rows, schema).where(~((F.col("arm") == "y") & (F.col("query_id") == 3)))).collect()
