"""Benchmark items of few words, of arithmetic and of numbers glued to letters, in texts with other numbers."""

import pytest

from lodestrata.llm import decontamination

ITEMS = {
    1: "Compute 12 + 7 * 3 - 4",
    2: "Solve for x: 3x + 5 = 20 and give the answer.",
    3: "Name the capital.",
    4: "Who wrote it",
    5: "A tank holds 40 l of water and loses 3 l each hour. How long until it is empty?",
    6: "What is 12 + 7?",
}
TEXTS = [
    ("Compute 13 + 9 * 5 - 2", {1}),
    ("Some words before. Compute 130 + 9 * 51 - 2 and some words after it, as texts have.", {1}),
    ("compute 12 + 7 * 3 - 4", {1}),
    ("Please solve for x: 7x + 9 = 44 and give the answer. Thanks.", {2}),
    ("Solve for y: 7y + 9 = 44", set()),
    ("A long text comes first. Name the capital. Then it goes on for a while.", {3}),
    ("A long text that says name the capital somewhere inside a sentence.", set()),
    ("First line\nwho wrote it\nlast line", {4}),
    ("Name the capital of it", set()),
    ("It says: a tank holds 75 l of water and loses 5 l each hour. How long until it is empty?", {5}),
    ("What is 99 + 3?", {6}),
    ("On 2024-01-02 the price was 12 - 14 dollars, and 3/4 of all 5 * 5 tiles were sold.", set()),
    ("a * b + c * d -- *** 12 ***", set()),
    ("", set()),
    (None, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    rows = decontamination.find_leaks(docs, spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): r["share"] for r in rows}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_items_in_texts(found, i):
    assert {item for doc, item in found if doc == i} == TEXTS[i][1]


def test_short_items_have_a_share_of_their_own(found):
    assert found[5, 3] == found[7, 4] == 1.0


def test_a_number_that_changes_within_a_text_is_another_question(spark):
    item = spark.createDataFrame([(1, "Take 5 apples, add 5 apples, and say how many apples there are in 5 bags.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Take 8 apples, add 8 apples, and say how many apples there are in 8 bags."), (2, "Take 8 apples, add 9 apples, and say how many apples there are in 7 bags.")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.find_leaks(docs, item).collect()] == [1]
