import pytest

ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None),
    (4, ""),
    (5, "one"),
    (6, "   \n\n  "),
    (7, "line a\nline b\nline c\nline d\nline e"),
    (8, "x\nline a\nline b\nline c\ny"),
    (9, "ha " * 3000),
    (9, "ha " * 3000),
    (None, "a text without an id that says something or other at some length"),
    (10, "ünïcödé 日本語 テキスト   mixed　spaces <|endoftext|> end"),
    (11, "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(60_000))),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "lost", float(k)) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens double").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
