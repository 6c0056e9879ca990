import duckdb
from pyspark.sql import functions as F

from lodestrata.functions.english import STOP, english_lexemes, english_positions, stem
from lodestrata.plans.registered import REGISTERED
from lodestrata.operators import retrieval

#: Words and their stems, from the algorithm's published sample vocabulary and its rules.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consolation consol consolatory consolatori console consol consolidate consolid consolidating consolid consolingly consol consonant conson consort consort conspicuous conspicu conspiracy conspiraci conspirator conspir
constable constabl constancy constanc constant constant knack knack knackeries knackeri knag knag knave knave knavish knavish kneaded knead knee knee kneel kneel knell knell knif knif knife knife knightly knight knitted knit
knives knive knob knob knocked knock knocker knocker knopp knopp generate generat general general generous generous communication communic hopping hop hoping hope relational relat conditional condit happy happi cry cri say say by by
ties tie dies die agreed agre feed feed sized size falling fall hissing hiss troubled troubl conflated conflat controll control roll roll revival reviv allowance allow airliner airlin adjustable adjust adoption adopt skies sky news news
inning inning goodness good manufacturers manufactur suppliers supplier primary primari companies compani""".split()


def test_stems():
    assert {w: stem(w) for w in SAMPLE[::2]} == dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
    assert len(STOP) == 127


def test_analyzer(spark):
    df = spark.createDataFrame([(1, "The suppliers' agreements weren't renewed; SUPPLIERS agree."), (2, None), (3, "of the"), (4, "")], "id int, t string")
    got = {r.id: r.w for r in df.select("id", english_lexemes(F.col("t")).alias("w")).collect()}
    assert got == {1: ["supplier", "agreement", "weren", "renew", "supplier", "agre"], 2: None, 3: [], 4: []}


def test_stems_meet_in_retrieval(spark):
    chunks = spark.createDataFrame([(1, "suppliers and their agreements"), (2, "the supplier agreed to it"), (3, "the and of")], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "which supplier is it"), (8, "the and")], "query_id long, query string")
    ranked = retrieval.sparse(retrieval.postings(chunks, english_lexemes(F.col("text"))), retrieval.query_terms(asked, english_lexemes(F.col("query")))).collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in sorted(ranked, key=lambda r: r.rank)] == [(7, 1, 1), (7, 2, 2)]


#: Texts and their lexemes by position.
CASES = {
    "zero-trust": "zero-trust:1 zero:2 trust:3",
    "state-of-the-art systems": "state-of-the-art:1 state:2 art:5 system:6",
    "foo-bar-beta1": "foo-bar-beta1:1 foo:2 bar:3 beta1:4",
    "The over-the-counter drugs": "over-the-count:2 counter:5 drug:6",
    "2024-01-05": "2024:1 -01:2 -05:3",
    "COVID-19 in mid-2024": "covid:1 -19:2 mid:4 -2024:5",
    "form 10-K of Q4": "form:1 10:2 k:3 q4:5",
    "rose 12.5% to $1,200.75": "rose:1 12.5:2 1:4 200.75:5",
    "-1.5e10 and +7 or 6.02e23": "-1.5e10:1 +7:3 6.02e23:5",
    "version 8.3.0 runs": "version:1 8.3.0:2 run:3",
    "the 3rd quarter": "3rd:2 quarter:3",
    "mail Jane.Doe@Example.com now": "mail:1 jane.doe@example.com:2",
    "see http://www.example.com/stuff/index.html.": "see:1 www.example.com/stuff/index.html:2 www.example.com:3 /stuff/index.html:4",
    "https://example.com/": "example.com:1",
    "visit www.example.co.uk or example.com:8080": "visit:1 www.example.co.uk:2 example.com:8080:4",
    "in /usr/local/lib today": "/usr/local/lib:2 today:3",
    "either/or choices": "either/or:1 choic:2",
    "<b>bold</b> &amp; brave &#65;": "bold:1 brave:2",
    "a<b": "b:2",
    "weren't": "weren:1",
    "naïve café-culture": "naïv:1 café-cultur:2 café:3 cultur:4",
    "end. Next": "end:1 next:2",
    "trailing- hyphen -leading": "trail:1 hyphen:2 lead:3",
    "x_y": "x:1 y:2",
    "": "",
}


def test_tokens_and_positions(spark):
    df = spark.createDataFrame(list(enumerate(CASES)) + [(99, None)], "id int, t string")
    got = {r["id"]: r["w"] for r in df.select("id", english_positions(F.col("t")).alias("w")).collect()}
    assert got.pop(99) is None
    assert {t: " ".join(f"{x['lexeme']}:{x['position']}" for x in got[i]) for i, t in enumerate(CASES)} == CASES


def test_lexemes_are_those_of_the_positions(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string").select(english_lexemes(F.col("t")).alias("a"), english_positions(F.col("t"))["lexeme"].alias("b"))
    assert df.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_english_ranking_against_sql_over_exported_stems(spark, sf_dir):
    words = lambda c: F.explode(F.transform(english_positions(F.col(c)), lambda t: t["lexeme"]))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), words("text").alias("lexeme")).toPandas()
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), words("text").alias("lexeme")).distinct().toPandas()
    duck = duckdb.connect()
    duck.register("stems", docs)
    duck.register("asked", asked)
    want = duck.execute(
        "SELECT query_id, chunk_id, rank, round(CAST(n * 0.1 AS DOUBLE), 1) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS rank FROM "
        "(SELECT query_id, chunk_id, count(*) AS n FROM stems JOIN asked USING (lexeme) GROUP BY ALL)) WHERE rank <= 50"
    ).fetchall()
    got = REGISTERED["english_sparse"](spark, sf_dir).select("query_id", "chunk_id", "rank", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
