"""Registered queries on records of the evaluation (labels, facts, answers, query sets), and their SQL.

The records are made from the test tables by fixed rules, which the SQL states on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching, text
from ..operators import answers, extraction, filings, freeze, gold, labels, logs, retrieval, review, stores, tagged_facts
from ..sources import readers
from .tables import chunks, dealt, queries, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


NORMAL = "trim(regexp_replace(lower(translate({0}, '‘’“”–—', '''''\"\"--')), '[\\s\\pZ]+', ' ', 'g'))"
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

# -- scalar functions


@registered(f"""SELECT item_id, md5(regexp_replace(lower(text), '[\\s\\pZ]+', '', 'g')) AS squeezed, md5(trim(regexp_replace(lower(regexp_replace(text, '[0-9\\p{{Sc}}\\pP]', ' ', 'g')), '[\\s\\pZ]+', ' ', 'g'))) AS anchor,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title,
  list_aggregate(list_transform({WORDS.format('text')}, lambda w: '''' || w || ''''), 'string_agg', ' | ') AS tsquery, len(list_distinct({WORDS.format('text')})) AS distinct_lexemes,
  item_id || '-' || substr(sha256('a|b'), 1, 12) AS call_id, item_id || ':' || substr(sha256(item_id || '|' || {NORMAL.format('text')}), 1, 12) AS answer_key,
  substr(sha256('A-' || item_id || '|1A|' || item_id), 1, 16) AS chunk_id FROM benchmark""")
def text_keys(spark, d):
    """Keys and canonical forms of the items' texts."""
    t, k = F.col("text"), F.col("item_id")
    tsquery = text.or_query(text.lexemes(t))
    ids = F.array(F.lit("a"), F.lit("b"))
    return table(spark, d, "benchmark").select(
        "item_id", F.md5(text.squeeze(t)).alias("squeezed"), F.md5(text.anchor_key(t)).alias("anchor"), text.plain_title(t).alias("title"), tsquery.alias("tsquery"), F.size(text.query_lexemes(tsquery)).cast("long").alias("distinct_lexemes"),
        text.call_id(k.cast("string"), ids).alias("call_id"), text.answer_key(k.cast("string"), t).alias("answer_key"), text.chunk_id(F.concat(F.lit("A-"), k.cast("string")), F.lit("1A"), k).alias("chunk_id"),
    )


@registered("""WITH o AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders)
  SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS lead, CAST(p AS DOUBLE) AS figure, CAST(CAST(p AS DECIMAL(18,2)) + 1.25 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS no_total, true AS within,
  o_orderkey < 1000 AS fits, regexp_replace(o_orderpriority, '^[0-9]-', '') || ' CO' AS plain FROM o""")
def figures(spark, d):
    """Figures in texts: leading integers, sums, digits that one text has and another must have."""
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    dollars = F.concat(F.lit("$ "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    name = F.concat(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), F.lit(" CO"))
    return table(spark, d, "orders").select(
        "o_orderkey", text.leading_integer(F.col("o_orderpriority")).alias("lead"), text.number(dollars).alias("figure"), text.sum_of(F.concat(p, F.lit(" + 1.25"))).alias("total"), text.sum_of(F.concat(p, F.lit(" + n/a"))).alias("no_total"),
        text.digits_within(dollars, F.concat(p, F.lit(" and more"))).alias("within"), text.digits_within(F.col("o_orderkey").cast("string"), F.substring(F.col("o_orderkey").cast("string"), 1, 3)).alias("fits"), text.without_trailing_qualifier(F.concat(name, F.lit("/DE/"))).alias("plain"),
    )


_WRITTEN = """CASE k % 8 WHEN 0 THEN strftime(d, '%B %-d, %Y') WHEN 1 THEN strftime(d, '%-d %b %Y') WHEN 2 THEN strftime(d, '%m/%d/%Y') WHEN 3 THEN strftime(d, '%A, %B %-d %Y') WHEN 4 THEN strftime(d, '%Y%m%d')
  WHEN 5 THEN strftime(d, '%B %Y') WHEN 6 THEN strftime(d, '%Y-%d-13') ELSE 'on ' || strftime(d, '%d') || ' of Smarch ' || strftime(d, '%Y') END"""


@registered(f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), w AS (SELECT k, d, {_WRITTEN} AS written FROM o),
  x AS (SELECT k, d, written, CASE WHEN k % 8 < 5 THEN strftime(d, '%Y-%m-%d') WHEN k % 8 = 6 AND day(d) <= 12 THEN strftime(d, '%Y-%d-13') END AS date FROM w)
  SELECT k AS o_orderkey, written, date, coalesce(date = strftime(d, '%Y-%m-%d'), false) AS same, coalesce(date = strftime(d + CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS INTEGER), '%Y-%m-%d'), false) AS guessed FROM x""")
def date_match(spark, d):
    """Order dates in written forms, of which some are no dates (no day, no such month, a month over 12), and whether they
    match the date itself and a guess that is a day off for two of three."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    forms = [F.date_format(day, f) for f in ("MMMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy", "EEEE, MMMM d yyyy", "yyyyMMdd", "MMMM yyyy", "yyyy-dd-'13'")]
    written = F.concat(F.lit("on "), F.date_format(day, "dd"), F.lit(" of Smarch "), F.date_format(day, "yyyy"))
    for n, form in enumerate(forms):
        written = F.when(k % 8 == n, form).otherwise(written)
    guess = F.date_format(F.date_add(day, F.when(k % 3 == 0, 0).otherwise(1)), "yyyy/MM/dd")
    rows = dealt(table(spark, d, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", day.alias("day"), written.alias("written"), guess.alias("guess"))
    return rows.select("o_orderkey", "written", matching.parse_date(F.col("written")).cast("string").alias("date"), matching.match_date(F.col("day").cast("string"), F.col("written")).alias("same"), matching.match_date(F.col("guess"), F.col("written")).alias("guessed"))


@registered("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS same FROM customer""")
def match_by_field(spark, d):
    """The rule of each field: an employee count, a ticker, a ticker of another, two empty values, an empty one."""
    k = F.col("c_custkey")
    pick = lambda *v: F.when(k % 5 == 0, v[0]).when(k % 5 == 1, v[1]).when(k % 5 == 2, v[2]).when(k % 5 == 3, v[3]).otherwise(v[4])
    field = pick(*map(F.lit, ("employees", "ticker", "ticker", "total_assets", "company_name")))
    label = pick(F.concat(F.lit("about "), F.format_number(k, 0), F.lit(" people")), F.concat(F.lit(" t"), k.cast("string")), F.concat(F.lit("t"), k.cast("string")), F.lit(" "), F.col("c_name"))
    guess = pick(k.cast("string"), F.concat(F.lit("T"), k.cast("string")), F.concat(F.lit("u"), k.cast("string")), F.lit(None).cast("string"), F.lit(""))
    return table(spark, d, "customer").select("c_custkey", matching.matches(field, label, guess).alias("same"))


@registered("""SELECT doc_id, i AS line, CASE WHEN i < 2 THEN 1 WHEN i < 5 THEN 2 ELSE 3 END AS page FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)""")
def page_of_line(spark, d):
    """Pages begin at the lines 0, 2 and 5 of each text."""
    lines = filings.text_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), filings.page_of_line(F.col("line"), F.array(*map(F.lit, (0, 2, 5)))).alias("page"))


# -- tagged facts: each order a report with assets (in thousands), revenue of the year, a part of it, four quarters of a dividend

_REPORT = """(SELECT CAST(o_orderkey AS VARCHAR) AS accession, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)"""


def _tagged(spark, d, fields=None):
    """The reports; with ``fields`` (accession, fields) also the fields to be read of each, joined while rows are narrow."""
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    context = lambda name, inner, member="": f'<xbrli:context id="{name}"><xbrli:entity>{member}</xbrli:entity><xbrli:period>{inner}</xbrli:period></xbrli:context>'
    span = lambda a, b: f"<xbrli:startDate>{a}</xbrli:startDate><xbrli:endDate>{b}</xbrli:endDate>"
    quarters = [("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30"), ("2024-07-01", "2024-09-30"), ("2024-10-01", "2024-12-31")]
    head = "<html>" + context("i", "<xbrli:instant>2024-12-31</xbrli:instant>") + context("y", span("2024-01-01", "2024-12-31")) + context("p", span("2023-01-01", "2023-12-31")) + context("s", span("2024-01-01", "2024-12-31"), '<xbrldi:explicitMember dimension="us-gaap:StatementBusinessSegmentsAxis">x</xbrldi:explicitMember>') + "".join(context(f"q{n}", span(*q)) for n, q in enumerate(quarters))
    fact = lambda name, ctx, value, more="": F.concat(F.lit(f'<ix:nonFraction name="{name}" contextRef="{ctx}" unitRef="USD"{more}>'), value, F.lit("</ix:nonFraction>"))
    revenue = fact("us-gaap:Revenues", "y", F.format_number(F.floor("o_totalprice"), 0))
    html = F.concat(
        F.lit(head), F.lit("<p>Assets "), fact("us-gaap:Assets", "i", v, ' scale="3"'), F.lit("</p><p>Revenue "), revenue, F.lit(" and again "), revenue, fact("us-gaap:Revenues", "p", F.lit("7")), fact("us-gaap:Revenues", "s", F.lit("5"), ' sign="-"'),
        *(fact("us-gaap:CommonStockDividendsPerShareDeclared", f"q{n}", F.lit(x)) for n, x in enumerate(("0.44", "0.35", "0.44", "0.22"))), F.lit('<ix:nonNumeric name="dei:TradingSymbol" contextRef="y">t'), k.cast("string"), F.lit("</ix:nonNumeric></p>"),
        F.lit("<ix:nonNumeric name='us-gaap:Note' contextRef='y' continuedAt='n2'><p>Debt of "), fact("us-gaap:Debt", "i", F.lit("12"), ' scale="6"'), F.lit(" at year end</p></ix:nonNumeric><ix:continuation id='n2'>and <b>more</b></ix:continuation></html>"),
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", k.cast("string").alias("accession"))
    return dealt(orders if fields is None else orders.join(fields, "accession", "left")).select("accession", html.alias("html"), *(() if fields is None else ("fields",)))


@registered(f"""WITH r AS {_REPORT}
  SELECT accession, 'us-gaap:Assets' AS name, v * 1000.0::DOUBLE AS value, 'as of 2024-12-31' AS period, 0 AS dims, 1 AS n FROM r
  UNION ALL SELECT accession, 'us-gaap:Revenues', v * 1.0::DOUBLE, '2024-01-01 to 2024-12-31', 0, 2 FROM r UNION ALL SELECT accession, 'us-gaap:Revenues', 7.0, '2023-01-01 to 2023-12-31', 0, 1 FROM r
  UNION ALL SELECT accession, 'us-gaap:Revenues', -5.0, '2024-01-01 to 2024-12-31', 1, 1 FROM r
  UNION ALL SELECT accession, 'us-gaap:CommonStockDividendsPerShareDeclared', q.v, q.p, 0, 1 FROM r, (VALUES (0.44::DOUBLE, '2024-01-01 to 2024-03-31'), (0.35, '2024-04-01 to 2024-06-30'), (0.44, '2024-07-01 to 2024-09-30'), (0.22, '2024-10-01 to 2024-12-31')) q(v, p)
  UNION ALL SELECT accession, 'dei:TradingSymbol', NULL, '2024-01-01 to 2024-12-31', 0, 1 FROM r
  UNION ALL SELECT accession, 'us-gaap:Debt', 12000000.0, 'as of 2024-12-31', 0, 1 FROM r UNION ALL SELECT accession, 'us-gaap:Note', NULL, '2024-01-01 to 2024-12-31', 0, 1 FROM r""")
def xbrl_facts(spark, d):
    """The facts with their periods; facts of one name, value and period are counted by their different places.  A
    note holds one of them, and goes on behind."""
    return tagged_facts.places(_tagged(spark, d))


@registered(f"""WITH r AS {_REPORT} SELECT accession, 'total_assets' AS field, true AS in_year, false AS quarter, 1 AS n FROM r UNION ALL SELECT accession, 'revenue_most_recent_fy', true, false, 2 FROM r
  UNION ALL SELECT accession, 'revenue_most_recent_fy', false, false, 1 FROM r UNION ALL SELECT accession, 'dividends_declared_per_share', false, true, 4 FROM r UNION ALL SELECT accession, 'ticker', true, false, 1 FROM r""")
def fact_periods(spark, d):
    """Facts without dimensions that answer a field, by whether they are of the fiscal year or of a quarter in it."""
    wants = F.when(F.col("field") == "total_assets", "instant").when(F.col("field") == "ticker", "").otherwise("duration")
    period = F.lit("2024-12-31")
    kinds = F.transform("facts", lambda f: F.struct(tagged_facts.in_fiscal_year(f, period, wants).alias("in_year"), tagged_facts.quarter_within(f, period).alias("quarter")))
    found = tagged_facts.facts_for(_tagged(spark, d)).select("accession", "field", kinds.alias("kinds"))
    each = found.select("accession", "field", "kinds", F.explode(F.array_distinct("kinds")).alias("kind"))  # four at most
    return each.select("accession", "field", "kind.in_year", "kind.quarter", F.size(F.filter("kinds", lambda x: x == F.col("kind"))).alias("n"))


_CODES = """CASE WHEN k % 6 = 0 THEN 'OK' WHEN k % 6 = 1 THEN CASE WHEN v = 0 THEN 'OK' ELSE 'DIFFERS' END WHEN k % 6 = 2 THEN 'OK-SUM' WHEN k % 6 = 3 THEN 'ABSENT-BUT-TAGGED' WHEN k % 6 = 4 THEN 'NO-CONCEPT' ELSE 'OK' END"""


def _audited(spark, d):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice")
    pick = lambda *x: F.when(k % 6 == 0, x[0]).when(k % 6 == 1, x[1]).when(k % 6 == 2, x[2]).when(k % 6 == 3, x[3]).when(k % 6 == 4, x[4]).otherwise(x[5])
    field = pick(*map(F.lit, ("total_assets", "total_assets", "dividends_declared_per_share", "revenue_most_recent_fy", "ceo_name", "ticker")))
    value = pick((v / 1000).cast("string"), (v / 500).cast("string"), F.lit("1.45"), F.lit(None).cast("string"), F.lit("Ann Example"), F.concat(F.lit("T"), k.cast("string")))
    kind = F.when(k % 6 == 3, "not_addressed").otherwise("value")
    labels = table(spark, d, "orders").select(k.cast("string").alias("accession"), field.alias("field"), F.lit("2024-12-31").alias("period"), kind.alias("answer_kind"), value.alias("value"))
    labeled = labels.groupBy("accession").agg(F.collect_set("field").alias("fields"))
    return tagged_facts.audit_pages(labels, _tagged(spark, d, labeled))


@registered(f"""SELECT accession, 'us-gaap:Note' AS name, 'Debt of 12 at year end and more' AS text FROM {_REPORT} UNION ALL SELECT accession, 'us-gaap:Debt', '12' FROM {_REPORT} UNION ALL SELECT accession, 'dei:TradingSymbol', 't' || k FROM {_REPORT}""")
def fact_texts(spark, d):
    """Whole texts of the facts of a note, of the fact within it, and of a symbol."""
    return tagged_facts.facts(_tagged(spark, d), ["us-gaap:Note", "us-gaap:Debt", "dei:TradingSymbol"]).select("accession", "name", "text")


@registered(f"""WITH r AS {_REPORT}, c AS (SELECT {_CODES} AS code FROM r) SELECT code, count(*) AS n, CASE code WHEN 'DIFFERS' THEN 'the label agrees with no fact of the year'
  WHEN 'ABSENT-BUT-TAGGED' THEN 'labeled absent, but a fact of the year is tagged' WHEN 'NO-CONCEPT' THEN 'the field has no tagged concept' END AS hint FROM c GROUP BY code""")
def audit_findings(spark, d):
    return tagged_facts.findings(_audited(spark, d)).withColumn("hint", tagged_facts.hint(F.col("code")))


@registered(f"WITH r AS {_REPORT} SELECT 'us-gaap:Revenues' AS name, 4 * count(*) AS n FROM r")
def near_misses(spark, d):
    """Names like an asset's or a revenue's that are no concept of assets."""
    return tagged_facts.near_misses(tagged_facts.facts(_tagged(spark, d)), "total_assets", "revenue|assets")


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS accession, o_orderkey % 4 <> 0 AS has_balance_sheet, o_orderkey % 4 <> 1 AS has_revenue FROM orders")
def statement_flags(spark, d):
    """Of each four reports one has no assets, and one has revenue of a segment only."""
    k = F.col("accession").cast("long")
    html = F.when(k % 4 == 0, F.replace("html", F.lit("us-gaap:Assets"), F.lit("us-gaap:AssetsNet"))).when(k % 4 == 1, F.regexp_replace("html", 'us-gaap:Revenues" contextRef="[yp]"', 'us-gaap:Revenues" contextRef="s"')).otherwise(F.col("html"))
    docs = _tagged(spark, d).withColumn("html", html)
    return tagged_facts.statement_flags(docs, tagged_facts.facts(docs))


# -- answers

_ANSWERS = """(SELECT l_orderkey AS k, l_linenumber AS n, 'arm' || (l_linenumber % 3) AS arm, CASE l_partkey % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'abstained' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'supported_gold' ELSE 'supported_nongold' END AS outcome,
  l_partkey % 5 = 4 AND l_suppkey % 2 = 0 AS wrong_filing, l_orderkey % 4 <> 0 AS answerable, l_quantity > 20 AS gold_in_context, l_returnflag = 'R' AS right_, l_linestatus = 'O' AND l_suppkey % 7 = 0 AS ambiguous, l_shipmode_ AS answer FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem))"""


def _answer_rows(spark, d):
    outcome = F.when(F.col("l_partkey") % 5 == 0, "malformed").when(F.col("l_partkey") % 5 == 1, "abstained").when(F.col("l_partkey") % 5 == 2, "unsupported").when(F.col("l_partkey") % 5 == 3, "supported_gold").otherwise("supported_nongold")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), "l_linenumber", F.concat(F.lit("arm"), F.col("l_linenumber") % 3).alias("arm"), outcome.alias("outcome"), ((outcome == "supported_nongold") & (F.col("l_suppkey") % 2 == 0)).alias("wrong_filing"),
        (F.col("l_orderkey") % 4 != 0).alias("answerable"), (F.col("l_quantity") > 20).alias("gold_in_context"), (F.col("l_returnflag") == "R").alias("right"), ((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 7 == 0)).alias("unclear"),
        F.concat("l_returnflag", "l_linestatus").alias("answer"), F.concat(F.lit("question "), F.col("l_orderkey").cast("string")).alias("question"), F.array(F.col("l_returnflag")).alias("gold_spans"),
    )


def _cell(name: str, hit: str, of: str = "true") -> str:
    return f"SELECT arm, '{name}' AS cell, count(*) FILTER (({hit}) AND ({of})) AS hits, count(*) FILTER ({of}) AS n FROM a GROUP BY arm"


_ANSWERED = "outcome IN ('unsupported', 'supported_gold', 'supported_nongold')"
_INVENTED = f"{_ANSWERED} AND (outcome = 'unsupported' OR NOT right_)"
_GROUNDED = "outcome = 'supported_gold' AND right_ AND NOT ambiguous"


@registered(
    f"WITH a AS {_ANSWERS}, c AS ("
    + " UNION ALL ".join(
        _cell(*x)
        for x in (
            ("grounded_accuracy_given_gold", _GROUNDED, "answerable AND gold_in_context"), ("abstained_given_gold", "outcome = 'abstained'", "answerable AND gold_in_context"), ("abstention_without_gold", "outcome = 'abstained'", "answerable AND NOT gold_in_context"),
            ("invention_without_gold", _INVENTED, "answerable AND NOT gold_in_context"), ("grounded_end_to_end", _GROUNDED, "answerable"), ("retrieval_ceiling", "gold_in_context", "answerable"), ("abstention_unanswerable", "outcome = 'abstained'", "NOT answerable"),
            ("malformed", "outcome = 'malformed'"), ("wrong_filing", "wrong_filing"),
        )
    )
    + ") SELECT arm, cell, hits, n, round(hits * 1.0::DOUBLE / n, 9) AS rate, n >= 25 AS reportable FROM c"
)
def qa_cells(spark, d):
    rows = _answer_rows(spark, d).select("query_id", "arm", "outcome", "wrong_filing", F.col("right").alias("verdict_correct"), F.col("unclear").alias("ambiguous"), "answerable", "gold_in_context")
    return answers.cells(rows).select("arm", "cell", "hits", "n", F.round("rate", 9).alias("rate"), "reportable")


@registered(f"""WITH a AS (SELECT * FROM {_ANSWERS} WHERE n <= 3 AND k IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3 AND count(*) = 3)),
  o AS (SELECT k, arm, CASE WHEN answerable THEN 'grounded_correct_answerable' ELSE 'abstained_unanswerable' END AS "on", CASE WHEN answerable THEN {_GROUNDED} ELSE outcome = 'abstained' END AS hit FROM a),
  p AS (SELECT x.arm AS arm_a, y.arm AS arm_b, x."on", count(*) FILTER (x.hit AND NOT y.hit) AS b, count(*) FILTER (NOT x.hit AND y.hit) AS c, count(*) AS n FROM o x JOIN o y ON x.k = y.k AND x."on" = y."on" AND x.arm < y.arm GROUP BY ALL)
  SELECT *, b + c AS discordant, round(b * 1.0::DOUBLE / nullif(b + c, 0), 9) AS rate FROM p""")
def qa_comparisons(spark, d):
    """The first three lines of an order as the answers of three arms to one question; others weren't asked of all once."""
    rows = _answer_rows(spark, d).where("l_linenumber <= 3").select("query_id", "arm", "outcome", F.col("right").alias("verdict_correct"), F.col("unclear").alias("ambiguous"), "answerable")
    whole = rows.groupBy("query_id").agg(F.count_distinct("arm").alias("arms"), F.count(F.lit(1)).alias("rows")).where("arms = 3 and rows = 3").select("query_id")
    return answers.comparisons(rows.join(whole, "query_id", "left_semi")).select("arm_a", "arm_b", "on", "b", "c", "n", "discordant", F.round("rate", 9).alias("rate"))


_LABELS = """(SELECT CAST(o_orderkey AS VARCHAR) AS accession, 'T' || o_custkey AS ticker, strftime(o_orderdate, '%Y') AS period, o_orderkey % 9 AS kind, o_totalprice AS v, o_orderkey AS k FROM orders)"""


def _label_records(spark, d):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    kind = k % 9
    pick = lambda *x: F.element_at(F.array(*(F.lit(y) if isinstance(y, str) else y for y in x)), (kind + 1).cast("int"))
    amount = F.floor(v).cast("string")
    return table(spark, d, "orders").select(
        k.cast("string").alias("accession"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.date_format("o_orderdate", "yyyy").alias("period"),
        pick("total_assets", "total_assets", "dividends_declared_per_share", "ceo_name", "ceo_name", "goodwill_impairment", "goodwill_impairment", "employees", "ticker").alias("field"),
        pick("value", "value", "value", "value", "value", "stated_none", "not_addressed", "value", "guess").alias("answer_kind"),
        pick(F.format_number(F.floor(v), 0), F.concat(F.lit("about "), amount), F.lit("0.44 + 0.35"), F.lit("Ann B. Example"), F.lit("Ann Example and Bob Other"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(" "), F.lit("x")).alias("value"),
        F.when(kind != 5, "the anchor").alias("anchor"), F.when(kind == 6, F.when(k % 2 == 0, F.array(F.lit("impairment"), F.lit(" "))).otherwise(F.array(F.lit(" ")))).alias("searched"),
        (k % 5 == 0).alias("ambiguous"), F.when(k % 10 == 0, "summed").otherwise(F.lit(" ")).alias("note"),
    )


@registered(f"""SELECT accession, CASE kind WHEN 1 THEN 'total_assets' WHEN 5 THEN 'goodwill_impairment' WHEN 6 THEN 'goodwill_impairment' WHEN 7 THEN 'employees' ELSE 'ticker' END AS field,
  CASE kind WHEN 1 THEN 'a figure is needed, not text' WHEN 5 THEN 'no anchor in the filing' WHEN 6 THEN 'no searched terms' WHEN 7 THEN 'no value' ELSE 'unknown kind of answer' END AS problem FROM {_LABELS} WHERE kind IN (1, 5, 7, 8) OR kind = 6 AND k % 2 = 1""")
def label_problems(spark, d):
    """Orders as labels, of which some break a rule each."""
    return labels.label_problems(_label_records(spark, d))


@registered(f"""SELECT accession, CASE kind WHEN 0 THEN CAST(floor(v) AS DOUBLE) WHEN 2 THEN 0.79 END AS figure, kind IN (3, 4) AS text FROM {_LABELS} WHERE kind IN (0, 2, 3, 4) OR kind = 6 AND k % 2 = 0""")
def accepted_labels(spark, d):
    """The labels that break no rule, as they are kept: sums added up, commas gone."""
    rows = _label_records(spark, d)
    good = rows.join(labels.label_problems(rows).select("accession").distinct(), "accession", "left_anti")
    kept = labels.accepted(good)
    return kept.select("accession", F.col("value").try_cast("double").alias("figure"), (F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()).alias("text"))


@registered(f"SELECT ticker, period, 5 AS words FROM {_LABELS} WHERE kind = 4")
def overlong_names(spark, d):
    return labels.overlong_names(_label_records(spark, d))


@registered(f"""SELECT ticker, period, CASE kind WHEN 0 THEN 'total_assets' WHEN 1 THEN 'total_assets' WHEN 2 THEN 'dividends_declared_per_share' WHEN 3 THEN 'ceo_name' WHEN 4 THEN 'ceo_name' WHEN 7 THEN 'employees' WHEN 8 THEN 'ticker' ELSE 'goodwill_impairment' END AS field
  FROM {_LABELS} WHERE k % 5 = 0 AND k % 10 <> 0""")
def unexplained_ambiguities(spark, d):
    return labels.unexplained(_label_records(spark, d))


@registered(f"WITH a AS {_ANSWERS} SELECT k || ':' || substr(sha256(k || '|' || lower(answer)), 1, 12) AS key, k AS query_id, 'question ' || k AS question, answer FROM a GROUP BY k, answer")
def blind_queue(spark, d):
    return answers.blind_queue(_answer_rows(spark, d)).select("key", "query_id", "question", "answer")


@registered(f"WITH a AS {_ANSWERS} SELECT k AS query_id, n AS l_linenumber, CASE WHEN outcome <> 'x' THEN answer = 'RF' END AS verdict_correct, answer = 'NO' AS ambiguous FROM a")
def with_verdicts(spark, d):
    """Verdicts from the blind queue: right where the answer is RF, unclear where it is NO."""
    rows = _answer_rows(spark, d).select("query_id", "l_linenumber", "outcome", "answerable", "answer")
    keyed = answers.blind_queue(_answer_rows(spark, d)).select("key", F.when(F.col("answer") == "RF", "correct").otherwise("incorrect").alias("verdict"), (F.col("answer") == "NO").alias("ambiguous"))
    return answers.with_verdicts(rows, keyed).select("query_id", "l_linenumber", "verdict_correct", "ambiguous")


@registered("SELECT count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS prompt_tokens, CAST(sum(l_linenumber) AS BIGINT) AS completion_tokens FROM lineitem")
def token_usage(spark, d):
    return review.token_usage(table(spark, d, "lineitem").select(F.struct(F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("completion_tokens")).alias("usage")))


# -- labels


@registered("WITH r AS (SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS v FROM orders GROUP BY ALL) SELECT o_orderpriority AS field, count(*) AS cases, count(*) FILTER (v > 1) AS differing FROM r GROUP BY ALL")
def unstable(spark, d):
    """Orders as repeated runs: the status is what a run says of a customer and a priority."""
    return extraction.unstable(table(spark, d, "orders").select(F.col("o_custkey").alias("accession"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value")))


_LABELS = "(SELECT o_orderkey AS k, 'f' || o_orderkey AS accession, 't' || o_custkey AS ticker, CASE o_orderpriority WHEN '1-URGENT' THEN 'total_assets' WHEN '2-HIGH' THEN 'ceo_name' ELSE 'employees' END AS field, strftime(o_orderdate, '%Y') AS period, o_orderstatus AS value FROM orders)"


def _labels(spark, d):
    field = F.when(F.col("o_orderpriority") == "1-URGENT", "total_assets").when(F.col("o_orderpriority") == "2-HIGH", "ceo_name").otherwise("employees")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("accession"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("ticker"), field.alias("field"), F.date_format("o_orderdate", "yyyy").alias("period"), F.col("o_orderstatus").alias("value"), F.lower("o_orderstatus").alias("anchor"))


@registered(f"SELECT ticker, field, count(DISTINCT period) AS periods FROM {_LABELS} GROUP BY ALL HAVING count(DISTINCT period) > 1 AND count(DISTINCT value) = 1")
def carried_over(spark, d):
    return extraction.carried_over(_labels(spark, d))


@registered(f"""WITH l AS (SELECT ticker, field, period, arg_max(accession, k) AS accession, arg_max(value, k) AS value FROM {_LABELS} GROUP BY ALL)
  SELECT a.accession, a.field, max(b.period) AS prior_period, arg_max(b.value, b.period) AS prior_value FROM l a JOIN l b ON a.ticker = b.ticker AND a.field = b.field AND a.period <> b.period GROUP BY a.accession, a.field, a.period, a.ticker""")
def prior_values(spark, d):
    return review.prior_values(_labels(spark, d), "o_orderkey")


@registered(f"SELECT accession, CAST(row_number() OVER (PARTITION BY ticker ORDER BY period, CASE field WHEN 'employees' THEN 1 WHEN 'total_assets' THEN 2 ELSE 3 END, accession) AS INTEGER) AS place FROM {_LABELS}")
def label_queue(spark, d):
    return review.label_queue(_labels(spark, d)).select("accession", "place")


@registered(f"SELECT ticker AS accession, array_to_string(list_sort(list_filter(['company_name', 'ticker', 'fiscal_year_end', 'employees', 'total_assets', 'revenue_most_recent_fy', 'ceo_name', 'dividends_declared_per_share', 'goodwill_impairment'], lambda x: NOT list_contains(list(field), x))), ',') AS missing FROM {_LABELS} GROUP BY ticker")
def fields_missing(spark, d):
    """Of each ticker's labels taken together."""
    return review.fields_missing(_labels(spark, d).select(F.col("ticker").alias("accession"), "field")).select("accession", F.array_join("missing", ",").alias("missing"))


@registered(f"""SELECT field, count(*) FILTER (CASE field WHEN 'total_assets' THEN value IN ('F', 'P') WHEN 'ceo_name' THEN value = 'O' ELSE true END) AS kept, count(*) FILTER (NOT CASE field WHEN 'total_assets' THEN value IN ('F', 'P') WHEN 'ceo_name' THEN value = 'O' ELSE true END) AS removed
  FROM {_LABELS} GROUP BY field""")
def anchor_support(spark, d):
    """Labels whose anchors hold one of the field's keywords, and those that go."""
    ok = review.anchor_supports(F.col("field"), F.lit("value"), F.col("anchor"), {"total_assets": ("f", "p"), "ceo_name": ("o",)})
    kept, removed = review.split_by(_labels(spark, d), ok)
    return kept.withColumn("k", F.lit(1)).unionByName(removed.withColumn("k", F.lit(0))).groupBy("field").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("removed"))


@registered("SELECT CAST(doc_id AS VARCHAR) AS accession FROM documents WHERE regexp_replace(lower(split_part(text, ' ', 2)), '[\\s\\pZ]+', '', 'g') <> '' AND NOT contains(regexp_replace(lower(text), '[\\s\\pZ]+', '', 'g'), regexp_replace(lower(split_part(text, ' ', 2)), '[\\s\\pZ]+', '', 'g') || 'zebra')")
def anchors_missing(spark, d):
    """Anchors that a text's second word begins and another word ends."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), "text")
    second = F.split_part("text", F.lit(" "), F.lit(2))
    labels = t.select("accession", F.when(text.squeeze(second) != "", F.concat(second, F.lit(" Zebra"))).alias("anchor"), F.lit("x").alias("field"))
    return review.anchors_missing(labels, t).select("accession")


@registered("""WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS accession, lower(text) AS t FROM documents), p AS (SELECT accession, t, 1 AS nth, instr(t, 'the') - 1 AS start FROM d WHERE instr(t, 'the') > 0
  UNION ALL SELECT accession, t, nth + 1, start + 3 + instr(substr(t, start + 4), 'the') - 1 FROM p WHERE nth < 8 AND instr(substr(t, start + 4), 'the') > 0) SELECT accession, nth, CAST(start AS BIGINT) AS start FROM p""")
def literal_places(spark, d):
    """The first eight places of a word in each text: the list is the feature."""
    return review.literal_places(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), "text"), "The")


@registered("""WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS accession, text AS t, lower(text) AS low FROM documents WHERE text IS NOT NULL), p AS (SELECT accession, t, low, 1 AS nth, instr(low, 'the') - 1 AS start FROM d WHERE instr(low, 'the') > 0
  UNION ALL SELECT accession, t, low, nth + 1, start + 320 + instr(substr(low, start + 322), 'the') FROM p WHERE nth < 8 AND instr(substr(low, start + 322), 'the') > 0)
  SELECT accession, 'any' AS field, nth, CAST(start AS BIGINT) AS start, md5(substr(t, greatest(0, start - 80) + 1, start + 320 - greatest(0, start - 80))) AS snippet FROM p""")
def candidate_passages(spark, d):
    """Places at least 320 characters apart, the first eight of each text, with their surroundings."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), "text")
    return review.passages(docs, {"any": "the"}).select("accession", "field", "nth", "start", F.md5("snippet").alias("snippet"))


@registered("SELECT doc_id, md5(substr(text, 1, 100)) AS before, md5(substr(text, 101, 20)) AS marked, md5(substr(text, 121, 180)) AS after FROM documents")
def marks(spark, d):
    """The twenty characters from the hundredth on, with what stands on either side."""
    m = review.mark(F.col("text"), F.lit(100), F.lit(120))
    return table(spark, d, "documents").select("doc_id", F.md5(m["before"]).alias("before"), F.md5(m["marked"]).alias("marked"), F.md5(m["after"]).alias("after"))


# -- query sets


def _records(spark, d):
    """Items as query records: every third without gold, every fifth of an unknown stratum, one place each."""
    q = queries(spark, d)
    k = F.col("query_id")
    place = F.struct(F.lit("A").alias("accession"), F.when(k % 7 == 0, "").otherwise(F.substring("query", 1, 60)).alias("span"))
    stratum = F.when(k % 5 == 0, "other").when(k % 3 == 0, "unanswerable").when(k % 2 == 0, "conceptual").otherwise("exact_entity")
    return q.select(k.cast("string").alias("query_id"), stratum.alias("stratum"), F.when(k % 11 == 0, " ").otherwise(F.col("query")).alias("query"), F.when(k % 3 == 0, F.array().cast("array<struct<accession:string,span:string>>")).otherwise(F.array(place)).alias("gold"))


_RECORDS = """(SELECT CAST(item_id AS VARCHAR) AS query_id, item_id AS k, CASE WHEN item_id % 5 = 0 THEN 'other' WHEN item_id % 3 = 0 THEN 'unanswerable' WHEN item_id % 2 = 0 THEN 'conceptual' ELSE 'exact_entity' END AS stratum,
  CASE WHEN item_id % 11 = 0 THEN ' ' ELSE text END AS query, CASE WHEN item_id % 7 = 0 THEN '' ELSE substr(text, 1, 60) END AS span FROM benchmark)"""


@registered(f"""WITH r AS {_RECORDS} SELECT problem, count(*) AS n FROM (SELECT query_id || ': unknown stratum' AS problem FROM r WHERE stratum = 'other' UNION ALL SELECT query_id || ': empty query' FROM r WHERE query = ' '
  UNION ALL SELECT query_id || ': answerable without gold' FROM r WHERE stratum <> 'unanswerable' AND k % 3 = 0 UNION ALL SELECT query_id || ': gold without accession or span' FROM r WHERE k % 3 <> 0 AND span = '') GROUP BY problem""")
def query_problems(spark, d):
    """Problems of the records but shared content words, which have a query of their own."""
    found = gold.query_problems(_records(spark, d)).where(~F.contains("problem", F.lit("content word")))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@registered(f"""WITH r AS {_RECORDS} SELECT 'conceptual has ' || count(*) || ' queries, not 1' AS problem FROM r WHERE stratum = 'conceptual' UNION ALL SELECT 'absent has 0 queries, not 2'
  UNION ALL SELECT 'query text ' || t || ' stands ' || count(*) || ' times' FROM (SELECT {NORMAL.format('query')} AS t FROM r) GROUP BY t HAVING count(*) > 1""")
def set_problems(spark, d):
    return gold.set_problems(_records(spark, d), {"conceptual": 1, "absent": 2})


_JSON = """replace(replace(replace({0}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n')"""
_HASHES = f"""(SELECT query_id, k, sha256('{{"gold":[' || CASE WHEN k % 3 = 0 THEN '' ELSE '{{"accession":"A","span":"' || {_JSON.format('span')} || '"}}' END || '],"query":"' || {_JSON.format('query')} || '","query_id":"' || query_id || '","stratum":"' || stratum || '"}}') AS sha256 FROM {_RECORDS})"""


@registered(f"SELECT query_id, sha256 FROM {_HASHES}")
def query_hashes(spark, d):
    return gold.query_hash(_records(spark, d))


@registered(f"SELECT sha256(string_agg(query_id || '  ' || sha256 || chr(10), '' ORDER BY query_id)) AS digest, count(*) AS queries FROM {_HASHES}")
def set_digest(spark, d):
    return gold.set_digest(gold.query_hash(_records(spark, d)))


@registered(f"""SELECT query_id, 'changed' AS how FROM {_HASHES} WHERE query_id LIKE '%4' UNION ALL SELECT query_id, 'removed' FROM {_HASHES} WHERE query_id LIKE '%6' UNION ALL SELECT query_id || '-new', 'added' FROM {_HASHES} WHERE query_id LIKE '%8'""")
def moved_queries(spark, d):
    """Against the frozen set: queries that end in 4 have another text, those in 6 are gone, copies of those in 8 are new."""
    r = _records(spark, d)
    live = r.where("query_id not like '%6'").withColumn("query", F.when(F.col("query_id").like("%4"), F.concat("query", F.lit("?"))).otherwise(F.col("query")))
    new = r.where("query_id like '%8'").withColumn("query_id", F.concat("query_id", F.lit("-new")))
    return freeze.moved(gold.query_hash(r), gold.query_hash(live.unionByName(new)))


_DECIDED = f"(SELECT *, NOT query_id LIKE '%1' AND NOT query_id LIKE '%4' AND NOT query_id LIKE '%9' AS approved, query_id LIKE '%4' AS stale FROM {_HASHES})"


def _decisions(spark, d):
    """Two decisions on each query but those that end in 9: rejected, then approved unless it ends in 1; those
    that end in 4 were decided on another text."""
    h = gold.query_hash(_records(spark, d)).where("query_id not like '%9'")
    told = F.when(F.col("query_id").like("%4"), F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    first = h.select("query_id", F.lit("rejected").alias("verdict"), told.alias("query_sha256"), F.lit(1).alias("decided_at"), F.lit(False).alias("ambiguous"))
    second = h.select("query_id", F.when(F.col("query_id").like("%1"), "rejected").otherwise("approved").alias("verdict"), told.alias("query_sha256"), F.lit(2).alias("decided_at"), F.col("query_id").like("%2").alias("ambiguous"))
    return first.unionByName(second)


@registered(f"SELECT query_id, sha256, approved, stale FROM {_DECIDED}")
def approvals(spark, d):
    return freeze.approvals(_decisions(spark, d), gold.query_hash(_records(spark, d)))


@registered(f"SELECT CASE WHEN query_id LIKE '%1' THEN 'rejected' ELSE 'approved' END AS verdict, count(*) AS n, count(*) FILTER (query_id LIKE '%2') AS ambiguous FROM {_HASHES} WHERE NOT query_id LIKE '%9' GROUP BY 1")
def verdict_counts(spark, d):
    return freeze.verdict_counts(_decisions(spark, d))


@registered(f"""SELECT 'the frozen set isn''t what its digest was made of' AS problem UNION ALL SELECT 'changed since the freeze: ' || query_id FROM {_HASHES} WHERE query_id LIKE '%4'
  UNION ALL SELECT 'not approved: ' || query_id FROM {_DECIDED} WHERE NOT approved""")
def freeze_problems(spark, d):
    """A set whose digest isn't the recorded one and of which some texts have changed."""
    r = _records(spark, d)
    frozen = gold.query_hash(r)
    live = gold.query_hash(r.withColumn("query", F.when(F.col("query_id").like("%4"), F.concat("query", F.lit("?"))).otherwise(F.col("query"))))
    out = freeze.freeze_problems(frozen, "recorded", live, "another", freeze.approvals(_decisions(spark, d), frozen))
    return out[0].unionByName(out[1]).unionByName(out[2])


@registered("SELECT stratum, count(*) AS queries, count(*) FILTER (k % 3 <> 0) AS answerable FROM " + _RECORDS + " GROUP BY stratum")
def composition(spark, d):
    return freeze.composition(_records(spark, d))


@registered("""WITH h AS (SELECT b.item_id AS query_id, b.text, d.source FROM documents d JOIN benchmark b ON contains(NORMAL_D, NORMAL_B)), n AS (SELECT item_id, len(list_filter(regexp_split_to_array(text, '[\\s\\pZ]+'), lambda w: w <> '')) AS words FROM benchmark)
  SELECT item_id AS query_id, CAST(words AS INTEGER) AS words, words < 12 AS short, coalesce((SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM h WHERE query_id = item_id AND source <> 'none'), '') AS elsewhere FROM n""".replace("NORMAL_D", NORMAL.format("d.text")).replace("NORMAL_B", NORMAL.format("b.text")))
def advisories(spark, d):
    """Notes on each item's text as a span of a filing that isn't in the store."""
    places = queries(spark, d).select("query_id", F.lit("none").alias("accession"), F.col("query").alias("span"))
    return gold.advisories(chunks(spark, d), places).select("query_id", "words", "short", F.array_join("elsewhere", ",").alias("elsewhere"))


# -- stores and runs


@registered("""SELECT 'oversized' AS kind, count(*) AS n FROM documents WHERE n_chars > 512 AND contains(text, chr(10)) UNION ALL SELECT 'empty', count(*) FROM documents WHERE trim(coalesce(text, '')) = ''
  UNION ALL SELECT 'repeated', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)""")
def store_problems(spark, d):
    problems = stores.store_problems(chunks(spark, d))
    frames = [p.select(F.lit(kind).alias("kind")) for kind, p in zip(("repeated", "empty", "oversized"), problems, strict=True)]
    every = spark.createDataFrame([("repeated",), ("empty",), ("oversized",)], "kind string")
    counted = frames[0].union(frames[1]).union(frames[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "kind", "left").fillna({"n": 0})


_RANKED = """(SELECT vec_id // 10 AS q, vec_id % 10 + 1 AS rank, CASE WHEN vec_id % 50 = 7 THEN vec_id + 100000000 WHEN vec_id % 30 = 9 THEN vec_id - 1 ELSE vec_id END AS c FROM embeddings WHERE (vec_id // 10) % 5 <> 4)"""


@registered(f"""WITH r AS {_RANKED} SELECT 'the store has no chunk ' || c AS problem FROM (SELECT DISTINCT c FROM r WHERE c NOT IN (SELECT doc_id FROM documents))
  UNION ALL SELECT 'ranked chunk ' || q || ', sparse, ' || c || ' stands ' || count(*) || ' times' FROM r GROUP BY q, c HAVING count(*) > 1
  UNION ALL SELECT 'no ranking: sparse of ' || item_id FROM benchmark WHERE item_id NOT IN (SELECT q FROM r)""")
def run_problems(spark, d):
    """Vectors as rankings of ten for each query: some chunks are unknown, some stand twice, each fifth query has no ranking."""
    v = F.col("vec_id")
    chunk = F.when(v % 50 == 7, v + 100000000).when(v % 30 == 9, v - 1).otherwise(v)
    rankings = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("query_id"), F.lit("sparse").alias("arm"), chunk.alias("chunk_id"), (v % 10 + 1).alias("rank")).where("query_id % 5 <> 4")
    out = freeze.run_problems(rankings, chunks(spark, d), queries(spark, d), ["sparse"])
    return out[0].union(out[1]).union(out[2])


@registered("SELECT 'the gated ranking isn''t its arm''s: ' || c_custkey AS problem FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no gated ranking for ' || c_custkey FROM customer WHERE c_acctbal > 9000")
def gated_problems(spark, d):
    """Customers as queries: the gate fires on a negative balance, but the fused list was written everywhere;
    for balances over 9000 none was."""
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), "c_acctbal")
    listed = lambda a, b: q.select("query_id", F.posexplode(F.array(F.lit(a), F.lit(b))).alias("rank", "chunk_id"))
    fused, dense = listed(1, 2), listed(2, 1)
    gates = q.select("query_id", (F.col("c_acctbal") < 0).alias("fires"))
    return freeze.gated_problems(gates, fused.join(q.where("c_acctbal <= 9000").select("query_id"), "query_id", "left_semi"), fused, dense)


@registered("SELECT 'missing: ' || n_name AS problem FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 'another digest: ' || n_name FROM nation WHERE n_nationkey < 3")
def pinned_problems(spark, d):
    pins = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"), "n_nationkey")
    have = pins.where("n_nationkey <= 20").withColumn("sha256", F.when(F.col("n_nationkey") < 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return freeze.pinned_problems(have, pins)


@registered("""SELECT 'not planned: ' || o_orderkey AS problem FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'asked with another input: ' || o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000""")
def resume_problems(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.sha2("o_orderpriority", 256).alias("sha"), "o_orderstatus", "o_totalprice")
    planned = o.where("o_orderstatus <> 'P'").withColumn("sha", F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000), F.lit("x")).otherwise(F.col("sha")))
    out = freeze.resume_problems(o, planned, ["call"], "sha")
    return out[0].union(out[1]).union(out[2])


_SPLIT = """(SELECT item_id AS query_id, item_id % 2 = 0 AS answerable, item_id % 6 = 0 AS inside FROM benchmark)"""


def _split(spark, d):
    q = queries(spark, d).select("query_id")
    k = F.col("query_id")
    contexts = q.select("query_id", F.lit("sparse").alias("arm"), F.array(k.cast("string"), (k + F.when(k % 6 == 0, 1000).otherwise(2000)).cast("string")).alias("ids"))
    return freeze.conditioned(contexts, q.where(k % 2 == 0).select("query_id", (k + 1000).alias("chunk_id")), q)


@registered(f"SELECT query_id, 'sparse' AS arm, answerable, inside AS gold_in_context FROM {_SPLIT}")
def conditioned_split(spark, d):
    return _split(spark, d)


@registered(f"SELECT 'sparse: gold in context of ' || count(*) FILTER (inside) || ' queries, 3 published' AS problem FROM {_SPLIT} HAVING count(*) FILTER (inside) <> 3 UNION ALL SELECT 'dense: gold in context of null queries, 5 published'")
def control_problems(spark, d):
    """A split that doesn't agree with what was published for one arm, and lacks another."""
    return freeze.control_problems(_split(spark, d), {"sparse": 3, "dense": 5})


@registered("SELECT item_id, sha256(length('system') || ':system' || chr(10) || length(text) || ':' || text || chr(10)) AS fingerprint FROM benchmark")
def prompt_fingerprints(spark, d):
    return table(spark, d, "benchmark").select("item_id", freeze.prompt_fingerprint(F.lit("system"), F.col("text")).alias("fingerprint"))


@registered("SELECT doc_id AS query_id, 'sparse' AS arm, 1 AS rank, CAST(doc_id AS VARCHAR) AS chunk_id, source AS accession FROM documents")
def excerpts(spark, d):
    contexts = chunks(spark, d).select(F.col("chunk_id").alias("query_id"), F.lit("sparse").alias("arm"), F.array(F.col("chunk_id").cast("string")).alias("ids"))
    return review.excerpts(contexts, chunks(spark, d)).drop("text")


@registered("SELECT doc_id AS chunk_id FROM documents WHERE lang IN ('en', 'es') AND contains(lower(text), 'the') AND contains(lower(text), 'and')")
def smoke_chunks(spark, d):
    """Chunks of two languages that hold two words."""
    c = chunks(spark, d).withColumn("ticker", F.col("item"))
    return review.smoke_chunks(c, ("en", "es"), ("the", "and")).select("chunk_id")


@registered("SELECT o_orderkey AS id, o_orderdate AS upload_date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_reports(spark, d):
    """The twenty newest: the list is the feature."""
    return review.recent(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("upload_date")))


@registered("""SELECT o_orderkey AS id, max(l_quantity) FILTER (l_linenumber = 1) AS figure, coalesce(string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) FILTER (l_linenumber > 1), '') AS risks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def report_detail(spark, d):
    """Orders as reports, their first lines as extractions, the others as risks."""
    line = table(spark, d, "lineitem")
    made = line.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("report_id")).agg(F.max("l_quantity").alias("figure"))
    risks = line.where("l_linenumber > 1").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("nth"), F.col("l_returnflag").alias("risk"))
    return review.report_detail(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), made, risks).select("id", "figure", F.array_join("risks", ",").alias("risks"))


@registered("""WITH s AS (SELECT o_custkey AS cik, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'a' || o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P'),
  i AS (SELECT c_custkey AS cik, c_mktsegment AS sector FROM customer WHERE c_custkey IN (SELECT cik FROM s WHERE n <= 2 GROUP BY cik HAVING count(*) = 2)),
  c AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY sha256('20260809|' || cik), cik) AS nth FROM i)
  SELECT sector, c.cik, 'a' || o_orderkey AS accession FROM c JOIN s ON c.cik = s.cik AND n <= 2 WHERE nth <= 2""")
def select_issuers(spark, d):
    """Customers as issuers of five sectors, their orders as submissions; those of status P aren't annual reports."""
    issuers = table(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_mktsegment").alias("sector"))
    sub = table(spark, d, "orders").select(F.col("o_custkey").alias("cik"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("accession"), F.col("o_orderdate").alias("filed"), F.when(F.col("o_orderstatus") == "P", "10-Q").otherwise("10-K").alias("form"), F.lit("Main.HTM").alias("document"))
    return readers.select_issuers(issuers, sub).select("sector", "cik", "accession")


@registered("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def upserted(spark, d):
    """Balances below zero written anew as zero."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return logs.upsert(c, c.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@registered("SELECT doc_id FROM documents WHERE doc_id % 7 = 3 OR len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) = 0")
def without_lexemes(spark, d):
    """Chunks that no query can match; each seventh text has lost its letters and digits."""
    c = chunks(spark, d).withColumn("text", F.when(F.col("chunk_id") % 7 == 3, F.regexp_replace(F.lower("text"), "[a-z0-9]", "")).otherwise(F.col("text")))
    return c.join(retrieval.postings(c).select("chunk_id").distinct(), "chunk_id", "left_anti").select(F.col("chunk_id").alias("doc_id"))
