"""Importance resampling towards a target: the features of each distinct line are counted once.

Words are runs of letters a-z (A-Z lowered), digits and characters beyond ASCII, so a newline never stands in
one: it cuts a text into lines, and only n-grams across lines are missing.  Lines are taken together over the
whole corpus; the buckets of each distinct line are computed once, and enter the corpus counts times the
line's occurrences.  A line's weight is likewise added up once and goes back to the documents by a join on
two 64-bit hashes of the line; lines that make up over 1 / ``HEAVY`` of all (so fewer than ``HEAVY``) are
sent to every task instead, so no key of that join holds more.  N-grams across lines are counted for each
document and added.  Documents are drawn by weight plus Gumbel noise, ranked over ranges of the score.

A null text is empty: no features, weight 0.  Rows alike in doc_id and text give equal rows; rows alike in
doc_id only are separate, ties going to the lesser hash of the text.  A null doc_id is hashed as an empty
string and comes first among ties.  Empty inputs give no rows.  Other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import _once, _upto
from .crc_sql import crc32_sql
from .scratch import materialise

HEAVY = 10_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), _GAP), lambda w: w != "")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram), F.lit(buckets)).cast("int")


def line_features(line: Column, n: int, buckets: int) -> Column:
    """(n_words, buckets): the buckets of all runs of 1 to ``n`` words of a line, repeats counted."""

    def made(ws: Column) -> Column:
        def runs(k: int) -> Column:
            return F.transform(_upto(F.size(ws) - k + 1), lambda i: _bucket(F.concat_ws(" ", F.slice(ws, i + 1, k)), buckets))

        return F.struct(F.size(ws).alias("n_words"), F.concat(F.transform(ws, lambda w: _bucket(w, buckets)), *map(runs, range(2, n + 1))).alias("buckets"))

    return _once(words_of(line), made)


def crossing_features(lines: Column, n: int, buckets: int) -> Column:
    """The buckets of the runs of 2 to ``n`` words that stand on more than one line."""

    def made(ws: Column) -> Column:
        def runs(k: int) -> Column:
            starts = F.filter(_upto(F.size(ws) - k + 1), lambda i: F.get(ws, i)["line"] != F.get(ws, i + (k - 1))["line"])
            return F.transform(starts, lambda i: _bucket(F.concat_ws(" ", F.transform(F.slice(ws, i + 1, k), lambda w: w["word"])), buckets))

        return F.concat(*map(runs, range(2, n + 1)))

    return _once(F.flatten(F.transform(lines, lambda line, i: F.transform(words_of(line), lambda w: F.struct(w.alias("word"), i.alias("line"))))), made)


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("rk"), F.split(text, "\n").alias("lines"))


def _line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(11), line).alias("h2")]


def distinct_lines(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(h1, h2, times, n_words, buckets) of the distinct lines of ``texts`` (lines), written once."""
    lines = texts.select(F.explode("lines").alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    made = lines.select(*_line_hashes(F.col("line")), "times", line_features(F.col("line"), n, buckets).alias("f")).select("h1", "h2", "times", "f.*")
    return materialise(made, "distinct-lines")


def bucket_counts(lines: DataFrame, texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, count) over all texts: distinct lines times their occurrences, and what crosses lines."""
    counted = lines.select(F.explode("buckets").alias("bucket"), "times").groupBy("bucket").agg(F.sum("times").alias("count"))
    if n > 1:
        crossing = texts.select(F.explode(crossing_features(F.col("lines"), n, buckets)).alias("bucket"))
        counted = counted.union(crossing.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))).groupBy("bucket").agg(F.sum("count").alias("count"))
    return counted


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row: the gain of each bucket in order, floor(1000 ln of the smoothed ratio of shares)."""
    both = raw.withColumnRenamed("count", "s").join(target.withColumnRenamed("count", "t"), "bucket", "full")
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))).alias("all"), F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T"))

    def gain(x: Column) -> Column:
        d = lambda c: c.cast("double")
        return F.floor(1000 * F.ln(d(x["t"] + 1) * d(F.col("S") + buckets) / (d(x["s"] + 1) * d(F.col("T") + buckets))))

    return one.select(F.transform("all", gain).alias("gains"))


def _weight(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, b: a + F.get(F.col("gains"), b))


def weights(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> DataFrame:
    """(doc_id, rk, n_words, n_features, weight), one row for each row of ``docs`` (doc_id, text)."""
    texts, wanted = _lines(docs), _lines(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    lines = distinct_lines(texts, n, buckets)
    table = materialise(gains(bucket_counts(lines, texts, n, buckets), bucket_counts(distinct_lines(wanted, n, buckets), wanted, n, buckets), buckets), "gains").scalar()
    sums = ["n_words", "n_features", "weight"]
    weighed = lines.withColumn("gains", table).select("h1", "h2", "times", F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"), _weight(F.col("buckets")).alias("weight"))
    weighed = materialise(weighed, "line-weights")
    total = weighed.agg(F.sum("times").alias("n")).first()["n"] or 0
    heavy = F.broadcast(weighed.where(F.col("times") * HEAVY > total))  # fewer than HEAVY rows
    placed = texts.select("doc_id", "rk", F.explode("lines").alias("line")).where("line <> ''").select("doc_id", "rk", *_line_hashes(F.col("line")))
    common = placed.join(heavy, ["h1", "h2"]).select("doc_id", "rk", *sums, F.lit(0).alias("copies"))
    light = weighed.where(F.col("times") * HEAVY <= total)
    others = placed.join(heavy.select("h1", "h2"), ["h1", "h2"], "left_anti").join(light, ["h1", "h2"]).select("doc_id", "rk", *sums, F.lit(0).alias("copies"))
    zero = F.lit(0).cast("long")
    itself = [zero.alias("n_words"), zero.alias("n_features"), zero.alias("weight")]
    if n > 1:
        across = texts.withColumn("gains", table).select("doc_id", "rk", "gains", crossing_features(F.col("lines"), n, buckets).alias("c"))
        own = across.select("doc_id", "rk", zero.alias("n_words"), F.size("c").cast("long").alias("n_features"), _weight(F.col("c")).alias("weight"), F.lit(1).alias("copies"))
    else:
        own = texts.select("doc_id", "rk", *itself, F.lit(1).alias("copies"))
    added = common.union(others).union(own).groupBy("doc_id", "rk").agg(*(F.sum(c).alias(c) for c in [*sums, "copies"]))
    once = added.select("doc_id", "rk", *((F.col(c) / F.col("copies")).cast("long").alias(c) for c in sums), "copies")
    return once.select("doc_id", "rk", *sums, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) that depends on the seed and the id only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` (score, doc_id, rk) with rank 1, 2, ... of the ``percent`` of the eligible rows with the highest scores.

    Rows are dealt out by ranges of the score; a row's rank is its place in its range and the rows of the
    ranges before, of which the driver has one number for each range.
    """
    spark = scored.sparkSession
    order = [F.col("key").desc_nulls_last(), F.col("doc_id").asc(), F.col("rk").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("key", F.when(eligible, F.col("score"))).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "by-score")
    counts = sorted((r["part"], r["n"]) for r in dealt.where("key is not null").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    drawn, before, offsets = percent * sum(n for _, n in counts) // 100, 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    place = (F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")).cast("long")
    return dealt.join(starts, "part", "left").withColumn("rank", F.when(F.col("key").isNotNull(), place)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("part", "before", "key")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, fewest_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``docs`` (doc_id, text).

    ``target`` (text) is what the draw leans towards; ``percent`` of the documents with at least ``fewest_words``
    words are drawn without replacement.
    """
    weighed = weights(docs.select("doc_id", "text"), target, n, buckets)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scored, F.col("n_words") >= fewest_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


#: With the defaults of :func:`resample`: words only.
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
raw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word),
aim AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM b) GROUP BY word),
each AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM raw UNION SELECT word FROM aim)),
s AS (SELECT bucket, sum(n) AS s FROM raw JOIN each USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM aim JOIN each USING (word) GROUP BY bucket),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE)
         / (CAST(s + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(t) FROM t), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
x AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(ws) AS word FROM w) JOIN each USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
y AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN x ON w.doc_id = x.doc_id),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM y),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM z LEFT JOIN r ON z.doc_id = r.doc_id
"""
