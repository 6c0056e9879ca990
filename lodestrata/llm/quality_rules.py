"""Quality rules: countable faults of a text, and the likelihood ratio of its hashed n-grams between trusted
texts and the whole corpus.

Words are runs of characters other than space and 0x09-0x0D; features are words and pairs of neighbouring
words.  A word's bucket is its crc32 modulo ``buckets``, a pair's that of the first one's crc32 times ``PAIR`` plus
the second one's.  The trusted multinomial is fitted on one half (by hash)
of all trusted rows; the raw one on all texts.  A bucket's gain is
1000 times the logarithm of its share among trusted texts over its share in the corpus, both with one added,
rounded down; a text's score is the sum of its gains, and it is kept if score / features is no less than the
``LOST`` quantile of the other half of the trusted rows less ``SLACK``.  Sums are integers, so every run gives
the same verdict for every text.  DataFrame functions only.

A null text has no words.  A text with no words, or of fewer than ``FEWEST_WORDS``, fails the base rules and
isn't kept.  Without trusted texts nothing is held against a text but the base rules.  Rows alike in doc_id
are separate rows; a null doc_id is never trusted; other columns of the input don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crc_sql import crc32_sql
from .scratch import materialise

BUCKETS = 1 << 16
LOST = 0.001
SLACK = 50
FEWEST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
PAIR = 1_000_003
BITS_AN_ID = 32  # of the bitmap: with three probes it takes about one id in 1,000 for another
MOST_BITS = 1 << 27  # 16 MB; with over 4 million fitted ids more are taken for others, and sent
PROBES = 3

_SPACES = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it in a function of each element."""
    return F.get(F.transform(F.array(value), f), 0)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(trimmed != "", F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>"))


def _upto(n: Column) -> Column:
    """0 ... n-1; empty for n of 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of three words that the text has twice or more.

    Windows are told apart by hash first: only a text in which one recurs sorts them, and equal neighbours in
    that order are compared word by word.
    """
    none = F.lit(0).cast("long")

    def within(ws: Column) -> Column:
        def places(hashes: Column) -> Column:  # in the order of (hash, place)
            def same(a: Column, b: Column) -> Column:
                alike = a["h"] == b["h"]
                for k in range(3):
                    alike = alike & (F.get(ws, a["i"] + k) == F.get(ws, b["i"] + k))
                return F.coalesce(alike, F.lit(False))

            def starts(order: Column) -> Column:
                twice = F.filter(order, lambda x, j: ((j > 0) & same(F.get(order, F.greatest(j - 1, F.lit(0))), x)) | same(x, F.get(order, j + 1)))
                return F.sort_array(F.transform(twice, lambda x: x["i"]))

            return _once(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts)

        def covered(starts: Column) -> Column:
            return F.aggregate(_upto(F.size(starts)), none, lambda n, k: n + F.coalesce(F.least(F.get(starts, k + 1) - F.get(starts, k), F.lit(3)), F.lit(3)))

        def counted(hashes: Column) -> Column:
            return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_once(places(hashes), covered))

        return _once(F.transform(_upto(F.size(ws) - 2), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))), counted)

    return _once(words, within)


def base_columns(words: Column, text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        "n_symbols": F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long"),
        "n_dup_lines": _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def _buckets(hashes: Column, i: Column, buckets: int) -> tuple[Column, Column]:
    """The bucket of word ``i`` and of the pair that it begins (null for the last word), from the words' hashes."""
    at = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return at(F.get(hashes, i)), at(F.get(hashes, i) * PAIR + F.get(hashes, i + 1))


def features(words: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""

    def made(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.concat(F.transform(_upto(n), lambda i: _buckets(hashes, i, buckets)[0]), F.transform(_upto(n - 1), lambda i: _buckets(hashes, i, buckets)[1]))

    return _once(F.transform(words, F.crc32), made)


def score(words: Column, table: Column, buckets: int) -> Column:
    """The sum of the gains of all features."""

    def summed(hashes: Column) -> Column:
        def plus(total: Column, i: Column) -> Column:
            word, pair = _buckets(hashes, i, buckets)
            return total + F.get(table, word) + F.coalesce(F.get(table, pair), F.lit(0))

        return F.aggregate(_upto(F.size(hashes)), F.lit(0).cast("long"), plus)

    return _once(F.transform(words, F.crc32), summed)


def trusted_rows(trusted: DataFrame, most: int | None = None) -> DataFrame:
    """(trusted_id, fitted): the distinct ids, or about ``most`` of them by hash where that is given, in two halves."""
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    n = 0 if most is None else ids.count()
    if most is not None and n > most:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * most / n))
    return ids.select(F.col("doc_id").alias("trusted_id"), (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0).alias("fitted"))


def _bits(key: Column, words: int) -> list[Column]:
    """The ``PROBES`` bits of a key among 64 * ``words`` (a power of two)."""
    h = F.xxhash64(key)
    return [F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit(64 * words - 1)) for k in range(PROBES)]


def bitmap(keys: DataFrame, words: int) -> DataFrame:
    """One row with the bits of all ``keys`` (key), as ``words`` longs in order."""
    bit = keys.select(F.explode(F.array(*_bits(F.col("key"), words))).alias("bit"))
    held = bit.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("held"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(held, "word", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("held", F.lit(0).cast("long")).alias("held")))).alias("all"))
    return one.select(F.transform("all", lambda x: x["held"]).alias("bits"))


def in_bitmap(key: Column, bits: Column, words: int) -> Column:
    """Whether all bits of a key are set: true for the keys of the bitmap and for few others; false for null."""
    found = key.isNotNull()
    for b in _bits(key, words):
        found = found & (F.getbit(F.get(bits, (b / 64).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found


def marked(docs: DataFrame, fitted: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``fitted``: whether the doc_id is among the distinct ones of ``fitted`` (trusted_id).

    The texts stay where they are: the ids' bitmap goes to every task, and so do the few ids that it takes for others.
    Those are found by the ids alone.
    """
    key = docs.select("doc_id").unionByName(fitted.select(F.col("trusted_id").alias("doc_id"))).schema["doc_id"].dataType  # as a join would compare them
    words = min(max(1 << (max(fitted.count(), 1) * BITS_AN_ID // 64).bit_length(), 64), MOST_BITS // 64)
    held = materialise(bitmap(fitted.select(F.col("trusted_id").cast(key).alias("key")), words), "bitmap").scalar()
    of = F.col("doc_id").cast(key)
    likely = docs.select("doc_id").withColumn("bits", held).where(in_bitmap(of, F.col("bits"), words)).select("doc_id")
    mistaken = materialise(likely.join(fitted, F.col("doc_id") == F.col("trusted_id"), "left_anti").select(F.col("doc_id").alias("other_id")).distinct(), "mistaken")
    rows = docs.withColumn("bits", held).withColumn("likely", in_bitmap(of, F.col("bits"), words)).drop("bits")
    return rows.join(F.broadcast(mistaken), F.col("doc_id") == F.col("other_id"), "left").select("doc_id", "text", (F.col("likely") & F.col("other_id").isNull()).alias("fitted"))


def gains(counted: DataFrame, buckets: int) -> DataFrame:
    """One row with the gain of every bucket, in order; ``counted`` has (bucket, s, t) of the buckets seen."""
    every = counted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left")
    filled = every.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    one = filled.agg(F.sum("s").alias("S"), F.sum("t").alias("T"), F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("all"))

    def gain(x: Column) -> Column:
        d = lambda c: c.cast("double")
        return F.floor(1000 * F.ln(d(x["t"] + 1) * d(F.col("S") + buckets) / (d(x["s"] + 1) * d(F.col("T") + buckets)))).cast("long")

    return one.select(F.transform("all", gain).alias("gains"))


def least_kept(means: DataFrame, share: float) -> float | None:
    """The observed ``mean`` at nearest rank ``share``, or None without rows: the unit in which the rank falls, then the
    part of it, and only the values there are put in order."""
    rank, some = None, means
    for per_unit in (1, 4096):
        by_bin = F.floor(F.col("mean") * per_unit)
        counted = some.groupBy(by_bin.alias("bin")).count().orderBy("bin").collect()  # gains are within a few thousand
        rank = max(1, math.ceil(share * sum(r["count"] for r in counted))) if rank is None else rank
        for r in counted:
            if rank <= r["count"]:
                some = some.where(by_bin == r["bin"])
                break
            rank -= r["count"]
        else:
            return None
    upto = 0
    for r in some.groupBy("mean").count().orderBy("mean").toLocalIterator():
        upto += r["count"]
        if upto >= rank:
            return r["mean"]


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, the base counts, n_features, score, base_failed and kept.

    ``trusted`` names trusted texts by doc_id; all of them count.  The gains (one row of ``buckets`` numbers) are sent to
    every task, and so is a bitmap of the trusted ids: texts are never shuffled, and scores meet the ids without them.
    """
    ids = materialise(trusted_rows(trusted), "trusted")
    docs = docs.select("doc_id", "text")
    rows = marked(docs, ids.where("fitted").select("trusted_id"))
    seen = rows.select(F.explode(_once(words_of(F.col("text")), lambda ws: features(ws, buckets))).alias("bucket"), F.when(F.col("fitted"), 1).otherwise(0).alias("t"))
    counted = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("s"), F.sum("t").alias("t"))
    table = materialise(gains(counted, buckets), "gains")

    def measured(ws: Column) -> Column:
        made = base_columns(ws, F.col("text"))
        n_features = F.greatest(2 * F.size(ws) - 1, F.lit(0)).cast("long")
        return F.struct(*(c.alias(k) for k, c in made.items()), n_features.alias("n_features"), score(ws, F.col("gains"), buckets).alias("score"))

    scored = docs.withColumn("gains", table.scalar()).select("doc_id", _once(words_of(F.col("text")), measured).alias("m"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.select("doc_id", "m.*").withColumn("base_failed", failed)
    scored = materialise(scored, "scored-texts")
    others = ids.where("not fitted")
    held = scored.where("not base_failed").join(others, F.col("doc_id") == F.col("trusted_id"), "left_semi").select((F.col("score") / F.col("n_features")).alias("mean"))
    least = least_kept(held, LOST)
    good = F.lit(True) if least is None else F.col("score") >= F.col("n_features") * F.lit(least - SLACK)
    return scored.withColumn("kept", ~F.col("base_failed") & good)


#: For trusted rows of quality 1 and toxic 0.
ORACLE_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
trusted AS (SELECT doc_id, min({crc32_sql("CAST(doc_id AS VARCHAR)")} % 2) = 0 AS fitted FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
each AS (SELECT word, {crc32_sql("word")} AS crc FROM (SELECT DISTINCT word FROM g)),
h AS (SELECT g.id, e.crc, lead(e.crc) OVER (PARTITION BY g.id ORDER BY g.i) AS after FROM g JOIN each e ON g.word = e.word),
f AS (SELECT id, bucket, count(*) AS n FROM (SELECT id, crc % {BUCKETS} AS bucket FROM h UNION ALL SELECT id, (crc * {PAIR} + after) % {BUCKETS} FROM h WHERE after IS NOT NULL) GROUP BY id, bucket),
c AS (SELECT f.bucket, sum(f.n) AS s, coalesce(sum(f.n) FILTER (WHERE t.fitted), 0) AS t FROM f JOIN w ON f.id = w.id LEFT JOIN trusted t ON w.doc_id = t.doc_id GROUP BY f.bucket),
gain AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM c) + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM c) + {BUCKETS} AS DOUBLE)))) AS gain FROM c),
score AS (SELECT f.id, sum(f.n) AS n_features, sum(f.n * gain.gain) AS score FROM f JOIN gain ON f.bucket = gain.bucket GROUP BY f.id),
win AS (SELECT id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, three) AS n FROM win) WHERE n > 1),
again AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY id),
line AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
base AS (SELECT w.id, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(score, 0) AS BIGINT) AS score, t.fitted
         FROM w LEFT JOIN line ON w.id = line.id LEFT JOIN again ON w.id = again.id LEFT JOIN score ON w.id = score.id LEFT JOIN trusted t ON w.doc_id = t.doc_id),
b AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base),
least AS (SELECT quantile_disc(CAST(score AS DOUBLE) / n_features, {LOST}) - {SLACK} AS least FROM b WHERE NOT fitted AND NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_features, score, base_failed,
       NOT base_failed AND score >= n_features * coalesce((SELECT least FROM least), CAST('-inf' AS DOUBLE)) AS kept
FROM b
"""
