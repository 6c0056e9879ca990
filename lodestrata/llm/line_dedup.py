"""Repeated runs of three lines: windows of three consecutive lines that stand earlier in the corpus go.

Every window of three lines is hashed (two 64-bit hashes of the lines without outer spaces).  Of each hash
the first place in order of (doc_id, line) stays; at all later places the covered lines go, overlapping
windows merging into one covered range.  A removed line therefore stands in an earlier place.  Windows of
blank lines only don't count.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

WINDOW = 3


def _lines() -> Column:
    return F.split(F.col("text"), "\n")


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it in a function of each element."""
    return F.get(F.transform(F.array(value), f), 0)


def window_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, pos, h1, h2): one row for each window; rk tells apart texts under one doc_id."""
    lines = docs.select("doc_id", "rk", F.transform(_lines(), lambda x: F.trim(x)).alias("lines")).where(F.size("lines") >= WINDOW)

    def windows(whole: Column) -> Column:
        def window(i: Column) -> Column:
            a, b, c = (F.get(whole, i + k) for k in range(WINDOW))
            return F.struct(i.alias("pos"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(F.lit(7), c, b, a).alias("h2"), (F.length(a) + F.length(b) + F.length(c) > 0).alias("filled"))

        return F.transform(F.sequence(F.lit(0), F.size(whole) - WINDOW), window)

    rows = lines.select("doc_id", "rk", F.explode(_once(F.col("lines"), windows)).alias("w"))
    return rows.where("w.filled").select("doc_id", "rk", "w.pos", "w.h1", "w.h2")


def drop_repeated_windows(docs: DataFrame) -> DataFrame:
    """``docs`` with text without the lines that repeat, and with n_lines and n_removed.

    A null text stays null (0 lines); an empty one has one line.  A text of fewer than three lines is
    never changed.  Rows alike in doc_id and text count as one document, so neither is a repeat of the
    other; rows alike in doc_id only are taken in order of a hash of their texts; a null doc_id comes
    first.  A text whose lines all go becomes empty.  Other columns stay; n_chars, where there is one, is
    brought up to date.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed", "rk")]
    rows = docs.select(*kept, "text", F.xxhash64("text").alias("rk"))
    windows = window_hashes(rows.select("doc_id", "text", "rk"))
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rk", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    firsts = materialise(firsts, "first-windows")  # only hashes that occur again; the join below can then split a hot one
    later = windows.join(firsts, ["h1", "h2"]).where(~F.struct("doc_id", "rk", "pos").eqNullSafe(F.col("first")))
    starts = later.groupBy("doc_id", "rk").agg(F.collect_set("pos").alias("starts")).withColumnRenamed("doc_id", "other_id").withColumnRenamed("rk", "other_rk")
    joined = rows.join(starts, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("rk") == F.col("other_rk")), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + WINDOW - 1))))

    def rest(whole: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), covered)
        return F.array_join(F.transform(left, lambda i: F.get(whole, i)), "\n")

    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(_once(_lines(), rest))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines()))
    out = joined.select(*kept, text.alias("new_text"), n_lines.alias("n_lines"), F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).alias("n_removed"))
    out = out.withColumnRenamed("new_text", "text")
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS pos, trim(lines[i + 1]) AS a, trim(lines[i + 2]) AS b, trim(lines[i + 3]) AS c
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM w WHERE a || b || c <> ''),
gone AS (SELECT DISTINCT doc_id, pos + k AS line_no FROM f, (VALUES (0), (1), (2)) v(k) WHERE nth > 1),
kept AS (SELECT x.doc_id, x.line_no, x.line FROM (SELECT doc_id, unnest(range(0, len(lines))) AS line_no, unnest(lines) AS line FROM l) x
         LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.line_no = g.line_no WHERE g.doc_id IS NULL),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(n.n, 0) AS INTEGER) AS n_removed,
       CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
