"""Reading records strictly: fixed schemas, and every problem named before anything is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..guard import Refused, duplicates, refuse, where


def records(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines by a fixed schema; blank lines are skipped, malformed lines and missing fields refused."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if required:
        missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
        refuse(rows.where(F.size(missing) > 0).select(F.concat(F.lit("a record lacks "), F.array_join(missing, ", ")).alias("problem")))
    return rows


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    rows = records(spark, path, schemas.CHUNKS, tuple(c.split()[0] for c in schemas.CHUNKS.split(", ")))
    if rows.isEmpty():
        raise Refused(["the chunk store is empty"])
    return rows


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """Ranking records as long rows (query_id, arm, rank, chunk_id, score); repeated ids are refused."""
    rows = records(spark, path, schemas.RANKING_RECORDS, ("query_id", "arms"))
    refuse(duplicates(rows, ["query_id"], "query"))
    listed = rows.select("query_id", F.explode("arms").alias("arm", "ranking")).select("query_id", "arm", F.posexplode("ranking").alias("at", "r"))
    return listed.select("query_id", "arm", (F.col("at") + 1).alias("rank"), "r.chunk_id", "r.score")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The filings of a manifest document."""
    whole = "filings array<struct<accession:string,ticker:string,period:string,fits_context_window:boolean,tokens:bigint>>"
    return spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("filings"))


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(L, tau) of a threshold artifact, whose ``null`` block maps lengths to measurements."""
    whole = "`null` map<string,struct<tau:double>>"
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode(F.col("`null`")).alias("L", "m")).select(F.col("L").cast("int").alias("L"), F.col("m.tau").alias("tau"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, period, content) of files called <ticker>_<period>.htm."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract(name, r"^([^_]+)_(.+)\.html?$", 1).alias("ticker"), F.regexp_extract(name, r"^([^_]+)_(.+)\.html?$", 2).alias("period"), "content")


def newest(spark: SparkSession, pattern: str) -> str:
    """The last path, in order of name, that matches; none is refused."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().toString() for f in found or [])
    if not names:
        raise Refused([f"nothing matches {pattern}"])
    return names[-1]


def eligible(submissions: DataFrame) -> DataFrame:
    """Annual reports whose document is HTML."""
    return submissions.where((F.col("form") == "10-K") & F.lower("document").rlike(r"\.html?$"))


def select_issuers(issuers: DataFrame, submissions: DataFrame, per_sector: int = 2, filings_each: int = 2, seed: int = 20260809) -> DataFrame:
    """Up to ``per_sector`` issuers of each sector in seeded order, with their newest filings; issuers with
    fewer filings are not eligible."""
    from ..operators.logs import first_per_group, seeded_order

    new = first_per_group(eligible(submissions), ["cik"], [F.desc("filed"), F.asc("accession")], filings_each)
    full = new.groupBy("cik").count().where(F.col("count") == filings_each).select("cik")
    chosen = first_per_group(issuers.join(full, "cik", "left_semi"), ["sector"], [seeded_order(seed, "cik"), F.asc("cik")], per_sector).drop("nth")
    return chosen.join(new.drop("nth"), "cik")


def check_labels(labels: DataFrame) -> None:
    """Refuse labels of an unknown kind, values without a figure or text, and repeated keys."""
    name = F.concat_ws(", ", "accession", "field")
    kinds = ("value", "stated_none", "not_addressed")
    refuse(
        duplicates(labels, ["accession", "field"], "label"),
        where(labels, (F.col("status") == "labeled") & ~F.coalesce(F.col("answer_kind").isin(*kinds), F.lit(False)), F.concat(F.lit("unknown kind: "), name)),
        where(labels, (F.col("answer_kind") == "value") & (F.coalesce(F.trim("value"), F.lit("")) == ""), F.concat(F.lit("no value: "), name)),
    )
