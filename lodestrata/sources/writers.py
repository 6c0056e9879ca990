"""Writing tables: checks first, never over what is there, and a digest of what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..guard import refuse


def store(df: DataFrame, path: str, problems: list[DataFrame] | None = None, force: bool = False) -> None:
    """Write after all checks; an existing table is refused unless forced."""
    refuse(*(problems or []))
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def load_verified(df: DataFrame, path: str, expected: int) -> None:
    """Write beside the target, compare the number of rows, then move: readers see all rows or none."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = spark.read.parquet(beside).count()
    if found != expected or fs.exists(target):
        fs.delete(source, True)
        raise ValueError(f"{found} rows were written, {expected} expected" if found != expected else f"{path} is there already")
    fs.rename(source, target)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_pending(wanted: DataFrame, path: str, keys: list[str], make) -> int:
    """Make and append what isn't in the table yet; returns how many rows were to do."""
    spark = wanted.sparkSession
    try:
        todo = wanted.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    except Exception as e:  # the table doesn't exist before the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = wanted
    n = todo.count()
    if n:
        make(todo).write.mode("append").parquet(path)
    return n


def digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def split_extractions(documents: DataFrame) -> dict[str, DataFrame]:
    """Nested extraction records as their three tables."""
    return {
        "extractions": documents.drop("risks", "management"),
        "risks": documents.select("report_id", F.explode("risks").alias("r")).select("report_id", "r.*"),
        "management": documents.select("report_id", F.explode("management").alias("m")).select("report_id", "m.*"),
    }


def write_rankings(rankings: DataFrame, path: str, provenance: dict[str, str]) -> str:
    """Rankings (query_id, arm, rank, chunk_id, score) as one record a query, with a provenance record beside
    them: what was given, how many queries there are, and the digest of the rows.  Nothing is written over.

    Gated rankings, with their columns L, s1, tau and fires, keep these in each record.
    """
    spark = rankings.sparkSession
    gate = [c for c in ("L", "s1", "tau", "fires") if c in rankings.columns]
    listed = rankings.groupBy("query_id", "arm", *gate).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"))).alias("ranking"))
    records = listed.groupBy("query_id", *gate).agg(F.map_from_entries(F.collect_list(F.struct("arm", "ranking"))).alias("arms"))
    records.write.mode("errorifexists").json(path)
    made = digest(spark.read.schema(records.schema).json(path))
    rows = sorted({**provenance, "rows": made, "queries": made.split(":")[0]}.items())
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("errorifexists").json(f"{path.rstrip('/')}.provenance")
    return made


def verify_rankings(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of :func:`write_rankings`; refused where their digest isn't the recorded one."""
    from ..guard import Refused

    records = spark.read.schema(schema).json(path)
    told = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path.rstrip('/')}.provenance").collect()}
    if told.get("rows") != digest(records):
        raise Refused([f"{path} isn't what its provenance record describes"])
    return records


def write_thresholds(measured: DataFrame, path: str) -> None:
    """Measured thresholds (L, tau, ...) as the document that :func:`lodestrata.sources.readers.thresholds` reads."""
    rest = [c for c in measured.columns if c != "L"]
    whole = measured.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("L").cast("string").alias("L"), F.struct(*rest).alias("m"))))).alias("null"))
    whole.coalesce(1).write.mode("errorifexists").json(path)


def export_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as JSON lines under ``path`` and a manifest of their counts, made from what was written."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").json(f"{path}/{name}")
        counts.append((name, spark.read.schema(df.schema).json(f"{path}/{name}").count()))
    manifest = spark.createDataFrame(counts, "name string, rows long")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return manifest
