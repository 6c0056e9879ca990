"""Append-only records as streams: the latest state by key, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import latest_per_key, upsert


def keep_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the last record of each key in versions of a table: ``path``/v<batch>, each written whole, so a
    failed batch can be run again; the newest version is the state."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = latest_per_key(batch, keys, order)
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}")
            newer = latest_per_key(old.join(changes.select(*keys), keys, "left_semi").unionByName(changes), keys, order)
            changes = upsert(old, newer, keys)
        changes.write.mode("overwrite").parquet(f"{path}/v{number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, by, n) of tumbling windows; records later than ``late`` are left out."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("w.start", "w.end", by, "n")


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The stream without repeated keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
