"""Append-only records as streams with state by key: the last record of each key, and calls that wait for an answer.

Each key's state is one record in the state store (RocksDB), so a batch costs what it brings, not what is
known.  What changes goes to a changelog, a folder that the file sink fills exactly once; the newest record of
each key in it is the state as a table.  A query that is started again with its checkpoint goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.logs import latest_per_key
from ..operators.logs import undo_target as undo_target_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def use_state_by_key(spark: SparkSession) -> None:
    """Have the session keep state in RocksDB, which state by key needs; queries that run keep theirs."""
    spark.conf.set(_PROVIDER_KEY, PROVIDER)


def _plain(values: tuple) -> tuple:
    """Values that compare: nulls first, and instants as numbers, as rows and state name them by different zones."""
    return tuple((x is not None, x.timestamp() if isinstance(x, datetime) else x) if x is not None else (False,) for x in values)


class _Latest(StatefulProcessor):
    def __init__(self, schema: StructType, order: list[str]):
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.names
        at = [names.index(c) for c in self.order]
        kept = tuple(self.last.get()) if self.last.exists() else None
        found = kept
        for row in rows:
            row = tuple(row[c] for c in names)
            if found is None or _plain(tuple(row[i] for i in at)) >= _plain(tuple(found[i] for i in at)):
                found = row
        if kept is None or _plain(found) != _plain(kept):
            self.last.update(found)
            yield Row(**dict(zip(names, found, strict=True)))

    def close(self) -> None:
        pass


def latest_changes(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The records that become the last ones of their keys, at most one for each key and batch; of equal order the later one."""
    return stream.groupBy(*keys).transformWithState(statefulProcessor=_Latest(stream.schema, order), outputStructType=stream.schema, outputMode="Append", timeMode="None")


def follow(changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream of changes to the changelog at ``path``."""
    writer = changes.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def standing(changelog: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state that a changelog has come to: the rows of :func:`latest_per_key` over all records."""
    return latest_per_key(changelog, keys, order)


def undo_target(changelog: DataFrame, keys: list[str], order: list[str], retracted: Column) -> DataFrame:
    """The most recent record whose key is not retracted by now, of the changelog alone; at most one row."""
    return undo_target_of(changelog, keys, order, retracted)


class _Calls(StatefulProcessor):
    def __init__(self, wait_ms: int, most: int):
        self.wait_ms, self.most = wait_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "asked_at long, attempts int, answered boolean, reported boolean")

    def _overdue(self, key: tuple, at: int, attempts: int) -> Row:
        return Row(call_id=key[0], status="overdue" if attempts < self.most else "given up", attempts=attempts, ms=at)

    def _wait_until(self, due: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked_at, attempts, answered, reported = tuple(self.call.get()) if self.call.exists() else (None, 0, False, False)
        for row in sorted(rows, key=lambda r: (r["ms"], r["kind"] == "answered")):
            if answered:
                break  # a call is answered once
            if asked_at is not None and not reported and row["ms"] >= asked_at + self.wait_ms:  # the watermark wasn't there yet
                reported = True
                yield self._overdue(key, asked_at, attempts)
            if row["kind"] == "answered":
                answered = True
                self._wait_until(None)
                yield Row(call_id=key[0], status="answered", attempts=attempts, ms=row["ms"])
            elif asked_at is None or row["ms"] > asked_at:
                asked_at, attempts, reported = row["ms"], attempts + 1, False
                self._wait_until(asked_at + self.wait_ms)
        self.call.update((asked_at, attempts, answered, reported))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        asked_at, attempts, answered, reported = tuple(self.call.get()) if self.call.exists() else (None, 0, True, True)
        if not answered and not reported:
            self.call.update((asked_at, attempts, answered, True))
            yield self._overdue(key, asked_at, attempts)

    def close(self) -> None:
        pass


def calls(stream: DataFrame, wait: str = "10 minutes", late: str = "1 minute", most: int = 3) -> DataFrame:
    """What becomes of calls: ``stream`` has (call_id string, kind, at), kind being asked or answered.

    (call_id, status, attempts, at): ``answered`` once; ``overdue`` once for an attempt that has no answer after
    ``wait`` (told by a timer, or by what comes for the call later), and ``given up`` where it was the ``most``-th.  An attempt that is asked again starts its wait anew.  Event time decides;
    events later than ``late`` are left out.
    """
    wait_ms = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {wait})").first()[0])
    rows = stream.select("call_id", "kind", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    found = rows.groupBy("call_id").transformWithState(statefulProcessor=_Calls(wait_ms, most), outputStructType="call_id string, status string, attempts int, ms long", outputMode="Append", timeMode="EventTime")
    return found.select("call_id", "status", "attempts", F.timestamp_millis("ms").alias("at"))


def pending_calls(changes: DataFrame) -> DataFrame:
    """(call_id, attempts): calls to be made again, by the changelog of :func:`calls`: the last thing known is that they are overdue."""
    rank = F.when(F.col("status") == "answered", 2).when(F.col("status") == "given up", 1).otherwise(0)
    last = latest_per_key(changes.withColumn("rank", rank), ["call_id"], ["rank", "attempts"])
    return last.where("status = 'overdue'").select("call_id", "attempts")
