import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import logs
from lodestrata.streaming import keyed

SCHEMA = "key string, at int, retracted boolean, note string"


@pytest.fixture(scope="module", autouse=True)
def state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    keyed.use_state_by_key(spark)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def put(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")


def records(seed, n, first):
    rng = random.Random(seed)
    ats = rng.sample(range(first, first + 10 * n), n)
    return [(f"k{rng.randint(0, 12)}", at, rng.random() < 0.3, None if rng.random() < 0.1 else f"note {at}") for at in ats]


def test_a_restarted_query_knows_the_last_records(spark, tmp_path):
    every = []
    for n, first in enumerate((0, 5000, 2000, 9000)):  # the third part is older than the second
        rows = records(n, 60, first)
        every += rows
        put(spark, rows, SCHEMA, tmp_path, n)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        keyed.follow(keyed.latest_changes(stream, ["key"], ["at"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
        whole, log = spark.createDataFrame(every, SCHEMA), spark.read.parquet(f"{tmp_path}/out")
        want = sorted(map(str, logs.latest_per_key(whole, ["key"], ["at"]).collect()))
        assert sorted(map(str, keyed.standing(log, ["key"], ["at"]).collect())) == want
        gone = F.col("retracted")
        assert keyed.undo_target(log, ["key"], ["at"], gone).collect() == logs.undo_target(whole, ["key"], ["at"], gone).collect()
    assert log.count() < len(every)  # only what changes the state is written


def test_a_batch_writes_only_its_changes(spark, tmp_path):
    rows = [(f"k{i}", 1, False, "x") for i in range(200)]
    for n, part in enumerate((rows, [("k3", 2, False, "y"), ("k4", 0, False, "old")])):
        put(spark, part, SCHEMA, tmp_path, n)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        keyed.follow(keyed.latest_changes(stream, ["key"], ["at"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 201


def test_instants_of_rows_and_state_compare(spark, tmp_path):
    schema, zero = "key string, at timestamp", datetime(2024, 1, 1)
    for n, minutes in enumerate(([5, 3], [4, 9], [9])):
        put(spark, [("k", zero + timedelta(minutes=m)) for m in minutes], schema, tmp_path, n)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        keyed.follow(keyed.latest_changes(stream, ["key"], ["at"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(r["at"].minute for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [5, 9]


def test_calls_that_wait(spark, tmp_path):
    zero = datetime(2024, 1, 1, 12)
    at = lambda m: zero + timedelta(minutes=m)
    parts = [
        [("a", "asked", at(0)), ("b", "asked", at(0)), ("c", "asked", at(1)), ("a", "answered", at(3))],
        [("clock", "asked", at(30)), ("b", "asked", at(31)), ("c", "answered", at(32))],
        [("clock", "asked", at(60)), ("b", "asked", at(61))],
        [("clock", "asked", at(90))],
    ]
    for n, rows in enumerate(parts):
        put(spark, rows, "call_id string, kind string, at timestamp", tmp_path, n)
        stream = spark.readStream.schema("call_id string, kind string, at timestamp").parquet(f"{tmp_path}/in")
        keyed.follow(keyed.calls(stream, "10 minutes", "1 minute", most=3), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    seen = spark.read.parquet(f"{tmp_path}/out")
    got = {(r["call_id"], r["status"], r["attempts"]) for r in seen.where("call_id <> 'clock'").collect()}
    assert ("a", "answered", 1) in got and ("c", "answered", 1) in got
    assert {x for x in got if x[0] == "b"} == {("b", "overdue", 1), ("b", "overdue", 2), ("b", "given up", 3)} and ("c", "overdue", 1) in got
    assert not any(c == "a" and s != "answered" for c, s, _ in got)
    assert not {r["call_id"] for r in keyed.pending_calls(seen).collect()} & {"a", "c"}
