import json

import pytest

from lodestrata.guard import Refused
from lodestrata.operators.logs import latest_per_key
from lodestrata.sources import readers, writers
from lodestrata.streaming import logs

CHUNK = {"chunk_id": "c", "accession": "a", "ticker": "t", "period": "p", "item": "", "title": "", "index": 0, "first_page": 1, "last_page": 1, "tokens": 1, "text": "x"}


def lines(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    return str(path)


def test_chunk_store(spark, tmp_path):
    assert readers.chunk_store(spark, lines(tmp_path / "a.jsonl", [CHUNK])).count() == 1
    with pytest.raises(Refused, match="lacks text"):
        readers.chunk_store(spark, lines(tmp_path / "b.jsonl", [{k: v for k, v in CHUNK.items() if k != "text"}]))
    with pytest.raises(Refused, match="empty"):
        readers.chunk_store(spark, lines(tmp_path / "c.jsonl", []))
    with pytest.raises(Exception):
        readers.chunk_store(spark, lines(tmp_path / "d.jsonl", ["oops"])).collect()


def test_rankings(spark, tmp_path):
    row = {"query_id": "q", "arms": {"sparse": [{"chunk_id": "c", "score": 0.2}, {"chunk_id": "d", "score": 0.1}]}}
    got = readers.rankings(spark, lines(tmp_path / "a.jsonl", [row])).collect()
    assert [(r.rank, r.chunk_id) for r in got] == [(1, "c"), (2, "d")]
    with pytest.raises(Refused, match="stands 2 times"):
        readers.rankings(spark, lines(tmp_path / "b.jsonl", [row, row]))


def test_thresholds_and_newest(spark, tmp_path):
    for name in ("t-1.json", "t-2.json"):
        (tmp_path / name).write_text(json.dumps({"null": {"4": {"tau": 3.3}}}))
    path = readers.newest(spark, f"{tmp_path}/t-*.json")
    assert path.endswith("t-2.json") and [tuple(r) for r in readers.thresholds(spark, path).collect()] == [(4, 3.3)]
    with pytest.raises(Refused):
        readers.newest(spark, f"{tmp_path}/none*")


def test_writers(spark, tmp_path):
    df = spark.range(10)
    writers.store(df, f"{tmp_path}/s")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.store(df, f"{tmp_path}/s")
    with pytest.raises(ValueError, match="expected"):
        writers.load_verified(df, f"{tmp_path}/v", 11)
    writers.load_verified(df, f"{tmp_path}/v", 10)
    assert writers.digest(spark.read.parquet(f"{tmp_path}/v")) == writers.digest(df)
    assert writers.append_pending(df, f"{tmp_path}/p", ["id"], lambda x: x) == 10
    assert writers.append_pending(spark.range(12), f"{tmp_path}/p", ["id"], lambda x: x) == 2


def test_stream_keeps_latest(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z"), ("c", 1, "w")]
    schema = "key string, at int, v string"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        logs.keep_latest(spark.readStream.schema(schema).parquet(str(source)), f"{tmp_path}/out", ["key"], ["at"], f"{tmp_path}/ck").awaitTermination()
    newest = sorted((tmp_path / "out").glob("v*"))[-1]
    got = {tuple(r) for r in spark.read.parquet(str(newest)).collect()}
    want = {tuple(r) for r in latest_per_key(spark.createDataFrame([r for p in rows for r in p], schema), ["key"], ["at"]).collect()}
    assert got == want
