import json

import pytest
from pyspark.sql import functions as F

from lodestrata.guard import Refused
from lodestrata.operators.logs import latest_per_key
from lodestrata.sources import datasource

SCHEMA = "key string, at int, note string"


def line(k, at, note="x"):
    return json.dumps({"key": k, "at": at, "note": note}, ensure_ascii=False) + "\n"


def logs(folder, files=5, rows=400):
    for f in range(files):
        (folder / f"log-{f}.jsonl").write_text("".join(line(f"k{i % 7}", f * rows + i, "é" * (i % 50)) + ("\n" if i % 9 == 0 else "") for i in range(rows)), encoding="utf-8")
    (folder / "_hidden.jsonl").write_text("not a record\n")
    return str(folder)


@pytest.mark.parametrize("target", ["800", "5000", "100000000"])
def test_lines_are_read_once_however_files_are_cut(spark, tmp_path, target):
    path = logs(tmp_path, 3, 60)
    got = datasource.record_log(spark, path, SCHEMA, targetBytes=target)
    assert sorted(r["at"] for r in got.collect()) == list(range(180))
    if target == "5000":
        assert got.rdd.getNumPartitions() >= 2
    for r in got.limit(5).collect():
        assert open(r["log_file"], "rb").read()[r["log_at"] :].startswith(b'{"key": "')


def test_partitions_are_planned_by_bytes():
    pieces = [p.pieces for p in datasource.plan_lines([("a", 0, 250), ("b", 0, 30), ("c", 10, 60), ("d", 0, 0)], 100)]
    assert pieces == [(("a", 0, 100),), (("a", 100, 200),), (("a", 200, 250), ("b", 0, 30)), (("c", 10, 60),)]
    sizes = [sum(e for _, _, e in p.pieces) for p in datasource.plan_files([(f"f{i}", s, "") for i, s in enumerate([90, 50, 40, 30, 20, 10])], 80)]
    assert sorted(sizes) == [80, 80, 80] or max(sizes) <= 90


def test_batch_and_stream_read_the_same_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = logs(tmp_path / "in", 2, 50)

    def run():
        stream = datasource.record_stream(spark, path, SCHEMA, targetBytes="3000")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    run()
    with open(f"{path}/log-1.jsonl", "a", encoding="utf-8") as f:
        f.write(line("new", 1) + '{"key": "half", "at"')  # the second one is still being written
    (tmp_path / "in" / "later.jsonl").write_text(line("other", 2))
    run()
    seen = spark.read.schema(SCHEMA + ", log_file string, log_at long").parquet(f"{tmp_path}/out")
    assert {r["key"] for r in seen.collect()} >= {"new", "other"} and "half" not in {r["key"] for r in seen.collect()}
    with open(f"{path}/log-1.jsonl", "a", encoding="utf-8") as f:
        f.write(": 5}\n")
    run()
    run()  # nothing new
    seen = spark.read.schema(SCHEMA + ", log_file string, log_at long").parquet(f"{tmp_path}/out")
    assert rows(seen) == rows(datasource.record_log(spark, path, SCHEMA))
    assert latest_per_key(seen, ["key"], ["at"]).count() == 10


def test_malformed_records_and_shorter_files_are_refused(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text(line("a", 1) + "oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        datasource.record_log(spark, str(tmp_path / "bad.jsonl"), SCHEMA).collect()
    stream = datasource._LogStream({"path": str(tmp_path)})
    end = stream.latestOffset()
    (tmp_path / "bad.jsonl").write_text(line("a", 1))
    with pytest.raises(ValueError, match="shorter"):
        stream.partitions(end, stream.latestOffset())
    with pytest.raises(ValueError, match="path"):
        datasource._LogReader({})


def test_nothing_to_read(spark, tmp_path):
    assert datasource.record_log(spark, str(tmp_path), SCHEMA).collect() == []
    assert datasource.filing_folder(spark, str(tmp_path)).collect() == []


def test_filings(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"T{i}_2024-12-3{i % 2}.htm").write_bytes(b"<p>" + b"x" * (1000 * i))
    (tmp_path / "notes.txt").write_text("no filing")
    got = datasource.filing_folder(spark, str(tmp_path), targetBytes="4000")
    assert sorted((r["ticker"], r["period"], len(r["content"])) for r in got.collect()) == [(f"T{i}", f"2024-12-3{i % 2}", 3 + 1000 * i) for i in range(6)]
    assert got.rdd.getNumPartitions() == 4
    assert got.select(F.sum(F.length("content"))).first()[0] == 15018


def test_runs_and_their_provenance_belong_together(tmp_path):
    with pytest.raises(Refused, match="no rankings"):
        datasource.newest_run(str(tmp_path))
    for stamp in ("20240101", "20240102"):
        (tmp_path / f"rankings-{stamp}.jsonl").write_text("")
    (tmp_path / "provenance-20240101.json").write_text(json.dumps({"depth": 1}))
    with pytest.raises(Refused, match="provenance-20240102"):
        datasource.newest_run(str(tmp_path))
    (tmp_path / "provenance-20240102.json").write_text(json.dumps({"depth": 50}))
    path, what = datasource.newest_run(str(tmp_path))
    assert path.endswith("rankings-20240102.jsonl") and what == {"depth": 50}
    with pytest.raises(Refused, match="no folder"):
        datasource.newest_run(f"{tmp_path}/absent")
