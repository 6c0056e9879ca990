"""Sources for Spark's Python Data Source API: append-only logs of lines, and folders of filings.

``record_log`` reads the lines of the files under a path, in a batch or as a stream; partitions are planned
by bytes, a long file being cut where lines begin and short files being read together.  A stream's offset
is each file's length up to its last newline, so a line that is still being written waits; a file that got
shorter is refused.  ``filing_folder`` reads whole files, dealt out by size.  Both list and open files with Arrow's file
systems, so paths may be those of a store (``s3://``, ``hdfs://``, ``gs://``) or local ones.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..guard import Refused

TARGET_BYTES = 32 << 20
_BLOCK = 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _listed(path: str, pattern: str) -> list[tuple[str, int, str]]:
    """(path, bytes, name) of the files at or under a path, in order of path; hidden ones are left out."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file]
    seen = [f for f in files if fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))]
    return sorted((f.path, f.size or 0, f.base_name) for f in seen)


class Pieces(InputPartition):
    """Ranges of bytes of files: (path, start, end)."""

    def __init__(self, pieces: Sequence[tuple[str, int, int]]):
        self.pieces = tuple(pieces)


def plan_lines(ranges: Sequence[tuple[str, int, int]], target: int) -> list[Pieces]:
    """Ranges cut at ``target`` bytes, and short ones put together up to as many, in order."""
    cut = [(path, a, min(a + target, end)) for path, start, end in ranges for a in range(start, end, target)]
    out, held, size = [], [], 0
    for piece in cut:
        if held and size + piece[2] - piece[1] > target:
            out.append(Pieces(held))
            held, size = [], 0
        held.append(piece)
        size += piece[2] - piece[1]
    return [*out, Pieces(held)] if held else out


def plan_files(files: Sequence[tuple[str, int, str]], target: int) -> list[Pieces]:
    """Whole files dealt out, largest first, each to the part with the fewest bytes."""
    total = sum(size for _, size, _ in files)
    parts: list[list] = [[0, k, []] for k in range(max(1, min(len(files), -(-total // max(target, 1)))))]
    for path, size, _ in sorted(files, key=lambda f: (-f[1], f[0])):
        least = min(parts)
        least[0] += size
        least[2].append((path, 0, size))
    return [Pieces(p[2]) for p in parts if p[2]]


def lines_within(system: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in [start, end)."""
    with system.open_input_file(path) as file:
        at = max(start - 1, 0)
        file.seek(at)
        rest, skip = b"", start > 0
        while True:
            block = file.read(_BLOCK)
            rest += block
            while (cut := rest.find(b"\n")) >= 0:
                line, rest = rest[:cut], rest[cut + 1 :]
                if skip:
                    skip = False
                elif at < end:
                    yield at, line.decode("utf-8")
                at += cut + 1
                if at >= end:
                    return
            if not block:
                break
        if rest and not skip and at < end:
            yield at, rest.decode("utf-8")


def whole_lines(system: fs.FileSystem, path: str, size: int) -> int:
    """The place behind the last newline among the first ``size`` bytes."""
    with system.open_input_file(path) as file:
        end = size
        while end > 0:
            start = max(end - _BLOCK, 0)
            cut = file.read_at(end - start, start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return 0


class _Options:
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.target = int(options.get("targetbytes", TARGET_BYTES))
        self.system = lambda: _open(self.path)[0]


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> Sequence[InputPartition]:
        return plan_lines([(path, 0, size) for path, size, _ in _listed(self.o.path, self.o.pattern)], self.o.target) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return _read_lines(self.o, partition)


def _read_lines(o: _Options, partition: Pieces) -> Iterator[tuple]:
    system = o.system()
    for path, start, end in partition.pieces:
        for at, line in lines_within(system, path, start, end):
            if line.strip():
                yield path, at, line.rstrip("\r")


class _LogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.o = _Options(options)
        self.known: dict[str, tuple[int, int]] = {}  # sizes for which the last newline is known

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self, *_) -> dict:
        system = self.o.system()
        for path, size, _name in _listed(self.o.path, self.o.pattern):
            if self.known.get(path, (None, 0))[0] != size:
                self.known[path] = size, whole_lines(system, path, size)
        return {"files": {path: end for path, (_, end) in sorted(self.known.items())}}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before = start["files"]
        shorter = [path for path, at in end["files"].items() if at < before.get(path, 0)]
        if shorter:
            raise ValueError(f"an append-only file got shorter: {', '.join(shorter)}")
        return plan_lines([(path, before.get(path, 0), at) for path, at in end["files"].items() if at > before.get(path, 0)], self.o.target) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return _read_lines(self.o, partition)

    def commit(self, end: dict) -> None:
        pass


class RecordLog(DataSource):
    """Lines as (file, at, line); blank ones are left out.  Options: path, pattern, targetBytes."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return "file string, at long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LogStream(dict(self.options))


class _FilingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> Sequence[InputPartition]:
        return plan_files(_listed(self.o.path, self.o.pattern), self.o.target) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        system = self.o.system()
        for path, _, size in partition.pieces:
            with system.open_input_stream(path) as file:
                yield path, path.rsplit("/", 1)[-1], size, file.read()


class FilingFolder(DataSource):
    """Whole files as (path, name, size, content).  Options: path, pattern, targetBytes."""

    @classmethod
    def name(cls) -> str:
        return "filing_folder"

    def schema(self) -> str:
        return "path string, name string, size long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FilingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    for source in (RecordLog, FilingFolder):
        spark.dataSource.register(source)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    read = lines.withColumn("r", F.from_json("line", schema, {"mode": "FAILFAST"}))
    return read.select("r.*", F.col("file").alias("log_file"), F.col("at").alias("log_at"))


def record_log(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The records of the logs under a path, with the file and the byte at which each begins; malformed ones are refused."""
    register(spark)
    return _parsed(spark.read.format("record_log").options(**options).load(path), schema)


def record_stream(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """:func:`record_log` as a stream that goes on where its checkpoint ends."""
    register(spark)
    return _parsed(spark.readStream.format("record_log").options(**options).load(path), schema)


def filing_folder(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(ticker, period, content) of the files called <ticker>_<period>.htm under a path."""
    register(spark)
    rows = spark.read.format("filing_folder").options(**{"pattern": "*_*.htm*", **options}).load(path)
    part = lambda k: F.regexp_extract("name", r"^([^_]+)_(.+)\.html?$", k)
    return rows.select(part(1).alias("ticker"), part(2).alias("period"), "content")


def newest_run(folder: str, kind: str = "rankings") -> tuple[str, dict]:
    """The newest ``<kind>-<stamp>.jsonl`` of a folder and the content of its own ``provenance-<stamp>.json``.

    They belong together by stamp; where the newest run has no provenance, an older one doesn't take its place.
    """
    try:
        files = {name: path for path, _, name in _listed(folder, "*.json*")}
    except FileNotFoundError:
        raise Refused([f"no folder {folder}"]) from None
    runs = sorted(n for n in files if n.startswith(f"{kind}-") and n.endswith(".jsonl"))
    if not runs:
        raise Refused([f"no {kind}-*.jsonl in {folder}"])
    stamp = runs[-1][len(kind) + 1 : -len(".jsonl")]
    name = f"provenance-{stamp}.json"
    if name not in files:
        raise Refused([f"{runs[-1]} has no {name}"])
    with _open(folder)[0].open_input_stream(files[name]) as file:
        return files[runs[-1]], json.loads(file.read())
