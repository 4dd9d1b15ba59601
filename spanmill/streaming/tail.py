"""Streaming source that follows growing files: offsets are bytes per file, every finished line comes once.

Spark's file source reads a file when it appears and never again, so a log that is still written loses what comes later. This source
remembers how far each file was read. Every step (micro-batch) takes, per file, the bytes up to its last line end.

* **Ledger.** A step is one small file in ``ledger`` (a folder the driver and the checkpoint share a fate with): the byte ranges it adds, written
  before Spark sees the step's number. The offset in Spark's log is that number alone, so it stays a few bytes however many files there are. A
  replayed or restarted batch reads the very same ranges. Every ``COMPACT`` steps the positions of all files are written once, so a restart reads few files.
* **Scale.** The driver lists names, sizes and modification times (about 100 bytes a file) and looks at the ends of files that grew; text is only read by tasks,
  in ranges of ``splitBytes``, each from its first line start to the line that crosses its end. ``maxBytesPerTrigger`` bounds a step.
* **Files** are reached through Arrow's file systems, so local, HDFS, S3 and GCS paths work alike on driver and executors.

Cases: a line without an end waits until its end is written; an empty line is a row; a file that became shorter (rotated in place) is read from its
start again; a removed file is left out if a step that names it has to be read again; bytes that are not UTF-8 are replaced; an
empty folder gives empty steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

COMPACT, LOOK, SPLIT, STEP, ROWS = 100, 1 << 16, 64 << 20, 16 << 30, 4096
SCHEMA = "file string, position bigint, value string"


class ByteRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file; ``first`` if the range begins at a line start."""

    def __init__(self, file: str, start: int, end: int, first: bool):
        self.file, self.start, self.end, self.first = file, start, end, first


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it; ``file:`` and plain paths are local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ledger:
    """Numbered steps of byte ranges, and the position of every file after the last one."""

    def __init__(self, path: str):
        self.fs, self.path = opened(path)
        self.fs.create_dir(self.path, recursive=True)
        self.at: dict[str, int] = {}
        self.step = 0
        names = [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.path))]
        full = max((int(n[5:-5]) for n in names if n.startswith("full-") and n.endswith(".json")), default=0)
        if full:
            self.at, self.step = self._load(f"full-{full}.json"), full
        while f"step-{self.step + 1}.json" in names:
            self._apply(self.ranges(self.step + 1))

    def _load(self, name: str):
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.readall())

    def _write(self, name: str, value) -> None:
        """Whole or not at all: written aside, then moved."""
        with self.fs.open_output_stream(f"{self.path}/_{name}") as f:
            f.write(json.dumps(value).encode())
        self.fs.move(f"{self.path}/_{name}", f"{self.path}/{name}")

    def _apply(self, ranges: list) -> None:
        self.step += 1
        for file, _, end in ranges:
            self.at[file] = end

    def ranges(self, step: int) -> list:
        return self._load(f"step-{step}.json")

    def add(self, ranges: list) -> None:
        self._write(f"step-{self.step + 1}.json", ranges)
        self._apply(ranges)
        if self.step % COMPACT == 0:
            self._write(f"full-{self.step}.json", self.at)


def last_line_end(f: pa.NativeFile, start: int, end: int) -> int:
    """Position after the last line end in [start, end), or ``start``; reads backwards from the end."""
    while end > start:
        lo = max(start, end - LOOK)
        f.seek(lo)
        at = f.read(end - lo).rfind(b"\n")
        if at >= 0:
            return lo + at + 1
        end = lo
    return start


def next_line_end(f: pa.NativeFile, start: int, end: int) -> int:
    """Position after the first line end in [start, end), or ``end``."""
    f.seek(start)
    while start < end:
        part = f.read(min(LOOK, end - start))
        at = part.find(b"\n")
        if at >= 0:
            return start + at + 1
        if not part:
            break
        start += len(part)
    return end


def lines_of(f: pa.NativeFile, part: ByteRange, size: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in the range; the last may end behind it."""
    at = part.start if part.first else next_line_end(f, part.start - 1, size)
    f.seek(at)
    rest = b""
    while at < part.end:
        more = f.read(LOOK)
        if not more:
            return
        *whole, rest = (rest + more).split(b"\n")
        for line in whole:
            if at >= part.end:
                return
            yield at, line
            at += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.ledger_path = options["path"], options["ledger"]
        self.suffix = options.get("suffix", ".jsonl")
        self.step_bytes, self.split = int(options.get("maxbytespertrigger", STEP)), int(options.get("splitbytes", SPLIT))
        self._ledger: Ledger | None = None

    @property
    def ledger(self) -> Ledger:
        if self._ledger is None:
            self._ledger = Ledger(self.ledger_path)
        return self._ledger

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        new = self._growth()
        if new:
            self.ledger.add(new)
        return {"step": self.ledger.step}

    def _growth(self) -> list:
        """[file, from, to] for each file with finished lines not taken yet, oldest change first."""
        files, root = opened(self.path)
        found = [f for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]
        out, left, at = [], self.step_bytes, self.ledger.at
        for info in sorted((f for f in found if f.size != at.get(f.path, 0)), key=lambda f: (f.mtime_ns, f.path)):
            if left <= 0:
                break
            start = at.get(info.path, 0)
            start = start if start <= info.size else 0
            with files.open_input_file(info.path) as f:
                end = last_line_end(f, start, min(info.size, start + left))
                if end == start and info.size > start + left:  # one line longer than a step
                    end = next_line_end(f, start + left, info.size)
                    end = end if last_line_end(f, end - 1, end) == end else start
            if end > start:
                out.append([info.path, start, end])
                left -= end - start
        return out

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return [ByteRange(file, lo, min(lo + self.split, b), lo == a)
                for step in range(start["step"] + 1, end["step"] + 1) for file, a, b in self.ledger.ranges(step) for lo in range(a, b, self.split)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        info = files.get_file_info(partition.file)
        if not info.is_file:
            return
        with files.open_input_file(partition.file) as f:
            at, text = [], []
            for position, line in lines_of(f, partition, info.size):
                at.append(position), text.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(at) >= ROWS:
                    yield self._batch(partition.file, at, text)
                    at, text = [], []
            if at:
                yield self._batch(partition.file, at, text)

    @staticmethod
    def _batch(file: str, at: list[int], text: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(at)), pa.array(at, pa.int64()), pa.array(text, pa.string())], names=["file", "position", "value"])

    def commit(self, end: dict) -> None:
        """Steps stay in the ledger: they are the record that a new query over the same folder replays."""


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spanmill_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, ledger: str, suffix: str = ".jsonl", max_bytes: int = STEP, split_bytes: int = SPLIT) -> DataFrame:
    """Stream of (file, position of the line's first byte, value) over a folder of growing files."""
    spark.dataSource.register(TailSource)
    return (spark.readStream.format(TailSource.name()).option("path", path).option("ledger", ledger).option("suffix", suffix)
            .option("maxBytesPerTrigger", str(max_bytes)).option("splitBytes", str(split_bytes)).load())
