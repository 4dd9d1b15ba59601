"""Records of log files by (file, line), read by seeking instead of scanning.

``line_blocks`` is a small side table of newline counts per block of a file (a row per 64 KB), made by tasks that read byte ranges.
``records_at`` finds the block of each wanted line by an equi-join on (file, bucket of newline numbers), seeks to it and reads on
to the line, so the bytes read grow with the lines asked for. Lines end at a newline (a carriage return before it is dropped), as
in ``numbered_lines`` for JSON lines. Cases: unknown files and lines after the end give no row; repeated positions one; null
positions none; an empty line an empty text; a line longer than ``MAX_BYTES`` its first ``MAX_BYTES``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import land
from ..streaming.tail import opened
from .drill import MAX_CHARS

BLOCK, RANGE, BUCKET = 1 << 16, 1 << 26, 256
MAX_BYTES = 4 * (MAX_CHARS + 1)  # holds more than MAX_CHARS code points of any text
_BEFORE = (Window.unboundedPreceding, -1)


def _newlines(block: int, range_bytes: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, file, lo in zip(part["path"], part["file"], part["lo"]):
                system, name = opened(path)
                out = []
                with system.open_input_file(name) as f:
                    f.seek(lo)
                    for at in range(lo, lo + range_bytes, block):
                        data = f.read(block)
                        if not data:
                            break
                        out.append((file, path, lo, at, data.count(b"\n")))
                yield pd.DataFrame(out, columns=["file", "path", "lo", "offset", "n"])
    return run


def line_blocks(spark: SparkSession, path: str, glob: str = "*.jsonl", block: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """(file, path, offset, before, n): newlines before each block and in it. ``range_bytes`` is a multiple of ``block``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
             .select(F.col("_metadata.file_path").alias("file"), "path", "length").filter("length > 0"))
    ranges = land(files.select("file", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("lo")))
    tasks = max(1, min(ranges.count(), 20_000))
    n = land(ranges.repartition(tasks, "file", "lo").mapInPandas(_newlines(block, range_bytes), "file string, path string, lo bigint, offset bigint, n bigint"))
    per = n.groupBy("file", "lo").agg(F.sum("n").alias("rn"))
    first = per.select("file", "lo", F.coalesce(F.sum("rn").over(Window.partitionBy("file").orderBy("lo").rowsBetween(*_BEFORE)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file", "lo").orderBy("offset").rowsBetween(*_BEFORE)), F.lit(0))
    return n.withColumn("inside", inside).join(first, ["file", "lo"]).select("file", "path", "offset", (F.col("base") + F.col("inside")).alias("before"), "n")


def _seek(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, f, at = None, None, 0  # the open block, its stream, and newlines passed since the block's start
    for part in parts:
        out = []
        for file, path, line, offset, skip in zip(part["file"], part["path"], part["line"], part["offset"], part["skip"]):
            if held != (path, offset) or skip < at:
                if f is None or held[0] != path:
                    if f is not None:
                        f.close()
                    system, name = opened(path)
                    f = io.BufferedReader(system.open_input_file(name), BLOCK)
                f.seek(offset)
                held, at = (path, offset), 0
            while at < skip:
                got = f.readline(MAX_BYTES)
                if not got:
                    break
                at += got.endswith(b"\n")
            data = f.readline(MAX_BYTES) if at == skip else b""
            at += data.endswith(b"\n")
            if data:
                out.append((file, line, data.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
        yield pd.DataFrame(out, columns=["file", "line", "text"])
    if f is not None:
        f.close()


def records_at(positions: DataFrame, blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """(file, line, record_id, text) of the wanted (file, line) rows; the form ``raw_records_for`` takes."""
    p = positions.select("file", F.col("line").cast("bigint").alias("line")).filter("line > 0").distinct().withColumn("after", F.col("line") - 1)
    p = p.withColumn("bucket", F.floor(F.col("after") / BUCKET))
    # newline number 0 is the start of a file
    b = blocks.select("file", "path", "offset", "before", F.when(F.col("offset") == 0, F.lit(0)).otherwise(F.col("before") + 1).alias("lo"),
                      (F.col("before") + F.col("n")).alias("hi")).filter("hi >= lo")
    b = b.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET))))
    j = p.join(b, ["file", "bucket"]).filter("after between lo and hi").select("file", "path", "line", "offset", (F.col("after") - F.col("before")).alias("skip"))
    j = j.repartition(*([parts] if parts else []), "path", F.floor(F.col("offset") / RANGE)).sortWithinPartitions("path", "offset", "skip")
    return j.mapInPandas(_seek, "file string, line bigint, text string").select("file", "line", F.lit(None).cast("string").alias("record_id"), "text")
