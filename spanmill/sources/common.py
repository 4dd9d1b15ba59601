"""Shared pieces of the readers: line numbers, warnings, source listing, quarantine."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RAW_SPAN_DDL, RUN_DDL, WARNING_DDL, conform
from ..session import land

PREVIEW = 200
LISTED = 100_000


@dataclass(frozen=True)
class Loaded:
    """What every source returns: run headers, raw spans and diagnostics."""
    runs: DataFrame
    spans: DataFrame
    warnings: DataFrame


class Source(Protocol):
    """Reader contract; the order of a registry list is the priority of its sources."""

    name: str

    def read(self, spark: SparkSession, path: str, **options) -> Loaded: ...


def loaded(runs: DataFrame, spans: DataFrame, warnings: DataFrame) -> Loaded:
    return Loaded(conform(runs, RUN_DDL), conform(spans, RAW_SPAN_DDL), conform(warnings, WARNING_DDL))


def listed(files: DataFrame | None) -> list[str] | None:
    """Paths of chosen files for a reader, which keeps the names of its files on the driver anyway; None beyond ``LISTED`` names."""
    if files is None:
        return None
    names = [r["path"] for r in files.select("path").limit(LISTED + 1).collect()]
    return names if len(names) <= LISTED else None


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", modified_after: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """(file, line, value) with exact 1-based line numbers, without reading a file in one task.

    ``files(path, file)`` chooses files of the folder: up to ``LISTED`` are opened by name, more are kept by a join with the scan.

    Rows of a file split are consecutive in their scan task, so a line is its running row id minus the split's first one,
    plus the line counts of the splits before it: one small row per split. The text is scanned once and landed with its split and
    row id; counts and lines both come from the landed rows, so they agree however the session cuts files later.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    names = listed(files)
    t = r.text(path if names is None else names).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                                        F.monotonically_increasing_id().alias("mid"), "value")
    if files is not None and names is None:
        t = t.join(files.select("file"), "file", "left_semi")
    t = land(t)
    per = t.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    t = t.join(land(per.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("off"))), ["file", "block"])
    line = (F.col("mid") + F.col("off")).cast("bigint")
    return t.select("file", line.alias("line"), F.when(line == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, file, bytes, modified): the files of a folder; ``file`` is spelt as readers report it, contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
            .select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))


def list_sources(spark: SparkSession, path: str, glob: str, unit: Column) -> DataFrame:
    """Candidates: files, newest modification and total size per unit (a column over ``path``)."""
    return list_files(spark, path, glob).groupBy(unit.alias("candidate")).agg(
        F.array_sort(F.collect_list("path")).alias("files"), F.max("modified").alias("modified"),
        F.sum("bytes").alias("bytes"))


def since(files: DataFrame, window: str, now_ms: int) -> DataFrame:
    """Candidates changed within ``7d`` / ``24h`` / ``30m`` before the given instant; another form is an error."""
    if not re.fullmatch(r"\d+[dhm]", window.strip()):
        raise ValueError(f"invalid window {window!r}: a number and d, h or m, such as 7d, 24h or 30m")
    window = window.strip()
    unit = {"d": 86_400_000, "h": 3_600_000, "m": 60_000}[window[-1]]
    return files.filter(F.unix_millis("modified") >= now_ms - int(window[:-1]) * unit)


def quarantine(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with a usable start, and the rejected ones with a reason."""
    ok = F.col("start_ms") >= 86_400_000
    bad = runs.filter(~F.coalesce(ok, F.lit(False))).select("run_id", F.lit("run has no usable start time").alias("reason"), "files")
    return runs.filter(ok), bad


def winning_spans(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """The spans of the copy whose header was kept, each span id once.

    ``load`` (the input a row came from) is compared where both sides have it. Two copies inside one input differ in their
    files: spans from a file of the kept header come first, then by file and line.
    """
    on = ["run_id", *({"load"} & {*spans.columns} & {*runs.columns})]
    j = spans.join(runs.select(*on, F.col("files").alias("own_files")), on)
    other = ~F.coalesce(F.array_contains("own_files", F.col("prov_file")), F.lit(False))
    w = Window.partitionBy("run_id", "span_id").orderBy(other, "prov_file", "prov_line", F.xxhash64(*spans.columns[:20]))
    return j.withColumn("copy", F.row_number().over(w)).filter("copy = 1").drop("copy", "own_files", "load")


def collapse_run_ids(runs: DataFrame) -> DataFrame:
    """One header per run id: newest start, then files (row_number = 1 is limited before the shuffle)."""
    w = Window.partitionBy("run_id").orderBy(F.desc("start_ms"), F.col("files").cast("string"))
    return runs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def iso_ms(x: Column | str) -> Column:
    return F.unix_millis(F.try_to_timestamp(x if isinstance(x, Column) else F.col(x)))


def span_between(start: Column, end: Column) -> Column:
    return F.when(end.isNotNull(), F.greatest(F.lit(0).cast("bigint"), end - start))


def vget(v: str | Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, typ)


def vstr(v: str | Column, path: str) -> Column:
    """A string field; null when the value has another JSON type."""
    c = F.col(v) if isinstance(v, str) else v
    sub = F.try_variant_get(c, path, "variant")
    return F.when(F.schema_of_variant(sub) == "STRING", F.try_variant_get(c, path, "string"))


def vint(v: str | Column, path: str) -> Column:
    """Non-negative rounded number, 0 when absent or not a number."""
    n = vget(v, path, "double")
    sub = F.schema_of_variant(vget(v, path, "variant"))
    return F.when(n.isNotNull() & (sub != "STRING"), F.greatest(F.lit(0), F.floor(n + 0.5)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def line_count(s: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", 0).otherwise(F.size(F.split(s, "\n")))


def text_of(content: Column) -> Column:
    """A string, or the text of the first text block of an array."""
    arr = F.try_variant_get(content, "$", "array<variant>")
    first = F.try_element_at(F.filter(arr, lambda b: (vstr(b, "$.type") == "text") & vstr(b, "$.text").isNotNull()), F.lit(1))
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(vstr(first, "$.text"))


def byte_length(content: Column) -> Column:
    arr = F.try_variant_get(content, "$", "array<variant>")
    total = F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(F.octet_length(vstr(b, "$.text")), F.lit(0)))
    return F.when(F.schema_of_variant(content) == "STRING",
                  F.octet_length(F.try_variant_get(content, "$", "string")).cast("bigint")).otherwise(total)
