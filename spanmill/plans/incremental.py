"""Loads that read only what changed: a ledger of files, the runs of every unit, finished rows by run.

A unit is what a reader must see as a whole (a transcript with its agents' files). A refresh lists the folder, compares (file, size,
modification) with the ledger, reads the units that differ, together with units that hold copies of the same runs, and rebuilds
these runs; all other runs keep their rows. Every refresh writes its rows into folders of its own number and the ledger last, so an
interrupted one leaves nothing that is read, and the next one takes its number again. Nothing written is changed: a row
counts while no later refresh has dealt with its unit or run.

A unit whose files are gone takes its rows along. With ``window`` only units changed in that time are looked at, and none is taken as gone.
An empty folder, a refresh without changes and files without a usable session give empty tables. Another rate card,
other thresholds or rules need a new store: kept runs are not priced again. One refresh at a time may write to a store.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Thresholds
from ..schema import RAW_SPAN_DDL, RUN_DDL, WARNING_DDL
from ..session import land
from ..skew import bounded
from ..sources.common import Loaded, list_files, since
from . import load

LEDGER = "unit string, file string, path string, bytes bigint, modified timestamp"


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: its number (None: nothing had changed), the changed units and files read, the rebuilt runs."""
    number: int | None
    units: DataFrame
    files: DataFrame
    runs: DataFrame | None


class Store:
    """Tables of a folder of logs under ``path``, kept up to date by ``refresh``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _committed(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/batch=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _write(self, name: str, number: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def _read(self, name: str) -> DataFrame | None:
        """All committed rows of a table with their refresh; folders of interrupted ones are not opened."""
        done = self._committed()
        if not done:
            return None
        parts = [f"{self.path}/{name}/batch={n}" for n in done]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*parts)

    def _latest(self, df: DataFrame, key: str, dealt: DataFrame) -> DataFrame:
        """Rows no later refresh has replaced; only keys dealt with more than once are joined."""
        again = dealt.groupBy(key).agg(F.max("batch").alias("newest"), F.count("*").alias("n")).filter("n > 1").drop("n")
        j = df.join(bounded(again), key, "left")
        return j.filter("newest is null or batch = newest").drop("newest", "batch").select(*[c for c in df.columns if c != "batch"])

    def ledger(self) -> DataFrame:
        """(unit, file, path, bytes, modified) as of the last refresh."""
        rows = self._read("ledger")
        if rows is None:
            return self.spark.createDataFrame([], LEDGER)
        return self._latest(rows, "unit", rows.select("unit", "batch").distinct()).filter("file is not null")

    def table(self, name: str) -> DataFrame:
        """``runs``, ``spans``, ``findings``, ``wasted``, ``rejects``, ``repairs`` (warnings of the tree), or the readers' ``warnings``."""
        by_unit = name in ("warnings", "members")
        rows = self._read(name)
        if rows is None:
            raise ValueError(f"no refresh has been written to {self.path}")
        dealt = self._read("ledger").select("unit", "batch").distinct() if by_unit else self._read("touched")
        return self._latest(rows, "unit" if by_unit else "run_id", dealt)

    def changes(self, now: DataFrame, gone_too: bool = True) -> DataFrame:
        """(unit): units with a new, changed or, if asked, missing file; ``now`` is the listing with units."""
        old = self.ledger().select("file", F.col("unit").alias("o_unit"), F.col("bytes").alias("o_bytes"), F.col("modified").alias("o_modified"))
        j = now.join(old, "file", "full" if gone_too else "left")
        same = F.col("bytes").eqNullSafe(F.col("o_bytes")) & F.col("modified").eqNullSafe(F.col("o_modified"))
        out = j.filter(~same).select(F.coalesce("unit", "o_unit").alias("unit"))
        if not gone_too:
            # a file that left a unit that is looked at changes that unit as well
            out = out.unionByName(old.join(now.select("unit").distinct(), F.col("o_unit") == F.col("unit"), "left_semi").join(now, "file", "left_anti")
                                  .select(F.col("o_unit").alias("unit")))
        return out.distinct()

    def refresh(self, source, path: str, pricing: DataFrame, thresholds: Thresholds | None = None, window: str | None = None, now_ms: int | None = None,
                rule_list=None, **options) -> Refresh:
        """Bring the tables up to date with the folder ``path``; ``window`` (``7d``) and ``now_ms`` limit it to units changed lately.

        ``rule_list`` replaces the rules. ``source`` is a reader with ``listing`` (glob), ``unit`` (file -> unit) and ``read(spark, path, files=..., **options)``.
        """
        done = self._committed()
        number = done[-1] + 1 if done else 0
        there = land(list_files(self.spark, path, options.pop("listing", source.listing)).withColumn("unit", source.unit(F.col("file"))))
        now = there
        if window is not None:
            if now_ms is None:
                raise ValueError("a window needs the instant it ends at (now_ms)")
            lately = since(there.groupBy("unit").agg(F.max("modified").alias("modified")), window, now_ms)
            now = there.join(lately.select("unit"), "unit", "left_semi")
        units = land(self.changes(now, window is None))
        if units.isEmpty():
            return Refresh(None, units, there.limit(0), None)
        members = self.table("members") if done else self.spark.createDataFrame([], "unit string, run_id string")
        while True:
            files = land(there.join(units, "unit", "left_semi"))
            if files.isEmpty():
                data = Loaded(*(self.spark.createDataFrame([], ddl) for ddl in (RUN_DDL, RAW_SPAN_DDL, WARNING_DDL)))
            else:
                data = source.read(self.spark, path, files=files.select("path", "file"), **options)
            fresh = land(data.runs.withColumn("unit", source.unit(F.get("files", F.lit(0)))))
            touched = land(fresh.select("run_id").union(members.join(units, "unit", "left_semi").select("run_id")).distinct())
            # unchanged units with a copy of a touched run: the copies have to be seen together
            copies = land(members.join(touched, "run_id", "left_semi").join(units, "unit", "left_anti").select("unit").distinct())
            if copies.isEmpty():
                break
            units = land(units.union(copies))
        t = load.build(self.spark, Loaded(fresh.drop("unit"), data.spans, data.warnings.limit(0)), pricing, thresholds, rule_list=rule_list)
        out = {"runs": t.trace.runs, "spans": t.trace.spans, "findings": t.findings, "wasted": t.wasted, "rejects": t.rejects, "repairs": t.warnings,
               "warnings": data.warnings.withColumn("unit", source.unit(F.col("file"))), "members": fresh.select("unit", "run_id").distinct(), "touched": touched}
        for name, df in out.items():
            self._write(name, number, df)
        # last of all; a unit that is gone keeps one row without a file
        self._write("ledger", number, units.join(files, "unit", "left").select("unit", "file", "path", "bytes", "modified"))
        return Refresh(number, units, files, touched)
