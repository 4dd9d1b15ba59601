"""Spark session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = 200_000


def build_session(app: str = "spanmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew-join splitting)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a private one only in local mode, where driver and tasks are one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanmill-ckpt-"))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the queries that run inside."""
    was = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that outlive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str = "landed") -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, by: str = "", parts: int = 0) -> DataFrame:
    """Write a columnar table into the shared folder and read it back (pruning and statistics intact).

    Spark estimates a landed table by its compressed bytes and the share of the columns read, so millions of rows can look small enough
    for a broadcast, which the driver has to hold. A table of more than ``BROADCAST_ROWS`` rows (counted from the file footers) is therefore marked
    for merge joins; an explicit ``broadcast`` of the other side still holds. zstd takes about two thirds of snappy's space.

    With ``parts`` the table is bucketed by the column ``by``, for which ``df`` should be hash-partitioned into as many parts: joins, windows and groups by it then need
    no shuffle, nor does a ``repartition`` into as many parts (which alone does not make Spark read by buckets: see ``forest.by_run``). Its name leaves the catalog at
    once; the files and the frame stay.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    out = df.write.option("compression", "zstd")
    if parts > 1:
        name = f"spanmill_{uuid.uuid4().hex}"
        out.format("parquet").option("path", path).bucketBy(parts, by).saveAsTable(name)
        back = spark.table(name)
        spark.sql(f"drop table {name}")
    else:
        out.parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
    return back.hint("merge") if back.count() > BROADCAST_ROWS else back
