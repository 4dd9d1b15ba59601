"""Drill-through to log records and inflated copies for load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1_048_576


def raw_records_for(evidence: DataFrame, spans: DataFrame, records: DataFrame) -> DataFrame:
    """The log record behind each evidence span: by (file, line), else by record id.

    ``records(file, line, record_id, text)``. Status: ok, redacted (text was dropped at load), unsupported
    (no position kept) or unavailable (the log is gone).
    """
    s = evidence.join(spans.select("run_id", "span_id", "prov_file", "prov_line", "prov_record", "content_redacted"), ["run_id", "span_id"])
    r = records.select(F.col("file").alias("prov_file"), F.col("line").alias("r_line"), F.col("record_id").alias("r_id"), "text")
    by_line = s.filter("prov_line is not null").join(r.withColumnRenamed("r_line", "prov_line").drop("r_id"), ["prov_file", "prov_line"], "left")
    by_id = s.filter("prov_line is null and prov_record is not null").join(r.withColumnRenamed("r_id", "prov_record").drop("r_line"), ["prov_file", "prov_record"], "left")
    none = s.filter("prov_line is null and prov_record is null").withColumn("text", F.lit(None).cast("string"))
    j = by_line.unionByName(by_id).unionByName(none)
    kept = F.coalesce("content_redacted", F.lit(False))
    status = (F.when(kept, "redacted").when(F.col("prov_line").isNull() & F.col("prov_record").isNull(), "unsupported")
              .when(F.col("text").isNull(), "unavailable").otherwise("ok"))
    return j.select("run_id", "finding_id", "span_id", "pos", status.alias("record_status"),
                    F.when(~kept, F.left("text", F.lit(MAX_CHARS))).alias("record"), (~kept & (F.length("text") > MAX_CHARS)).alias("truncated"))


def scale_up(spans: DataFrame, n: int, one_session: bool = True) -> DataFrame:
    """``n`` copies with remapped ids and shifted time; one long session per run, or ``n`` runs each."""
    gap = spans.groupBy("run_id").agg((F.max(F.coalesce("end_ms", "start_ms")) - F.min("start_ms") + 60_000).alias("gap"))
    c = spans.join(gap, "run_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    root = F.col("kind") == "session"

    def remap(x: str, keep: Column) -> Column:
        return F.when((F.col("copy") == 0) | F.col(x).isNull() | keep, F.col(x)).otherwise(F.sha1(F.concat_ws(":", x, F.col("copy").cast("string"))))

    if one_session:
        roots = spans.filter("kind = 'session'").select("run_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("p_root"))
        c = c.join(roots, ["run_id", "parent_id"], "left").filter(~root | (F.col("copy") == 0))
        keep_p, keep_s, run = F.coalesce("p_root", F.lit(False)), root, F.col("run_id")
    else:
        keep_p = keep_s = F.lit(False)
        run = F.when(F.col("copy") == 0, F.col("run_id")).otherwise(F.concat_ws("_", "run_id", F.col("copy").cast("string")))
    shift = F.col("copy") * F.col("gap")
    return c.withColumns({"span_id": remap("span_id", keep_s), "parent_id": remap("parent_id", keep_p), "new_run": run, "start_ms": F.col("start_ms") + shift,
                          "end_ms": F.col("end_ms") + shift}).withColumn("run_id", F.col("new_run")).select(*spans.columns)
