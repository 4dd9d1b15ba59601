"""Live view: the batch operators' answers kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.money import nz, total_tokens
from ..schema import RAW_SPAN_DDL
from ..session import ensure_checkpoint_dir
from .tail import tail

WATERMARK = "24 hours"


def live_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Records of a log folder that receives finished chunk files, with file, id and event time."""
    t = (spark.readStream.format("text").option("maxFilesPerTrigger", str(max_files)).option("recursiveFileLookup", "true").load(path)
         .select(F.col("_metadata.file_path").alias("file"), "value"))
    return _records(t)


def tailed_records(spark: SparkSession, path: str, ledger: str, **options) -> DataFrame:
    """Records of log files that are still written, each line once; ``position`` is the line's first byte."""
    return _records(tail(spark, path, ledger, **options))


def _records(lines: DataFrame) -> DataFrame:
    t = lines.withColumn("v", F.try_parse_json("value")).drop("value")
    return t.filter("v is not null").select(
        *[c for c in t.columns if c != "v"], F.try_variant_get("v", "$.uuid", "string").alias("uuid"), F.try_variant_get("v", "$.type", "string").alias("type"),
        F.try_variant_get("v", "$.sessionId", "string").alias("session_id"),
        F.try_to_timestamp(F.try_variant_get("v", "$.timestamp", "string")).alias("event_ts"), "v")


def live_spans(spark: SparkSession, path: str, ddl: str = RAW_SPAN_DDL, max_files: int = 1000) -> DataFrame:
    """Stream of landed span chunks (Parquet) with an event time column."""
    d = spark.readStream.schema(ddl).option("maxFilesPerTrigger", str(max_files)).parquet(path)
    return d.withColumn("event_ts", F.timestamp_millis("start_ms"))


def dedupe_stream(records: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """First copy of a record id within the watermark."""
    return records.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(keys)


def pair_stream(calls: DataFrame, results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tool call and result, left outer with a time bound; a call without a result comes out as in_progress.

    ``calls(transcript, tool_use_id, call_ts, ...)``, ``results(r_transcript, r_tool_use_id, result_ts, r_status)``.
    """
    c, r = calls.withWatermark("call_ts", delay), results.withWatermark("result_ts", delay)
    cond = F.expr(f"transcript = r_transcript and tool_use_id = r_tool_use_id and result_ts >= call_ts "
                  f"and result_ts <= call_ts + interval {delay}")
    return c.join(r, cond, "left_outer").select(*calls.columns, "result_ts", F.coalesce("r_status", F.lit("in_progress")).alias("status"))


def _totals() -> list[Column]:
    call = (F.col("kind") == "llm_call") & F.col("model").isNotNull()
    tool = F.col("kind").isin("tool_call", "mcp_call")
    return [nz(F.sum(F.when(call, F.col("cost_micro")))).alias("cost_micro"), nz(F.sum(F.when(call, total_tokens()))).alias("tok_total"),
            F.count(F.when(call, 1)).alias("llm_calls"), F.count(F.when(tool, 1)).alias("tool_calls"),
            F.count(F.when(tool & (F.col("status") == "error"), 1)).alias("tool_errors"), F.max("start_ms").alias("last_ms")]


def live_run_totals(spans: DataFrame) -> DataFrame:
    """Running totals per run (update mode); state holds every run ever seen, so for bounded replays."""
    return spans.groupBy("run_id").agg(*_totals())


def live_burst_totals(spans: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Totals per run and burst of activity (append mode): a burst comes out once, when the watermark is past its gap, and its state ends there.

    The totals of a run are the sums over its bursts; rows later than the watermark are left out.
    """
    w = F.session_window("event_ts", gap).alias("w")
    return (spans.withWatermark("event_ts", watermark).groupBy("run_id", w).agg(*_totals())
            .select("run_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "cost_micro", "tok_total", "llm_calls", "tool_calls", "tool_errors", "last_ms"))


def spend_windows(spans: DataFrame, length: str = "1 day", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Spend per tumbling or sliding event-time window."""
    w = F.window("event_ts", length, slide) if slide else F.window("event_ts", length)
    return (spans.withWatermark("event_ts", watermark).filter("kind = 'llm_call'").groupBy(w.alias("w"))
            .agg(nz(F.sum("cost_micro")).alias("cost_micro"), F.count("*").alias("llm_calls"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cost_micro", "llm_calls"))


def session_activity(spans: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Bursts of activity per run; a gap closes one."""
    return (spans.withWatermark("event_ts", watermark).groupBy("run_id", F.session_window("event_ts", gap).alias("w"))
            .agg(F.count("*").alias("spans"), nz(F.sum("cost_micro")).alias("cost_micro"))
            .select("run_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "spans", "cost_micro"))


ALERT_SCHEMA = "run_id string, scope_id string, alert string, span_id string, at_ms bigint, detail string"


def alert_processor(min_failures: int = 3, max_gap: int = 3, min_prefix: int = 20_000, collapse: float = 0.2, rewrite: int = 10_000,
                    idle_ms: int = 300_000, slack_ms: int = 0, forget_ms: int = 7 * 86_400_000):
    """State per (run, scope): open failure clusters, the tool counter and the last call per model.

    Rows wait in state until the watermark passes them, then are handled in (start, id) order, so late
    rows within the watermark change nothing. State grows with open clusters and models, not with rows.
    A scope without rows for ``forget_ms`` of event time loses all its state: clusters and pauses longer than that raise no alert.
    """
    if forget_ms <= slack_ms:
        raise ValueError("forget_ms must be larger than slack_ms: rows would be forgotten while they wait")

    class Alerts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.wait = handle.getMapState("wait", "at bigint, span_id string", "row string")
            self.open = handle.getMapState("open", "name string, target string", "n int, seq bigint")
            self.last = handle.getMapState("last", "model string", "span_id string, end_ms bigint, rd bigint, wr bigint, one_h boolean")
            self.seq = handle.getValueState("seq", "n bigint")
            self.seen = handle.getValueState("seen", "newest bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            import json
            latest = None
            for pdf in rows:
                for r in pdf.to_dict("records"):
                    at = int(r["start_ms"])
                    latest = at if latest is None else max(latest, at)
                    keep = {k: (None if pd.isna(v) else (v.item() if hasattr(v, "item") else v)) for k, v in r.items() if k != "event_ts"}
                    self.wait.updateValue((at, r["span_id"]), (json.dumps(keep),))
            if latest is not None:
                self.handle.registerTimer(latest + slack_ms + 1)
                old = self.seen.get()[0] if self.seen.exists() else None
                if old is None or latest > old:
                    # one timer a scope says when it is forgotten; it moves with the newest row
                    if old is not None:
                        self.handle.deleteTimer(old + forget_ms)
                    self.handle.registerTimer(latest + forget_ms)
                    self.seen.update((latest,))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            import json
            done = expiredTimerInfo.getExpiryTimeInMs() - slack_ms
            ready = sorted(k for k in self.wait.keys() if k[0] < done)
            out = []
            for k in ready:
                r = json.loads(self.wait.getValue(k)[0])
                self.wait.removeKey(k)
                out += self.step(key, r)
            if self.seen.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.seen.get()[0] + forget_ms:
                for state in (self.wait, self.open, self.last, self.seq, self.seen):
                    state.clear()
            if out:
                yield pd.DataFrame(out, columns=["run_id", "scope_id", "alert", "span_id", "at_ms", "detail"])

        def step(self, key, r: dict) -> list:
            alerts = []
            if r["kind"] in ("tool_call", "mcp_call"):
                n = (self.seq.get()[0] if self.seq.exists() else 0) + 1
                self.seq.update((n,))
                who = (r["name"], r.get("target_key") or "")
                state = self.open.getValue(who) if self.open.containsKey(who) else None
                if r["status"] != "error":
                    if state:
                        self.open.removeKey(who)
                else:
                    fails = state[0] + 1 if state and n - state[1] - 1 <= max_gap else 1
                    self.open.updateValue(who, (fails, n))
                    if fails == min_failures:
                        alerts.append((*key, "retry-loop", r["span_id"], r["start_ms"], f"{who[0]} failed {fails} times"))
            elif r["kind"] == "llm_call" and r.get("model"):
                rd, wr = int(r.get("tok_cache_read") or 0), int(r.get("tok_cache_write") or 0)
                prev = self.last.getValue((r["model"],)) if self.last.containsKey((r["model"],)) else None
                if prev is not None:
                    ttl = max(idle_ms, 3_600_000) if prev[4] else idle_ms
                    idle = r["start_ms"] - prev[1] >= ttl and wr >= rewrite
                    if idle and min(wr, prev[2] + prev[3]) > 0:
                        alerts.append((*key, "idle-cache-expiry", r["span_id"], r["start_ms"], prev[0]))
                    elif not idle and prev[2] >= min_prefix and rd <= collapse * prev[2] and wr >= rewrite:
                        alerts.append((*key, "cache-prefix-break", r["span_id"], r["start_ms"], prev[0]))
                one_h = int(r.get("cache_write_1h") or 0) * 2 >= wr if wr > 0 else bool(prev and prev[4])
                end = int(r["end_ms"]) if r.get("end_ms") is not None else int(r["start_ms"])
                self.last.updateValue((r["model"],), (r["span_id"], end, rd, wr, one_h))
            return alerts

        def close(self) -> None:
            pass

    return Alerts()


def live_alerts(spans: DataFrame, watermark: str = "10 minutes", **limits) -> DataFrame:
    """Retry loops and cache breaks as they happen, per (run, scope)."""
    cols = ["run_id", "scope_id", "span_id", "kind", "name", "status", "start_ms", "end_ms", "model", "target_key", "tok_cache_read", "tok_cache_write",
            "cache_write_1h", "event_ts"]
    return (spans.filter("kind in ('llm_call', 'tool_call', 'mcp_call')").select(*cols).withWatermark("event_ts", watermark).groupBy("run_id", "scope_id")
            .transformWithStateInPandas(alert_processor(**limits), ALERT_SCHEMA, "append", "EventTime"))


def budget_gate(windows: DataFrame, budget_micro: int, out_path: str, on_over: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write windows above the budget per micro-batch; a replayed batch overwrites its own folder."""
    spark = windows.sparkSession
    ensure_checkpoint_dir(spark)

    def gate(batch: DataFrame, batch_id: int) -> None:
        over = batch.filter(F.col("cost_micro") > budget_micro).withColumn("budget_micro", F.lit(budget_micro))
        over.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        if on_over is not None and not over.isEmpty():
            on_over(batch_id)

    return windows.writeStream.outputMode("update").foreachBatch(gate).option("checkpointLocation", out_path + "_checkpoint").start()
