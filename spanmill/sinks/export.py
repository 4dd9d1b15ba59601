"""Sinks: run documents, CSV reports and the silver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import usd
from ..functions.text import local_day
from ..operators.privacy import assert_no_paths
from ..skew import lookup

# Column order of the sessions report (later additions are appended).
SESSION_COLUMNS = ["runId", "startedAt", "endedAt", "project", "source", "title", "models", "durationMs", "tokensInput", "tokensOutput", "tokensCacheRead",
                   "tokensCacheWrite", "tokensTotal", "costUSD", "wastedUSD", "llmCalls", "toolCalls", "toolErrors", "subagents", "insightCount", "gitBranch"]


def iso(ms: str | Column) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _cell(c: Column) -> Column:
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def _num(micro: str) -> Column:
    """Shortest plain decimal of micro-dollars."""
    size = F.abs(F.col(micro))
    d = F.format_string("%s%d.%06d", F.when(F.col(micro) < 0, "-").otherwise(""), F.call_function("div", size, F.lit(1_000_000)), F.pmod(size, F.lit(1_000_000)))
    return F.regexp_replace(F.regexp_replace(d, "0+$", ""), r"\.$", "")


def _checked(private: DataFrame | None, *frames: DataFrame) -> None:
    """Before anything is written: with ``private`` names (``Tables.private``), no path and none of these names may be in the texts.

    Names are also looked for as JSON and CSV spell them.
    """
    if private is not None:
        spelt = F.to_json(F.struct("name"))
        forms = F.array(F.col("name"), F.substring(spelt, F.lit(10), F.char_length(spelt) - 11), F.replace("name", F.lit('"'), F.lit('""')))
        assert_no_paths(*frames, basenames=private.select(F.explode(forms).alias("name")))


def _write_lines(lines: DataFrame, header: list[str] | Column, order: list[str], path: str) -> None:
    """CRLF text in global order; byte-order mark and header open the first part file."""
    spark = lines.sparkSession
    head = spark.range(1).select(F.lit(0).alias("_s"), *[F.lit(None).cast(lines.schema[o].dataType).alias(o) for o in order],
                                 F.concat(F.lit("﻿"), F.lit(",".join(header))).alias("line"))
    body = lines.select(F.lit(1).alias("_s"), *order, "line")
    out = head.unionByName(body).orderBy("_s", *order).select("line")
    out.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def sessions_csv(facts: DataFrame, findings: DataFrame, path: str, private: DataFrame | None = None) -> None:
    """One line per run in start order; RFC 4180 quoting."""
    n = findings.groupBy("run_id").agg(F.count("*").alias("n"))
    f = facts.join(n, "run_id", "left")
    models = F.array_join(F.array_sort(F.map_keys("by_model")), ";")
    cells = [F.col("run_id"), iso("start_ms"), iso("end_ms"), F.col("project_name"), F.col("source"), F.col("title"), models, F.col("duration_ms"), F.col("tok_input"),
             F.col("tok_output"), F.col("tok_cache_read"), F.col("tok_cache_write"), F.col("tok_total"), _num("cost_micro"), _num("wasted_micro"), F.col("llm_calls"),
             F.col("tool_calls"), F.col("tool_errors"), F.col("subagents"), F.coalesce("n", F.lit(0)), F.col("git_branch")]
    lines = f.select("start_ms", "run_id", F.concat_ws(",", *[_cell(c) for c in cells]).alias("line"))
    _checked(private, lines.select("line"))
    _write_lines(lines, SESSION_COLUMNS, ["start_ms", "run_id"], path)


def day_model_costs(facts: DataFrame, tz: str = "UTC") -> DataFrame:
    """Day and model, one row each: the long form of the pivot, for vocabularies too wide for columns."""
    by = facts.select(local_day("start_ms", tz).alias("day"), F.explode("by_model").alias("model", "micro"))
    return by.groupBy("day", "model").agg(F.sum("micro").alias("cost_micro"))


def day_model_pivot(facts: DataFrame, tz: str = "UTC") -> DataFrame:
    """Day x model cost table over all days; model columns in name order."""
    d = facts.withColumn("day", local_day("start_ms", tz))
    base = d.groupBy("day").agg(F.sum("cost_micro").alias("cost_micro"), F.sum("wasted_micro").alias("wasted_micro"), F.count("*").alias("runs"))
    by = d.select("day", F.explode("by_model").alias("model", "micro")).groupBy("day", "model").agg(F.sum("micro").alias("micro"))
    names = [r["model"] for r in by.select("model").distinct().orderBy("model").collect()]  # model names: a vocabulary, all of it
    wide = by.groupBy("day").pivot("model", names).agg(F.sum("micro")).fillna(0) if names else by.select("day").distinct()
    return base.join(wide, "day", "left").fillna(0)


def day_aggregates_csv(facts: DataFrame, path: str, tz: str = "UTC", private: DataFrame | None = None) -> None:
    w = day_model_pivot(facts, tz)
    _checked(private, facts.select(F.map_keys("by_model").alias("models")))
    models = w.columns[4:]
    safe = w.toDF(*w.columns[:4], *[f"m{i}" for i in range(len(models))])
    cells = [F.col("day"), _num("cost_micro"), _num("wasted_micro"), F.col("runs"), *[_num(f"m{i}") for i in range(len(models))]]
    quoted = ['"' + m.replace('"', '""') + '"' if any(c in m for c in '",\r\n') else m for m in models]
    _write_lines(safe.select("day", F.concat_ws(",", *[_cell(c) for c in cells]).alias("line")), ["day", "costUSD", "wastedUSD", "runs", *quoted], ["day"], path)


def span_json() -> Column:
    """Span struct in the field names of the run document; absent fields are left out by ``to_json``."""
    call, tool = F.col("model").isNotNull(), F.col("kind").isin("tool_call", "mcp_call")
    llm = F.when(call, F.struct(F.col("provider"), F.col("model"), F.struct(
        F.col("tok_input").alias("input"), F.col("tok_output").alias("output"), F.col("tok_cache_read").alias("cacheRead"), F.col("tok_cache_write").alias("cacheWrite"),
        F.col("tok_reasoning").alias("reasoning")).alias("tokens"), usd("cost_micro").alias("costUSD"), F.col("cost_source").alias("costSource"), F.col("stop_reason").alias("stopReason")))
    tl = F.when(tool, F.struct(F.col("tool_name").alias("name"), F.col("mcp_server").alias("mcpServer"), (F.col("status") == "error").alias("isError"), F.col("exit_code").alias("exitCode"),
                               F.col("output_bytes").alias("outputBytes"), F.col("lines_added").alias("linesAdded"), F.col("lines_removed").alias("linesRemoved")))
    agent = F.when(F.col("agent_name").isNotNull() | F.col("agent_session").isNotNull(), F.struct(F.col("agent_name").alias("name"), F.col("agent_session").alias("sessionId")))
    content = F.when(F.coalesce("prompt_preview", "output_preview", "delegation_reason").isNotNull(), F.struct(
        F.col("prompt_preview").alias("promptPreview"), F.col("output_preview").alias("outputPreview"), F.col("delegation_reason").alias("delegationReason")))
    return F.struct(F.col("span_id").alias("id"), F.col("parent_id").alias("parentId"), F.col("kind"), F.col("name"), F.col("status"), F.col("status_reason").alias("statusReason"),
                    iso("start_ms").alias("startedAt"), iso("end_ms").alias("endedAt"), F.col("duration_ms").alias("durationMs"), F.col("depth"), llm.alias("llm"), tl.alias("tool"),
                    agent.alias("agent"), content.alias("content"), F.col("attributes"),
                    F.struct(F.col("prov_file").alias("file"), F.col("prov_line").alias("line"), F.col("prov_record").alias("recordId")).alias("provenance"))


def write_trace_json(runs: DataFrame, spans: DataFrame, findings: DataFrame | None, path: str, private: DataFrame | None = None) -> None:
    """Runs as JSON lines, one shape for all sizes: ``runs`` (headers), ``spans`` and ``findings`` (a line each, with the run id).

    No row holds a whole session; ``read_run_lines`` and ``read_finding_lines`` read the folder back.
    """
    doc = F.struct(F.col("run_id").alias("id"), F.struct(F.col("source").alias("tool"), "format", "files").alias("source"), "title",
                   F.struct(F.col("project_name").alias("name"), F.col("project_path").alias("path"), F.col("git_branch").alias("gitBranch")).alias("project"),
                   iso("start_ms").alias("startedAt"), iso("end_ms").alias("endedAt"), F.col("duration_ms").alias("durationMs"))
    out = {"runs": runs.select(F.to_json(doc).alias("value")), "spans": spans.select(F.to_json(F.struct("run_id", span_json().alias("span"))).alias("value"))}
    if findings is not None:
        f = F.struct("run_id", F.struct(F.col("finding_id").alias("id"), F.col("rule").alias("ruleId"), "severity", F.col("evidence").alias("spanIds"),
                                        usd("waste_micro").alias("estimatedWasteUSD")).alias("insight"))
        out["findings"] = findings.select(F.to_json(f).alias("value"))
    _checked(private, *out.values())
    for name, lines in out.items():
        lines.write.mode("overwrite").text(f"{path}/{name}")


def write_tables(path: str, runs: DataFrame, spans: DataFrame, private: DataFrame | None = None, **more: DataFrame) -> None:
    """Silver tables as Parquet: ``spans`` and ``runs`` by source and start day, spans sorted by run.

    Rows of a (source, day) folder are spread over tasks by run and chunk, so a hot session fills
    several files instead of one task.
    """
    _checked(private, runs, spans, *more.values())
    day = F.to_date(F.timestamp_millis("start_ms")).alias("start_day")
    head = runs.select("*", day)
    at = head.select("run_id", "source", "start_day")
    if spans.filter("chunk > 0").isEmpty():  # no hot run: the join itself leaves the rows by run, in tasks by their number
        s = lookup(spans, at, ["run_id"], "inner", rows=spans.count())
    else:
        s = spans.join(at, "run_id").repartition("source", "start_day", "run_id", "chunk")
    s = s.sortWithinPartitions("source", "start_day", "run_id", "span_seq")
    s.write.mode("overwrite").partitionBy("source", "start_day").parquet(path + "/spans")
    head.write.mode("overwrite").partitionBy("source", "start_day").parquet(path + "/runs")
    for name, df in more.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def bucket_spans(spans: DataFrame, table: str, buckets: int = 512) -> None:
    """Catalog table bucketed by run: per-run joins and aggregations read it without a shuffle."""
    spans.write.mode("overwrite").bucketBy(buckets, "run_id").sortBy("run_id", "span_seq").saveAsTable(table)

