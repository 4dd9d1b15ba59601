from __future__ import annotations

import csv
import glob
import io

import fixtures as X
import pytest
from pyspark.sql import functions as F

from spanmill.operators import overview, privacy, rules, wording
from spanmill.operators.tree import place
from spanmill.plans import load, views
from spanmill.sinks import export
from spanmill.sources import drill
from spanmill.sources.session_jsonl import read_records
from spanmill.sources.trace_json import read_finding_lines, read_run_lines


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    logs, otlp, store = (tmp_path_factory.mktemp(n) for n in ("l", "o", "s"))
    X.transcript(logs), X.otlp(otlp), X.file_store(store)
    inputs = [("claude-code", str(logs), {}), ("opencode", str(store), {}), ("otlp", str(otlp), {})]
    data = load.read_all(spark, inputs)
    return data, load.build(spark, data, views.pricing(spark)), str(logs)


def lines(path):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(path + "/part-*"))).decode("utf-8")


def test_load_order_and_totals(tables):
    _, t, _ = tables
    r = {x["source"]: x for x in t.trace.runs.collect()}
    assert set(r) == {"claude-code", "opencode", "otlp"}
    tot = {x["run_id"]: x for x in t.trace.totals.collect()}
    c = tot[r["claude-code"]["run_id"]]
    assert c["llm_calls"] == 5 and c["tool_calls"] == 8 and c["tool_errors"] == 1 and c["subagents"] == 2
    # three main and two agent calls at the sonnet-4-5 card: in 100, out 20, read 3000, 100 5m and 600 1h written
    assert c["cost_micro"] == 5 * (300 + 300 + 900 + 375 + 3600)
    assert tot[r["otlp"]["run_id"]]["cost_micro"] == 11 * 3 + 3 * 15 + 40 * 0.3 + 133


def test_metadata_profile(spark, tables):
    data, full, _ = tables
    t = load.build(spark, data, views.pricing(spark), profile="metadata-only")
    assert t.profile == "metadata-only" and t.trace.spans.filter("kind not in ('session', 'subagent')").isEmpty()
    privacy.assert_no_paths(t.trace.spans.drop("path"), t.trace.runs, t.warnings)
    a, b = (sorted(tuple(r) for r in x.trace.totals.select("run_id", "cost_micro", "tok_total").collect()) for x in (t, full))
    assert a == b
    assert t.trace.runs.filter("title is not null").isEmpty()
    # findings cite what was kept, and the manifest says what was done
    cited = t.findings.select("run_id", F.explode("evidence").alias("span_id"))
    assert cited.join(t.trace.spans, ["run_id", "span_id"], "left_anti").isEmpty() and t.findings.count() == full.findings.count()
    m = t.manifest.first()
    assert (m["profile"], m["spans_pruned"], m["spans"]) == ("metadata-only", True, t.trace.spans.count())


def test_sessions_csv(spark, sf, tmp_path):
    t = views.event_trace(spark, sf)
    f = overview.run_facts(t.runs.withColumn("title", F.when(F.col("run_id") == "run_1", 'a "b", c').otherwise(F.col("title"))), t.totals)
    export.sessions_csv(f, spark.createDataFrame([], "run_id string"), str(tmp_path / "s"))
    text = lines(str(tmp_path / "s"))
    assert text.startswith("﻿runId,startedAt") and text.endswith("\r\n")
    rows = list(csv.DictReader(io.StringIO(text[1:], newline="")))
    assert len(rows) == f.count() and list(rows[0]) == export.SESSION_COLUMNS
    keys = [(r["startedAt"], r["runId"]) for r in rows]
    assert keys == sorted(keys)
    want = {r["run_id"]: r for r in f.collect()}
    assert all(abs(float(r["costUSD"]) * 1e6 - want[r["runId"]]["cost_micro"]) < 0.01 for r in rows)
    export.day_aggregates_csv(f, str(tmp_path / "d"))
    d = list(csv.DictReader(io.StringIO(lines(str(tmp_path / "d"))[1:], newline="")))
    assert sum(int(r["runs"]) for r in d) == len(rows) and "gpt-5.4-mini" in d[0]


def test_trace_json_round_trip(spark, tables, tmp_path):
    _, t, _ = tables
    export.write_trace_json(t.trace.runs, t.trace.spans, t.findings, str(tmp_path / "j"))
    back = read_run_lines(spark, str(tmp_path / "j"))
    assert sorted(r["run_id"] for r in back.runs.collect()) == sorted(r["run_id"] for r in t.trace.runs.collect())
    cols = ["run_id", "span_id", "parent_id", "kind", "status", "start_ms", "end_ms", "tok_input", "cost_micro", "tool_name", "output_bytes", "prompt_preview"]
    rows = lambda d: sorted(map(repr, d.select(cols).collect()))
    assert rows(back.spans) == rows(t.trace.spans)
    assert spark.read.text(str(tmp_path / "j" / "findings")).count() == t.findings.count()
    cols = ["run_id", "finding_id", "rule", "severity", "evidence", "waste_micro"]
    assert rows(read_finding_lines(spark, str(tmp_path / "j"))) == rows(t.findings)


def test_written_tables_are_pruned(spark, sf, tmp_path):
    from spanmill.operators import filters
    from spanmill.sources.tables import read_table, spans_of
    t = views.event_trace(spark, sf)
    f = overview.run_facts(t.runs, t.totals)
    export.write_tables(str(tmp_path), f, t.spans)
    back = read_table(spark, str(tmp_path), "runs")
    for tz in ("UTC", "Pacific/Auckland", "America/Los_Angeles"):
        for cond in ({"period": 3}, {"day": "2024-01-04"}, {"period": "reset"}, {"source": "claude-code", "period": 5}):
            want = {r[0] for r in filters.filter_runs(f, tz=tz, **cond).select("run_id").collect()}
            assert {r[0] for r in filters.filter_runs(back, tz=tz, **cond).select("run_id").collect()} == want and (want or "day" in cond)
    day = filters.filter_runs(back, day="2024-01-04")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_day" in plan and "start_day" in plan.split("PartitionFilters")[1].split("]")[0]
    s = spans_of(spark, str(tmp_path), day)
    assert "dynamicpruning" in s._jdf.queryExecution().executedPlan().toString()
    want = t.spans.join(day.select("run_id"), "run_id", "left_semi").select("run_id", "span_id")
    assert sorted(map(tuple, s.select("run_id", "span_id").collect())) == sorted(map(tuple, want.collect())) != []
    folders = s.select(F.col("_metadata.file_path").alias("p")) if "_metadata" in s.columns else s.select("start_day")
    assert folders.distinct().count() <= 2


def test_write_tables(spark, tables, tmp_path):
    _, t, _ = tables
    export.write_tables(str(tmp_path), t.trace.runs, t.trace.spans, findings=t.findings)
    s = spark.read.parquet(str(tmp_path / "spans"))
    assert s.count() == t.trace.spans.count()
    plan = s.filter("source = 'otlp'").select("span_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "tok_input" not in plan


def test_drill_through(spark, tables):
    _, t, logs = tables
    rec, _ = read_records(spark, logs)
    rec = rec.select("file", "line", F.col("uuid").alias("record_id"), F.to_json("v").alias("text"))
    ev = t.trace.spans.filter("span_id in ('t2', 'l1')").select("run_id", F.lit("i1").alias("finding_id"), "span_id", F.lit(0).alias("pos"))
    got = {r["span_id"]: r for r in drill.raw_records_for(ev, t.trace.spans, rec).collect()}
    assert got["t2"]["record_status"] == "ok" and "new_string" in got["t2"]["record"] and got["l1"]["record_status"] == "unavailable"


def test_scale_up(spark, sf):
    raw = views.raw_event_spans(spark, sf)
    one, many = drill.scale_up(raw, 3), drill.scale_up(raw, 3, one_session=False)
    n, roots = raw.count(), raw.filter("kind = 'session'").count()
    assert one.count() == 3 * n - 2 * roots and many.count() == 3 * n
    assert one.select("run_id", "span_id").distinct().count() == one.count()
    placed, warn, _ = place(one)
    assert warn.isEmpty() and placed.filter("depth = 0").count() == roots


def test_wording_and_vocabulary(spark, tables, sf):
    t = views.event_trace(spark, sf)
    f = rules.apply_rules(t)
    w = wording.worded(f, t.runs)
    assert w.filter("title is null or suggestion is null").isEmpty() and w.filter("title like '%after each of 3 failures%'").count() > 0
    d = spark.createDataFrame([("activity", "test", None, True), ("activity", "x", None, False), ("toolSub", "status", "git", True), ("toolSub", "status", "npm", False),
                               ("toolsAlso", '["git","git"]', None, False), ("toolFlags", '["timeout"]', None, True), ("hookCount", "-1", None, False), ("other", "x", None, False)],
                              "k string, v string, t string, ok boolean")
    got = d.withColumn("got", privacy.attr_valid(F.col("k"), F.col("v"), F.col("t"), ["git"], {"git": ["status"]}, ["npx"]))
    assert got.filter("got <> ok").isEmpty()
    a = spark.createDataFrame([("missing-binary",), ("nope",)], "c string").select(wording.advice(F.col("c"), F.lit("opencode")).alias("a")).collect()
    assert "AGENTS.md" in a[0]["a"] and a[1]["a"] == wording.OWNER_ADVICE["unknown"]
