from __future__ import annotations

import json

import fixtures as X
import pytest
from pyspark.sql import functions as F

from spanmill.sources import common, price_list, session_jsonl, store
from spanmill.sources import otlp as otlp_src
from spanmill.sources.trace_json import read_trace_json


def by_id(df):
    return {r["span_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root = X.transcript(tmp_path_factory.mktemp("logs"))
    return session_jsonl.read_session_jsonl(spark, str(root)), str(root)


def test_session_spans(session):
    s = by_id(session[0].spans)
    assert {k: s[k]["kind"] for k in ("sess-1", "m1", "t1", "t9", "aa1", "bb2", "h1", "h2")} == {
        "sess-1": "session", "m1": "llm_call", "t1": "tool_call", "t9": "mcp_call", "aa1": "subagent", "bb2": "subagent", "h1": "hook", "h2": "hook"}
    m1 = s["m1"]
    assert (m1["tok_input"], m1["tok_cache_read"], m1["tok_cache_write"], m1["cache_write_1h"]) == (100, 3000, 700, 600)
    assert m1["prompt_preview"].startswith("please fix") and m1["output_preview"] == "Looking at it"
    assert m1["end_ms"] - m1["start_ms"] == 3000 and m1["prov_line"] == 5
    t1 = s["t1"]
    assert (t1["status"], t1["exit_code"], t1["parent_id"]) == ("error", 1, "m1")
    assert t1["output_preview"].startswith("Build failed") and t1["activity"] == "build" and t1["tool_id"] == "npm"
    assert (s["t2"]["lines_added"], s["t2"]["lines_removed"], s["t2"]["target_kind"]) == (2, 1, "file-write")
    assert s["t3"]["output_bytes"] == 6 and s["t3"]["target_key"] == s["t2"]["target_key"]
    assert (s["t9"]["status"], s["t9"]["status_reason"], s["t9"]["mcp_server"]) == ("cancelled", "user-rejected", "docs")
    assert s["t6"]["status"] == "in_progress" and s["t6"]["tool_flags"] == ["background"]
    assert "mm3" not in s and "t5:agent" not in s


def test_subagents_and_containers(session):
    s = by_id(session[0].spans)
    assert (s["aa1"]["parent_id"], s["aa1"]["name"], s["mm1"]["parent_id"]) == ("t4", "subagent:explorer", "aa1")
    assert (s["bb2"]["parent_id"], s["bb2"]["agent_name"], s["bb2"]["delegation_reason"]) == ("t5", "writer", "write it")
    # the agent's last result (second 90) stretches both containers
    assert s["aa1"]["end_ms"] == s["tt1"]["end_ms"] == s["sess-1"]["end_ms"]


def test_hooks(session):
    s = by_id(session[0].spans)
    h1, h2 = s["h1"], s["h2"]
    assert (h1["name"], h1["parent_id"], h1["status"], h1["status_reason"], h1["duration_ms"]) == ("PostToolUse:Edit", "t2", "error", "exit 2", 2000)
    assert (h2["name"], h2["parent_id"], h2["hook_count"], h2["tool_id"], h2["activity"]) == ("Stop", "sess-1", 2, "eslint", "check")


def test_header_and_warnings(session):
    runs = session[0].runs.collect()
    assert len(runs) == 1 and runs[0]["title"] == "Fix the build" and runs[0]["project_name"] == "app" and runs[0]["git_branch"] == "main"
    w = {r["message"].split(":")[0].split(" (")[0]: r for r in session[0].warnings.collect()}
    bad = w["unparseable JSONL line"]
    assert bad["line"] == 4
    assert any(m.startswith("not a session") for m in w) and any("1 subagent transcript" in m for m in w)


def test_redaction_at_source(spark, session):
    s = session_jsonl.read_session_jsonl(spark, session[1], redact=True)
    assert s.spans.filter("prompt_preview is not null or output_preview is not null or target_label is not null").isEmpty()
    assert s.runs.first()["title"] is None and not s.spans.filter("content_redacted").isEmpty()


def test_line_numbers_across_splits(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("\n".join(json.dumps({"i": i, "pad": "x" * 200}) for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        d = common.numbered_lines(spark, str(tmp_path))
        assert d.select("file", "line").distinct().count() == 2000
        assert d.filter(F.get_json_object("value", "$.i").cast("long") != F.col("line")).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_when_the_splits_change_before_the_action(spark, tmp_path):
    """Lines and their offsets come from one landed scan, so later settings cannot lose lines."""
    (tmp_path / "big.jsonl").write_text("\n".join(json.dumps({"i": i, "pad": "x" * 200}) for i in range(1, 2001)))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "40000")
        d = common.numbered_lines(spark, str(tmp_path))
        spark.conf.set(key, "9000")
        assert d.select("line").distinct().count() == 2000 and d.filter(F.get_json_object("value", "$.i").cast("long") != F.col("line")).isEmpty()
    finally:
        spark.conf.set(key, old)


def check_store(out, children=True):
    s = by_id(out.spans)
    assert (s["msg_2"]["tok_reasoning"], s["msg_2"]["tok_cache_read"], s["msg_2"]["prompt_preview"], s["msg_2"]["output_preview"]) == (2, 100, "do it", "ok")
    assert (s["prt_2"]["lines_added"], s["prt_2"]["lines_removed"], s["prt_2"]["output_bytes"]) == (2, 1, 5)
    assert (s["prt_3"]["status"], s["prt_3"]["output_preview"], s["prt_3"]["tool_id"]) == ("error", "2 tests failed", "pytest")
    assert (s["prt_4"]["kind"], s["prt_4"]["mcp_server"]) == ("mcp_call", "jira")
    assert (s["ses_2"]["kind"], s["ses_2"]["parent_id"], s["ses_2"]["name"]) == ("subagent", "prt_5", "subagent:dev")
    if children:
        assert (s["ses_3"]["kind"], s["ses_3"]["parent_id"], s["ses_3"]["name"]) == ("subagent", "ses_1", "subagent:unknown")
        assert s["msg_3"]["parent_id"] == "ses_2"
    return [r["message"] for r in out.warnings.collect()]


def test_file_store(spark, tmp_path):
    out = store.StoreSource().read(spark, str(X.file_store(tmp_path)))
    w = check_store(out)
    assert any("ses_3 not referenced" in m for m in w) and any("ses_2 has no time.created" in m for m in w)
    assert out.runs.count() == 1


def test_export(spark, tmp_path):
    w = check_store(store.StoreSource().read(spark, str(X.export_doc(tmp_path)), kind="export"), children=False)
    assert any("ses_2 referenced by task tool not found" in m for m in w)


def test_database(spark, tmp_path):
    db = str(X.database(spark, tmp_path / "db"))
    w = check_store(store.StoreSource().read(spark, db, kind="tables"))
    assert any("unparseable part row bad" in m for m in w)
    files = str(X.file_store(tmp_path / "fs"))
    ses, held = store.read_store_json(spark, files)[0], store.read_store_tables(spark, db)[0]
    assert store.prefer_db_over_files(ses, held).isEmpty()
    assert store.prefer_db_over_files(ses, held.withColumn("root", F.lit("/elsewhere"))).count() == ses.count()
    both = store.StoreSource().read(spark, files, tables=db)
    assert [r["format"] for r in both.runs.collect()] == ["opencode-sqlite"]


def test_otlp(spark, tmp_path):
    root = str(X.otlp(tmp_path))
    out = otlp_src.read_otlp_traces(spark, root)
    s = by_id(out.spans)
    assert {k: s[k]["kind"] for k in s} == {"s-otlp": "session", "i1": "turn", "l1": "llm_call", "l2": "llm_call", "t1": "mcp_call", "g1": "other"}
    # session metrics fill the first call only, which carried no tokens
    assert (s["l1"]["tok_input"], s["l1"]["tok_output"], s["l1"]["tok_cache_read"], s["l1"]["cost_micro"], s["l1"]["cost_source"]) == (11, 3, 40, 500000, "reported")
    assert (s["l2"]["tok_input"], s["l2"]["tok_output"], s["l2"]["cost_micro"]) == (50, 7, 250000)
    assert (s["t1"]["status"], s["t1"]["mcp_server"], s["t1"]["output_preview"]) == ("error", "docs", "boom failed")
    assert s["l1"]["target_key"] == "k1" and s["i1"]["prompt_preview"] == "hello"
    assert (s["s-otlp"]["start_ms"], s["s-otlp"]["duration_ms"]) == (1767607200000, 9000)
    assert out.runs.first()["git_branch"] == "dev" and out.warnings.count() == 1
    g = by_id(otlp_src.read_otlp_traces(spark, root, genai=True).spans)
    assert (g["g1"]["kind"], g["g1"]["model"]) == ("llm_call", "gpt-5.4")


def test_otlp_lines_and_documents_side_by_side(spark, tmp_path):
    def doc(trace, span):
        return {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [{"traceId": trace, "spanId": span, "name": "claude_code.llm_request", "startTimeUnixNano": "1767607200000000000", "endTimeUnixNano": "1767607201000000000"}]}]}]}
    (tmp_path / "lines.jsonl").write_text(json.dumps(doc("t1", "a")) + "\n" + json.dumps(doc("t2", "b")) + "\n{broken\n")
    (tmp_path / "pretty.json").write_text(json.dumps(doc("t3", "c"), indent=2))
    (tmp_path / "bad.json").write_text("{\n  \"resourceSpans\": [")
    out = otlp_src.read_otlp_traces(spark, str(tmp_path))
    assert {r["span_id"] for r in out.spans.filter("kind = 'llm_call'").collect()} == {"a", "b", "c"}
    assert sorted(r["file"].rsplit("/", 1)[1] for r in out.warnings.filter("message like '%unreadable%'").collect()) == ["bad.json", "lines.jsonl"]


def test_a_run_read_twice_counts_once(spark, session):
    one = session_jsonl.read_session_jsonl(spark, session[1])
    from spanmill.plans import load, views
    once = load.build(spark, load.read_all(spark, [("claude-code", session[1], {})]), views.pricing(spark))
    twice = load.build(spark, load.read_all(spark, [("claude-code", session[1], {})] * 2), views.pricing(spark))
    rows = lambda t: sorted(map(repr, t.trace.spans.select("run_id", "span_id", "parent_id", "cost_micro").collect()))
    assert rows(once) == rows(twice) and len(rows(once)) == one.spans.count()
    total = lambda t: sorted(tuple(r) for r in t.trace.totals.select("run_id", "cost_micro", "llm_calls").collect())
    assert total(once) == total(twice)


def test_price_list(spark, tmp_path):
    m = lambda **k: {"litellm_provider": "anthropic", "mode": "chat", **k}
    doc = {"claude-a": m(input_cost_per_token=3e-6, output_cost_per_token=1.5e-5, cache_creation_input_token_cost=3.75e-6, cache_creation_input_token_cost_above_1hr=6e-6),
           "anthropic/claude-a": m(input_cost_per_token=9e-6), "claude-b": m(input_cost_per_token=1e-6, cache_creation_input_token_cost_above_1hr=9e-5),
           "claude-neg": m(input_cost_per_token=-1), "claude-str": m(input_cost_per_token="1"), "claude-big": m(input_cost_per_token=1), "emb": {"mode": "embedding"}}
    p = tmp_path / "prices.json"
    p.write_text(json.dumps(doc))
    good, bad = price_list.read_price_list(spark, str(p))
    g = {r["model_pattern"]: r for r in good.collect()}
    assert set(g) == {"claude-a", "claude-b"} and g["claude-a"]["input_per_mtok"] == 3.0 and g["claude-a"]["cache_write_1h_per_mtok"] == 6.0
    assert g["claude-b"]["cache_write_1h_per_mtok"] is None and g["claude-b"]["cache_read_per_mtok"] == 1.0
    assert {r["key"] for r in bad.collect()} == {"claude-neg", "claude-str", "claude-big"}
    with pytest.raises(ValueError):
        price_list.read_price_list(spark, str(p), min_entries=5)
    bundled = good.limit(1)
    t, warn = price_list.effective_pricing(spark, str(tmp_path / "missing.json"), bundled)
    assert t is bundled and warn


def test_listing_quarantine_collapse(spark, session):
    files = common.list_sources(spark, session[1], "*.jsonl", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
    assert files.count() == 6 and files.agg(F.sum("bytes")).first()[0] > 0
    assert common.since(files, "7d", 4_000_000_000_000).isEmpty()
    r = spark.createDataFrame([("a", 5, ["x"]), ("b", 10**12, ["z"]), ("b", 10**12, ["y"])], "run_id string, start_ms bigint, files array<string>")
    ok, bad = common.quarantine(r)
    assert bad.count() == 1 and common.collapse_run_ids(ok).first()["files"] == ["y"]


def test_trace_json(spark, tmp_path):
    run = {"id": "run_1", "source": {"tool": "otlp", "format": "otlp-json", "files": ["f"]}, "startedAt": X.ts(0), "warnings": [{"message": "w"}],
           "spans": [{"id": "s", "parentId": None, "kind": "session", "name": "session", "status": "ok", "startedAt": X.ts(0), "attributes": {}, "provenance": {"file": "f"}},
                     {"id": "c", "parentId": "s", "kind": "llm_call", "name": "m", "status": "ok", "startedAt": X.ts(1), "llm": {"provider": "p", "model": "m", "costSource": "reported",
                      "costUSD": 0.1, "tokens": {"input": 1, "output": 2, "cacheRead": 3, "cacheWrite": 4}}, "content": {"promptPreview": None},
                      "attributes": {"vendor.cacheWrite1hTokens": "3", "gen_ai.system": "x", "session.id": "q"}, "provenance": {"file": "f", "line": 2}}]}
    (tmp_path / "a.json").write_text(json.dumps(run))
    (tmp_path / "b.json").write_text(json.dumps({"schemaVersion": "0.1.0", "runs": [{**run, "id": "run_2"}]}))
    out = read_trace_json(spark, str(tmp_path))
    assert out.runs.count() == 2 and out.spans.count() == 4 and out.warnings.count() == 2
    c = out.spans.filter("span_id = 'c'").first()
    assert c["cost_micro"] == 100000 and c["content_redacted"] and c["cache_write_1h"] == 3
    assert c["attributes"] == {"cacheWrite1hTokens": "3", "gen_ai.system": "x", "session.id": "q"}
