"""Small hand-written logs for the readers."""

from __future__ import annotations

import json
from pathlib import Path


def _w(path: Path, rows) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")


def ts(sec: int) -> str:
    return f"2026-01-05T10:{sec // 60:02d}:{sec % 60:02d}.000Z"


def transcript(root: Path) -> Path:
    """A session with a failing and a declined call, an edit, hooks, a linked, an adopted and a lost agent."""
    def user(u, sec, content, **kw):
        return {"type": "user", "uuid": u, "timestamp": ts(sec), "sessionId": "sess-1", "cwd": "/work/app", "gitBranch": "main",
                "message": {"role": "user", "content": content}, **kw}

    def asst(u, sec, mid, parent, content, usage=None, **kw):
        return {"type": "assistant", "uuid": u, "parentUuid": parent, "timestamp": ts(sec), "sessionId": "sess-1",
                "message": {"id": mid, "model": "claude-sonnet-4-5", "content": content, "stop_reason": "tool_use",
                            **({"usage": usage} if usage else {})}, **kw}

    def use(i, name, **inp):
        return {"type": "tool_use", "id": i, "name": name, "input": inp}

    def res(i, content, err=False):
        return {"type": "tool_result", "tool_use_id": i, "is_error": err, "content": content}

    usage = {"input_tokens": 100, "output_tokens": 20, "cache_read_input_tokens": 3000, "cache_creation_input_tokens": 500,
             "cache_creation": {"ephemeral_5m_input_tokens": 100, "ephemeral_1h_input_tokens": 600}}
    main = root / "proj" / "sess-1.jsonl"
    first = user("u1", 0, "please fix the build in /work/app")
    _w(main, [
        "﻿" + json.dumps(first), first, "", "{not json",
        asst("a1", 5, "m1", "u1", [{"type": "text", "text": "Looking at it"}], usage),
        asst("a2", 8, "m1", "u1", [use("t1", "Bash", command="npm run build")]),
        user("u2", 12, [res("t1", "Exit code 1\nBuild failed: x\n0 errors in y", True)]),
        asst("a3", 15, "m2", "u2", [use("t2", "Edit", file_path="/work/app/a.ts", old_string="a", new_string="b\nc"), use("t3", "Read", file_path="/work/app/a.ts"),
                                    use("t9", "mcp__docs__find", q="x")], usage),
        user("u3", 20, [res("t2", "ok")]), user("u4", 22, [res("t3", [{"type": "text", "text": "héllo"}])]),
        user("u4b", 23, [res("t9", "The user doesn't want to proceed with this tool use", True)]),
        asst("a4", 25, "m3", "u4", [use("t4", "Agent", subagent_type="explorer", description="look around"), use("t5", "Agent", subagent_type="writer"),
                                    use("t6", "Bash", command="sleep 100", run_in_background=True)], usage),
        user("u5", 60, [res("t4", "done")], toolUseResult={"agentId": "aa1", "status": "completed"}),
        {"type": "attachment", "uuid": "h1", "timestamp": ts(61), "attachment": {"type": "hook_non_blocking_error", "hookName": "PostToolUse:Edit",
         "hookEvent": "PostToolUse", "command": "eslint --fix a.ts", "durationMs": 2000, "exitCode": 2, "toolUseID": "t2"}},
        {"type": "system", "subtype": "stop_hook_summary", "uuid": "h2", "timestamp": ts(62), "hookCount": 2, "hookErrors": [],
         "hookInfos": [{"command": "eslint a.ts"}, {"command": "eslint b.ts"}]},
        {"type": "custom-title", "customTitle": "Fix the build", "sessionId": "sess-1"}, {"type": "ai-title", "aiTitle": "Other", "sessionId": "sess-1"},
    ])
    sub = root / "proj" / "sess-1" / "subagents"
    _w(sub / "agent-aa1.jsonl", [user("x1", 30, "go"), asst("x2", 40, "mm1", "x1", [use("tt1", "Grep", pattern="x")], usage), user("x3", 90, [res("tt1", "found")])])
    _w(sub / "agent-bb2.jsonl", [user("y1", 33, "go"), asst("y2", 44, "mm2", "y1", [{"type": "text", "text": "hi"}], usage)])
    (sub / "agent-bb2.meta.json").write_text(json.dumps({"agentType": "writer", "description": "write it", "toolUseId": "t5"}))
    _w(sub / "agent-cc3.jsonl", [user("z1", 33, "lost"), asst("z2", 44, "mm3", "z1", [], usage)])
    _w(root / "proj" / "other.jsonl", [{"foo": 1}])
    _w(root / "proj" / "empty.jsonl", [{"type": "summary", "summary": "s"}])
    return root


_T0 = 1767607200000


def _store_records():
    ses = [{"id": "ses_1", "directory": "/work/app", "title": "Store run", "time": {"created": _T0, "updated": _T0 + 90_000}},
           {"id": "ses_2", "parentID": "ses_1", "directory": "/work/app", "title": "child", "time": {"updated": _T0 + 40_000}},
           {"id": "ses_3", "parentID": "ses_1", "directory": "/work/app", "title": "orphan", "time": {"created": _T0 + 5_000, "updated": _T0 + 6_000}}]
    tok = {"input": 10, "output": 5, "reasoning": 2, "cache": {"read": 100, "write": 7}}

    def msg(i, s, role, a, b=None, parent=None, **kw):
        return {"id": i, "sessionID": s, "role": role, "modelID": "claude-sonnet-4-5", "providerID": "anthropic", "time": {"created": _T0 + a, **({"completed": _T0 + b} if b else {})},
                **({"parentID": parent} if parent else {}), **({"tokens": tok} if role == "assistant" else {}), **kw}

    msgs = [msg("msg_1", "ses_1", "user", 0), msg("msg_2", "ses_1", "assistant", 1000, 9000, "msg_1", finish="tool-calls"), msg("msg_3", "ses_2", "assistant", 12000, 15000)]

    def tool(i, m, name, status, a, b, **state):
        return {"id": i, "messageID": m, "type": "tool", "tool": name, "state": {"status": status, "time": {"start": _T0 + a, "end": _T0 + b}, **state}}

    parts = [{"id": "prt_0", "messageID": "msg_1", "type": "text", "text": "do it"}, {"id": "prt_1", "messageID": "msg_2", "type": "text", "text": "ok"},
             tool("prt_2", "msg_2", "edit", "completed", 2000, 2500, input={"filePath": "/work/app/a.ts", "oldString": "x", "newString": "y\nz"}, output="héé"),
             tool("prt_3", "msg_2", "bash", "error", 3000, 3500, input={"command": "pytest -q"}, error="2 tests failed"),
             tool("prt_4", "msg_2", "jira_search", "completed", 4000, 4100, input={}, output="r"),
             tool("prt_5", "msg_2", "task", "completed", 10000, 30000, input={"subagent_type": "dev", "description": "help"}, metadata={"sessionId": "ses_2"})]
    return ses, msgs, parts


def file_store(root: Path) -> Path:
    ses, msgs, parts = _store_records()
    for s in ses:
        _w(root / "storage" / "session" / "p1" / f"{s['id']}.json", [s])
    for m in msgs:
        _w(root / "storage" / "message" / m["sessionID"] / f"{m['id']}.json", [m])
    for p in parts:
        _w(root / "storage" / "part" / p["messageID"] / f"{p['id']}.json", [p])
    return root


def export_doc(root: Path) -> Path:
    ses, msgs, parts = _store_records()
    doc = {"info": ses[0], "messages": [{"info": m, "parts": [p for p in parts if p["messageID"] == m["id"]]} for m in msgs if m["sessionID"] == "ses_1"]}
    root.mkdir(parents=True, exist_ok=True)
    (root / "export.json").write_text(json.dumps(doc))
    return root


def database(spark, path: Path) -> Path:
    """The store's tables as a database holds them, landed as Parquet."""
    ses, msgs, parts = _store_records()
    rest = lambda x: json.dumps({k: v for k, v in x.items() if k != "id"})
    rows = {
        "session": ([(s["id"], s.get("parentID"), s["directory"], s["title"], s["time"].get("created"), s["time"]["updated"]) for s in ses],
                    "id string, parent_id string, directory string, title string, time_created long, time_updated long"),
        "message": ([(m["id"], m["sessionID"], rest(m)) for m in msgs], "id string, session_id string, data string"),
        "part": ([(p["id"], p["messageID"], "ses_1", rest(p)) for p in parts] + [("bad", "msg_2", "ses_1", "{oops")], "id string, message_id string, session_id string, data string"),
    }
    for name, (data, ddl) in rows.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{path}/{name}")
    return path


def otlp(root: Path) -> Path:
    def kv(k, **v):
        return {"key": k, "value": v}

    def span(i, name, a, b, parent=None, attrs=(), **kw):
        n = 1767607200_000_000_000
        return {"traceId": "tr1", "spanId": i, **({"parentSpanId": parent} if parent else {}), "name": name, "startTimeUnixNano": str(n + a * 10**6),
                "endTimeUnixNano": str(n + b * 10**6), "attributes": [kv("session.id", stringValue="s-otlp"), *attrs], **kw}

    spans = [
        span("i1", "claude_code.interaction", 0, 9000, attrs=[kv("user_prompt", stringValue="hello"), kv("git.branch", stringValue="dev")]),
        span("l1", "claude_code.llm_request", 100, 2000, "i1", [kv("model", stringValue="claude-sonnet-4-5"), kv("vendor.targetKey", stringValue="k1")]),
        span("l2", "claude_code.llm_request", 3000, 4000, "i1", [kv("gen_ai.request.model", stringValue="gpt-5.4"), kv("input_tokens", intValue="50"), kv("output_tokens", intValue=7),
                                                                 kv("gen_ai.usage.cost", doubleValue=0.25), kv("gen_ai.input.messages", stringValue="secret")]),
        span("t1", "claude_code.tool", 4100, 4500, "i1", [kv("tool_name", stringValue="mcp__docs__find"), kv("success", boolValue=False)], status={"code": 2, "message": "boom failed"}),
        {"traceId": "tr1", "name": "no id"},
        span("g1", "chat gpt", 5000, 6000, "gone", [kv("gen_ai.operation.name", stringValue="chat"), kv("gen_ai.request.model", stringValue="gpt-5.4")]),
    ]
    doc = {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": spans}]}]}
    pt = [{"attributes": [kv("session.id", stringValue="s-otlp"), kv("type", stringValue=t)], "asInt": str(v)} for t, v in (("input", 11), ("output", 3), ("cacheRead", 40))]
    met = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "opencode.token.usage", "sum": {"dataPoints": pt}},
           {"name": "opencode.cost.usage", "sum": {"dataPoints": [{"attributes": [kv("session.id", stringValue="s-otlp")], "asDouble": 0.5}]}}]}]}]}
    root.mkdir(parents=True, exist_ok=True)
    (root / "traces.json").write_text(json.dumps(doc, indent=1))
    (root / "metrics.json").write_text(json.dumps(met, indent=1))
    return root
