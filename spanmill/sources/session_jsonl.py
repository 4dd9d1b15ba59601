"""Agent session transcripts: newline JSON, one main file per session plus agent transcripts beside it.

``<dir>/<session>.jsonl`` and ``<dir>/<session>/subagents/**/agent-<id>.jsonl`` (+ ``.meta.json``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename, error_preview, exit_code, is_user_rejection, mcp_server, stable_run_id, target_spec, tool_target
from ..operators.commands import classify_commands
from ..operators.toolusage import command_outcome_flags, hook_summary_identity
from ..operators.tree import repaired_parents, subtree
from ..session import land
from .common import (PREVIEW, Loaded, byte_length, iso_ms, line_count, listed, loaded, numbered_lines, span_between, text_of, vget, vint, vstr)

AGENT_FILE = r"^(.*)/([^/]+)/subagents/(?:.*/)?agent-([A-Za-z0-9]+)\.jsonl$"
META_TYPES = ["summary", "file-history-snapshot", "queue-operation"]
# Hook events that may carry a matcher, and the shapes of safe hook names.
MATCHER_EVENTS = ["PreToolUse", "PostToolUse", "PostToolUseFailure", "PermissionRequest", "PermissionDenied", "SubagentStart",
                  "SubagentStop", "SessionStart", "SessionEnd", "PreCompact", "PostCompact", "Notification"]
EVENT_RE, MATCHER_RE = r"^[A-Za-z][A-Za-z0-9]*$", r"^[A-Za-z0-9_-]{1,64}(?::[A-Za-z0-9_-]{1,64}){0,2}$"


def unit_of(file: Column | str) -> Column:
    """The main transcript a file belongs to: itself, or the one beside the folder of its agents."""
    return F.regexp_replace(file, r"/subagents/.*$", ".jsonl")


def read_records(spark: SparkSession, path: str, modified_after: str | None = None, glob: str = "*.jsonl",
                 files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, warnings): parsed objects with file, line, session file and agent id; bad lines apart."""
    t = numbered_lines(spark, path, glob, modified_after, files).filter(F.trim("value") != "")
    t = t.filter(~F.col("file").endswith("/journal.jsonl")).withColumn("v", F.try_parse_json("value"))
    agent = F.regexp_extract("file", AGENT_FILE, 3)
    session = F.when(agent != "", F.concat(F.regexp_extract("file", AGENT_FILE, 1), F.lit("/"), F.regexp_extract("file", AGENT_FILE, 2),
                                           F.lit(".jsonl"))).otherwise(F.col("file"))
    t = t.withColumns({"agent": agent, "session": session})
    bad = t.filter("v is null").select("session", F.lit("unparseable JSONL line").alias("message"), "file", "line")
    rec = t.filter("v is not null").filter(F.ltrim("value").startswith("{")).withColumns({
        "type": vstr("v", "$.type"), "uuid": vstr("v", "$.uuid"), "ts": vstr("v", "$.timestamp")})
    rec = rec.filter(~F.coalesce(F.col("type").rlike(r"^x-[a-z]+-scrub$"), F.lit(False))).drop("value")
    return rec.withColumn("ms", iso_ms("ts")), bad


def dedupe_records(rec: DataFrame) -> DataFrame:
    """First occurrence of a uuid per transcript; records without one are all kept."""
    w = Window.partitionBy("file", "uuid").orderBy("line")
    first = rec.filter("uuid is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return first.unionByName(rec.filter("uuid is null"))


def _content(df: DataFrame) -> DataFrame:
    return df.withColumns({"msg": vget("v", "$.message", "variant"), "content": vget("v", "$.message.content", "variant")})


def assemble_llm_calls(rec: DataFrame) -> DataFrame:
    """Assistant records that share a message id are one call."""
    a = _content(rec.filter("type = 'assistant'"))
    a = a.filter(F.coalesce(vget("msg", "$.id", "variant"), vget("msg", "$.model", "variant"), F.col("content"), vget("msg", "$.usage", "variant")).isNotNull())
    a = a.withColumn("key", F.coalesce(vstr("msg", "$.id"), F.col("uuid"), F.concat(F.lit("rec-"), F.col("line"))))
    model, stop, usage = vstr("msg", "$.model"), vstr("msg", "$.stop_reason"), vget("msg", "$.usage", "variant")
    has_usage = F.schema_of_variant(usage).startswith("OBJECT")
    text = F.substring(vstr(F.try_element_at(F.filter(F.try_variant_get("content", "$", "array<variant>"), lambda b: vstr(b, "$.type") == "text"),
                                             F.lit(1)), "$.text"), 1, PREVIEW)
    v = a.select("session", "file", "agent", "line", "key", "ts", "ms", vstr("v", "$.parentUuid").alias("parent_uuid"), model.alias("model"),
                 stop.alias("stop_reason"), F.when(has_usage, F.col("line")).alias("u_line"), token_usage_of(usage).alias("u"),
                 F.coalesce(vget("v", "$.isApiErrorMessage", "boolean"), F.lit(False)).alias("api_error"), text.alias("text"))
    first, last = (lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line")))), (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))))
    return v.groupBy("session", "file", "agent", "key").agg(
        F.min("line").alias("line"), F.min_by("parent_uuid", "line").alias("parent_uuid"), first("model").alias("model"),
        last("stop_reason").alias("stop_reason"), F.max_by("u", "u_line").alias("u"), F.min_by("ts", "line").alias("start_raw"),
        F.coalesce(F.min_by("ms", "line"), F.lit(0)).alias("start_ms"), F.coalesce(last("ms"), F.lit(0)).alias("end_ms"),
        F.bool_or("api_error").alias("api_error"), first("text").alias("text"))


def token_usage_of(usage: Column) -> Column:
    """input, output, read, write (flat total or TTL split, whichever is larger) and the 1-hour share."""
    w5, w60 = vint(usage, "$.cache_creation.ephemeral_5m_input_tokens"), vint(usage, "$.cache_creation.ephemeral_1h_input_tokens")
    write = F.greatest(vint(usage, "$.cache_creation_input_tokens"), w5 + w60)
    return F.struct(vint(usage, "$.input_tokens").alias("input"), vint(usage, "$.output_tokens").alias("output"),
                    vint(usage, "$.cache_read_input_tokens").alias("read"), write.alias("write"), F.least(w60, write).alias("write_1h"))


def extract_tool_calls(rec: DataFrame) -> DataFrame:
    """tool_use blocks; the first sighting of a tool id in a transcript wins."""
    a = _content(rec.filter("type = 'assistant'"))
    key = F.coalesce(vstr("msg", "$.id"), F.col("uuid"), F.concat(F.lit("rec-"), F.col("line")))
    b = a.select("session", "file", "agent", "line", "ts", "ms", key.alias("key"),
                 F.posexplode(F.try_variant_get("content", "$", "array<variant>")).alias("pos", "b"))
    b = b.filter((vstr("b", "$.type") == "tool_use") & vstr("b", "$.id").isNotNull()).select(
        "session", "file", "agent", "line", "pos", "ts", "ms", "key", vstr("b", "$.id").alias("tool_id_"),
        F.coalesce(vstr("b", "$.name"), F.lit("unknown")).alias("name"), vget("b", "$.input", "variant").alias("input"))
    w = Window.partitionBy("file", "tool_id_").orderBy("line", "pos")
    return b.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def tool_results(rec: DataFrame) -> DataFrame:
    """First tool_result per tool id of a transcript with its outcome."""
    u = _content(rec.filter("type = 'user'"))
    b = u.select("file", "line", "ts", "ms", F.try_variant_get("v", "$.toolUseResult", "variant").alias("res"),
                 F.posexplode(F.try_variant_get("content", "$", "array<variant>")).alias("pos", "b"))
    err = F.coalesce(vget("b", "$.is_error", "boolean"), F.lit(False))
    body = vget("b", "$.content", "variant")
    fail = F.when(err, text_of(body))
    b = b.filter((vstr("b", "$.type") == "tool_result") & vstr("b", "$.tool_use_id").isNotNull()).select(
        "file", "line", "pos", vstr("b", "$.tool_use_id").alias("tool_id_"), F.coalesce("ms", F.lit(0)).alias("r_ms"), err.alias("is_error"),
        byte_length(body).alias("output_bytes"), error_preview(fail).alias("r_preview"), exit_code(fail).alias("exit_code"),
        is_user_rejection(fail).alias("rejected"), vstr("res", "$.agentId").alias("r_agent"), F.lower(vstr("res", "$.status")).alias("r_status"),
        vstr("res", "$.commandName").alias("r_command"), vstr("res", "$.backgroundTaskId").alias("r_bg"),
        F.coalesce(vget("res", "$.interrupted", "boolean"), F.lit(False)).alias("r_int"), vget("res", "$.timedOutAfterMs", "double").alias("r_timeout"))
    w = Window.partitionBy("file", "tool_id_").orderBy("line", "pos")
    return b.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "pos", "line")


def code_change_counts(name: Column, inp: str) -> tuple[Column, Column]:
    """(added, removed) of the edit tools from their input strings."""
    edits = F.try_variant_get(inp, "$.edits", "array<variant>")
    total = lambda k: F.aggregate(edits, F.lit(0), lambda a, e: a + line_count(vstr(e, k)))
    added = (F.when(name == "Edit", line_count(vstr(inp, "$.new_string"))).when(name == "MultiEdit", F.coalesce(total("$.new_string"), F.lit(0)))
             .when(name == "Write", line_count(vstr(inp, "$.content"))).when(name == "NotebookEdit", line_count(vstr(inp, "$.new_source"))))
    removed = F.when(name == "Edit", line_count(vstr(inp, "$.old_string"))).when(name == "MultiEdit", F.coalesce(total("$.old_string"), F.lit(0)))
    return added.cast("bigint"), removed.cast("bigint")


def pair_tool_results(tools: DataFrame, results: DataFrame) -> DataFrame:
    """Left equi-join of calls and results: status, end, bytes, exit code, preview."""
    j = tools.join(results, ["file", "tool_id_"], "left")
    status = (F.when(F.col("is_error").isNull(), "in_progress").when(F.col("rejected"), "cancelled").when(F.col("is_error"), "error").otherwise("ok"))
    return j.withColumn("status", status)


def extract_hooks(rec: DataFrame) -> DataFrame:
    """Failed / cancelled hook attachments and stop-hook summaries that can be placed in time."""
    r = rec.filter("ms is not null and type in ('attachment', 'system')")
    at = F.when(F.col("type") == "attachment", vstr("v", "$.attachment.type"))
    summary = (F.col("type") == "system") & (vstr("v", "$.subtype") == "stop_hook_summary")
    nm, ev = vstr("v", "$.attachment.hookName"), vstr("v", "$.attachment.hookEvent")
    cutoff = F.instr(nm, ":")
    ok_name = F.when(cutoff == 0, nm.rlike(EVENT_RE)).otherwise(
        F.substring_index(nm, ":", 1).isin(MATCHER_EVENTS) & F.substring(nm, cutoff + 1, F.length(nm)).rlike(MATCHER_RE))
    name = F.when(summary, "Stop").otherwise(F.when(ok_name, nm).when(ev.rlike(EVENT_RE), ev).otherwise("hook"))
    infos = F.transform(F.try_variant_get("v", "$.hookInfos", "array<variant>"), lambda i: vstr(i, "$.command"))
    cmds = F.when(summary, F.filter(F.coalesce(infos, F.array().cast("array<string>")), lambda c: c.isNotNull())).otherwise(
        F.array_compact(F.array(vstr("v", "$.attachment.command"))))
    errs = F.size(F.coalesce(F.try_variant_get("v", "$.hookErrors", "array<variant>"), F.array().cast("array<variant>")))
    dur = F.when(summary, F.lit(0)).otherwise(vint("v", "$.attachment.durationMs"))
    h = r.filter(summary | at.isin("hook_non_blocking_error", "hook_cancelled")).select(
        "session", "file", "agent", "line", "uuid", "ts", "ms", name.alias("name"), dur.cast("bigint").alias("dur"),
        F.coalesce(F.when(summary, vstr("v", "$.toolUseID")), vstr("v", "$.attachment.toolUseID")).alias("hook_tool"),
        F.when(at == "hook_cancelled", "cancelled").when((at == "hook_non_blocking_error") | (errs > 0), "error").otherwise("ok").alias("status"),
        F.when((at == "hook_cancelled") & F.coalesce(vget("v", "$.attachment.timedOut", "boolean"), F.lit(False)), "timeout").otherwise(
            F.concat(F.lit("exit "), vget("v", "$.attachment.exitCode", "int"))).alias("status_reason"),
        F.when(summary, F.coalesce(vget("v", "$.hookCount", "int"), F.size(cmds))).alias("hook_count"), cmds.alias("cmds"))
    return h


def session_header(rec: DataFrame) -> DataFrame:
    """Title, cwd, branch, session id and what kind of file it is; one row per main transcript."""
    m = rec.filter("agent = ''")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line")))
    talk = F.col("type").isin("user", "assistant") & F.col("ts").isNotNull()
    sid = vstr("v", "$.sessionId")
    return m.groupBy("session").agg(
        last(F.when(F.col("type") == "custom-title", vstr("v", "$.customTitle"))).alias("custom"),
        last(F.when(F.col("type") == "ai-title", vstr("v", "$.aiTitle"))).alias("ai"), first(vstr("v", "$.cwd")).alias("cwd"),
        first(F.nullif(vstr("v", "$.gitBranch"), F.lit(""))).alias("branch"), first(sid).alias("session_id"), first(F.col("ts")).alias("first_ts"),
        F.coalesce(F.bool_or(talk), F.lit(False)).alias("conversational"), F.bool_or(sid.isNotNull() | F.col("type").isin(META_TYPES)).alias("own_markers"),
        F.coalesce(F.bool_or(vget("v", "$.isSidechain", "boolean")), F.lit(False)).alias("legacy"))


def reject_non_sessions(header: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions; and files that are none (warned unless they carry the agent's own markers)."""
    ok = F.col("conversational") & F.col("first_ts").isNotNull()
    bad = header.filter(~ok & ~F.coalesce("own_markers", F.lit(False))).select(
        "session", F.lit("not a session: no timestamped user or assistant records").alias("message"), F.col("session").alias("file"))
    return header.filter(ok), bad


def agent_metas(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Sidecars of agent transcripts; ``files`` chooses some."""
    names = listed(files)
    m = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.meta.json").option("multiLine", "true")
         .schema("name string, agentType string, description string, toolUseId string, parentAgentId string").json(path if names is None else names)
         .select("*", F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", ".jsonl").alias("file")))
    return m.select(F.regexp_extract("file", AGENT_FILE, 3).alias("agent"), "file", F.concat(
        F.regexp_extract("file", AGENT_FILE, 1), F.lit("/"), F.regexp_extract("file", AGENT_FILE, 2), F.lit(".jsonl")).alias("session"),
        F.coalesce("name", "agentType", F.lit("unknown")).alias("m_name"), F.col("description").alias("m_desc"),
        F.col("toolUseId").alias("m_tool"), F.col("parentAgentId").alias("m_parent"))


def link_subagents(calls: DataFrame) -> DataFrame:
    """Delegating calls: one per agent id (main transcript first, then by line); ids missing stay apart."""
    d = calls.filter("name = 'Agent' or r_agent is not null").withColumn("agent_span", F.coalesce("r_agent", F.concat("tool_id_", F.lit(":agent"))))
    w = Window.partitionBy("session", "agent_span").orderBy(F.col("agent") != "", "file", "line", "pos")
    return d.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def reach_transcripts(records: DataFrame, calls: DataFrame, delegations: DataFrame, metas: DataFrame) -> DataFrame:
    """(session, agent, via): agent transcripts reachable from the main one.

    ``via`` = 'record' when a result names the agent, 'sidecar' when only its sidecar does. Grows level
    by level (nesting depth rounds); record links are followed to the end before sidecars are tried.
    """
    have = records.filter("agent <> ''").select("session", "agent").distinct()
    rec = delegations.filter("r_agent is not null").select("session", F.col("agent").alias("src"), F.col("r_agent").alias("agent")).join(
        have, ["session", "agent"], "left_semi")
    by_tool = metas.join(calls.select("session", F.col("agent").alias("src"), F.col("tool_id_").alias("m_tool")), ["session", "m_tool"])
    side = by_tool.select("session", "src", "agent").unionByName(
        metas.filter("m_parent is not null").select("session", F.col("m_parent").alias("src"), "agent")).join(have, ["session", "agent"], "left_semi")
    rec, side = land(rec.distinct()), land(side.distinct())
    reached = land(records.select("session").distinct().withColumns({"agent": F.lit(""), "via": F.lit("main")}))
    while True:
        grown = False
        for edges, via in ((rec, "record"), (side, "sidecar")):
            new = land(edges.join(reached.select("session", F.col("agent").alias("src")), ["session", "src"], "left_semi")
                       .join(reached.select("session", "agent"), ["session", "agent"], "left_anti").select("session", "agent").distinct()
                       .withColumn("via", F.lit(via)))
            if not new.isEmpty():
                reached = land(reached.unionByName(new))
                grown = True
                break
        if not grown:
            return reached.filter("agent <> ''")


def extend_containers(spans: DataFrame) -> DataFrame:
    """Sessions and subagents end no earlier than any descendant and start no later than a descendant hook."""
    ends = F.coalesce("end_ms", "start_ms")
    d = (subtree(repaired_parents(spans), {"d_end": ("max", ends), "d_start": ("min", F.when(F.col("kind") == "hook", F.col("start_ms"))), "size": ("sum", F.lit(1).cast("bigint"))})
         .filter("size > 1").drop("size").join(spans.filter("kind in ('session', 'subagent')").select("run_id", "span_id"), ["run_id", "span_id"], "left_semi"))
    j = spans.join(d, ["run_id", "span_id"], "left")
    start, end = F.least("start_ms", F.coalesce("d_start", "start_ms")), F.greatest(ends, F.coalesce("d_end", ends))
    hit = F.col("d_end").isNotNull()
    return j.withColumns({"n_s": start, "n_e": F.when(hit, end).otherwise(F.col("end_ms"))}).withColumns({
        "start_ms": F.col("n_s"), "end_ms": F.col("n_e"),
        "duration_ms": F.when(hit, F.col("n_e") - F.col("n_s")).otherwise(F.col("duration_ms"))}).select(*spans.columns)


class SessionJsonlSource:
    name = "claude-code"

    # one unit of change is a main transcript with all that lies in its folder
    listing = "*.{jsonl,meta.json}"
    unit = staticmethod(unit_of)

    def read(self, spark: SparkSession, path: str, redact: bool = False, modified_after: str | None = None, files: DataFrame | None = None,
             glob: str = "*.jsonl") -> Loaded:
        """Transcripts of a folder, or the chosen ``files(path, file)`` of it, to runs, spans and warnings."""
        rec, bad = read_records(spark, path, modified_after, glob, files)
        rec = land(dedupe_records(rec))
        header, not_sessions = reject_non_sessions(session_header(rec))
        header = header.withColumn("root", F.coalesce("session_id", F.regexp_replace(basename(F.col("session")), r"\.jsonl$", "")))
        header = land(header.withColumn("run_id", stable_run_id(F.col("root"))))
        ids = header.select("session", "run_id", "root")
        calls = land(pair_tool_results(extract_tool_calls(rec), tool_results(rec)))
        deleg, metas = link_subagents(calls), agent_metas(spark, path, files)
        reach = reach_transcripts(rec, calls, deleg, metas)
        keep = land(reach.select("session", "agent", "via").unionByName(ids.select("session", F.lit("").alias("agent"), F.lit("main").alias("via"))))

        def owned(df: DataFrame) -> DataFrame:
            return df.join(keep.select("session", "agent"), ["session", "agent"], "left_semi").join(ids, "session").withColumn(
                "owner", F.when(F.col("agent") == "", F.col("root")).otherwise(F.col("agent")))

        none = F.lit(None).cast("string")
        hide = (lambda c: none) if redact else (lambda c: c)
        groups = assemble_llm_calls(rec)
        users = _content(rec.filter("type = 'user' and uuid is not null")).select(
            "file", F.col("uuid").alias("parent_uuid"), F.substring(text_of(F.col("content")), 1, PREVIEW).alias("prompt"))
        users = users.filter("prompt is not null")
        g = owned(groups).join(users, ["file", "parent_uuid"], "left")
        model = F.coalesce("model", F.lit("unknown"))
        llm = g.select("run_id", F.col("key").alias("span_id"), F.col("owner").alias("parent_id"), F.lit("llm_call").alias("kind"), model.alias("name"),
                       F.when(F.col("api_error"), "error").otherwise("ok").alias("status"), "start_ms", "start_raw", "end_ms",
                       span_between(F.col("start_ms"), F.col("end_ms")).alias("duration_ms"), F.lit("anthropic").alias("provider"), model.alias("model"),
                       F.coalesce("u.input", F.lit(0)).alias("tok_input"), F.coalesce("u.output", F.lit(0)).alias("tok_output"),
                       F.coalesce("u.read", F.lit(0)).alias("tok_cache_read"), F.coalesce("u.write", F.lit(0)).alias("tok_cache_write"),
                       F.nullif(F.col("u.write_1h"), F.lit(0).cast("bigint")).alias("cache_write_1h"), F.lit("unknown").alias("cost_source"), "stop_reason",
                       hide(F.col("prompt")).alias("prompt_preview"), hide(F.col("text")).alias("output_preview"), F.lit(redact).alias("content_redacted"),
                       F.col("file").alias("prov_file"), F.col("line").alias("prov_line"))
        c = owned(calls)
        starts = groups.select("file", "key", F.col("start_ms").alias("g_start"))
        c = c.join(starts, ["file", "key"], "left").withColumn("s_ms", F.coalesce("ms", "g_start", F.lit(0)))
        kind, fld = target_spec("claude-code", "name")
        raw = F.coalesce(*[F.when(fld == f, F.nullif(vstr("input", "$." + f), F.lit(""))) for f in ("file_path", "notebook_path", "command")])
        add, rem = code_change_counts(F.col("name"), "input")
        ok = F.col("status").isin("ok") | (F.col("status") == "cancelled") & ~F.coalesce("is_error", F.lit(False))
        command = F.when(F.col("name").isin("Bash", "PowerShell"), vstr("input", "$.command"))
        c = c.withColumns({"t": tool_target(kind, raw), "command": command, "server": mcp_server("name"),
                           "flags": command_outcome_flags(F.coalesce(vget("input", "$.run_in_background", "boolean"), F.lit(False)) | (F.coalesce("r_bg", F.lit("")) != ""),
                                                          F.col("r_timeout").isNotNull(), F.coalesce("r_int", F.lit(False)))})
        cls = classify_commands(c).withColumnRenamed("command", "cmd_text")
        c = c.join(cls, c["command"] == cls["cmd_text"], "left")
        err = F.coalesce("is_error", F.lit(False))
        tools = c.select(
            "run_id", F.col("tool_id_").alias("span_id"), F.col("key").alias("parent_id"), F.when(F.col("server").isNull(), "tool_call").otherwise("mcp_call").alias("kind"),
            "name", "status", F.when(F.col("status") == "cancelled", "user-rejected").alias("status_reason"), F.col("s_ms").alias("start_ms"),
            F.col("ts").alias("start_raw"), F.col("r_ms").alias("end_ms"), span_between(F.col("s_ms"), F.col("r_ms")).alias("duration_ms"),
            F.col("name").alias("tool_name"), F.col("server").alias("mcp_server"), "exit_code", "output_bytes", F.when(ok, add).alias("lines_added"),
            F.when(ok, rem).alias("lines_removed"), hide(F.when(err, F.col("r_preview"))).alias("output_preview"), (F.lit(redact) & err).alias("content_redacted"),
            F.col("t.key").alias("target_key"), F.col("t.kind").alias("target_kind"), hide(F.col("t.display")).alias("target_label"), "activity", "tool_id",
            "tool_sub", "tools_also", F.when(F.size("flags") > 0, F.col("flags")).alias("tool_flags"), F.col("file").alias("prov_file"), F.col("line").alias("prov_line"))
        subs = self._subagents(owned(deleg.join(starts, ["file", "key"], "left")), groups, metas, reach, ids, rec, calls, hide, redact)
        hooks = self._hooks(owned(extract_hooks(rec)), calls)
        root = header.select("run_id", F.col("root").alias("span_id"), F.lit("session").alias("kind"), F.lit("session").alias("name"), F.lit("ok").alias("status"),
                             iso_ms("first_ts").alias("start_ms"), F.col("first_ts").alias("start_raw"), F.col("root").alias("agent_session"),
                             F.col("session").alias("prov_file"), F.lit(1).alias("prov_line"))
        spans = root
        for part in (llm, tools, subs, hooks):
            spans = spans.unionByName(part, allowMissingColumns=True)
        # a span id seen in two transcripts keeps the main one
        w = Window.partitionBy("run_id", "span_id").orderBy("prov_file", "prov_line", "kind")
        spans = land(spans.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn"))
        spans = extend_containers(loaded(root, spans, bad).spans)
        return loaded(self._runs(header, rec, redact), spans, self._warnings(bad, not_sessions, header, rec, calls, deleg, reach, ids))

    def _subagents(self, d, groups, metas, reach, ids, rec, calls, hide, redact) -> DataFrame:
        child = groups.filter("agent <> ''").groupBy("session", "agent").agg(F.max("end_ms").alias("c_end"), F.bool_or("api_error").alias("c_err"))
        side = reach.filter("via = 'sidecar'").join(metas, ["session", "agent"])
        # a resultless call whose agent is known from a sidecar is that delegation
        d = d.join(side.select("session", F.col("m_tool").alias("tool_id_"), F.lit(True).alias("claimed")).filter("tool_id_ is not null").distinct(),
                   ["session", "tool_id_"], "left").filter("claimed is null or r_agent is not null")
        d = d.join(child.select("session", F.col("agent").alias("r_agent"), "c_end", "c_err"), ["session", "r_agent"], "left")
        fork = (F.col("r_status") == "forked") & F.col("c_end").isNotNull()
        st = F.coalesce("r_status", F.lit(""))
        status = (F.when(fork & F.col("c_err"), "error").when(F.col("is_error").isNull(), "in_progress").when(F.col("rejected"), "cancelled").when(F.col("is_error"), "error")
                  .when(st.contains("error") | st.contains("fail"), "error").when(st.contains("cancel"), "cancelled")
                  .when(st.rlike("running|progress|pending"), "in_progress").otherwise("ok"))
        typ = F.coalesce(vstr("input", "$.subagent_type"), F.col("r_command"), F.lit("unknown"))
        end = F.coalesce(F.when(fork, F.col("c_end")), F.col("r_ms"))
        s = F.coalesce("ms", "g_start", F.lit(0))
        rows = d.select("run_id", F.col("agent_span").alias("span_id"), F.col("tool_id_").alias("parent_id"), F.lit("subagent").alias("kind"),
                        F.concat(F.lit("subagent:"), typ).alias("name"), status.alias("status"), s.alias("start_ms"), F.col("ts").alias("start_raw"), end.alias("end_ms"),
                        span_between(s, end).alias("duration_ms"), typ.alias("agent_name"), F.col("r_agent").alias("agent_session"),
                        hide(vstr("input", "$.description")).alias("delegation_reason"), F.lit(redact).alias("content_redacted"),
                        F.col("file").alias("prov_file"), F.col("line").alias("prov_line"))
        first = rec.filter("agent <> ''").groupBy("session", "agent").agg(F.min_by("ms", F.when(F.col("ms").isNotNull(), F.col("line"))).alias("f_ms"),
                                                                          F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line"))).alias("f_ts"))
        tool_ids = calls.select("session", F.col("tool_id_").alias("m_tool"), F.col("ms").alias("a_ms")).dropDuplicates(["session", "m_tool"])
        a = (side.join(ids, "session").join(first, ["session", "agent"]).join(tool_ids, ["session", "m_tool"], "left")
             .join(child, ["session", "agent"], "left"))
        s2 = F.coalesce("f_ms", "a_ms", F.lit(0))
        adopted = a.select("run_id", F.col("agent").alias("span_id"), F.when(F.col("a_ms").isNotNull(), F.col("m_tool")).otherwise(F.col("m_parent")).alias("parent_id"),
                           F.lit("subagent").alias("kind"), F.concat(F.lit("subagent:"), F.col("m_name")).alias("name"),
                           F.when(F.coalesce("c_err", F.lit(False)), "error").otherwise("ok").alias("status"), s2.alias("start_ms"), F.col("f_ts").alias("start_raw"),
                           F.col("c_end").alias("end_ms"), span_between(s2, F.col("c_end")).alias("duration_ms"), F.col("m_name").alias("agent_name"),
                           F.col("agent").alias("agent_session"), hide(F.col("m_desc")).alias("delegation_reason"), F.lit(redact).alias("content_redacted"),
                           F.col("file").alias("prov_file"), F.lit(1).alias("prov_line"))
        return rows.unionByName(adopted)

    def _hooks(self, h: DataFrame, calls: DataFrame) -> DataFrame:
        known = calls.select("file", F.col("tool_id_").alias("hook_tool"), F.lit(True).alias("known"))
        h = h.join(known, ["file", "hook_tool"], "left").withColumn("span_id", F.coalesce("uuid", F.concat("owner", F.lit(":hook:"), F.col("line"))))
        each = h.select("run_id", "span_id", F.coalesce("hook_count", F.lit(1)).alias("hook_count"), F.explode("cmds").alias("command")).filter(
            "trim(command) not in ('', 'callback')")
        cls = classify_commands(each)
        one = hook_summary_identity(each.join(cls, "command", "left")).drop("hook_count")
        h = h.join(one, ["run_id", "span_id"], "left")
        start = F.col("ms") - F.col("dur")
        return h.select("run_id", "span_id", F.when(F.col("known"), F.col("hook_tool")).otherwise(F.col("owner")).alias("parent_id"), F.lit("hook").alias("kind"), "name",
                        "status", "status_reason", start.alias("start_ms"), F.when(F.col("dur") == 0, F.col("ts")).alias("start_raw"), F.col("ms").alias("end_ms"),
                        F.col("dur").alias("duration_ms"), "hook_count", "tool_id", "activity", F.col("file").alias("prov_file"), F.col("line").alias("prov_line"))

    def _runs(self, header: DataFrame, rec: DataFrame, redact: bool) -> DataFrame:
        files = rec.groupBy("session").agg(F.array_sort(F.collect_set("file")).alias("files"))
        name = F.coalesce(F.nullif(basename(F.translate("cwd", "\\", "/")), F.lit("")), F.col("cwd"))
        title = F.lit(None).cast("string") if redact else F.coalesce("custom", "ai")
        return header.join(files, "session").select(
            "run_id", F.lit("claude-code").alias("source"), F.lit("claude-jsonl").alias("format"), title.alias("title"), name.alias("project_name"),
            F.col("cwd").alias("project_path"), F.when(F.col("cwd").isNotNull(), F.col("branch")).alias("git_branch"), iso_ms("first_ts").alias("start_ms"), "files")

    def _warnings(self, bad, not_sessions, header, rec, calls, deleg, reach, ids) -> DataFrame:
        none = F.lit(None).cast("bigint").alias("line")
        legacy = header.join(calls.filter("name = 'Task'").select("session").distinct().withColumn("task", F.lit(True)), "session", "left").filter(
            "legacy or task").select("session", F.lit("legacy subagent format detected (Task tool / isSidechain records): spans parsed flat").alias("message"),
                                     F.col("session").alias("file"), none)
        agents = rec.filter("agent <> ''").select("session", "agent").distinct()
        lost = agents.join(reach, ["session", "agent"], "left_anti").groupBy("session").agg(F.count("*").alias("n")).select(
            "session", F.concat("n", F.lit(" subagent transcript(s) not linked by any tool result or sidecar")).alias("message"), F.col("session").alias("file"), none)
        missing = deleg.filter("r_agent is not null").join(agents.select("session", F.col("agent").alias("r_agent")), ["session", "r_agent"], "left_anti").select(
            "session", F.concat(F.lit("subagent transcript not found for agentId "), "r_agent").alias("message"), "file", "line")
        w = bad.unionByName(not_sessions.withColumn("line", F.lit(None).cast("bigint"))).unionByName(legacy).unionByName(lost).unionByName(missing)
        return w.join(ids.select("session", "run_id"), "session", "left")


def read_session_jsonl(spark: SparkSession, path: str, **options) -> Loaded:
    return SessionJsonlSource().read(spark, path, **options)

