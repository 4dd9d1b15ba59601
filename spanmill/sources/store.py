"""Message stores: session / message / part records from JSON files, export documents or a database.

Three loaders give the same three tables (``kind``, id columns, ``v`` VARIANT); one emitter turns them
into spans, so a store of millions of sessions is a handful of equi-joins.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import error_preview, is_user_rejection, stable_run_id, target_spec, tool_target
from ..operators.commands import classify_commands
from ..session import land
from .common import PREVIEW, Loaded, line_count, loaded, span_between, vget, vint, vstr

# Tools of the store's own agent; other names with an underscore name an MCP server.
BUILTIN_TOOLS = ["bash", "read", "write", "edit", "glob", "grep", "list", "patch", "apply_patch", "webfetch", "websearch", "task",
                 "todowrite", "todoread", "skill", "question"]


def mcp_by_name(tool: Column) -> Column:
    """Server prefix of a tool outside the built-ins."""
    return F.when(~tool.isin(BUILTIN_TOOLS) & (F.instr(tool, "_") > 1), F.substring_index(tool, "_", 1))


def read_store_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, parts, warnings) of a file store: one JSON document per file."""
    def tree(part: str) -> DataFrame:
        t = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v")))
        return t.filter(F.col("file").contains(f"/{part}/")).withColumn("stem", F.regexp_extract("file", r"([^/]+)\.json$", 1)).withColumn(
            "folder", F.regexp_extract("file", r"([^/]+)/[^/]+\.json$", 1))

    s, m, p = tree("session"), tree("message"), tree("part")
    root = F.regexp_extract("file", r"^(.*)/session/", 1)
    ses = s.filter("v is not null").select(F.coalesce(vstr("v", "$.id"), F.col("stem")).alias("session_id"), "v", "file", root.alias("root"))
    msg = m.filter("v is not null").select(F.col("folder").alias("session_id"), F.coalesce(vstr("v", "$.id"), F.col("stem")).alias("message_id"), "v", "file")
    prt = p.filter("v is not null").select(F.col("folder").alias("message_id"), F.coalesce(vstr("v", "$.id"), F.col("stem")).alias("part_id"), "v", "file")
    bad = s.unionByName(m).unionByName(p).filter("v is null").select(F.lit("unparseable JSON file").alias("message"), "file")
    return ses, msg, prt, bad


def read_export_json(spark: SparkSession, path: str, ndjson: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same tables from ``{info, messages: [{info, parts}]}`` documents."""
    t = spark.read.option("recursiveFileLookup", "true").option("wholetext", str(not ndjson).lower()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("d"))
    ok = t.filter(vstr("d", "$.info.id").isNotNull())
    ses = ok.select(vstr("d", "$.info.id").alias("session_id"), vget("d", "$.info", "variant").alias("v"), "file", F.col("file").alias("root"))
    m = ok.select(vstr("d", "$.info.id").alias("session_id"), "file", F.explode(F.try_variant_get("d", "$.messages", "array<variant>")).alias("m"))
    m = m.withColumn("v", F.coalesce(vget("m", "$.info", "variant"), F.col("m"))).filter(vstr("v", "$.id").isNotNull())
    msg = m.select("session_id", vstr("v", "$.id").alias("message_id"), "v", "file")
    p = m.select(vstr("v", "$.id").alias("message_id"), "file", F.explode(F.try_variant_get("m", "$.parts", "array<variant>")).alias("p"))
    prt = p.filter(vstr("p", "$.id").isNotNull()).select("message_id", vstr("p", "$.id").alias("part_id"), F.col("p").alias("v"), "file")
    return ses, msg, prt, t.filter("d is null").select(F.lit("unparseable JSON file").alias("message"), "file")


def read_store_tables(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same tables from a store's database: ``session``, ``message`` and ``part`` as Parquet folders under ``path``, with the database's columns.

    Land them with any tool, for instance ``spark.read.jdbc``; ``root`` is the folder whose file store the database belongs to.
    """
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").select(F.col("_metadata.file_path").alias("file"), F.parse_json(F.to_json(F.struct("*"))).alias("r"))

    s = table("session").withColumn("v", F.parse_json(F.to_json(F.struct(
        vstr("r", "$.id").alias("id"), vstr("r", "$.parent_id").alias("parentID"), vstr("r", "$.directory").alias("directory"), vstr("r", "$.title").alias("title"),
        F.struct(vget("r", "$.time_created", "bigint").alias("created"), vget("r", "$.time_updated", "bigint").alias("updated")).alias("time")))))
    ses = s.select(vstr("r", "$.id").alias("session_id"), "v", "file", F.lit(root).alias("root"))
    m = table("message").select("file", "r", F.try_parse_json(vstr("r", "$.data")).alias("v"))
    msg = m.filter("v is not null").select(vstr("r", "$.session_id").alias("session_id"), vstr("r", "$.id").alias("message_id"), "v", "file")
    p = table("part").select("file", "r", F.try_parse_json(vstr("r", "$.data")).alias("v"))
    prt = p.filter("v is not null").select(vstr("r", "$.message_id").alias("message_id"), vstr("r", "$.id").alias("part_id"), "v", "file")
    bad = m.filter("v is null").select(F.concat(F.lit("unparseable message row "), vstr("r", "$.id")).alias("message"), "file").unionByName(
        p.filter("v is null").select(F.concat(F.lit("unparseable part row "), vstr("r", "$.id")).alias("message"), "file"))
    return ses, msg, prt, bad


def prefer_db_over_files(files: DataFrame, db: DataFrame) -> DataFrame:
    """Sessions of a file store that the database of the same root does not hold; a database without a root speaks for all."""
    own = db.select(F.col("session_id").alias("own_id"), F.col("root").alias("own_root")).distinct()
    same = (F.col("session_id") == F.col("own_id")) & ((F.col("own_root") == "") | F.startswith("root", F.col("own_root")))
    return files.join(own, same, "left_anti")


def session_roots(ses: DataFrame) -> DataFrame:
    """(session, root session) by following ``parentID``; log2(depth) joins, unknown parents are dropped."""
    cur = ses.select("session_id", vstr("v", "$.parentID").alias("up")).withColumn("top", F.col("session_id"))
    while True:
        cur = land(cur)
        if cur.filter("up is not null").isEmpty():
            return cur.select("session_id", F.col("top").alias("root_session"))
        nxt = cur.select(F.col("session_id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        j = cur.join(nxt, "up", "left")
        cur = j.filter("up is null or top2 is not null").select(
            "session_id", F.when(F.col("up").isNotNull(), F.col("up2")).alias("up"), F.when(F.col("up").isNotNull(), F.col("top2")).otherwise(F.col("top")).alias("top"))


def store_spans(ses: DataFrame, msg: DataFrame, prt: DataFrame, fmt: str, redact: bool = False) -> Loaded:
    """Assistant messages to calls, tool parts to tool calls, task parts to subagents, orphans to the root."""
    none = F.lit(None).cast("string")
    hide = (lambda c: none) if redact else (lambda c: c)
    ses = land(ses.join(session_roots(ses), "session_id"))
    run = stable_run_id(F.col("root_session"))
    first_text = prt.filter(vstr("v", "$.type") == "text").groupBy("message_id").agg(
        F.min_by(F.substring(vstr("v", "$.text"), 1, PREVIEW), "part_id").alias("text"))
    a = msg.filter(vstr("v", "$.role") == "assistant").join(ses.select("session_id", "root_session", vget("v", "$.time.created", "bigint").alias("s_start")), "session_id")
    a = a.withColumns({"m_start": vget("v", "$.time.created", "bigint"), "m_end": vget("v", "$.time.completed", "bigint")})
    p = prt.filter(vstr("v", "$.type") == "tool").join(a.select("message_id", "session_id", "root_session", "m_start", "s_start"), "message_id")
    p = p.withColumns({"tool": F.coalesce(vstr("v", "$.tool"), F.lit("unknown")), "p_start": vget("v", "$.state.time.start", "bigint"),
                       "p_end": vget("v", "$.state.time.end", "bigint"), "st": vstr("v", "$.state.status"),
                       "failure": F.coalesce(vstr("v", "$.state.error"), vstr("v", "$.state.error.message"), vstr("v", "$.state.error.name"))})
    st = F.when(F.col("st") == "completed", "ok").when(F.col("st") == "error", "error").when(F.col("st").isin("running", "pending"), "in_progress").otherwise("unknown")
    p = p.withColumn("base_status", st)
    p = p.withColumn("rejected", (F.col("base_status") == "error") & is_user_rejection("failure"))
    task = p.filter("tool = 'task'").withColumn("child", vstr("v", "$.state.metadata.sessionId"))
    task = task.withColumn("agent_span", F.coalesce("child", F.concat("part_id", F.lit(":agent"))))
    w = Window.partitionBy("root_session", "agent_span").orderBy("message_id", "part_id")
    task = land(task.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn"))
    kids = ses.filter("session_id <> root_session")
    linked = task.filter("child is not null").select(F.col("child").alias("session_id"), F.coalesce("p_start", "m_start", "s_start").alias("owner_start"))
    orphans = kids.join(linked.select("session_id"), "session_id", "left_anti")
    # a child without a start of its own takes the one of the span it hangs under
    starts = ses.join(linked, "session_id", "left").join(ses.select(F.col("session_id").alias("root_session"), vget("v", "$.time.created", "bigint").alias("r_start")), "root_session")
    starts = starts.select("session_id", F.coalesce(vget("v", "$.time.created", "bigint"), "owner_start", "r_start", F.lit(0)).alias("ses_start"))
    a = a.join(starts, "session_id")
    model = F.coalesce(vstr("v", "$.modelID"), vstr("v", "$.model.modelID"), F.lit("unknown"))
    m_start = F.coalesce("m_start", "ses_start")
    up = first_text.select(F.col("message_id").alias("parent_mid"), F.col("text").alias("prompt"))
    a = a.withColumn("parent_mid", vstr("v", "$.parentID")).join(up, "parent_mid", "left").join(first_text, "message_id", "left")
    llm = a.select(
        run.alias("run_id"), F.col("message_id").alias("span_id"), F.col("session_id").alias("parent_id"), F.lit("llm_call").alias("kind"), model.alias("name"),
        F.when(F.schema_of_variant(vget("v", "$.error", "variant")).startswith("OBJECT"), "error").otherwise("ok").alias("status"), m_start.alias("start_ms"),
        F.col("m_end").alias("end_ms"), span_between(m_start, F.col("m_end")).alias("duration_ms"),
        F.coalesce(vstr("v", "$.providerID"), vstr("v", "$.model.providerID"), F.lit("unknown")).alias("provider"), model.alias("model"),
        vint("v", "$.tokens.input").alias("tok_input"), vint("v", "$.tokens.output").alias("tok_output"), vint("v", "$.tokens.cache.read").alias("tok_cache_read"),
        vint("v", "$.tokens.cache.write").alias("tok_cache_write"), F.nullif(vint("v", "$.tokens.reasoning"), F.lit(0).cast("bigint")).alias("tok_reasoning"),
        F.lit("unknown").alias("cost_source"), vstr("v", "$.finish").alias("stop_reason"), hide(F.col("prompt")).alias("prompt_preview"),
        hide(F.col("text")).alias("output_preview"), F.lit(redact).alias("content_redacted"), F.col("file").alias("prov_file"), F.col("message_id").alias("prov_record"))
    p = p.join(starts, "session_id")
    kind, fld = target_spec("opencode", "tool")
    raw = F.coalesce(*[F.when(fld == f, F.nullif(vstr("v", "$.state.input." + f), F.lit(""))) for f in ("filePath", "command")])
    p = p.withColumns({"t": tool_target(kind, raw), "server": mcp_by_name(F.col("tool")), "command": F.when(F.col("tool") == "bash", vstr("v", "$.state.input.command"))})
    p = p.join(classify_commands(p).withColumnRenamed("command", "cmd_text"), F.col("command") == F.col("cmd_text"), "left")
    ok = F.col("base_status") == "ok"
    added = F.when(F.col("tool") == "edit", line_count(vstr("v", "$.state.input.newString"))).when(F.col("tool") == "write", line_count(vstr("v", "$.state.input.content")))
    removed = F.when(F.col("tool") == "edit", line_count(vstr("v", "$.state.input.oldString")))
    p_start = F.coalesce("p_start", "m_start", "ses_start")
    tools = p.select(
        run.alias("run_id"), F.col("part_id").alias("span_id"), F.col("message_id").alias("parent_id"), F.when(F.col("server").isNull(), "tool_call").otherwise("mcp_call").alias("kind"),
        F.col("tool").alias("name"), F.when(F.col("rejected"), "cancelled").otherwise(F.col("base_status")).alias("status"), F.when(F.col("rejected"), "user-rejected").alias("status_reason"),
        p_start.alias("start_ms"), F.col("p_end").alias("end_ms"), span_between(p_start, F.col("p_end")).alias("duration_ms"), F.col("tool").alias("tool_name"),
        F.col("server").alias("mcp_server"), F.octet_length(vstr("v", "$.state.output")).cast("bigint").alias("output_bytes"), F.when(ok, added).alias("lines_added"),
        F.when(ok, removed).alias("lines_removed"), hide(F.when(F.col("base_status") == "error", error_preview("failure"))).alias("output_preview"),
        F.lit(redact).alias("content_redacted"), F.col("t.key").alias("target_key"), F.col("t.kind").alias("target_kind"), hide(F.col("t.display")).alias("target_label"),
        "activity", "tool_id", "tool_sub", "tools_also", F.when(F.col("server").isNotNull(), F.create_map(F.lit("mcpDetection"), F.lit("name-heuristic"))).alias("attributes"),
        F.col("file").alias("prov_file"), F.col("part_id").alias("prov_record"))
    typ = F.coalesce(vstr("v", "$.state.input.subagent_type"), F.lit("unknown"))
    t_start = F.coalesce("p_start", "m_start", "s_start", F.lit(0))
    subs = task.select(
        run.alias("run_id"), F.col("agent_span").alias("span_id"), F.col("part_id").alias("parent_id"), F.lit("subagent").alias("kind"), F.concat(F.lit("subagent:"), typ).alias("name"),
        F.col("base_status").alias("status"), t_start.alias("start_ms"), F.col("p_end").alias("end_ms"), span_between(t_start, F.col("p_end")).alias("duration_ms"),
        typ.alias("agent_name"), F.col("child").alias("agent_session"), hide(vstr("v", "$.state.input.description")).alias("delegation_reason"), F.lit(redact).alias("content_redacted"),
        F.col("file").alias("prov_file"), F.col("part_id").alias("prov_record"))
    end = vget("v", "$.time.updated", "bigint")

    def box(df: DataFrame, k: str, name: str, parent: Column) -> DataFrame:
        return df.join(starts, "session_id").select(
            run.alias("run_id"), F.col("session_id").alias("span_id"), parent.alias("parent_id"), F.lit(k).alias("kind"), F.lit(name).alias("name"), F.lit("ok").alias("status"),
            F.col("ses_start").alias("start_ms"), end.alias("end_ms"), span_between(F.col("ses_start"), end).alias("duration_ms"), F.col("session_id").alias("agent_session"),
            F.col("file").alias("prov_file"), F.col("session_id").alias("prov_record"))

    parent_session = vstr("v", "$.parentID")
    spans = box(ses.filter("session_id = root_session"), "session", "session", none).unionByName(box(orphans, "subagent", "subagent:unknown", parent_session))
    for part in (llm, tools, subs):
        spans = spans.unionByName(part, allowMissingColumns=True)
    roots = ses.filter("session_id = root_session")
    folder = F.regexp_extract(F.translate(vstr("v", "$.directory"), "\\", "/"), "([^/]+)/*$", 1)
    runs = roots.select(run.alias("run_id"), F.lit("opencode").alias("source"), F.lit(fmt).alias("format"), hide(vstr("v", "$.title")).alias("title"),
                        F.coalesce(F.nullif(folder, F.lit("")), vstr("v", "$.directory")).alias("project_name"), vstr("v", "$.directory").alias("project_path"),
                        vget("v", "$.time.created", "bigint").alias("start_ms"), end.alias("end_ms"), F.array("file").alias("files"))
    lost = task.filter("child is not null").join(ses.select(F.col("session_id").alias("child")), "child", "left_anti").select(
        run.alias("run_id"), F.concat(F.lit("child session "), "child", F.lit(" referenced by task tool not found")).alias("message"), "file")
    loose = orphans.select(run.alias("run_id"), F.concat(F.lit("child session "), "session_id", F.lit(" not referenced by any task tool: attached to the session root")).alias("message"), "file")
    undated = kids.filter(vget("v", "$.time.created", "bigint").isNull()).select(
        run.alias("run_id"), F.concat(F.lit("child session "), "session_id", F.lit(" has no time.created; its start falls back to the span it hangs under")).alias("message"), "file")
    return loaded(runs, spans, lost.unionByName(loose).unionByName(undated))


class StoreSource:
    name = "opencode"

    def read(self, spark: SparkSession, path: str, kind: str = "files", redact: bool = False, tables: str | None = None) -> Loaded:
        """``kind`` = files, export or tables (a landed database). With ``tables`` beside files both are read, and of a session that both
        hold the database's copy is kept."""
        if kind == "tables":
            return self._emit(read_store_tables(spark, path), "opencode-sqlite", redact)
        if kind == "export":
            return self._emit(read_export_json(spark, path), "opencode-export", redact)
        ses, msg, prt, bad = read_store_json(spark, path)
        if not tables:
            return self._emit((ses, msg, prt, bad), "opencode-storage", redact)
        db = read_store_tables(spark, tables)
        a = self._emit((prefer_db_over_files(ses, db[0]), msg, prt, bad), "opencode-storage", redact)
        b = self._emit(db, "opencode-sqlite", redact)
        return Loaded(*(getattr(a, f).unionByName(getattr(b, f)) for f in ("runs", "spans", "warnings")))

    def _emit(self, tables, fmt: str, redact: bool) -> Loaded:
        ses, msg, prt, bad = tables
        out = store_spans(ses, msg, prt, fmt, redact)
        return Loaded(out.runs, out.spans, out.warnings.unionByName(loaded(out.runs, out.spans, bad).warnings))
