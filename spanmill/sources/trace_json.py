"""Normalised run files: reader and the attribute keys it lifts to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Loaded, iso_ms, loaded

RUN_JSON = """
id STRING, source STRUCT<tool:STRING,format:STRING,files:ARRAY<STRING>>, title STRING,
project STRUCT<name:STRING,path:STRING,gitBranch:STRING>, startedAt STRING, endedAt STRING, durationMs DOUBLE,
warnings ARRAY<STRUCT<message:STRING,file:STRING,line:BIGINT>>,
spans ARRAY<STRUCT<id:STRING,parentId:STRING,kind:STRING,name:STRING,status:STRING,statusReason:STRING,
  startedAt:STRING,endedAt:STRING,durationMs:DOUBLE,depth:INT,
  llm:STRUCT<provider:STRING,model:STRING,tokens:STRUCT<input:BIGINT,output:BIGINT,cacheRead:BIGINT,cacheWrite:BIGINT,reasoning:BIGINT>,
    costUSD:DOUBLE,costSource:STRING,stopReason:STRING>,
  tool:STRUCT<name:STRING,mcpServer:STRING,isError:BOOLEAN,exitCode:INT,outputBytes:BIGINT,linesAdded:BIGINT,linesRemoved:BIGINT>,
  agent:STRUCT<name:STRING,sessionId:STRING>,
  content:MAP<STRING,STRING>,
  attributes:VARIANT,
  provenance:STRUCT<file:STRING,line:BIGINT,recordId:STRING>>>,
totals VARIANT, insights ARRAY<STRUCT<id:STRING,ruleId:STRING,severity:STRING,title:STRING,detail:STRING,spanIds:ARRAY<STRING>,
  estimatedWasteUSD:DOUBLE,suggestion:STRING>>
"""


# Attribute names that emitters write behind a prefix of their own.
KNOWN_KEYS = ["targetKey", "targetKind", "target", "mcpDetection", "cacheWrite1hTokens", "tool", "toolSub", "toolVia", "toolsAlso",
              "toolFlags", "toolActivity", "activity", "hookCount", "toolName", "toolScript", "skill"]
KNOWN_RE = r"^[a-z]+\.(" + "|".join(KNOWN_KEYS) + ")$"


def plain_keys(attrs: Column) -> Column:
    """Attribute map with the emitter's own prefix dropped (``vendor.targetKey`` -> ``targetKey``).

    Every other key keeps its full name.
    """
    def short(k: Column) -> Column:
        return F.when(k.rlike(KNOWN_RE), F.substring_index(k, ".", -1)).otherwise(k)

    entries = F.transform(F.map_entries(attrs), lambda e: F.struct(short(e["key"]).alias("key"), e["value"].alias("value")))
    uniq = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda p: p["key"] == e["key"]))
    return F.map_from_entries(uniq)


def lifted(spans: DataFrame) -> DataFrame:
    """Typed columns from the plain attribute map."""
    def a(k: str) -> Column:
        return F.try_element_at("attributes", F.lit(k))

    def arr(k: str) -> Column:
        return F.from_json(a(k), "array<string>")

    return spans.withColumns({
        "target_key": a("targetKey"), "target_kind": a("targetKind"), "target_label": a("target"), "activity": F.coalesce(a("toolActivity"), a("activity")),
        "tool_id": a("tool"), "tool_sub": a("toolSub"), "tools_also": arr("toolsAlso"), "tool_flags": arr("toolFlags"),
        "hook_count": a("hookCount").try_cast("int"), "cache_write_1h": a("cacheWrite1hTokens").try_cast("double").cast("bigint")})


def read_trace_json(spark: SparkSession, path: str, multiline: bool = True) -> Loaded:
    """Run documents (one per file, or one per line) or envelopes with a ``runs`` array."""
    raw = spark.read.option("multiLine", str(multiline).lower()).schema(f"{RUN_JSON}, runs ARRAY<STRUCT<{_struct(RUN_JSON)}>>").json(path)
    one = raw.filter("id is not null").drop("runs")
    many = raw.filter("runs is not null").select(F.explode("runs").alias("r")).select("r.*")
    r = one.unionByName(many)
    start = iso_ms("startedAt")
    runs = r.select(F.col("id").alias("run_id"), F.col("source.tool").alias("source"), F.col("source.format").alias("format"), "title",
                    F.col("project.name").alias("project_name"), F.col("project.path").alias("project_path"),
                    F.col("project.gitBranch").alias("git_branch"), start.alias("start_ms"), iso_ms("endedAt").alias("end_ms"),
                    F.col("durationMs").cast("bigint").alias("duration_ms"), F.col("source.files").alias("files"))
    warn = r.select(F.col("id").alias("run_id"), F.explode("warnings").alias("w")).select("run_id", "w.*")
    return loaded(runs, lifted(_span_columns(r.select(F.col("id").alias("run_id"), F.explode("spans").alias("s")))), warn)


def _span_columns(s: DataFrame) -> DataFrame:
    """Contract columns of span structs ``s``."""
    t = F.col("s.llm.tokens")
    return s.select(
        "run_id", F.col("s.id").alias("span_id"), F.col("s.parentId").alias("parent_id"), "s.kind", "s.name", "s.status",
        F.col("s.statusReason").alias("status_reason"), iso_ms(F.col("s.startedAt")).alias("start_ms"), F.col("s.startedAt").alias("start_raw"),
        iso_ms(F.col("s.endedAt")).alias("end_ms"), F.col("s.durationMs").cast("bigint").alias("duration_ms"), "s.llm.provider", "s.llm.model",
        t["input"].alias("tok_input"), t["output"].alias("tok_output"), t["cacheRead"].alias("tok_cache_read"),
        t["cacheWrite"].alias("tok_cache_write"), t["reasoning"].alias("tok_reasoning"),
        F.floor(F.col("s.llm.costUSD") * 1e6 + 0.5).cast("bigint").alias("cost_micro"), F.col("s.llm.costSource").alias("cost_source"),
        F.col("s.llm.stopReason").alias("stop_reason"), F.col("s.tool.name").alias("tool_name"), F.col("s.tool.mcpServer").alias("mcp_server"),
        F.col("s.tool.exitCode").alias("exit_code"), F.col("s.tool.outputBytes").alias("output_bytes"), F.col("s.tool.linesAdded").alias("lines_added"),
        F.col("s.tool.linesRemoved").alias("lines_removed"), F.col("s.agent.name").alias("agent_name"), F.col("s.agent.sessionId").alias("agent_session"),
        F.try_element_at("s.content", F.lit("promptPreview")).alias("prompt_preview"),
        F.try_element_at("s.content", F.lit("outputPreview")).alias("output_preview"),
        F.try_element_at("s.content", F.lit("delegationReason")).alias("delegation_reason"),
        F.coalesce(F.exists(F.map_values("s.content"), lambda v: v.isNull()), F.lit(False)).alias("content_redacted"),
        plain_keys(F.try_variant_get("s.attributes", "$", "map<string,string>")).alias("attributes"),
        F.col("s.provenance.file").alias("prov_file"), F.col("s.provenance.line").alias("prov_line"), F.col("s.provenance.recordId").alias("prov_record"))


def read_run_lines(spark: SparkSession, path: str) -> Loaded:
    """Headers and spans of a folder that ``write_trace_json`` wrote."""
    head = read_trace_json(spark, path + "/runs", multiline=False)
    element = spark.createDataFrame([], RUN_JSON).schema["spans"].dataType.elementType.simpleString()
    s = spark.read.schema(f"run_id STRING, span {element}").json(path + "/spans").select("run_id", F.col("span").alias("s"))
    return loaded(head.runs, lifted(_span_columns(s)), head.warnings)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings stored in run documents."""
    raw = spark.read.option("multiLine", "true").schema(RUN_JSON).json(path)
    return _finding_columns(raw.select(F.col("id").alias("run_id"), F.explode("insights").alias("i")))


def read_finding_lines(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a folder that ``write_trace_json`` wrote."""
    element = spark.createDataFrame([], RUN_JSON).schema["insights"].dataType.elementType.simpleString()
    s = spark.read.schema(f"run_id STRING, insight {element}").json(path + "/findings")
    return _finding_columns(s.select("run_id", F.col("insight").alias("i")))


def _finding_columns(f: DataFrame) -> DataFrame:
    return f.select(
        "run_id", F.col("i.id").alias("finding_id"), F.col("i.ruleId").alias("rule"), "i.severity", F.col("i.spanIds").alias("evidence"),
        F.floor(F.col("i.estimatedWasteUSD") * 1e6 + 0.5).cast("bigint").alias("waste_micro"))


def _struct(ddl: str) -> str:
    from ..schema import ddl_columns
    return ",".join(f"{n}:{t}" for n, t in ddl_columns(ddl))
