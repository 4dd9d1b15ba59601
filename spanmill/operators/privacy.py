"""Redaction, pseudonyms, pruning and the path check of sanitised exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, path_shapes
from ..skew import bounded, global_row_number
from .known_names import names_in_texts
from .tree import NODE

# Attribute keys that describe a call without quoting it.
GEN_AI_KEYS = """gen_ai.system gen_ai.provider.name gen_ai.operation.name gen_ai.output.type gen_ai.conversation.id
gen_ai.agent.id gen_ai.agent.name gen_ai.request.model gen_ai.request.max_tokens gen_ai.request.temperature
gen_ai.request.top_p gen_ai.request.top_k gen_ai.request.frequency_penalty gen_ai.request.presence_penalty
gen_ai.request.seed gen_ai.request.choice.count gen_ai.response.id gen_ai.response.model
gen_ai.response.finish_reasons gen_ai.tool.name gen_ai.tool.call.id gen_ai.tool.type gen_ai.usage.input_tokens
gen_ai.usage.output_tokens gen_ai.usage.cache_read.input_tokens gen_ai.usage.cache_creation.input_tokens
gen_ai.usage.prompt_tokens gen_ai.usage.completion_tokens gen_ai.usage.cost""".split()
# Reserved keys (written without their emitter's prefix); display and free-form names are not here.
RESERVED_KEYS = ["targetKey", "targetKind", "mcpDetection", "cacheWrite1hTokens", "tool", "toolSub", "toolVia", "toolsAlso",
                 "toolFlags", "activity", "hookCount"]

CONTENT = ["prompt_preview", "output_preview", "delegation_reason"]
PROFILES = ["full", "sanitized", "metadata-only"]


def allowed_attribute(key: Column) -> Column:
    return key.isin(*GEN_AI_KEYS, *RESERVED_KEYS)


def scrub_attributes(spans: DataFrame) -> DataFrame:
    return spans.withColumn("attributes", F.map_filter("attributes", lambda k, v: allowed_attribute(k)))


def redact_text(spans: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Null every preview, drop titles and display targets; counts stay. Meant to run before any write."""
    had = reduce(Column.__or__, [F.col(c).isNotNull() for c in CONTENT]) | F.col("kind").isin("llm_call", "subagent", "turn")
    s = spans.withColumn("content_redacted", had).withColumns({c: F.lit(None).cast("string") for c in CONTENT})
    return s.withColumn("target_label", F.lit(None).cast("string")), runs.withColumn("title", F.lit(None).cast("string"))


def identity_table(runs: DataFrame, spans: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(kind, value, alias): distinct projects, branches and files of the whole batch, numbered in order.

    Values are made distinct first; the number is a range-partitioned global position.
    """
    def vals(kind: str, df: DataFrame, col: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), col.alias("value")).filter("value is not null and value <> ''")

    parts = [vals("project", runs, F.coalesce(F.nullif("project_path", F.lit("")), F.col("project_name"))),
             vals("branch", runs, F.col("git_branch")), vals("transcript", runs, F.explode("files")),
             vals("transcript", spans, F.col("prov_file"))]
    if warnings is not None:
        parts.append(vals("transcript", warnings, F.col("file")))
    d = reduce(DataFrame.unionByName, parts).distinct()
    n = global_row_number(d, ["kind", "value"], "pos")
    first = n.groupBy("kind").agg(F.min("pos").alias("base"))
    return n.join(F.broadcast(first), "kind").select(
        "kind", "value", F.concat("kind", F.lit("-"), F.col("pos") - F.col("base") + 1).alias("alias"))


def scrub_identity(runs: DataFrame, spans: DataFrame, table: DataFrame,
                   warnings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Replace projects, branches and files by their aliases (equi-joins); titles are dropped."""
    def alias(kind: str, key: str) -> DataFrame:
        return bounded(table.filter(F.col("kind") == kind).select(F.col("value").alias(key), F.col("alias").alias(key + "_alias")))

    r = runs.withColumn("pk", F.coalesce(F.nullif("project_path", F.lit("")), F.col("project_name")))
    r = r.join(alias("project", "pk"), "pk", "left").join(alias("branch", "git_branch"), "git_branch", "left")
    f = (runs.select("run_id", F.posexplode("files").alias("i", "f")).join(alias("transcript", "f"), "f", "left")
         .groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "f_alias"))), lambda x: x["f_alias"]).alias("new_files")))
    r = r.join(f, "run_id", "left").withColumns({
        "project_name": F.col("pk_alias"), "project_path": F.when(F.col("project_path").isNotNull(), F.col("pk_alias")),
        "git_branch": F.when(F.col("git_branch").isNotNull(), F.coalesce("git_branch_alias", F.lit("branch-1"))),
        "files": F.coalesce("new_files", F.array().cast("array<string>")), "title": F.lit(None).cast("string")})
    s = scrub_attributes(spans).join(alias("transcript", "prov_file"), "prov_file", "left").withColumn(
        "prov_file", F.coalesce("prov_file_alias", F.when(F.col("prov_file").isNotNull(), F.lit("transcript-1")))).select(*spans.columns)
    w = None
    if warnings is not None:
        w = warnings.join(alias("transcript", "file"), "file", "left").withColumn(
            "file", F.when(F.col("file").isNotNull(), F.coalesce("file_alias", F.lit("transcript-1")))).select(*warnings.columns)
    return r.select(*runs.columns), s, w


def nearest_container(spans: DataFrame) -> DataFrame:
    """(run, span, container): nearest self-or-ancestor session or subagent."""
    keep = F.col("kind").isin("session", "subagent")
    return spans.select(*NODE, F.when(keep, F.col("span_id")).otherwise(F.col("container_id")).alias("container_id"))


def prune_to_metadata(spans: DataFrame) -> DataFrame:
    """Sessions and subagents only, hanging under their nearest surviving ancestor."""
    return spans.filter("kind in ('session', 'subagent')").withColumn("parent_id", F.col("container_id"))


def reanchor_evidence(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Evidence rows moved to their nearest container, duplicates dropped, first position kept."""
    j = evidence.join(nearest_container(spans), ["run_id", "span_id"]).filter("container_id is not null")
    return j.groupBy("run_id", "finding_id", F.col("container_id").alias("span_id")).agg(F.min("pos").alias("pos"))


def reanchored(findings: DataFrame, evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings whose evidence names surviving containers only; ``evidence`` has a row per id (run_id, finding_id, span_id, pos)."""
    moved = reanchor_evidence(evidence, spans).groupBy("run_id", "finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "span_id"))).alias("kept"))
    ids = F.coalesce(F.transform("kept", lambda x: x["span_id"]), F.array().cast("array<string>"))
    return (findings.join(moved, ["run_id", "finding_id"], "left").withColumn("evidence", ids)
            .withColumn("first_id", F.get("evidence", F.lit(0))).select(*findings.columns))


def resolve_profile(profile: str | None = None, strip_text: bool = False, scrub: bool = False, prune: bool = False) -> str:
    if profile in PROFILES:
        return profile
    return "metadata-only" if prune else "sanitized" if strip_text and scrub else "full"


def manifest(spans: DataFrame, profile: str) -> DataFrame:
    """One row stating what was done, with the number of exported spans."""
    p = resolve_profile(profile)
    return spans.agg(F.count("*").alias("spans")).select(
        F.lit(p).alias("profile"), F.lit(p != "full").alias("text_redacted"), F.lit(p != "full").alias("paths_scrubbed"),
        F.lit(p == "metadata-only").alias("spans_pruned"), "spans")


def sanitize(runs: DataFrame, spans: DataFrame, profile: str, warnings: DataFrame | None = None):
    """full / sanitized / metadata-only; identity is scrubbed over the batch before anything is pruned."""
    p = resolve_profile(profile)
    if p == "full":
        return runs, spans, warnings
    s, r = redact_text(spans, runs)
    r, s, w = scrub_identity(r, s, identity_table(runs, spans, warnings), warnings)
    return r, (prune_to_metadata(s) if p == "metadata-only" else s), w


def path_hits(df: DataFrame) -> DataFrame:
    """Local path shapes per string column (arrays and maps included); one row per offending column."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            cols.append((f.name, F.col(f.name)))
        elif t == "array<string>":
            cols.append((f.name, F.array_join(f.name, "\n")))
        elif t == "map<string,string>":
            cols.append((f.name, F.array_join(F.map_values(f.name), "\n")))
    g = df.agg(*[F.coalesce(F.sum(F.size(path_shapes(c))), F.lit(0)).alias(n) for n, c in cols])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("hits")) for n, _ in cols])
    return g.select(F.explode(rows).alias("r")).select("r.*").filter("hits > 0")


def known_project_names(runs: DataFrame) -> DataFrame:
    """(name): project names and last parts of project paths, as the logs have them; read them before aliases replace them."""
    p = F.translate("project_path", "\\", "/")
    each = F.explode(F.array("project_name", "project_path", basename(F.regexp_replace(p, "/+$", ""))))
    return runs.select(each.alias("name")).filter("name is not null and name <> ''").distinct()


def assert_no_paths(*frames: DataFrame, basenames: DataFrame | None = None) -> None:
    """Fail the job when any output text holds a path shape, or one of the known names (``basenames.name``) anywhere inside it."""
    found = [f"{r['column']}: {r['hits']}" for df in frames for r in path_hits(df).collect()]
    if basenames is not None:
        for df in frames:
            # the message names a few; the check itself has seen all
            found += [f"{r['column']}: known name in {r['cells']}" for r in names_in_texts(df, basenames).orderBy("column", "name").limit(5).collect()]
    if found:
        raise ValueError("path check failed: " + "; ".join(found))


def attr_valid(key: Column, value: Column, tool: Column, tool_ids: list[str], subs: dict[str, list[str]], runners: list[str]) -> Column:
    """Closed-vocabulary check of a tool attribute that arrived from outside."""
    from .toolusage import ACTIVITIES, FLAGS
    arr = F.from_json(value, "array<string>")

    def all_in(allowed: list[str], limit: int) -> Column:
        ok = F.array(*[F.lit(a) for a in allowed])
        return arr.isNotNull() & (F.size(arr) > 0) & (F.size(arr) <= limit) & (F.size(F.array_distinct(arr)) == F.size(arr)) & (F.size(F.array_except(arr, ok)) == 0)

    sub_ok = value.isin("run", "script", "inline")
    for t, names in subs.items():
        sub_ok = sub_ok | ((tool == t) & value.isin(names))
    return F.coalesce(
        F.when(key == "activity", value.isin(ACTIVITIES)).when(key == "tool", value.isin(tool_ids)).when(key == "toolVia", value.isin(runners))
        .when(key == "toolSub", sub_ok).when(key == "toolsAlso", all_in(tool_ids, 8)).when(key == "toolFlags", all_in(FLAGS, len(FLAGS)))
        .when(key == "hookCount", value.rlike(r"^\d+$")), F.lit(False))
