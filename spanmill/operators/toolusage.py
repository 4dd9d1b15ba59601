"""Tool identity and usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import closed_duration, nz
from ..functions.text import mcp_tool_name
from ..session import land
from ..skew import lookup
from .overview import exact_ranks

# Activities in display order.
ACTIVITIES = ["explore", "edit", "run", "check", "build", "test", "vcs", "deps", "infra", "cloud", "data", "web",
              "system", "devices", "agent", "human", "integration", "other"]
FLAGS = ["background", "timeout", "interrupted"]

# Harness tools by exact name -> activity, and the roles of some of them.
HARNESS = {
    "other": "Bash PowerShell bash shell run_shell_command exec_command local_shell",
    "explore": ("Read Glob Grep LS LSP NotebookRead BashOutput TaskOutput read glob grep list read_file "
                "read_many_files list_directory search_file_content view_image"),
    "edit": "Edit Write MultiEdit NotebookEdit edit write patch apply_patch multiedit write_file replace",
    "web": "WebFetch WebSearch webfetch websearch web_fetch google_web_search",
    "agent": ("Agent Task task Skill skill TodoWrite TodoRead TaskCreate TaskUpdate TaskList TaskGet TaskStop KillShell "
              "KillBash EnterPlanMode ToolSearch SendMessage Workflow SlashCommand Monitor ScheduleWakeup EnterWorktree "
              "ExitWorktree StructuredOutput SubagentHandback todowrite todoread update_plan"),
    "human": "AskUserQuestion ExitPlanMode question",
    "integration": "ListMcpResourcesTool ReadMcpResourceTool",
}
ROLES = {"shell": HARNESS["other"], "agent": "Agent Task task", "skill": "Skill skill"}

OTHER_COMMAND = "other-command"
USAGE = ["act", "status", "hook_count", "dur", "tools_also", "tool_flags"]  # what the usage figures read of a span


def _by_name(table: dict[str, str], name: Column) -> Column:
    e = None
    for value, names in table.items():
        cond = name.isin(names.split())
        e = F.when(cond, value) if e is None else e.when(cond, value)
    return e


def tool_label() -> Column:
    return F.coalesce(F.nullif("tool_name", F.lit("")), F.col("name"))


def harness_activity(name: Column) -> Column:
    return F.coalesce(_by_name(HARNESS, name), F.lit("other"))


def activity_of() -> Column:
    """Activity without container knowledge: enough to tell waiting from work."""
    name = tool_label()
    mcp = F.col("mcp_server").isNotNull() | (F.col("kind") == "mcp_call")
    return F.when(F.col("kind") == "hook", F.coalesce("activity", F.lit("other"))).when(mcp, "integration").otherwise(
        F.when(_is_shell(name), F.coalesce("activity", harness_activity(name))).otherwise(harness_activity(name)))


def _is_shell(name: Column) -> Column:
    known = _by_name(HARNESS, name).isNotNull()
    custom = ~known & (F.col("activity").isNotNull() | F.col("tool_id").isNotNull())
    return name.isin(ROLES["shell"].split()) | custom


def command_outcome_flags(background: Column, timed_out: Column, interrupted: Column) -> Column:
    t = F.lit(True)
    return F.array_compact(F.array(F.when(background == t, F.lit(FLAGS[0])), F.when(timed_out == t, F.lit(FLAGS[1])),
                                   F.when(interrupted == t, F.lit(FLAGS[2]))))


def tool_identity(spans: DataFrame, tool_dim: DataFrame | None = None) -> DataFrame:
    """Family, key, sub, detail, activity, flags and container of every tool, MCP and hook span.

    ``tool_dim(tool_id, utility)`` marks the small utilities of the usage table.
    """
    t = spans.filter("kind in ('tool_call', 'mcp_call', 'hook')")
    subs = spans.filter("kind = 'subagent' and parent_id is not null").withColumn("d", closed_duration()).groupBy(
        "run_id", F.col("parent_id").alias("span_id")).agg(
        F.min_by(F.coalesce("agent_name", F.regexp_replace("name", "^subagent:", "")), "span_seq").alias("sub_agent"),
        F.max("d").alias("sub_ms"))
    t = lookup(t, subs, ["run_id", "span_id"])
    name = tool_label()
    call = F.col("kind") != "hook"
    container = call & F.col("sub_agent").isNotNull()
    has_srv = F.coalesce("mcp_server", F.lit("")) != ""
    shell = _is_shell(name)
    stamped = F.col("tool_id").isNotNull()
    role = lambda r: name.isin(ROLES[r].split())
    family = (F.when(~call, "hook").when(container, "agent").when(has_srv | (F.col("kind") == "mcp_call"), "mcp")
              .when(shell, "shell").when(role("skill"), "skill").when(role("agent"), "agent").otherwise("harness"))
    key = (F.when(~call, F.col("name")).when(container, F.col("sub_agent")).when(has_srv, F.col("mcp_server"))
           .when(F.col("kind") == "mcp_call", name)
           .when(shell, F.when(stamped, F.col("tool_id")).when(F.col("activity").isNotNull(), OTHER_COMMAND).otherwise(name))
           .when(role("skill"), F.coalesce(_attr("skill"), name)).otherwise(name))
    sub = (F.when(~call, F.when(F.col("hook_count").isNull(), F.col("tool_id"))).when(container, F.lit(None))
           .when(has_srv, mcp_tool_name(name)).when(shell & stamped, F.col("tool_sub")))
    detail = F.when(shell & ~container & stamped, _attr("toolScript")).when(shell & ~container, _attr("toolName"))
    act = (F.when(~call, F.coalesce("activity", F.lit("other"))).when(container, "agent")
           .when(has_srv | (F.col("kind") == "mcp_call"), "integration")
           .when(shell, F.coalesce("activity", harness_activity(name))).otherwise(harness_activity(name)))
    out = t.withColumns({
        "family": family, "tkey": key, "sub": sub, "detail": detail, "act": act, "container": container,
        "registry": (family == "shell") & stamped,
        "classified": ~((family == "shell") & ~stamped & F.col("activity").isNull()),
        "dur": F.when(container, F.when(closed_duration().isNotNull(), F.greatest(closed_duration(), nz("sub_ms"))))
        .otherwise(closed_duration())})
    if tool_dim is not None:
        u = tool_dim.select(F.col("tool_id").alias("tkey"), F.lit(True).alias("registry"), "utility")
        out = out.join(F.broadcast(u) if tool_dim.limit(10_001).count() <= 10_000 else u, ["tkey", "registry"], "left")
        return out.withColumn("utility", F.coalesce("utility", F.lit(False)))
    return out.withColumn("utility", F.lit(False))


def _attr(key: str) -> Column:
    v = F.trim(F.try_element_at(F.col("attributes"), F.lit(key)))
    return F.when((v != "") & (F.length(v) <= 80), v)


def usage_rows(ident: DataFrame, keys: list[str]) -> DataFrame:
    """Usage figures per key; percentiles are exact nearest ranks from a frequency table. ``ident`` is read more than once: a landed frame."""
    timed = F.col("hook_count").isNull() & F.col("dur").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    per_act = ident.groupBy(*keys, "act").agg(
        F.count("*").alias("calls"), n(F.col("status") == "error").alias("errors"), n(F.col("status") == "cancelled").alias("cancelled"),
        n(F.col("hook_count").isNull() & F.col("dur").isNull()).alias("open"), n(F.col("hook_count").isNotNull()).alias("untimed"),
        nz(F.sum("hook_count")).alias("hook_runs"), nz(F.sum(F.when(timed, F.col("dur")))).alias("total_ms"),
        nz(F.sum(F.when(timed & (F.size(F.coalesce("tools_also", F.array())) > 0), F.col("dur")))).alias("shared_ms"),
        F.max(F.when(timed, F.col("dur"))).alias("max_ms"),
        *[n(F.array_contains("tool_flags", f)).alias("flag_" + f) for f in FLAGS])
    adds = ["calls", "errors", "cancelled", "open", "untimed", "hook_runs", "total_ms", "shared_ms", *["flag_" + f for f in FLAGS]]
    order = F.array_position(F.array(*[F.lit(a) for a in ACTIVITIES]), F.col("act"))
    tot = per_act.groupBy(*keys).agg(*[F.sum(a).alias(a) for a in adds], nz(F.max("max_ms")).alias("max_ms"),
                                     F.min_by("act", F.struct(-F.col("total_ms"), order)).alias("activity"))
    freq = land(ident.filter(timed).groupBy(*keys, F.col("dur").alias("ms")).agg(F.count("*").alias("n")))
    ranks = exact_ranks(freq, keys, "ms", {"p50_ms": lambda x: F.greatest(F.lit(1), F.ceil(x * 0.5)),
                                           "p95_ms": lambda x: F.greatest(F.lit(1), F.ceil(x * 0.95))})
    on = [F.col("a." + k).eqNullSafe(F.col("b." + k)) for k in keys]
    cond = on[0]
    for o in on[1:]:
        cond = cond & o
    return tot.alias("a").join(ranks.alias("b"), cond, "left").select(
        "a.*", nz("b.p50_ms").alias("p50_ms"), nz("b.p95_ms").alias("p95_ms"))


def usage_group() -> Column:
    """ranked, or one of the side groups that stay out of summed tool time."""
    return (F.when(F.col("family") == "hook", "hooks").when(F.col("container"), "agents")
            .when(F.col("act") == "human", "waiting").otherwise("ranked"))


def tool_usage(ident: DataFrame, activities: list[str] | None = None, by_run: bool = True) -> DataFrame:
    """Rows per (run, group, family, registry, key) with also-ran time; ``activities`` narrows the ranked rows."""
    d = ident.withColumn("grp", usage_group())
    if activities is not None:
        d = d.filter((F.col("grp") != "ranked") | F.col("act").isin(activities))
    keys = [*(["run_id"] if by_run else []), "grp", "family", "registry", "tkey"]
    d = land(d.select(*keys, *USAGE))
    rows = usage_rows(d, keys)
    also = (d.filter("grp = 'ranked'").select(*([ "run_id"] if by_run else []), "tkey", "dur", F.explode("tools_also").alias("other"))
            .filter(F.col("other") != F.col("tkey")).groupBy(*(["run_id"] if by_run else []), F.col("other").alias("tkey"))
            .agg(F.count("*").alias("also_calls"), nz(F.sum("dur")).alias("also_ms"))
            .withColumn("grp", F.lit("ranked")).withColumn("family", F.lit("shell")).withColumn("registry", F.lit(True)))
    j = rows.join(also, keys, "left" if activities is not None else "full")
    fill = [c for c in j.columns if c not in (*keys, "activity")]
    return j.fillna(0, fill)


def tool_usage_subs(ident: DataFrame) -> DataFrame:
    """Sub-rows by (sub, detail) of every tool row that has at least one named call."""
    keys = ["run_id", "family", "registry", "tkey"]
    named = ident.groupBy(*keys).agg(F.bool_or(F.col("sub").isNotNull() | F.col("detail").isNotNull()).alias("x")).filter("x")
    keys = [*keys, "sub", "detail"]
    return usage_rows(land(ident.join(named.select(*keys[:4]), keys[:4], "left_semi").select(*keys, *USAGE)), keys)


def activity_totals(ident: DataFrame, by_run: bool = True) -> DataFrame:
    """Partition of the summed tool time by activity."""
    d = ident.withColumn("grp", usage_group()).filter("grp = 'ranked'")
    keys = ["run_id"] if by_run else []
    return d.groupBy(*keys, F.col("act").alias("activity")).agg(F.count("*").alias("calls"), nz(F.sum("dur")).alias("total_ms"))


def activity_parts(totals: DataFrame, top: int = 6) -> DataFrame:
    """Six largest named activities, the rest folded, unresolved last; per run."""
    order = F.array_position(F.array(*[F.lit(a) for a in ACTIVITIES]), F.col("activity"))
    t = totals.filter("total_ms > 0").withColumn("ord", order)
    w = Window.partitionBy("run_id", F.col("activity") == "other").orderBy(F.desc("total_ms"), "ord")
    t = t.withColumn("rn", F.row_number().over(w))
    part = F.when(F.col("activity") == "other", "unresolved").when(F.col("rn") <= top, F.col("activity")).otherwise("rest")
    g = t.groupBy("run_id", part.alias("part")).agg(F.sum("total_ms").alias("total_ms"), F.sum("calls").alias("calls"),
                                                    F.count("*").alias("members"))
    s = totals.groupBy("run_id").agg(F.sum("total_ms").alias("summed_ms"))
    return g.join(s, "run_id").select("run_id", "part", "members", "calls", "total_ms",
                                      F.when(F.col("summed_ms") > 0, F.col("total_ms") / F.col("summed_ms")).otherwise(0.0).alias("share"))


def tool_table(usage: DataFrame, utility: DataFrame, family: str = "all", sort: str = "total_ms") -> DataFrame:
    """Ranked rows with two or more utilities of a run folded into one row."""
    r = usage.filter("grp = 'ranked'")
    if family != "all":
        r = r.filter(F.col("family") == family)
    r = r.join(F.broadcast(utility.select(F.col("tool_id").alias("tkey"), "utility")), "tkey", "left").withColumn(
        "utility", nzb("utility") & F.col("registry"))
    n = r.filter("utility").groupBy("run_id").agg(F.count("*").alias("n_util"))
    r = r.join(n, "run_id", "left").withColumn("fold", F.col("utility") & (F.col("n_util") >= 2))
    stats = ["calls", "errors", "cancelled", "open", "untimed", "hook_runs", "total_ms", "shared_ms"]
    plain = r.filter("not fold").select("run_id", "family", F.col("tkey").alias("label"), *stats, "p95_ms", "max_ms", F.lit(1).cast("bigint").alias("members"))
    folded = r.filter("fold").groupBy("run_id").agg(*[F.sum(s).alias(s) for s in stats], F.max("p95_ms").alias("p95_ms"),
                                                    F.max("max_ms").alias("max_ms"), F.count("*").alias("members")).select(
        "run_id", F.lit("shell").alias("family"), F.lit("shell utilities").alias("label"), *stats, "p95_ms", "max_ms", "members")
    return plain.unionByName(folded).orderBy("run_id", F.desc(sort), "label")


def nzb(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def hook_summary_identity(commands: DataFrame) -> DataFrame:
    """One tool per stop-hook summary: only when every command ran it and all are listed.

    ``commands(run_id, span_id, hook_count, tool_id, activity)`` holds one row per listed command.
    """
    g = commands.groupBy("run_id", "span_id").agg(
        F.max("hook_count").alias("hook_count"), F.count("*").alias("listed"), F.count("tool_id").alias("named"),
        F.min("tool_id").alias("lo"), F.max("tool_id").alias("hi"), F.min("activity").alias("alo"), F.max("activity").alias("ahi"))
    one = (F.col("listed") == F.col("hook_count")) & ((F.col("listed") == 1) | (
        (F.col("named") == F.col("listed")) & (F.col("lo") == F.col("hi")) & F.col("alo").eqNullSafe(F.col("ahi"))))
    return g.select("run_id", "span_id", "hook_count", F.when(one, F.col("lo")).alias("tool_id"), F.when(one, F.col("alo")).alias("activity"))
