"""Spend by tool, tool duration statistics and MCP share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import nz, total_tokens, usd
from ..schema import TOOL_KINDS
from .overview import exact_ranks

ORCHESTRATION = "Orchestration / Interface"


def _tool_name():
    return F.coalesce("tool_name", "name")


def _shares(spans: DataFrame) -> DataFrame:
    """(run, call, name, n): distinct tool names a call caused and their number; n null = none.

    A tool belongs to its nearest model-call ancestor, else to every call beside it under the same
    turn or subagent. Names are made distinct before any join, so work follows names, not pairs.
    """
    tools = spans.filter(F.col("kind").isin(TOOL_KINDS)).select(
        "run_id", _tool_name().alias("name"), "parent_id",
        "call_id", F.col("parent_kind").alias("p_kind"))
    direct = tools.filter("call_id is not null").select("run_id", "call_id", "name").distinct()
    boxed = (tools.filter("call_id is null and p_kind in ('turn', 'subagent')")
             .select("run_id", F.col("parent_id").alias("box"), "name").distinct())
    calls = spans.filter("kind = 'llm_call'").select(
        "run_id", F.col("span_id").alias("call_id"), F.col("parent_id").alias("box"), nz("cost_micro").alias("cost"),
        nz("tok_input").alias("inp"), nz("tok_output").alias("outp"), total_tokens().alias("tot"))
    beside = calls.join(boxed, ["run_id", "box"]).select("run_id", "call_id", "name")
    names = direct.unionByName(beside).distinct()
    n = names.groupBy("run_id", "call_id").agg(F.count("*").alias("n"))
    return calls.join(n, ["run_id", "call_id"], "left").join(names, ["run_id", "call_id"], "left")


def _split(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum shares exactly: integer sums per divisor first, then one division per divisor."""
    per = df.groupBy(*keys, "n").agg(*[F.sum(x).alias(x) for x in ("cost", "inp", "outp", "tot")])
    parts = F.array_sort(F.collect_list(F.struct("n", "cost", "inp", "outp", "tot")))

    def total(x: str):
        return F.aggregate("parts", F.lit(0.0), lambda a, p: a + p[x] / p["n"])
    return per.groupBy(*keys).agg(parts.alias("parts")).select(*keys, *[total(x).alias(x) for x in ("cost", "inp", "outp", "tot")])


def _calls_by_tool(spans: DataFrame, keys: list[str]) -> DataFrame:
    t = spans.filter(F.col("kind").isin(TOOL_KINDS)).withColumn("name", _tool_name())
    server = (F.col("kind") == "mcp_call") & F.col("mcp_server").isNotNull()
    return t.groupBy(*keys).agg(F.count("*").alias("calls"),
                                F.max_by("mcp_server", F.when(server, F.col("span_seq"))).alias("mcp_server"))


def _r(x: str):
    return F.floor(nz(x) + 0.5).cast("bigint")


def tool_spend(spans: DataFrame) -> DataFrame:
    """Per run and tool: attributed cost and tokens, invocations; the remainder is orchestration."""
    sh = _shares(spans)
    att = _split(sh.filter("n is not null"), ["run_id", "name"])
    j = att.join(_calls_by_tool(spans, ["run_id", "name"]), ["run_id", "name"], "full")
    rows = j.select("run_id", "name", _r("cost").alias("cost_micro"), _r("inp").alias("tok_input"), _r("outp").alias("tok_output"),
                    _r("tot").alias("tok_all"), nz("calls").alias("calls"), "mcp_server", F.lit(False).alias("orchestration"))
    orch = sh.filter("n is null").groupBy("run_id").agg(
        *[F.sum(x).alias(y) for x, y in (("cost", "cost_micro"), ("inp", "tok_input"), ("outp", "tok_output"), ("tot", "tok_all"))],
        F.count("*").alias("calls")).select(
        "run_id", F.lit(ORCHESTRATION).alias("name"), "cost_micro", "tok_input", "tok_output", "tok_all", "calls",
        F.lit(None).cast("string").alias("mcp_server"), F.lit(True).alias("orchestration"))
    return rows.unionByName(orch)


def tool_duration_stats(spans: DataFrame) -> DataFrame:
    """Calls and nearest-rank p50, p95 and max per tool over all runs, from a frequency table."""
    d = spans.filter(F.col("kind").isin(*TOOL_KINDS, "hook") & (nz("duration_ms") > 0))
    freq = d.groupBy("name", F.col("duration_ms").alias("ms")).agg(F.count("*").alias("n"))
    ranks = exact_ranks(freq, ["name"], "ms", {"p50_ms": lambda n: F.greatest(F.lit(1), F.ceil(n * 0.5)),
                                              "p95_ms": lambda n: F.greatest(F.lit(1), F.ceil(n * 0.95))})
    ends = freq.groupBy("name").agg(F.sum("n").alias("calls"), F.max("ms").alias("max_ms"))
    return ends.join(ranks, "name")


def tool_ranking(spans: DataFrame, limit: int | None = 8, by: str = "usd") -> DataFrame:
    """Tools over all runs by attributed spend, without orchestration; ``limit=None`` = all."""
    s = tool_spend(spans).filter("not orchestration").groupBy("name").agg(
        F.sum("cost_micro").alias("cost_micro"), F.sum("tok_all").alias("tokens"), F.sum("calls").alias("calls"),
        F.max("mcp_server").alias("mcp_server"))
    p = tool_duration_stats(spans).select("name", "p95_ms")
    out = s.join(p, "name", "left").select("name", "mcp_server", usd("cost_micro").alias("cost_usd"), "tokens", "calls",
                                           nz("p95_ms").alias("p95_ms"))
    out = out.orderBy(F.desc("cost_usd" if by == "usd" else "tokens"), "name")
    return out if limit is None else out.limit(limit)


def mcp_share(spans: DataFrame) -> DataFrame:
    """MCP part of the attributed spend and the most expensive server."""
    s = tool_spend(spans).filter("not orchestration").groupBy("name").agg(
        F.sum("cost_micro").alias("c"), F.sum("tok_all").alias("t"), F.max("mcp_server").alias("srv"))
    per = s.groupBy("srv").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    m = F.col("srv").isNotNull()
    return per.agg(F.sum("c").alias("all"), nz(F.sum(F.when(m, F.col("c")))).alias("mc"), nz(F.sum(F.when(m, F.col("t")))).alias("mt"),
                   F.min(F.when(m, F.struct((-F.col("c")).alias("c"), "srv"))).alias("top")).select(
        usd("mc").alias("cost_usd"), F.col("mt").alias("tokens"),
        F.when(F.col("all") > 0, F.col("mc") / F.col("all")).otherwise(0.0).alias("share"), F.col("top.srv").alias("top_server"))
