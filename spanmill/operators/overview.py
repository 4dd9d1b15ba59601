"""Roll-ups over runs and across sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import int_div, nz, round_half_up, total_tokens, usd
from ..functions.text import branch_key, local_day, project_key


def run_totals(spans: DataFrame) -> DataFrame:
    """Tokens, cost, counts, depth, cache hit rate, code changes and per-model maps, one row per run.

    Grouped by (run, model) first, so the second step per run only sees a handful of rows.
    """
    call = (F.col("kind") == "llm_call") & F.col("model").isNotNull()
    tool = F.col("kind").isin("tool_call", "mcp_call")
    changed = tool & (F.col("lines_added").isNotNull() | F.col("lines_removed").isNotNull())
    v = spans.withColumn("m", F.when(call, F.col("model")))

    def s(cond: Column, x: str) -> Column:
        return nz(F.sum(F.when(cond, F.col(x))))

    toks = ["tok_input", "tok_output", "tok_cache_read", "tok_cache_write", "tok_reasoning"]
    counts = {"llm_calls": call, "tool_calls": tool, "tool_errors": tool & (F.col("status") == "error"),
              "subagents": F.col("kind") == "subagent", "changes": changed, "priced": call & F.col("cost_micro").isNotNull()}
    lvl1 = v.groupBy("run_id", "m").agg(
        *[s(call, t).alias(t) for t in toks], s(call, "cost_micro").alias("cost_micro"),
        *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()],
        s(changed, "lines_added").alias("lines_added"), s(changed, "lines_removed").alias("lines_removed"),
        F.max("depth").alias("max_depth"), F.min("start_ms").alias("start_ms"),
        F.max(F.coalesce("end_ms", "start_ms")).alias("end_ms"))
    lvl1 = lvl1.withColumn("tok_total", reduce(Column.__add__, [F.col(t) for t in toks]))
    add = [*toks, "tok_total", "cost_micro", *counts]
    out = lvl1.groupBy("run_id").agg(
        *[F.sum(x).alias(x) for x in add], F.sum("lines_added").alias("la"), F.sum("lines_removed").alias("lr"),
        F.max("max_depth").alias("max_depth"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("m").isNotNull() & (F.col("priced") > 0), F.struct("m", "cost_micro"))))).alias("by_model"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("m").isNotNull(), F.struct("m", "tok_total"))))).alias("tokens_by_model"))
    den = F.col("tok_cache_read") + F.col("tok_input")
    return out.select(
        "run_id", *toks, "tok_total", "cost_micro", "llm_calls", "tool_calls", "tool_errors", "subagents", "max_depth",
        F.when(den == 0, F.lit(0.0)).otherwise(round_half_up(F.col("tok_cache_read") / den, 4)).alias("hit_rate"),
        F.when(F.col("changes") > 0, F.col("la")).alias("lines_added"),
        F.when(F.col("changes") > 0, F.col("lr")).alias("lines_removed"),
        "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "by_model", "tokens_by_model")


def run_bounds(spans: DataFrame) -> DataFrame:
    b = spans.groupBy("run_id").agg(F.min("start_ms").alias("start_ms"),
                                    F.max(F.coalesce("end_ms", "start_ms")).alias("end_ms"))
    return b.withColumn("duration_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))


def run_facts(runs: DataFrame, totals: DataFrame, wasted: DataFrame | None = None) -> DataFrame:
    """One row per run: header, totals and wasted estimate; the input of the cross-run roll-ups."""
    head = runs.select("run_id", "source", "format", "title", "project_name", "project_path", "git_branch", "files")
    j = head.join(totals, "run_id")
    if wasted is None:
        return j.withColumn("wasted_micro", F.lit(0).cast("bigint"))
    return j.join(wasted.select("run_id", "wasted_micro"), "run_id", "left").withColumn("wasted_micro", nz("wasted_micro"))


def aggregate_totals(facts: DataFrame) -> DataFrame:
    return facts.agg(usd(nz(F.sum("cost_micro"))).alias("cost_usd"), usd(nz(F.sum("wasted_micro"))).alias("wasted_usd"),
                     nz(F.sum("tok_total")).alias("tokens"), F.count("*").alias("sessions"),
                     nz(F.sum("lines_added")).alias("lines_added"), nz(F.sum("lines_removed")).alias("lines_removed"))


def _models(facts: DataFrame, *keep: str) -> DataFrame:
    """(run, model) rows with cost and tokens from the stored maps."""
    names = F.explode(F.array_union(F.map_keys("by_model"), F.map_keys("tokens_by_model"))).alias("model")
    return facts.select(*keep, "by_model", "tokens_by_model", names).select(
        *keep, "model", nz(F.try_element_at("by_model", F.col("model"))).alias("cost_micro"),
        nz(F.try_element_at("tokens_by_model", F.col("model"))).alias("tok_total"))


def spend_by_day(facts: DataFrame, max_days: int = 30, tz: str = "UTC") -> DataFrame:
    """(day, dim, key): all / model / source splits, gaps zero-filled for dim 'all', last ``max_days`` days."""
    d = facts.withColumn("day", local_day("start_ms", tz))
    sums = [F.sum("cost_micro").alias("cost_micro"), F.sum("tok_total").alias("tokens")]
    every = d.groupBy("day").agg(*sums, F.sum("wasted_micro").alias("wasted_micro"), F.count("*").alias("runs"))
    span = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(
            F.explode(F.sequence(F.greatest(F.col("a"), F.date_sub("b", max_days - 1)), F.col("b"))).alias("day"))
    base = span.join(every, "day", "left").fillna(0)
    src = d.groupBy("day", F.col("source").alias("key")).agg(*sums)
    mod = _models(d, "day").groupBy("day", F.col("model").alias("key")).agg(*sums)

    def part(df: DataFrame, dim: str) -> DataFrame:
        return df.join(F.broadcast(span), "day", "left_semi").select(
            "day", F.lit(dim).alias("dim"), "key", usd("cost_micro").alias("cost_usd"), "tokens",
            F.lit(None).cast("double").alias("wasted_usd"), F.lit(None).cast("bigint").alias("runs"))

    total = base.select("day", F.lit("all").alias("dim"), F.lit("").alias("key"), usd("cost_micro").alias("cost_usd"),
                        "tokens", usd("wasted_micro").alias("wasted_usd"), "runs")
    return total.unionByName(part(src, "source")).unionByName(part(mod, "model"))


def rank(df: DataFrame, keys: list[str], limit: int = 5, by: str = "usd") -> DataFrame:
    """Top ``limit`` by unit, then the other unit, then name (TakeOrderedAndProject)."""
    a, b = ("cost_micro", "tokens") if by == "usd" else ("tokens", "cost_micro")
    return (df.groupBy(*keys).agg(F.sum("cost_micro").alias("cost_micro"), F.sum("tok_total").alias("tokens"))
            .orderBy(F.desc(a), F.desc(b), *keys).limit(limit)
            .select(*keys, usd("cost_micro").alias("cost_usd"), "tokens"))


def top_projects(facts: DataFrame, limit: int = 5, by: str = "usd") -> DataFrame:
    return rank(facts.withColumn("name", project_key()), ["name"], limit, by)


def top_branches(facts: DataFrame, limit: int = 5, by: str = "usd") -> DataFrame:
    """Per (project, branch); runs without a branch share one row."""
    b = facts.withColumn("branch", branch_key()).withColumn(
        "project", F.when(F.col("branch") == "~none", F.lit("")).otherwise(project_key()))
    return rank(b, ["project", "branch"], limit, by)


def top_models(facts: DataFrame, limit: int = 5, by: str = "usd") -> DataFrame:
    return rank(_models(facts).withColumnRenamed("model", "name"), ["name"], limit, by)


def top_sources(facts: DataFrame, limit: int = 5, by: str = "usd") -> DataFrame:
    return rank(facts.withColumnRenamed("source", "name"), ["name"], limit, by)


def session_cost_stats(facts: DataFrame) -> DataFrame:
    """Mean and exact median from a cost frequency table (no per-group buffer of all rows)."""
    freq = facts.groupBy("cost_micro").agg(F.count("*").alias("n"))
    mean = facts.agg(F.sum("cost_micro").alias("s"), F.count("*").alias("n"))
    mid = exact_ranks(freq, [], "cost_micro", {
        "lo": lambda n: int_div(n + 1, 2), "hi": lambda n: int_div(n, 2) + 1})
    return mid.select((mean.select(F.col("s") / F.col("n")).scalar() / 1e6).alias("mean_usd"),
                      ((F.col("lo") + F.col("hi")) / 2e6).alias("median_usd"))


def exact_ranks(freq: DataFrame, keys: list[str], value: str, ranks: dict) -> DataFrame:
    """Values at given 1-based ranks per group, from a (keys, value, n) frequency table.

    The table is summed in value slices first; only the slice that holds a rank is ordered.
    """
    b = freq.withColumn(
        "slice", F.when(F.col(value) <= 0, 0).otherwise(F.floor(F.log2(F.col(value).cast("double") + 1) * 16)).cast("int"))
    per = b.groupBy(*keys, "slice").agg(F.sum("n").alias("sn"))
    tot = per.groupBy(*keys).agg(F.sum("sn").alias("total"))
    from pyspark.sql import Window
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("slice")
    per = per.withColumn("before", F.sum("sn").over(w) - F.col("sn"))
    j = b.join(per.drop("sn"), [*keys, "slice"])
    wv = Window.partitionBy(*keys, "slice").orderBy(value)
    j = j.withColumn("cum", F.col("before") + F.sum("n").over(wv))
    j = j.join(tot, keys) if keys else j.withColumn("total", tot.select("total").scalar())
    pick = [F.min(F.when(F.col("cum") >= f(F.col("total")), F.col(value))).alias(name) for name, f in ranks.items()]
    return j.groupBy(*keys).agg(*pick) if keys else j.agg(*pick)


def cache_aggregate(facts: DataFrame) -> DataFrame:
    den = F.sum("tok_cache_read") + F.sum("tok_input")
    return facts.agg(F.when(nz(den) == 0, F.lit(0.0)).otherwise(F.sum("tok_cache_read") / den).alias("hit_rate"),
                     nz(F.sum("tok_cache_read")).alias("cache_read_tokens"))


def error_rate(facts: DataFrame) -> DataFrame:
    return facts.agg(F.when(nz(F.sum("tool_calls")) == 0, F.lit(0.0))
                     .otherwise(F.sum("tool_errors") / F.sum("tool_calls")).alias("rate"),
                     nz(F.sum("tool_errors")).alias("errors"), nz(F.sum("tool_calls")).alias("calls"))


def worst_tool(spans: DataFrame) -> DataFrame:
    """Tool with most failures; classified shell calls count under their program."""
    f = spans.filter("kind in ('tool_call', 'mcp_call') and status = 'error'")
    name = F.coalesce(F.when(F.col("tool_id").isNotNull() & F.col("mcp_server").isNull(), F.col("tool_id")),
                      F.nullif("tool_name", F.lit("")), F.nullif("name", F.lit("")), F.lit("tool"))
    key = F.when(F.col("tool_id").isNotNull() & F.col("mcp_server").isNull(), "shell").otherwise("tool")
    return (f.groupBy(key.alias("family"), name.alias("name")).agg(F.count("*").alias("failures"))
            .orderBy(F.desc("failures"), "name", "family").limit(1).select("name", "failures"))


def priciest_call(spans: DataFrame) -> DataFrame:
    c = spans.filter("kind = 'llm_call' and model is not null")
    return c.agg(usd(nz(F.max(F.when(F.col("cost_source") != "unknown", F.col("cost_micro"))))).alias("max_cost_usd"),
                 nz(F.max(total_tokens())).alias("max_tokens"))


def waste_by_rule(findings: DataFrame) -> DataFrame:
    f = findings.filter("waste_micro > 0").withColumn(
        "sev", F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    # two-step distinct: per (rule, run) first
    per = f.groupBy("rule", "run_id").agg(F.count("*").alias("n"), F.sum("waste_micro").alias("w"), F.max("sev").alias("sev"))
    return per.groupBy("rule").agg(
        F.sum("n").alias("findings"), F.count("*").alias("sessions"), usd(F.sum("w")).alias("total_usd"),
        F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.max("sev") + 1).alias("worst_severity"))


def waste_entries(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings behind ``waste_by_rule``, worst first within a rule."""
    return (findings.filter("waste_micro > 0").join(runs.select("run_id", F.coalesce("title", "source").alias("run_title")), "run_id")
            .select("rule", "run_id", "run_title", "finding_id", "severity", usd("waste_micro").alias("usd"))
            .orderBy("rule", F.desc("usd"), "finding_id", "run_id"))


def savings_summary(facts: DataFrame, findings: DataFrame) -> DataFrame:
    a = facts.agg(nz(F.sum("wasted_micro")).alias("b"), nz(F.sum("cost_micro")).alias("c"))
    o = findings.agg(nz(F.sum(F.when(F.col("rule_class") == "opportunity", F.col("waste_micro")))).alias("o"),
                     F.count("*").alias("findings"))
    return a.select("b", "c", o.select("o").scalar().alias("o"), o.select("findings").scalar().alias("findings")).select(
        usd("b").alias("burned_usd"), F.when(F.col("c") > 0, F.col("b") / F.col("c")).otherwise(0.0).alias("burned_share"),
        usd("o").alias("opportunity_usd"), "findings")


def top_changes(findings: DataFrame, n: int = 3) -> DataFrame:
    return waste_by_rule(findings).orderBy(F.desc("total_usd"), "rule").limit(n)


def tokens_by_model(spans: DataFrame) -> DataFrame:
    return (spans.filter("kind = 'llm_call' and model is not null and model <> ''").groupBy("run_id", "model")
            .agg(F.sum(total_tokens()).alias("tokens")))


def warnings_count(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("run_id").agg(F.count("*").alias("warnings"))


def run_summaries(facts: DataFrame, findings: DataFrame, coverage: DataFrame) -> DataFrame:
    n = findings.groupBy("run_id").agg(F.count("*").alias("findings"))
    u = coverage.select("run_id", "unpriced_calls")
    return facts.join(n, "run_id", "left").join(u, "run_id", "left").select(
        "run_id", "source", F.coalesce("title", "source").alias("title"), project_key().alias("project"), "start_ms",
        "duration_ms", "llm_calls", "tool_calls", "tool_errors", "tok_total", usd("cost_micro").alias("cost_usd"),
        usd("wasted_micro").alias("wasted_usd"), nz("findings").alias("findings"), nz("unpriced_calls").alias("unpriced_calls"))


def run_teaser(facts: DataFrame, findings: DataFrame, top: int = 3) -> DataFrame:
    """The priciest run: its models by share, the remainder and its biggest finding."""
    best = facts.orderBy(F.desc("cost_micro"), F.desc("start_ms"), "run_id").limit(1)
    f = (findings.join(F.broadcast(best.select("run_id")), "run_id", "left_semi")
         .orderBy(F.desc_nulls_last("waste_micro"), "finding_id").limit(1).select("run_id", F.col("rule").alias("top_rule"),
                                                                                 "waste_micro"))
    m = F.array_sort(F.transform(F.map_entries("by_model"), lambda e: F.struct(
        (-e["value"]).alias("neg"), e["key"].alias("model"))))
    b = best.withColumn("ms", m).join(F.broadcast(f), "run_id", "left")
    shown = F.slice("ms", 1, top)
    return b.select(
        "run_id", usd("cost_micro").alias("cost_usd"),
        F.array_join(F.transform(shown, lambda x: x["model"]), ",").alias("models"),
        usd(F.col("cost_micro") + F.aggregate(shown, F.lit(0).cast("bigint"), lambda a, x: a + x["neg"])).alias("rest_usd"),
        F.greatest(F.size("ms") - top, F.lit(0)).alias("rest_models"), "top_rule", usd("waste_micro").alias("top_usd"))


def cost_buckets(spans: DataFrame, bounds: DataFrame, n: int = 48) -> DataFrame:
    """Cost per model in ``n`` equal slices of the run, booked at call end."""
    c = spans.filter("kind = 'llm_call' and cost_micro is not null and cost_micro > 0").select(
        "run_id", "model", "cost_micro", F.coalesce("end_ms", "start_ms").alias("at"))
    j = c.join(bounds.select("run_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b")), "run_id")
    width = F.greatest(F.lit(1).cast("bigint"), F.col("b") - F.col("a"))
    slot = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col("at") - F.col("a")) / width * n))).cast("int")
    return j.groupBy("run_id", slot.alias("bucket"), "model").agg(usd(F.sum("cost_micro")).alias("cost_usd"))

