"""The twelve waste rules. Every rule maps a ``Trace`` to rows of the findings contract."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import (break_shape, closed_end, context_tokens, effective_write_rate, nz, severity, usd)
from ..functions.text import error_snippet
from ..schema import TOOL_KINDS
from ..session import land
from ..skew import CHUNK, chunk_edges, rechunk, scan, with_chunks
from .overview import run_totals
from .pricing import (RATES, context_excess, dominant_model, dominant_rates, downgrade_map, main_calls_ranked,
                      reprice_cells, reprice_spans, with_rates)
from .tree import agent_sums, agents_within


@dataclass(frozen=True)
class Thresholds:
    """Defaults of every rule; override with ``Thresholds.of(retry_min_failures=4, ...)``."""
    retry_min_failures: int = 3
    retry_max_gap: int = 3
    cache_max_hit_rate: float = 0.4
    cache_min_cost: int = 100_000
    cache_min_calls: int = 5
    cache_target_hit_rate: float = 0.6
    bloat_multiplier: float = 2
    bloat_min_median: int = 50_000
    bloat_culprits: int = 3
    sub_min_share: float = 0.5
    sub_min_cost: int = 250_000
    mismatch_min_savings: int = 500_000
    risk_tools: int = 25
    risk_context: int = 150_000
    break_min_prefix: int = 20_000
    break_collapse: float = 0.2
    break_rewrite_floor: int = 10_000
    break_retained: int = 5_000
    break_shrink: float = 0.6
    idle_minutes: float = 5
    idle_rewrite_floor: int = 10_000
    fixed_floor: int = 20_000
    fixed_min_calls: int = 5
    dup_min_repeats: int = 3
    scattered_min: int = 5
    scattered_share: float = 0.2
    output_min_bytes: int = 100_000
    output_top: int = 5
    warn_share: float = 0.02
    warn_floor: int = 50_000
    crit_share: float = 0.1
    crit_floor: int = 1_000_000

    @classmethod
    def of(cls, **over) -> "Thresholds":
        """Partial override. The old name ``retry_min_consecutive`` still works; unknown names are refused."""
        if "retry_min_consecutive" in over:
            over.setdefault("retry_min_failures", over.pop("retry_min_consecutive"))
        over.pop("retry_min_consecutive", None)
        bad = set(over) - {f.name for f in fields(cls)}
        if bad:
            raise ValueError(f"unknown thresholds: {sorted(bad)}")
        t = replace(cls(), **over)
        return replace(t, cache_target_hit_rate=max(t.cache_target_hit_rate, t.cache_max_hit_rate))


@dataclass(frozen=True)
class Trace:
    """Silver tables of one load: placed and priced spans, run headers, rate card."""
    spans: DataFrame
    runs: DataFrame
    pricing: DataFrame
    chunked: bool = False
    thresholds: Thresholds = field(default_factory=Thresholds)
    memo: dict = field(default_factory=dict, compare=False, repr=False)

    def once(self, name: str, make):
        """A result several rules share: computed once and landed in the shared folder."""
        if name not in self.memo:
            self.memo[name] = land(make())
        return self.memo[name]

    @property
    def totals(self) -> DataFrame:
        return self.once("totals", lambda: run_totals(self.spans))

    @property
    def dominant(self) -> DataFrame:
        return self.once("dominant", lambda: dominant_rates(self.spans, self.pricing))

    @property
    def downgrades(self) -> DataFrame:
        if "downgrades" not in self.memo:
            self.memo["downgrades"] = downgrade_map(self.spans, self.pricing)
        return self.memo["downgrades"]

    @property
    def tools(self) -> DataFrame:
        return self.spans.filter(F.col("kind").isin(TOOL_KINDS))

    @property
    def calls(self) -> DataFrame:
        return self.spans.filter("kind = 'llm_call' and model is not null")


# Registration order, class and label of the rules.
RULES = [
    ("retry-loop", "waste", "Repeated failing tool calls"),
    ("low-cache-hit", "opportunity", "Low cache hit-rate"),
    ("context-bloat", "opportunity", "Growing context"),
    ("expensive-subagent", "opportunity", "Expensive subagent"),
    ("dead-end-run", "waste", "Run ended in an error"),
    ("model-mismatch", "opportunity", "Wrong model tier"),
    ("cache-prefix-break", "waste", "Cache prefix broken mid-session"),
    ("idle-cache-expiry", "waste", "Cache expired while idle"),
    ("fixed-context-overhead", "opportunity", "Heavy fixed context"),
    ("duplicate-read", "waste", "Same file re-read unchanged"),
    ("scattered-tool-failures", "waste", "Scattered tool failures"),
    ("oversized-output", "opportunity", "Oversized tool output"),
]
EVIDENCE_ARRAY = 10_000  # rows of longer retry clusters are read from the clusters instead of the array; the result is the same
RULE_ORDER = {r: i for i, (r, _, _) in enumerate(RULES)}


def _finding(df: DataFrame, rule: str, evidence: Column, first_ms: Column, first_id: Column, waste: Column,
             **facts: Column) -> DataFrame:
    kv = [x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        "run_id", F.lit(rule).alias("rule"), F.lit(RULE_ORDER[rule]).alias("rule_order"),
        evidence.cast("array<string>").alias("evidence"), first_ms.alias("first_ms"), first_id.alias("first_id"),
        waste.cast("bigint").alias("waste_micro"),
        (F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")).alias("facts"))


def _top_ids(df: DataFrame, keys: list[str], k: int, order: list[Column], out: str = "ids") -> DataFrame:
    """First k span ids per group under ``order`` (struct fields, ascending), by bounded per-task heaps.

    Rows are first cut to k per (group, slice), then to k per group, so a hot group never sits in one task.
    """
    slim = df.select(*keys, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)],
                                     F.col("span_id").alias("id")).alias("x"),
                     F.pmod(F.xxhash64("span_id"), F.lit(32)).alias("slice"))
    part = _cut_k(_cut_k(slim, [*keys, "slice"], k), keys, k)
    return part.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias(out))


def _cut_k(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    from pyspark.sql import Window
    # row_number <= k is planned with WindowGroupLimit: each task keeps k rows per group before the shuffle
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("x"))).filter(
        F.col("rn") <= k).drop("rn")


# -- W0 / W1 ---------------------------------------------------------------

def retry_clusters(t: Trace) -> DataFrame:
    """Failed tool spans with their cluster: (run, scope, name, target, island) and cluster bounds."""
    return t.once("clusters", lambda: _retry_clusters(t))


def _retry_clusters(t: Trace) -> DataFrame:
    th = t.thresholds
    tools = t.tools.select("run_id", "scope_id", "span_id", "parent_id", "name", "kind", "status", "start_ms",
                           "mcp_server", "output_preview", F.coalesce("target_key", F.lit("")).alias("target"), CHUNK)
    o = ["start_ms", "span_id"]
    s = scan(tools, ["run_id", "scope_id"], o, {"seq": ("rownum", None)}, t.chunked)
    ident = ["run_id", "scope_id", "name", "target"]
    s = scan(s, ident, o, {"prev_status": ("lag", F.col("status")), "prev_seq": ("lag", F.col("seq"))}, t.chunked)
    err = F.col("status") == "error"
    fresh = err & (F.col("prev_seq").isNull() | (F.col("prev_status") != "error")
                   | (F.col("seq") - F.col("prev_seq") - 1 > th.retry_max_gap))
    s = scan(s.withColumn("fresh", fresh.cast("long")), ident, o, {"island": ("sum", F.col("fresh"))}, t.chunked)
    f = land(s.filter(err))  # read twice; the windows run once
    key = [*ident, "island"]
    b = f.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("start_ms").alias("w_start"), F.max("start_ms").alias("w_end"),
        F.min_by("span_id", F.struct(*o)).alias("first_id"), F.max_by("span_id", F.struct(*o)).alias("last_id"))
    return f.join(b.filter(F.col("n") >= th.retry_min_failures), key)


def cluster_heads(t: Trace) -> DataFrame:
    return retry_clusters(t).filter("span_id = first_id")


def claimed_calls(t: Trace) -> DataFrame:
    """(call -> first cluster that bills it): parents of failures and same-scope calls in the window.

    Windows of one scope are cut to disjoint intervals (a cluster keeps what earlier ones left),
    so the window side is one backward as-of scan instead of a range join.
    """
    return t.once("claimed", lambda: _claimed_calls(t))


def _claimed_calls(t: Trace) -> DataFrame:
    cl = retry_clusters(t)
    heads = cl.filter("span_id = first_id").select("run_id", "scope_id", "first_id", "w_start", "w_end", CHUNK)
    heads = scan(heads.withColumnRenamed("w_start", "start_ms").withColumnRenamed("first_id", "span_id"),
                 ["run_id", "scope_id"], ["start_ms", "span_id"], {"covered": ("prev_max", F.col("w_end"))}, t.chunked)
    own = heads.filter("covered is null or covered < w_end").select(
        "run_id", "scope_id", F.greatest("start_ms", F.coalesce(F.col("covered") + 1, F.col("start_ms"))).alias("at"),
        F.lit(0).alias("tag"), F.lit(None).cast("string").alias("call_id"),
        F.struct(F.col("start_ms").alias("c_start"), F.col("span_id").alias("c_id"), F.col("w_end").alias("c_end"))
        .alias("c"), F.lit(None).cast("long").alias("cost_micro"), F.col("start_ms").alias("head_ms"), CHUNK)
    calls = t.spans.filter("kind = 'llm_call'").select(
        "run_id", "scope_id", F.col("start_ms").alias("at"), F.lit(1).alias("tag"), F.col("span_id").alias("call_id"),
        F.lit(None).cast("struct<c_start:bigint,c_id:string,c_end:bigint>").alias("c"), "cost_micro",
        F.lit(None).cast("long").alias("head_ms"), CHUNK)
    both = own.unionByName(calls)
    if t.chunked:
        both = rechunk(both, chunk_edges(calls, "at"), "at")
    j = scan(both, ["run_id", "scope_id"], ["at", "tag"], {"hit": ("last", F.col("c"))}, t.chunked)
    win = j.filter("tag = 1 and hit is not null and at <= hit.c_end").select(
        "run_id", "call_id", "cost_micro", F.col("hit.c_start").alias("c_start"), F.col("hit.c_id").alias("c_id"))
    par = cl.select("run_id", F.col("parent_id").alias("call_id"), F.col("w_start").alias("c_start"),
                    F.col("first_id").alias("c_id")).groupBy("run_id", "call_id").agg(
        F.min(F.struct("c_start", "c_id")).alias("c"))
    par = par.join(t.spans.filter("kind = 'llm_call'").select("run_id", F.col("span_id").alias("call_id"), "cost_micro"),
                   ["run_id", "call_id"]).select("run_id", "call_id", "cost_micro", "c.c_start", "c.c_id")
    return win.unionByName(par).groupBy("run_id", "call_id").agg(
        F.max("cost_micro").alias("cost_micro"), F.min(F.struct("c_start", "c_id")).alias("c")).select(
        "run_id", "call_id", "cost_micro", F.col("c.c_id").alias("first_id"))


def retry_loop(t: Trace) -> DataFrame:
    cl = retry_clusters(t)
    billed = claimed_calls(t).groupBy("run_id", "first_id").agg(F.sum("cost_micro").alias("w"))
    last = cl.filter("span_id = last_id").select("run_id", "first_id", error_snippet("output_preview").alias("last_error"))
    ev = _ordered_ids(cl, ["run_id", "first_id"])
    h = (cl.filter("span_id = first_id").join(ev, ["run_id", "first_id"]).join(billed, ["run_id", "first_id"], "left")
         .join(last, ["run_id", "first_id"], "left"))
    return _finding(h, "retry-loop", F.col("ids"), F.col("start_ms"), F.col("first_id"), nz("w"),
                    name=F.col("name"), failures=F.col("n"), kind=F.col("kind"), mcp_server=F.col("mcp_server"),
                    last_error=F.col("last_error"), scope=F.col("scope_id"), target=F.col("target"))


def _ordered_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("start_ms", "span_id"))), lambda x: x["span_id"]).alias("ids"))


# -- W2, W3 ----------------------------------------------------------------

def low_cache_hit(t: Trace) -> DataFrame:
    th = t.thresholds
    hit = t.totals.filter((F.col("hit_rate") < th.cache_max_hit_rate) & (F.col("cost_micro") > th.cache_min_cost)
                          & (F.col("llm_calls") >= th.cache_min_calls))
    dom = t.dominant.drop("model")
    unc = t.calls.filter("tok_input > 0 and coalesce(tok_cache_read, 0) = 0")
    ev = _top_ids(unc, ["run_id"], 5, [F.col("span_seq")])
    j = hit.join(dom, "run_id", "left").join(ev, "run_id", "left")
    gain = F.greatest(F.lit(0.0), F.lit(th.cache_target_hit_rate) - F.col("hit_rate"))
    waste = F.when(F.col("pattern").isNotNull(), F.floor(
        gain * (F.col("tok_input") + F.col("tok_cache_read")) * ((F.col("in_u") - F.col("read_u")) / F.lit(1e6)) + 0.5))
    return _finding(j, "low-cache-hit", F.coalesce("ids", F.array()), F.col("start_ms"), F.lit(""), waste,
                    hit_rate=F.col("hit_rate"), cache_read=F.col("tok_cache_read"), input=F.col("tok_input"))


def context_bloat(t: Trace) -> DataFrame:
    th = t.thresholds
    x = context_excess(t.spans, t.pricing, chunked=t.chunked, dominant=t.dominant)
    x = x.filter((F.col("last_median") > F.lit(th.bloat_multiplier) * F.col("baseline"))
                 & (F.col("last_median") > th.bloat_min_median))
    big = _top_ids(t.tools.filter("output_bytes > 0"), ["run_id"], th.bloat_culprits, [-F.col("output_bytes"), F.col("span_id")])
    starts = t.totals.select("run_id", "start_ms")
    j = x.join(big, "run_id", "left").join(starts, "run_id")
    return _finding(j, "context-bloat", F.concat("last_ids", F.coalesce("ids", F.array())), F.col("start_ms"), F.lit(""),
                    F.col("micro_base"), first=F.col("baseline"), last=F.col("last_median"), excess=F.col("tokens_base"))


# -- W4, W6 ----------------------------------------------------------------

def expensive_roots(t: Trace) -> DataFrame:
    """Innermost subagents whose subtree cost passes the share and floor gates."""
    return t.once("expensive", lambda: _expensive_roots(t))


def _expensive_roots(t: Trace) -> DataFrame:
    th = t.thresholds
    own = (t.spans.filter("kind = 'llm_call' and owner_id is not null").groupBy("run_id", F.col("owner_id").alias("agent_id"))
           .agg(nz(F.sum("cost_micro")).alias("sub_micro")))
    sub = agent_sums(t.spans, own, ["sub_micro"]).withColumnRenamed("agent_id", "root_id")
    q = (sub.join(t.totals.select("run_id", F.col("cost_micro").alias("run_micro")), "run_id")
         .filter((F.col("run_micro") > 0) & (F.col("sub_micro") > F.lit(th.sub_min_share) * F.col("run_micro"))
                 & (F.col("sub_micro") > th.sub_min_cost)))
    subs = t.spans.filter("kind = 'subagent'").select(
        "run_id", F.col("span_id").alias("root_id"), "start_ms", F.coalesce("agent_name", "name").alias("agent"))
    q = land(q.join(subs, ["run_id", "root_id"]))
    flagged = q.select("run_id", F.col("root_id").alias("agent_id"), F.lit(1).cast("bigint").alias("flagged"))
    innermost = agent_sums(t.spans, flagged, ["flagged"]).filter("flagged = 1").select("run_id", F.col("agent_id").alias("root_id"))
    return q.join(innermost, ["run_id", "root_id"], "left_semi")


def expensive_subagents(t: Trace) -> DataFrame:
    roots = expensive_roots(t)
    calls = t.calls
    inside = agents_within(t.spans, roots).select("run_id", F.col("agent_id").alias("owner_id"), "root_id")
    under = calls.join(inside, ["run_id", "owner_id"])
    dom = dominant_model(under, ["run_id", "root_id"])
    tgt = dom.join(t.downgrades.select("model", "suggestion"), "model", "left").drop("model")
    rated = tgt.withColumnRenamed("suggestion", "target")
    p = under.join(with_rates(rated, t.pricing, "target", "t_"), ["run_id", "root_id"], "left").withColumn(
        "suggestion", F.col("target")).withColumn("target", F.coalesce("target", "model"))
    from ..functions.money import cost_micro as at
    cur = F.when(F.col("cost_source") != "unknown", F.col("cost_micro"))
    delta = F.when(F.col("target") == F.col("model"), F.when(cur.isNotNull(), F.lit(0).cast("bigint"))).when(
        cur.isNotNull() & F.col("t_pattern").isNotNull(), at("t_") - cur)
    d = p.withColumn("delta", delta).groupBy("run_id", "root_id").agg(
        nz(F.sum("delta")).alias("delta"), F.max("suggestion").alias("suggestion"))
    j = roots.join(d, ["run_id", "root_id"], "left")
    saving = F.when(F.col("suggestion").isNotNull() & (F.col("delta") < 0), -F.col("delta"))
    return _finding(j, "expensive-subagent", F.array("root_id"), F.col("start_ms"), F.col("root_id"), saving,
                    agent=F.col("agent"), subtree_usd=usd("sub_micro"), run_usd=usd("run_micro"), target=F.col("suggestion"))


def model_mismatch(t: Trace) -> DataFrame:
    th = t.thresholds
    sugg = t.downgrades.filter("suggestion is not null").select("model", F.col("suggestion").alias("target"))
    calls = t.calls.join(sugg.select("model"), "model", "left_semi")
    rp = reprice_spans(calls, t.pricing, sugg)
    # risk flags do not depend on the model; "unpriced" does: other models map to themselves
    base = reprice_cells(t.spans, reprice_spans(t.spans, t.pricing), th.risk_tools, th.risk_context)
    inside = _within(t, expensive_roots(t))
    cell = F.coalesce("owner_id", F.lit(""))
    per = rp.withColumn("cell_id", cell).groupBy("run_id", "model", "target", "cell_id").agg(
        F.count("*").alias("n"), nz(F.sum("delta_micro")).alias("delta"),
        F.count(F.when(F.col("delta_micro").isNull(), 1)).alias("u"),
        nz(F.sum(F.when(F.col("delta_micro").isNotNull(), F.col("current_micro")))).alias("cur"))
    per = (per.join(base.select("run_id", "cell_id", "flags"), ["run_id", "cell_id"])
           .join(inside, ["run_id", "cell_id"], "left"))
    safe = (F.size("flags") == 0) & (F.col("u") == 0) & F.col("inside").isNull()
    per = land(per.withColumn("safe", safe))
    g = per.groupBy("run_id", "model", "target").agg(
        F.sum("n").alias("n"), nz(F.sum(F.when(F.col("safe"), -F.col("delta")))).alias("saving"),
        nz(F.sum(F.when(F.col("safe"), F.col("cur")))).alias("cur"))
    g = g.filter(F.col("saving") >= th.mismatch_min_savings)
    sp = (rp.withColumn("cell_id", cell).join(per.filter("safe").select("run_id", "model", "cell_id"),
                                              ["run_id", "model", "cell_id"]).filter("delta_micro is not null"))
    ev = _top_ids(sp, ["run_id", "model"], 5, [F.col("delta_micro"), F.col("span_id")])
    e = land(g.join(ev, ["run_id", "model"]))
    starts = (e.select("run_id", "model", F.explode("ids").alias("span_id"))
              .join(t.spans.select("run_id", "span_id", "start_ms"), ["run_id", "span_id"])
              .groupBy("run_id", "model").agg(F.min("start_ms").alias("first_ms")))
    e = e.join(starts, ["run_id", "model"])
    title = F.concat(F.col("n").cast("string"), F.lit(" calls on "), F.col("model"))
    return _finding(e, "model-mismatch", F.col("ids"), F.col("first_ms"), title, F.col("saving"),
                    model=F.col("model"), target=F.col("target"), calls=F.col("n"), safe_current_usd=usd("cur"))


def _within(t: Trace, roots: DataFrame) -> DataFrame:
    """Cells that are, or lie under, one of the roots."""
    return agents_within(t.spans, roots).select("run_id", F.col("agent_id").alias("cell_id"), F.lit(True).alias("inside"))


# -- W5 --------------------------------------------------------------------

def dead_end_run(t: Trace) -> DataFrame:
    s = t.spans
    pick = F.struct("span_id", "name", "status", "start_ms", "status_reason", "output_preview")
    last = s.filter("kind not in ('session', 'hook')").groupBy("run_id").agg(F.max_by(pick, F.col("span_seq")).alias("l"))
    sess = s.filter("kind = 'session' and status = 'error'").groupBy("run_id").agg(
        F.min_by(pick, F.col("span_seq")).alias("s"))
    term = (last.join(sess, "run_id", "full").select("run_id", F.coalesce(
        "s", F.when(F.col("l.status") == "error", F.col("l"))).alias("x")).filter("x is not null"))
    mark = (t.tools.filter("status = 'ok' and (lines_added is not null or lines_removed is not null)")
            .groupBy("run_id").agg(F.max(F.struct("start_ms", "span_id", "name")).alias("m")))
    term = term.join(mark, "run_id", "left").join(t.totals.select("run_id", F.col("cost_micro").alias("run_micro")), "run_id")
    tail = (s.filter("kind = 'llm_call'").select("run_id", F.col("span_id").alias("call_id"), "start_ms", "cost_micro")
            .join(mark, "run_id").filter(F.col("start_ms") > F.col("m.start_ms"))
            .join(claimed_calls(t).select("run_id", "call_id"), ["run_id", "call_id"], "left_anti")
            .groupBy("run_id").agg(nz(F.sum("cost_micro")).alias("tail")))
    j = term.join(tail, "run_id", "left")
    waste = F.when(F.col("m").isNull(), F.col("run_micro")).otherwise(F.greatest(F.lit(0).cast("bigint"), nz("tail")))
    return _finding(j, "dead-end-run", F.array("x.span_id"), F.col("x.start_ms"), F.col("x.span_id"), waste,
                    terminal=F.col("x.name"), marker=F.col("m.name"),
                    why=F.coalesce(F.col("x.status_reason"), error_snippet(F.col("x.output_preview"))))


# -- W7 .. W9 --------------------------------------------------------------

def cache_pairs(t: Trace) -> DataFrame:
    """Neighbouring calls (a, this) of one scope and model whose second call wrote enough to matter."""
    floor = min(t.thresholds.break_rewrite_floor, t.thresholds.idle_rewrite_floor)
    return t.once("pairs", lambda: live_cache_1h(t).filter(F.col("a").isNotNull() & (nz("tok_cache_write") >= floor)))


def live_cache_1h(t: Trace) -> DataFrame:
    """Calls with the TTL class of the cache that was live at them, and their predecessor in the stream."""
    c = t.calls.withColumn("ctx", context_tokens())
    writes = nz("tok_cache_write") > 0
    flag = F.when(writes, nz("cache_write_1h") * 2 >= F.col("tok_cache_write"))
    a = F.struct("span_id", "start_ms", closed_end().alias("end_ms"), nz("tok_cache_read").alias("read"),
                 nz("tok_cache_write").alias("write"), "ctx", "live_1h")
    key, o = ["run_id", "scope_id", "model"], ["start_ms", "span_id"]
    cols = ["run_id", "scope_id", "model", "span_id", "start_ms", "end_ms", "tok_input", "tok_cache_read",
            "tok_cache_write", "cache_write_1h", "ctx", *RATES, CHUNK]
    s = scan(c.select(*cols, flag.alias("w1h")), key, o, {"live": ("last", F.col("w1h"))}, t.chunked)
    s = s.withColumn("live_1h", F.coalesce("live", F.lit(False)))
    return scan(s, key, o, {"a": ("lag", a)}, t.chunked)


def _idle(t: Trace) -> Column:
    th = t.thresholds
    ttl = F.when(F.col("a.live_1h"), F.lit(float(max(th.idle_minutes, 60)))).otherwise(F.lit(float(th.idle_minutes)))
    return (F.col("start_ms") - F.col("a.end_ms") >= ttl * 60_000) & (nz("tok_cache_write") >= th.idle_rewrite_floor)


def _rewrite_waste(tokens: Column) -> Column:
    return F.when(F.col("pattern").isNotNull(), F.floor(
        tokens * (effective_write_rate() - F.col("read_u") / F.lit(1e6)) + 0.5))


def cache_prefix_break(t: Trace) -> DataFrame:
    th = t.thresholds
    p = cache_pairs(t).filter(
        (F.col("a.read") >= th.break_min_prefix) & (nz("tok_cache_read") <= F.lit(th.break_collapse) * F.col("a.read"))
        & (nz("tok_cache_write") >= th.break_rewrite_floor) & ~_idle(t))
    lost = F.least(nz("tok_cache_write"), F.col("a.read"))
    shape = break_shape(F.col("a.ctx"), F.col("ctx"), nz("tok_cache_read"), th.break_shrink, th.break_retained)
    return _finding(p, "cache-prefix-break", F.array("a.span_id", "span_id"), F.col("a.start_ms"), F.col("a.span_id"),
                    _rewrite_waste(lost), shape=shape, model=F.col("model"), read_before=F.col("a.read"),
                    read_after=nz("tok_cache_read"), written=nz("tok_cache_write"), rewritten=lost)


def idle_cache_expiry(t: Trace) -> DataFrame:
    lost = F.least(nz("tok_cache_write"), F.col("a.read") + F.col("a.write"))
    p = cache_pairs(t).filter(_idle(t)).filter(lost > 0)
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") - F.col("a.end_ms"))
    return _finding(p, "idle-cache-expiry", F.array("a.span_id", "span_id"), F.col("a.start_ms"), F.col("a.span_id"),
                    _rewrite_waste(lost), model=F.col("model"), gap_ms=gap, read_before=F.col("a.read"),
                    read_after=nz("tok_cache_read"), written=nz("tok_cache_write"), rewritten=lost,
                    live_1h=F.col("a.live_1h"))


# -- W10 .. W13 ------------------------------------------------------------

def fixed_context_overhead(t: Trace) -> DataFrame:
    th = t.thresholds
    m = main_calls_ranked(t.spans, t.chunked).filter("pos = 1").filter(
        (F.col("n_main") >= th.fixed_min_calls) & (F.col("ctx") >= th.fixed_floor))
    dom = t.dominant.drop("model")
    servers = (t.spans.filter("mcp_server is not null").select("run_id", "mcp_server").distinct()
               .groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_list("mcp_server")), ",").alias("servers")))
    j = m.drop(*RATES).join(dom, "run_id", "left").join(servers, "run_id", "left")
    over = F.col("ctx") - th.fixed_floor
    waste = F.when(F.col("pattern").isNotNull(), F.floor(
        over * (effective_write_rate() + F.col("read_u") / F.lit(1e6) * (F.col("n_main") - 1)) + 0.5))
    return _finding(j, "fixed-context-overhead", F.array("span_id"), F.col("start_ms"), F.col("span_id"), waste,
                    footprint=F.col("ctx"), overhead=over, rereads=F.col("n_main") - 1, servers=F.col("servers"))


def duplicate_reads(t: Trace) -> DataFrame:
    th = t.thresholds
    ok = t.tools.filter("status = 'ok' and target_key is not null and target_kind in ('file-read', 'file-write')")
    ok = ok.select("run_id", "scope_id", "span_id", "start_ms", "target_key", "target_label", "output_bytes", "target_kind",
                   F.when(F.col("target_kind") == "file-write", 0).otherwise(1).alias("tag"), CHUNK)
    w = scan(ok, ["run_id", "target_key"], ["start_ms", "tag", "span_id"],
             {"write_ms": ("last", F.when(F.col("tag") == 0, F.col("start_ms")))}, t.chunked)
    key, o = ["run_id", "scope_id", "target_key"], ["start_ms", "span_id"]
    r = scan(w.filter("tag = 1"), key, o, {"prev_ms": ("lag", F.col("start_ms")), "rn": ("rownum", None)}, t.chunked)
    red = F.col("prev_ms").isNotNull() & (F.col("write_ms").isNull() | (F.col("write_ms") <= F.col("prev_ms")))
    r = land(r.withColumn("red", red))
    g = r.groupBy(*key).agg(
        F.count("*").alias("reads"), F.count(F.when(F.col("red"), 1)).alias("wasted"),
        nz(F.sum(F.when(F.col("red"), nz("output_bytes")))).alias("bytes"),
        F.min(F.struct("start_ms", "span_id")).alias("first"), F.min_by("target_label", F.struct("start_ms", "span_id")).alias("display"))
    g = g.filter(F.col("wasted") >= th.dup_min_repeats - 1)
    ev = _top_ids(r.filter("red or rn = 1"), key, 10, [F.col("start_ms"), F.col("span_id")])
    j = g.join(ev, key).join(t.dominant.drop("model"), "run_id", "left")
    waste = F.when(F.col("pattern").isNotNull(), F.floor(F.col("bytes") / 4 * F.col("in_u") / F.lit(1e6) + 0.5))
    return _finding(j, "duplicate-read", F.col("ids"), F.col("first.start_ms"), F.col("first.span_id"), waste,
                    target=F.coalesce("display", "target_key"), reads=F.col("reads"), wasted=F.col("wasted"),
                    bytes=F.col("bytes"))


def reactions(t: Trace, failures: DataFrame) -> DataFrame:
    """Forward as-of: per failure the first same-scope call starting at or after its end."""
    f = failures.select("run_id", "scope_id", F.greatest("start_ms", closed_end()).alias("at"), F.lit(0).alias("tag"),
                        "span_id", F.lit(None).cast("struct<id:string,cost:bigint>").alias("call"), CHUNK)
    c = t.calls.select("run_id", "scope_id", F.col("start_ms").alias("at"), F.lit(1).alias("tag"), "span_id",
                       F.struct(F.col("span_id").alias("id"), F.col("cost_micro").alias("cost")).alias("call"), CHUNK)
    both = f.unionByName(c)
    if t.chunked:
        both = rechunk(both, chunk_edges(c, "at"), "at")
    return scan(both, ["run_id", "scope_id"], ["at", "tag", "span_id"], {"next": ("next_first", F.col("call"))},
                t.chunked).filter("tag = 0").select("run_id", "span_id", F.col("next.id").alias("call_id"),
                                                    F.col("next.cost").alias("cost_micro"))


def scattered_failures(t: Trace) -> DataFrame:
    th = t.thresholds
    f = land(t.tools.filter("status = 'error'").select("run_id", "span_id", "scope_id", "name", "start_ms", "end_ms", "output_preview", CHUNK)
             .join(retry_clusters(t).select("run_id", "span_id"), ["run_id", "span_id"], "left_anti"))
    n = f.groupBy("run_id").agg(F.count("*").alias("n"))
    gate = land(n.join(t.totals.select("run_id", "tool_calls"), "run_id").filter(
        (F.col("n") >= th.scattered_min) & (F.col("n") / F.col("tool_calls") >= th.scattered_share)))
    f = land(f.join(gate.select("run_id"), "run_id", "left_semi"))
    w = (reactions(t, f).filter("call_id is not null").groupBy("run_id", "call_id").agg(F.max("cost_micro").alias("c"))
         .groupBy("run_id").agg(F.sum("c").alias("w")))
    names = f.groupBy("run_id", "name").agg(F.count("*").alias("k"),
                                            F.max(F.struct("start_ms", "span_id", error_snippet("output_preview").alias("e"))).alias("last"))
    dom = names.groupBy("run_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "name", F.col("last.e").alias("e"))).alias("d"))
    ev = _top_ids(f, ["run_id"], 10, [F.col("start_ms"), F.col("span_id")])
    first = f.groupBy("run_id").agg(F.min(F.struct("start_ms", "span_id")).alias("first"))
    j = gate.join(w, "run_id", "left").join(dom, "run_id").join(ev, "run_id").join(first, "run_id")
    return _finding(j, "scattered-tool-failures", F.col("ids"), F.col("first.start_ms"), F.col("first.span_id"), nz("w"),
                    failures=F.col("n"), tool_calls=F.col("tool_calls"), dominant=F.col("d.name"),
                    dominant_count=-F.col("d.k"), last_error=F.col("d.e"))


def oversized_outputs(t: Trace) -> DataFrame:
    th = t.thresholds
    o = t.tools.filter(F.col("output_bytes") >= th.output_min_bytes)
    g = o.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("output_bytes").alias("bytes"),
                                F.min(F.struct((-F.col("output_bytes")).alias("b"), "span_id", "name", "start_ms")).alias("top"))
    ev = _top_ids(o, ["run_id"], th.output_top, [-F.col("output_bytes"), F.col("span_id")])
    j = g.join(ev, "run_id").join(t.dominant.drop("model"), "run_id", "left")
    waste = F.when(F.col("pattern").isNotNull(), F.floor(F.col("bytes") / 4 * F.col("in_u") / F.lit(1e6) + 0.5))
    return _finding(j, "oversized-output", F.col("ids"), F.col("top.start_ms"), F.col("top.span_id"), waste,
                    outputs=F.col("n"), bytes=F.col("bytes"), largest=F.col("top.name"), largest_bytes=-F.col("top.b"))


REGISTRY = [retry_loop, low_cache_hit, context_bloat, expensive_subagents, dead_end_run, model_mismatch,
            cache_prefix_break, idle_cache_expiry, fixed_context_overhead, duplicate_reads, scattered_failures,
            oversized_outputs]


def apply_rules(t: Trace, rules=None) -> DataFrame:
    """All findings, numbered i1.. per run in (rule order, first evidence) and graded.

    The findings are landed once; numbering goes through ``scan``, since a hot run has many of them.
    """
    th = t.thresholds
    rows = land(reduce(DataFrame.unionByName, [r(t) for r in (rules or REGISTRY)]))
    rows = rows.withColumn("ev", F.array_join(F.slice("evidence", 1, 10), ","))
    order = ["rule_order", "first_ms", "first_id", "ev"]
    rows, chunked = with_chunks(rows, ["run_id"], order)
    rows = scan(rows, ["run_id"], order, {"rn": ("rownum", None)}, chunked).drop("ev", CHUNK)
    rows = rows.join(t.totals.select("run_id", F.col("cost_micro").alias("run_micro")), "run_id")
    sev = severity(F.col("waste_micro"), F.col("run_micro"), th.warn_share, th.warn_floor, th.crit_share, th.crit_floor)
    return rows.withColumn("finding_id", F.concat(F.lit("i"), F.col("rn").cast("string"))).withColumn(
        "severity", sev).withColumn("rule_class", rule_class()).drop("rn")


def evidence_rows(t: Trace, findings: DataFrame) -> DataFrame:
    """(run, finding, span, pos) for every evidence span; the array of a finding holds the same ids."""
    long = (F.col("rule") == "retry-loop") & (F.coalesce(F.col("facts")["failures"].try_cast("bigint"), F.lit(0)) > EVIDENCE_ARRAY)
    short = findings.filter(~long).select("run_id", "finding_id", "rule", F.posexplode("evidence").alias("pos", "span_id"))
    o = scan(retry_clusters(t).filter(F.col("n") > EVIDENCE_ARRAY), ["run_id", "first_id"], ["start_ms", "span_id"],
             {"rn": ("rownum", None)}, t.chunked)
    rest = (findings.filter(long).select("run_id", "finding_id", "rule", "first_id")
            .join(o.select("run_id", "first_id", (F.col("rn") - 1).cast("int").alias("pos"), "span_id"), ["run_id", "first_id"]))
    return short.unionByName(rest.select("run_id", "finding_id", "rule", "pos", "span_id"))


def rule_class(col: str = "rule") -> Column:
    return F.when(F.col(col).isin([r for r, c, _ in RULES if c == "waste"]), "waste").otherwise("opportunity")


def rule_label(col: str = "rule") -> Column:
    e = None
    for r, _, label in RULES:
        e = F.when(F.col(col) == r, label) if e is None else e.when(F.col(col) == r, label)
    return F.coalesce(e, F.col(col))


def wasted_estimate(t: Trace, findings: DataFrame) -> DataFrame:
    """Per run: sum of waste-class estimates, never above the run's cost."""
    w = findings.groupBy("run_id").agg(nz(F.sum(F.when(F.col("rule_class") == "waste", F.col("waste_micro")))).alias("w"))
    return t.totals.join(w, "run_id", "left").select(
        "run_id", "cost_micro", F.least(nz("w"), F.col("cost_micro")).alias("wasted_micro"))

