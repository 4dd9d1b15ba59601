"""Waste rules, findings, triage and diff queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import waste as G
from .catalog import register
from .catalog_tree import CELLS
from .oracle import v1
from .views import _once, conversation_trace, event_trace

SUB_SHARE, SUB_COST, SAVINGS = 0.05, 10_000, 1_000
OVERRIDES = dict(sub_min_share=SUB_SHARE, sub_min_cost=SUB_COST, mismatch_min_savings=SAVINGS)


def trace(spark, sf):
    """V1 with delegation and tier gates lowered to the size of its runs."""
    return _once(spark, ("v1-rules", sf), lambda: replace(
        event_trace(spark, sf), thresholds=R.Thresholds.of(**OVERRIDES), memo={}))


def findings(spark, sf):
    return trace(spark, sf).once("findings", lambda: R.apply_rules(trace(spark, sf)))


RULE_CTES = CELLS + f""",
f_retry as (select h.run_id, 'retry-loop' as rule, 0 as rule_order, h.w_start as first_ms, h.first_id,
    (select string_agg(span_id, ',' order by start_ms, span_id) from clus x where x.run_id = h.run_id and x.first_id = h.first_id) as evidence,
    coalesce((select sum(cost) from claimed c where c.run_id = h.run_id and c.first_id = h.first_id), 0)::bigint as waste_micro from heads h),
f_bloat as (select e.run_id, 'context-bloat' as rule, 2 as rule_order, t.start_ms as first_ms, '' as first_id,
    array_to_string(last_ids, ',') || coalesce(',' || b.ids, '') as evidence,
    case when x.bad = 0 then (x.nano + 500) // 1000 end as waste_micro
  from xedge e join tot t using (run_id)
  join (select run_id, count(*) filter (ctx > baseline and rate is null) as bad,
      coalesce(sum(floor(greatest(ctx - baseline, 0) * rate * 1000 + 0.5)::bigint), 0)::bigint as nano from xcall group by 1) x using (run_id)
  left join (select run_id, string_agg(span_id, ',' order by output_bytes desc, span_id) as ids from (
      select * from tools where output_bytes > 0 qualify row_number() over (partition by run_id order by output_bytes desc, span_id) <= 3) group by 1) b using (run_id)
  where last_median > 2 * baseline and last_median > 50000),
sub as (select run_id, owner_id as root_id, sum(cost)::bigint as sub_micro from calls where owner_id is not null group by 1, 2),
roots as (select s.*, b.start_ms, b.name as agent from sub s join tot using (run_id) join box b on b.run_id = s.run_id and b.span_id = s.root_id
  where cost_micro > 0 and sub_micro > {SUB_SHARE}e0 * cost_micro and sub_micro > {SUB_COST}),
sdom as (select run_id, root_id, model from (select r.run_id, r.root_id, c.model, sum(tok_input + tok_cache_read) as t
    from roots r join calls c on c.run_id = r.run_id and c.owner_id = r.root_id group by all)
  qualify row_number() over (partition by run_id, root_id order by t desc, model) = 1),
sdelta as (select d.run_id, d.root_id, g.target, coalesce(sum(case when cost is null then null when g.target is null or g.target = c.model then 0 else
    (tok_input * t.in_u + (tok_output + coalesce(tok_reasoning, 0)) * t.out_u + tok_cache_read * t.read_u + (tok_cache_write - one_h) * t.write_u
     + one_h * coalesce(t.write1h_u, case when t.pattern like '%claude%' then t.in_u * 2 else t.write_u end) + 500000) // 1000000 - cost end), 0)::bigint as delta
  from sdom d left join dg g using (model) left join rates t on t.pattern = g.target
  join calls c on c.run_id = d.run_id and c.owner_id = d.root_id group by all),
f_sub as (select r.run_id, 'expensive-subagent' as rule, 3 as rule_order, r.start_ms as first_ms, root_id as first_id, root_id as evidence,
    case when target is not null and delta < 0 then -delta end as waste_micro from roots r join sdelta using (run_id, root_id)),
lastspan as (select * from spans where kind not in ('session', 'hook') qualify row_number() over (partition by run_id order by seq desc) = 1),
marker as (select run_id, max(start_ms) as m_ms from tools where status = 'ok' and lines_added is not null group by 1),
f_dead as (select l.run_id, 'dead-end-run' as rule, 4 as rule_order, l.start_ms as first_ms, span_id as first_id, span_id as evidence,
    case when m_ms is null then t.cost_micro else coalesce((select sum(cost) from calls c where c.run_id = l.run_id and c.start_ms > m_ms
      and not exists (select 1 from claimed k where k.run_id = c.run_id and k.call_id = c.span_id)), 0)::bigint end as waste_micro
  from lastspan l join tot t using (run_id) left join marker using (run_id) where status = 'error'),
bflag as (select c.run_id, c.cell_id, errs = 0 and tools < 25 and coalesce(long, 0) = 0 and coalesce(u, 0) = 0 and r.root_id is null as safe
  from cell c left join (select run_id, coalesce(owner_id, '') as cell_id, count(*) filter (tok_input + tok_cache_read >= 150000) as long,
     count(*) filter (cost is null) as u from calls group by 1, 2) using (run_id, cell_id)
  left join roots r on r.run_id = c.run_id and r.root_id = c.cell_id),
safecalls as (select rp.*, repriced - cost as delta from rp join bflag b on b.run_id = rp.run_id and b.cell_id = coalesce(rp.owner_id, '')
  where safe and target <> model and cost is not null),
allcalls as (select run_id, model, count(*) as n from rp where target <> model group by 1, 2),
f_mismatch as (select s.run_id, 'model-mismatch' as rule, 5 as rule_order, min(start_ms) filter (rn <= 5) as first_ms,
    max(n) || ' calls on ' || s.model as first_id, string_agg(span_id, ',' order by rn) filter (rn <= 5) as evidence, -sum(delta)::bigint as waste_micro
  from (select *, row_number() over (partition by run_id, model order by delta, span_id) as rn from safecalls) s
  join allcalls using (run_id, model) group by s.run_id, s.model having -sum(delta) >= {SAVINGS}),
f_break as (select run_id, 'cache-prefix-break' as rule, 6 as rule_order, a_start as first_ms, a_id as first_id, a_id || ',' || span_id as evidence,
    case when pattern is not null then floor(least(tok_cache_write, a_read) * (eff_write - read_u / 1000000e0) + 0.5)::bigint end as waste_micro,
    case when ctx < 0.6e0 * a_ctx then 'compaction' when tok_cache_read < 5000 then 'front' else 'history' end as shape
  from idle where a_read >= 20000 and tok_cache_read <= 0.2e0 * a_read and tok_cache_write >= 10000 and not is_idle),
f_idle as (select run_id, 'idle-cache-expiry' as rule, 7 as rule_order, a_start as first_ms, a_id as first_id, a_id || ',' || span_id as evidence,
    case when pattern is not null then floor(least(tok_cache_write, a_read + a_write) * (eff_write - read_u / 1000000e0) + 0.5)::bigint end as waste_micro
  from idle where is_idle and least(tok_cache_write, a_read + a_write) > 0),
f_fixed as (select m.run_id, 'fixed-context-overhead' as rule, 8 as rule_order, start_ms as first_ms, span_id as first_id, span_id as evidence,
    case when dm.pattern is not null then floor((ctx - 20000) * ((case when tok_cache_write > 0 then
        ((tok_cache_write - one_h) * dm.write_u + one_h * coalesce(dm.write1h_u, case when dm.pattern like '%claude%' then dm.in_u * 2 else dm.write_u end))
        / tok_cache_write / 1000000e0 else dm.write_u / 1000000e0 end) + dm.read_u / 1000000e0 * (n_main - 1)) + 0.5)::bigint end as waste_micro
  from mainc m left join dom d on d.run_id = m.run_id left join matched dm on dm.model = d.model where m.pos = 1 and n_main >= 5 and ctx >= 20000),
rd as (select *, lag(start_ms) over w as prev_ms, row_number() over w as rn from tools where status = 'ok' and target_kind = 'file-read'
  window w as (partition by run_id, scope_id, target_key order by start_ms, span_id)),
red as (select r.*, prev_ms is not null and not exists (select 1 from tools w where w.run_id = r.run_id and w.target_key = r.target_key and w.status = 'ok'
    and w.target_kind = 'file-write' and w.start_ms > r.prev_ms and w.start_ms <= r.start_ms) as red from rd r),
f_dup as (select r.run_id, 'duplicate-read' as rule, 9 as rule_order, min(start_ms) as first_ms, arg_min(span_id, seq) as first_id,
    array_to_string(list_slice(list(span_id order by seq) filter (red or rn = 1), 1, 10), ',') as evidence,
    case when any_value(d_pattern) is not null then floor(coalesce(sum(output_bytes) filter (red), 0)::bigint / 4 * any_value(d_in) / 1000000e0 + 0.5)::bigint end as waste_micro
  from red r left join dom using (run_id) group by r.run_id, scope_id, target_key having count(*) filter (red) >= 2),
sfail as (select f.* from ft f where not exists (select 1 from clus c where c.run_id = f.run_id and c.span_id = f.span_id)),
sgate as (select run_id, count(*) as n, max(tool_calls) as tc from sfail join tot using (run_id) group by 1 having count(*) >= 5 and count(*) / max(tool_calls) >= 0.2),
react as (select f.run_id, f.span_id, arg_min(c.span_id, c.seq) as call_id from sfail f join sgate using (run_id)
  join calls c on c.run_id = f.run_id and c.scope_id = f.scope_id and c.start_ms >= coalesce(f.end_ms, f.start_ms) group by 1, 2),
f_scat as (select g.run_id, 'scattered-tool-failures' as rule, 10 as rule_order, (select min(start_ms) from sfail s where s.run_id = g.run_id) as first_ms,
    (select arg_min(span_id, seq) from sfail s where s.run_id = g.run_id) as first_id,
    (select array_to_string(list_slice(list(span_id order by seq), 1, 10), ',') from sfail s where s.run_id = g.run_id) as evidence,
    coalesce((select sum(cost) from calls c where c.run_id = g.run_id and c.span_id in (select call_id from react r where r.run_id = g.run_id)), 0)::bigint as waste_micro
  from sgate g),
f_big as (select t.run_id, 'oversized-output' as rule, 11 as rule_order, arg_min(start_ms, (-output_bytes, span_id)) as first_ms,
    arg_min(span_id, (-output_bytes, span_id)) as first_id,
    array_to_string(list_slice(list(span_id order by output_bytes desc, span_id), 1, 5), ',') as evidence,
    case when any_value(d_pattern) is not null then floor(sum(output_bytes)::bigint / 4 * any_value(d_in) / 1000000e0 + 0.5)::bigint end as waste_micro
  from tools t left join dom using (run_id) where output_bytes >= 100000 group by t.run_id),
allf as (select * from f_retry union all select * from f_bloat union all select * from f_sub union all select * from f_dead union all select * from f_mismatch
  union all select * exclude (shape) from f_break union all select * from f_idle union all select * from f_fixed union all select * from f_dup
  union all select * from f_scat union all select * from f_big),
fin as (select f.*, 'i' || row_number() over (partition by run_id order by rule_order, first_ms, first_id) as finding_id, t.cost_micro as run_micro,
    case when waste_micro is null or t.cost_micro <= 0 then 'info' when waste_micro / t.cost_micro >= 0.1 and waste_micro >= 1000000 then 'critical'
      when waste_micro / t.cost_micro >= 0.02 and waste_micro >= 50000 then 'warning' else 'info' end as severity,
    case when rule in ('retry-loop', 'dead-end-run', 'cache-prefix-break', 'idle-cache-expiry', 'duplicate-read', 'scattered-tool-failures')
      then 'waste' else 'opportunity' end as rule_class from allf f join tot t using (run_id)),
wasted as (select t.run_id, t.cost_micro, least(coalesce(sum(waste_micro) filter (rule_class = 'waste'), 0)::bigint, t.cost_micro) as wasted_micro
  from tot t left join fin using (run_id) group by t.run_id, t.cost_micro)
"""


def vr(body: str, extra: str = "") -> str:
    return v1(body, RULE_CTES.strip() + (extra and ", " + extra))


def _rule(name: str, fn, cte: str):
    @register(name, vr(f"select run_id, first_ms, first_id, evidence, waste_micro from {cte}"))
    def q(spark, sf):
        return fn(trace(spark, sf)).select("run_id", "first_ms", "first_id", F.array_join("evidence", ",").alias("evidence"),
                                           "waste_micro")
    return q


@register("w0_retry_clusters", v1("select run_id, scope_id, name, tk as target, first_id, n, w_start, w_end from heads"))
def w0(spark, sf):
    return R.cluster_heads(trace(spark, sf)).select("run_id", "scope_id", "name", "target", "first_id", "n", "w_start", "w_end")


@register("w1b_claimed_calls", v1("select run_id, call_id, first_id from claimed"))
def w1b(spark, sf):
    return R.claimed_calls(trace(spark, sf)).select("run_id", "call_id", "first_id")


_rule("w1_retry_loop", R.retry_loop, "f_retry")
_rule("w3_context_bloat", R.context_bloat, "f_bloat")
_rule("w4_expensive_subagents", R.expensive_subagents, "f_sub")
_rule("w5_dead_end_run", R.dead_end_run, "f_dead")
_rule("w6_model_mismatch", R.model_mismatch, "f_mismatch")
_rule("w8_cache_prefix_break", R.cache_prefix_break, "f_break")
_rule("w9_idle_cache_expiry", R.idle_cache_expiry, "f_idle")
_rule("w10_fixed_context_overhead", R.fixed_context_overhead, "f_fixed")
_rule("w11_duplicate_reads", R.duplicate_reads, "f_dup")
_rule("w12_scattered_failures", R.scattered_failures, "f_scat")
_rule("w13_oversized_outputs", R.oversized_outputs, "f_big")

V3 = """with cc as (select 'c' || conv_id as run_id, turn, floor(sum(length(text)) over (partition by conv_id order by turn) / 4)::bigint as tok from conversations)"""


@register("w2_low_cache_hit", V3 + """ select run_id, array_to_string(list_slice(list(run_id || '_' || turn order by turn) filter (tok > 0), 1, 5), ',') as evidence,
    floor(0.6e0 * sum(tok)::bigint * ((3000000 - 300000) / 1000000e0) + 0.5)::bigint as waste_micro from cc group by run_id
  having count(*) >= 5 and sum((tok * 3000000 + 10 * 15000000 + 500000) // 1000000) > 10""")
def w2(spark, sf):
    return R.low_cache_hit(conversation_trace(spark, sf)).select("run_id", F.array_join("evidence", ",").alias("evidence"), "waste_micro")


@register("w7_live_cache_1h", v1("select run_id, span_id, coalesce(live, false) as live_1h, lag(span_id) over (partition by run_id, scope_id, model order by start_ms, span_id) as prev_id from pair0"))
def w7(spark, sf):
    return R.live_cache_1h(trace(spark, sf)).select("run_id", "span_id", "live_1h", F.col("a.span_id").alias("prev_id"))


@register("w14_apply_rules", vr("select run_id, finding_id, rule, severity, rule_class, evidence, waste_micro from fin"))
def w14(spark, sf):
    return findings(spark, sf).select("run_id", "finding_id", "rule", "severity", "rule_class",
                                      F.array_join("evidence", ",").alias("evidence"), "waste_micro")


@register("k1_findings_round_trip", vr("select run_id, finding_id, rule, severity, evidence, waste_micro from fin"))
def k1_findings(spark, sf):
    """Findings written as lines and read back."""
    from ..session import scratch
    from ..sinks.export import write_trace_json
    from ..sources.trace_json import read_finding_lines
    t, path = trace(spark, sf), scratch(spark, "runs")
    write_trace_json(t.runs, t.spans, findings(spark, sf), path)
    return read_finding_lines(spark, path).withColumn("evidence", F.array_join("evidence", ","))


@register("w14b_wasted_estimate", vr("select run_id, cost_micro, wasted_micro from wasted"))
def w14b(spark, sf):
    return R.wasted_estimate(trace(spark, sf), findings(spark, sf))


GROUPS = """grp as (select run_id, rule, any_value(rule_class) as rule_class, count(*) as findings, coalesce(sum(waste_micro), 0)::bigint as micro,
  any_value(run_micro) as run_micro, bool_or(waste_micro is null) as unpriced, bool_or(waste_micro is not null) as any_priced,
  bool_and(waste_micro is not null and waste_micro < 50000) as folded from fin group by run_id, rule)"""


@register("w15_waste_groups", vr("""select run_id, rule, rule_class, findings, micro / 1000000e0 as usd, case when run_micro > 0 then micro / run_micro else 0.0 end as share,
  case when not any_priced or run_micro <= 0 then 'info' when micro / run_micro >= 0.1 and micro >= 1000000 then 'critical'
    when micro / run_micro >= 0.02 and micro >= 50000 then 'warning' else 'info' end as severity, folded, unpriced from grp""", GROUPS))
def w15(spark, sf):
    return G.waste_groups(findings(spark, sf)).select("run_id", "rule", "rule_class", "findings", "usd", "share", "severity", "folded", "unpriced")


@register("w15b_break_shapes", vr("""select run_id, shape, count(*) as findings, coalesce(sum(waste_micro), 0)::bigint / 1000000e0 as usd from f_break group by 1, 2"""))
def w15b(spark, sf):
    return G.break_shapes(findings(spark, sf))


OCC = """ev0 as (select f.run_id, f.finding_id, f.rule, unnest(string_split(evidence, ',')) as span_id, generate_subscripts(string_split(evidence, ','), 1) as pos from fin f),
evs as (select e.*, s.start_ms, coalesce(s.end_ms, s.start_ms) as e_ms, s.kind, s.name, s.model, s.tok_cache_read, s.tok_cache_write, s.ctx, s.seq from ev0 e join spans s using (run_id, span_id)),
occ0 as (select run_id, finding_id, any_value(rule) as rule, arg_min(span_id, seq) as first_span, min(start_ms) as s0, max(e_ms) as e1,
    arg_min(name, pos) filter (kind in ('tool_call', 'mcp_call')) as tool,
    max(span_id) filter (pos = 2) as b_id, max(start_ms) filter (pos = 2) as b_ms, max(model) filter (pos = 2) as b_model,
    max(e_ms) filter (pos = 1) as a_end, max(tok_cache_read) filter (pos = 1) as a_read, max(tok_cache_write) filter (pos = 1) as a_write, max(ctx) filter (pos = 1) as a_ctx,
    max(tok_cache_read) filter (pos = 2) as b_read, max(tok_cache_write) filter (pos = 2) as b_write, max(ctx) filter (pos = 2) as b_ctx from evs group by 1, 2),
occ as (select o.run_id, o.finding_id, rule, rule in ('cache-prefix-break', 'idle-cache-expiry') as pair, first_span, b_id, s0 - t.start_ms as s_off, e1 - t.start_ms as e_off,
    b_ms - t.start_ms as b_off, tool, b_model, a_end - t.start_ms as a_off, a_read, b_read, a_write, b_write,
    case when rule = 'cache-prefix-break' then case when b_ctx < 0.6e0 * a_ctx then 'compaction' when b_read < 5000 then 'front' else 'history' end end as shape
  from occ0 o join tot t using (run_id))"""


@register("w16_waste_occurrences", vr("""select run_id, finding_id, rule, case when pair then b_id else first_span end as span_id, case when pair then b_off else s_off end as at_ms,
  e_off as until_ms, tool, case when pair then b_model end as model, shape, case when pair then a_read end as read_before, case when pair then b_read end as read_after,
  case when rule = 'cache-prefix-break' then least(b_write, a_read) when rule = 'idle-cache-expiry' then least(b_write, a_read + a_write) end as rewritten,
  case when rule = 'idle-cache-expiry' then greatest(0, b_off - a_off) end as gap_ms from occ""", OCC))
def w16(spark, sf):
    t = trace(spark, sf)
    return G.waste_occurrences(t, findings(spark, sf)).drop("severity", "usd", "priced")


@register("w17_leak_events", vr("""select run_id, finding_id, rule, kind, start_off, end_off, usd, span_id from (
  select run_id, finding_id, o.rule, 'idle' as kind, a_off as start_off, b_off as end_off, 0.0 as usd, b_id as span_id from occ o where o.rule = 'idle-cache-expiry'
  union all select o.run_id, o.finding_id, o.rule, 'burn', b_off, b_off, coalesce(waste_micro, 0) / 1000000e0, b_id from occ o join fin f using (run_id, finding_id) where o.rule = 'idle-cache-expiry'
  union all select o.run_id, o.finding_id, o.rule, case when shape = 'compaction' then 'compaction' else 'burn' end, b_off, b_off, coalesce(waste_micro, 0) / 1000000e0, b_id
    from occ o join fin f using (run_id, finding_id) where o.rule = 'cache-prefix-break'
  union all select o.run_id, o.finding_id, o.rule, 'burn', s_off, e_off, coalesce(waste_micro, 0) / 1000000e0, first_span from occ o join fin f using (run_id, finding_id)
    where not pair and rule_class = 'waste')""", OCC))
def w17(spark, sf):
    t = trace(spark, sf)
    return G.leak_events(t, findings(spark, sf))


@register("w18_context_series", v1("select c.run_id, c.span_id, c.start_ms - t.start_ms as offset_ms, ctx as tokens, model from calls c join tot t using (run_id)"))
def w18(spark, sf):
    return G.context_series(trace(spark, sf))


@register("w19_rank_findings", vr("""select run_id, finding_id, row_number() over (partition by run_id order by coalesce(waste_micro, 0) desc,
  case severity when 'critical' then 0 when 'warning' then 1 else 2 end, finding_id) as rank from fin"""))
def w19(spark, sf):
    return G.rank_findings(findings(spark, sf)).select("run_id", "finding_id", "rank")


@register("w19b_findings_by_span", vr("select run_id, span_id, string_agg(distinct finding_id, ',' order by finding_id) as findings from ev0 group by 1, 2", OCC))
def w19b(spark, sf):
    return G.findings_by_span(R.evidence_rows(trace(spark, sf), findings(spark, sf)))
