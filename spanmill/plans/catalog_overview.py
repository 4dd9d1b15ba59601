"""Roll-ups, filters, spend, tool usage and timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import overview as O
from ..operators import rules as R
from ..operators import spend as S
from ..operators import timeline as L
from ..operators import toolusage as U
from ..operators.pricing import unpriced_coverage
from ..session import scratch
from ..sinks.export import write_tables
from ..sources.tables import read_table, spans_of
from .catalog import register
from .catalog_rules import findings, trace, vr
from .oracle import v1, v2
from .views import event_trace, line_trace

FACTS = """facts as (select r.*, t.*exclude (run_id), w.wasted_micro, strftime(make_timestamp(t.start_ms * 1000), '%Y-%m-%d')::date as day,
  coalesce(project_name, '—') as project, coalesce(nullif(git_branch, ''), '~none') as branch
  from runs r join tot t using (run_id) join wasted w using (run_id))"""


def vf(body: str, extra: str = "") -> str:
    return vr(body, FACTS + (extra and ", " + extra))


def facts(spark, sf):
    t = trace(spark, sf)
    return t.once("facts", lambda: O.run_facts(t.runs, t.totals, R.wasted_estimate(t, findings(spark, sf))))


@register("a1_run_totals", v1("""select t.*, end_ms - start_ms as duration_ms, m.models, m.by_model, m.tokens_by_model from tot t
  join (select run_id, count(cost) as models, string_agg(model || '=' || cost, ',' order by model) as by_model,
    string_agg(model || '=' || tok, ',' order by model) as tokens_by_model from bymodel group by 1) m using (run_id)"""))
def a1(spark, sf):
    def flat(c):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return O.run_totals(event_trace(spark, sf).spans).withColumns({
        "models": F.size("by_model"), "by_model": flat("by_model"), "tokens_by_model": flat("tokens_by_model")})


@register("a2_run_bounds", v2("select run_id, min(start_ms) as start_ms, max(end_ms) as end_ms, max(end_ms) - min(start_ms) as duration_ms from ls group by 1"))
def a2(spark, sf):
    return O.run_bounds(line_trace(spark, sf).spans)


@register("a3_aggregate_totals", vf("""select sum(cost_micro)::bigint / 1000000e0 as cost_usd, sum(wasted_micro)::bigint / 1000000e0 as wasted_usd, sum(tok_total)::bigint as tokens,
  count(*) as sessions, coalesce(sum(lines_added), 0)::bigint as lines_added, coalesce(sum(lines_removed), 0)::bigint as lines_removed from facts"""))
def a3(spark, sf):
    return O.aggregate_totals(facts(spark, sf))


@register("a4_spend_by_day", vf("""
  select a.day, 'all' as dim, '' as key, coalesce(c, 0) / 1000000e0 as cost_usd, coalesce(tk, 0) as tokens, coalesce(w, 0) / 1000000e0 as wasted_usd, coalesce(n, 0) as runs
  from axis a left join (select day, sum(cost_micro)::bigint as c, sum(tok_total)::bigint as tk, sum(wasted_micro)::bigint as w, count(*) as n from facts group by 1) d using (day)
  union all select day, 'source', source, sum(cost_micro)::bigint / 1000000e0, sum(tok_total)::bigint, null, null from facts join axis using (day) group by day, source
  union all select day, 'model', model, sum(coalesce(cost, 0))::bigint / 1000000e0, sum(tok)::bigint, null, null from facts join axis using (day) join bymodel using (run_id) group by day, model""",
    """axis as (select unnest(generate_series(greatest(min(day), max(day) - 29), max(day), interval 1 day))::date as day from facts)"""))
def a4(spark, sf):
    return O.spend_by_day(facts(spark, sf))


def _top(keys, src):
    return vf(f"select {keys}, sum(c)::bigint / 1000000e0 as cost_usd, sum(tk)::bigint as tokens from ({src}) group by {keys} order by sum(c) desc, sum(tk) desc, {keys} limit 5")


@register("a5_top_models", _top("name", "select model as name, coalesce(cost, 0) as c, tok as tk from bymodel"))
def a5(spark, sf):
    t = event_trace(spark, sf)
    return O.top_models(O.run_facts(t.runs, t.totals))


@register("a5b_top_projects", _top("name", "select project as name, cost_micro as c, tok_total as tk from facts"))
def a5b(spark, sf):
    return O.top_projects(facts(spark, sf))


@register("a5c_top_branches", _top("project, branch", "select case when branch = '~none' then '' else project end as project, branch, cost_micro as c, tok_total as tk from facts"))
def a5c(spark, sf):
    return O.top_branches(facts(spark, sf))


@register("a5d_top_sources", _top("name", "select source as name, cost_micro as c, tok_total as tk from facts"))
def a5d(spark, sf):
    return O.top_sources(facts(spark, sf))


@register("a6_session_cost_stats", v1("""select sum(cost_micro)::bigint / count(*) / 1000000e0 as mean_usd,
  (list(cost_micro order by cost_micro)[(count(*) + 1) // 2] + list(cost_micro order by cost_micro)[count(*) // 2 + 1]) / 2000000e0 as median_usd from tot"""))
def a6(spark, sf):
    return O.session_cost_stats(event_trace(spark, sf).totals)


@register("a7_cache_aggregate", v1("select sum(tok_cache_read)::bigint / (sum(tok_cache_read) + sum(tok_input))::bigint as hit_rate, sum(tok_cache_read)::bigint as cache_read_tokens from tot"))
def a7(spark, sf):
    return O.cache_aggregate(event_trace(spark, sf).totals)


@register("a8_error_rate", v1("select sum(tool_errors)::bigint / sum(tool_calls)::bigint as rate, sum(tool_errors)::bigint as errors, sum(tool_calls)::bigint as calls from tot"))
def a8(spark, sf):
    return O.error_rate(event_trace(spark, sf).totals)


@register("a9_worst_tool", v1("select coalesce(tool_id, name) as name, count(*) as failures from tools where status = 'error' group by 1 order by 2 desc, 1 limit 1"))
def a9(spark, sf):
    return O.worst_tool(event_trace(spark, sf).spans)


@register("a10_priciest_call", v1("select max(cost) / 1000000e0 as max_cost_usd, max(tot) as max_tokens from calls"))
def a10(spark, sf):
    return O.priciest_call(event_trace(spark, sf).spans)


@register("a11_waste_by_rule", vf("""select rule, count(*) as findings, count(distinct run_id) as sessions, sum(waste_micro)::bigint / 1000000e0 as total_usd,
  case when bool_or(severity = 'critical') then 'critical' when bool_or(severity = 'warning') then 'warning' else 'info' end as worst_severity
  from fin where waste_micro > 0 group by 1"""))
def a11(spark, sf):
    return O.waste_by_rule(findings(spark, sf))


@register("a11b_waste_entries", vf("""select rule, run_id, coalesce(title, source) as run_title, finding_id, severity, waste_micro / 1000000e0 as usd
  from fin join facts using (run_id) where waste_micro > 0"""))
def a11b(spark, sf):
    return O.waste_entries(findings(spark, sf), trace(spark, sf).runs)


@register("a12_savings_summary", vf("""select sum(wasted_micro)::bigint / 1000000e0 as burned_usd, sum(wasted_micro)::bigint / sum(cost_micro)::bigint as burned_share,
  (select coalesce(sum(waste_micro), 0)::bigint / 1000000e0 from fin where rule_class = 'opportunity') as opportunity_usd, (select count(*) from fin) as findings from facts"""))
def a12(spark, sf):
    return O.savings_summary(facts(spark, sf), findings(spark, sf))


SHARE = """calltools as (select distinct t.run_id, coalesce(p1.span_id, p2.span_id) as call_id, t.name from tools t
    left join calls p1 on p1.run_id = t.run_id and p1.span_id = t.parent_id
    left join (select c.run_id, c.span_id, c.parent_id from calls c join box b on b.run_id = c.run_id and b.span_id = c.parent_id and b.kind = 'subagent') p2
      on p1.span_id is null and p2.run_id = t.run_id and p2.parent_id = t.parent_id
    where coalesce(p1.span_id, p2.span_id) is not null),
  cn as (select c.run_id, c.span_id, coalesce(c.cost, 0) as cost, tok_input, tok_output, tot, n from calls c
    left join (select run_id, call_id, count(*) as n from calltools group by 1, 2) x on x.run_id = c.run_id and x.call_id = c.span_id),
  share as (select run_id, name, sum(cost / n order by n) as cost, sum(tok_input / n order by n) as i, sum(tok_output / n order by n) as o, sum(tot / n order by n) as a from (
    select c.run_id, t.name, n, sum(cost)::bigint as cost, sum(tok_input)::bigint as tok_input, sum(tok_output)::bigint as tok_output, sum(tot)::bigint as tot
    from cn c join calltools t on t.run_id = c.run_id and t.call_id = c.span_id group by 1, 2, 3) group by 1, 2),
  tspend as (select run_id, name, floor(coalesce(cost, 0) + 0.5)::bigint as cost_micro, floor(coalesce(i, 0) + 0.5)::bigint as tok_input, floor(coalesce(o, 0) + 0.5)::bigint as tok_output,
    floor(coalesce(a, 0) + 0.5)::bigint as tok_all, calls, mcp_server, false as orchestration
    from (select run_id, name, count(*) as calls, max(mcp_server) as mcp_server from tools group by 1, 2) left join share using (run_id, name)),
  dur as (select name, count(*) as calls, list(duration_ms order by duration_ms) as d from spans where kind in ('tool_call', 'mcp_call', 'hook') and duration_ms > 0 group by 1),
  durs as (select name, calls, d[ceil(calls * 0.5e0)::int] as p50_ms, d[ceil(calls * 0.95e0)::int] as p95_ms, d[-1] as max_ms from dur)"""


@register("a13_tool_spend", v1("""select * from tspend union all select run_id, 'Orchestration / Interface', sum(cost)::bigint, sum(tok_input)::bigint,
  sum(tok_output)::bigint, sum(tot)::bigint, count(*), null, true from cn where n is null group by run_id""", SHARE))
def a13(spark, sf):
    return S.tool_spend(event_trace(spark, sf).spans)


@register("a14_tool_ranking", v1("""select name, max(mcp_server) as mcp_server, sum(cost_micro)::bigint / 1000000e0 as cost_usd, sum(tok_all)::bigint as tokens, sum(t.calls)::bigint as calls,
  coalesce(max(p95_ms), 0) as p95_ms from tspend t left join durs using (name) group by name""", SHARE))
def a14(spark, sf):
    return S.tool_ranking(event_trace(spark, sf).spans, None)


@register("a15_mcp_share", v1("""select sum(cost_micro) filter (mcp_server is not null)::bigint / 1000000e0 as cost_usd, sum(tok_all) filter (mcp_server is not null)::bigint as tokens,
  sum(cost_micro) filter (mcp_server is not null)::bigint / sum(cost_micro)::bigint as share, 'docs' as top_server from tspend""", SHARE))
def a15(spark, sf):
    return S.mcp_share(event_trace(spark, sf).spans)


@register("a16_tool_duration_stats", v1("select * from durs", SHARE))
def a16(spark, sf):
    return S.tool_duration_stats(event_trace(spark, sf).spans)


TREND = """w as (select max(day) as d from facts), z as (select sum(cost_micro) filter (day >= d - {a})::bigint as cu, sum(cost_micro) filter (day between d - {b} and d - {c})::bigint as pu,
  sum(tok_total) filter (day >= d - {a})::bigint as ct, sum(tok_total) filter (day between d - {b} and d - {c})::bigint as pt, count(*) filter (day between d - {b} and d - {c}) as n from facts, w)"""


@register("a17_spend_trend", vf("""select cu / 1000000e0 as current_usd, pu / 1000000e0 as previous_usd, ct as current_tokens, pt as previous_tokens, (cu - pu) / pu as delta_fraction
  from z where n >= 2 and pu > 0""", TREND.format(a=6, b=13, c=7)))
def a17(spark, sf):
    return P.spend_trend(facts(spark, sf), 7)


@register("a18_run_summaries", vf("""select run_id, source, coalesce(title, source) as title, project, start_ms, end_ms - start_ms as duration_ms, llm_calls, tool_calls, tool_errors, tok_total,
  cost_micro / 1000000e0 as cost_usd, wasted_micro / 1000000e0 as wasted_usd, coalesce(f.n, 0) as findings, u.n as unpriced_calls from facts
  left join (select run_id, count(*) as n from fin group by 1) f using (run_id) join (select run_id, count(*) filter (cost is null) as n from calls group by 1) u using (run_id)"""))
def a18(spark, sf):
    return O.run_summaries(facts(spark, sf), findings(spark, sf), unpriced_coverage(trace(spark, sf).spans))


@register("a19_run_teaser", vf("""select b.run_id, b.cost_micro / 1000000e0 as cost_usd,
  (select string_agg(model, ',' order by cost desc, model) from m where rn <= 3) as models,
  (b.cost_micro - (select sum(cost) from m where rn <= 3))::bigint / 1000000e0 as rest_usd,
  (select greatest(count(*) - 3, 0) from m) as rest_models, f.rule as top_rule, f.waste_micro / 1000000e0 as top_usd from b
  left join (select * from fin where run_id = (select run_id from b) order by waste_micro desc nulls last, finding_id limit 1) f using (run_id)""",
    """b as (select * from facts order by cost_micro desc, start_ms desc, run_id limit 1),
  m as (select *, row_number() over (order by cost desc, model) as rn from bymodel where cost is not null and run_id = (select run_id from b))"""))
def a19(spark, sf):
    return O.run_teaser(facts(spark, sf), findings(spark, sf))


@register("a20_cost_buckets", v1("""select run_id, least(47, greatest(0, floor((coalesce(c.end_ms, c.start_ms) - t.start_ms) / greatest(1, t.end_ms - t.start_ms) * 48)))::int as bucket, model,
  sum(cost)::bigint / 1000000e0 as cost_usd from calls c join tot t using (run_id) where cost > 0 group by 1, 2, 3"""))
def a20(spark, sf):
    t = event_trace(spark, sf)
    return O.cost_buckets(t.spans, t.totals)


@register("a21_tokens_by_model", v1("select run_id, model, tok as tokens from bymodel"))
def a21(spark, sf):
    return O.tokens_by_model(event_trace(spark, sf).spans)


@register("p1_filter_runs", vf("""select run_id from facts f where source = 'claude-code' and project = 'proj3' and day >= (select max(day) - 29 from facts)
  and exists (select 1 from bymodel b where b.run_id = f.run_id and b.model = 'gpt-5.4-mini') and exists (select 1 from tools t where t.run_id = f.run_id and t.name = 'Edit')"""))
def p1(spark, sf):
    t = trace(spark, sf)
    return P.filter_runs(facts(spark, sf), t.spans, source="claude-code", project="proj3", period=30, model="gpt-5.4-mini",
                         tool="Edit").select("run_id")


@register("p1b_filter_branch_day", vf("select run_id from facts where branch = 'br3' and day = date '2024-01-04'"))
def p1b(spark, sf):
    return P.filter_runs(facts(spark, sf), branch="br3", day="2024-01-04").select("run_id")


@register("p1c_filter_written", vf("""select run_id, count(*) as tools, count(output_bytes) as sized from facts f join tools t using (run_id)
  where f.source = 'claude-code' and f.day >= (select max(day) - 4 from facts) group by 1"""))
def p1c(spark, sf):
    """The same conditions over written tables: folders of other sources and days are not opened."""
    t, path = trace(spark, sf), scratch(spark, "tables")
    write_tables(path, facts(spark, sf), t.spans)
    chosen = P.filter_runs(read_table(spark, path, "runs"), source="claude-code", period=5)
    return spans_of(spark, path, chosen).filter("kind in ('tool_call', 'mcp_call')").groupBy("run_id").agg(
        F.count("*").alias("tools"), F.count("output_bytes").alias("sized"))


@register("p2_uses_tool", v1("select distinct run_id from tools where name = 'mcp__docs__search'"))
def p2(spark, sf):
    return P.uses_tool(event_trace(spark, sf).spans, "mcp__docs__search")


@register("p2b_uses_model", v1("select run_id from bymodel where model = 'claude-opus-4.5' and cost is not null"))
def p2b(spark, sf):
    return P.uses_model(event_trace(spark, sf).totals, "claude-opus-4.5").select("run_id")


# newest run decides; windows of 3 days from Wednesday 06:00
LIMIT = """lim0 as (select max(start_ms) as a from tot),
  lim1 as (select a, to_timestamp(a / 1000e0)::timestamp as ts from lim0),
  lim2 as (select a, ts, date_trunc('day', ts) - to_days(((dayofweek(ts) - 3 + 7) % 7)::int) + interval 6 hour as r0 from lim1),
  lim3 as (select a, case when epoch_ms(r0) > a then r0 - interval 7 day else r0 end as r from lim2),
  lim as (select a as anchor_ms, epoch_ms(r) + ((a - epoch_ms(r)) // 259200000) * 259200000 as start_ms from lim3)"""


@register("p3_limit_window", v1("select anchor_ms, start_ms, start_ms + 259200000 as end_ms, start_ms - 259200000 as prev_start_ms from lim", LIMIT))
def p3(spark, sf):
    return P.limit_window(event_trace(spark, sf).totals, P.LimitWindow(3, "wed", 6))


@register("p4_budget_use", v1("""select coalesce(sum(cost_micro), 0)::bigint / 1000000e0 as used, 5.0 as budget, coalesce(sum(cost_micro), 0)::bigint / 1000000e0 / 5e0 as ratio,
  coalesce(sum(cost_micro), 0)::bigint / 1000000e0 > 5 as over from tot t, lim l where t.start_ms >= l.start_ms and t.start_ms < l.start_ms + 259200000""", LIMIT))
def p4(spark, sf):
    return P.budget_use(event_trace(spark, sf).totals, P.LimitWindow(3, "wed", 6, budget_usd=5.0))


@register("p5_select_run", v1("select run_id, cost_micro from tot where run_id = (select min(run_id) from tot)"))
def p5(spark, sf):
    t = event_trace(spark, sf).totals
    ref = t.agg(F.min("run_id")).first()[0]
    return P.select_run(t, ref).select("run_id", "cost_micro")


@register("o1_sort_runs", vf("select run_id, row_number() over (order by lower(project_name) desc nulls last, start_ms desc, run_id) as position from facts"))
def o1(spark, sf):
    return P.ranked_runs(facts(spark, sf), "project", "desc").select("run_id", "position")


IDENT = """ident as (select s.*, case when kind = 'hook' then 'hook' when kind = 'mcp_call' then 'mcp' when name = 'Bash' then 'shell' else 'harness' end as family,
    case when kind = 'mcp_call' then 'docs' when name = 'Bash' then coalesce(tool_id, 'Bash') else name end as tkey,
    case when kind = 'mcp_call' then 'search' when name = 'Bash' and tool_id is not null then tool_sub end as sub,
    case when kind = 'hook' then coalesce(activity, 'other') when kind = 'mcp_call' then 'integration' when name = 'Bash' then coalesce(activity, 'other')
      when name = 'Read' then 'explore' else 'edit' end as act, name = 'Bash' and tool_id is not null as registry,
    not (name = 'Bash' and tool_id is null) as classified, case when status <> 'in_progress' then duration_ms end as dur
  from spans s where kind in ('tool_call', 'mcp_call', 'hook')),
  urows as (select run_id, case when family = 'hook' then 'hooks' else 'ranked' end as grp, family, registry, tkey, count(*) as calls, count(*) filter (status = 'error') as errors,
    count(*) filter (status = 'cancelled') as cancelled, count(*) filter (dur is null) as open, coalesce(sum(dur), 0)::bigint as total_ms,
    coalesce(list(dur order by dur) filter (dur is not null)[ceil(count(dur) * 0.5e0)::int], 0) as p50_ms,
    coalesce(list(dur order by dur) filter (dur is not null)[ceil(count(dur) * 0.95e0)::int], 0) as p95_ms, coalesce(max(dur), 0) as max_ms,
    any_value(act) as activity from ident group by all)"""
UCOLS = ["run_id", "grp", "family", "registry", "tkey", "calls", "errors", "cancelled", "open", "total_ms", "p50_ms", "p95_ms", "max_ms", "activity"]


def ident(spark, sf):
    t = event_trace(spark, sf)
    return U.tool_identity(t.spans)


@register("u1_tool_identity", v1("select run_id, span_id, family, tkey, sub, act, registry, classified, dur from ident", IDENT))
def u1(spark, sf):
    return ident(spark, sf).select("run_id", "span_id", "family", "tkey", "sub", "act", "registry", "classified", "dur")


@register("u5_tool_usage", v1(f"select {', '.join(UCOLS)} from urows", IDENT))
def u5(spark, sf):
    return U.tool_usage(ident(spark, sf)).select(*UCOLS)


@register("u6_tool_usage_subs", v1("""select run_id, family, tkey, sub, count(*) as calls, coalesce(sum(dur), 0)::bigint as total_ms, coalesce(max(dur), 0) as max_ms from ident i
  where exists (select 1 from ident j where j.run_id = i.run_id and j.family = i.family and j.tkey = i.tkey and j.registry = i.registry and j.sub is not null) group by all""", IDENT))
def u6(spark, sf):
    return U.tool_usage_subs(ident(spark, sf)).select("run_id", "family", "tkey", "sub", "calls", "total_ms", "max_ms")


ACT = IDENT + """, acts as (select run_id, act as activity, count(*) as calls, coalesce(sum(dur), 0)::bigint as total_ms from ident where family <> 'hook' group by 1, 2)"""


@register("u7_activity_totals", v1("select * from acts", ACT))
def u7(spark, sf):
    return U.activity_totals(ident(spark, sf))


@register("u8_activity_parts", v1("""select run_id, part, count(*) as members, sum(calls)::bigint as calls, sum(total_ms)::bigint as total_ms, sum(total_ms)::bigint / any_value(s) as share from (
  select *, case when activity = 'other' then 'unresolved' when row_number() over (partition by run_id, activity = 'other' order by total_ms desc,
      list_position(['explore','edit','run','check','build','test','vcs','deps','infra','cloud','data','web','system','devices','agent','human','integration','other'], activity)) <= 2
      then activity else 'rest' end as part from acts join (select run_id, sum(total_ms)::bigint as s from acts group by 1) using (run_id) where total_ms > 0) group by run_id, part""", ACT))
def u8(spark, sf):
    return U.activity_parts(U.activity_totals(ident(spark, sf)), 2)


@register("u9_tool_table", v1("select * from tt", IDENT + """, ur as (select *, registry and tkey in ('git', 'npm') as util from urows where grp = 'ranked'),
  un as (select *, count(*) filter (util) over (partition by run_id) >= 2 and util as fold from ur),
  tt as (select run_id, family, tkey as label, calls, errors, total_ms, p95_ms, max_ms, 1::bigint as members from un where not fold
    union all select run_id, 'shell', 'shell utilities', sum(calls)::bigint, sum(errors)::bigint, sum(total_ms)::bigint, max(p95_ms), max(max_ms), count(*) from un where fold group by run_id)"""))
def u9(spark, sf):
    util = spark.sql("select * from values ('git', true), ('npm', true) as v(tool_id, utility)")
    return U.tool_table(U.tool_usage(ident(spark, sf)), util).select(
        "run_id", "family", "label", "calls", "errors", "total_ms", "p95_ms", "max_ms", "members")


SEG = """rng as (select run_id, min(start_ms) as r0, greatest(max(start_ms + coalesce(duration_ms, 0)), min(start_ms) + 1) as r1 from spans group by 1),
  act as (select run_id, start_ms as s, start_ms + duration_ms as e, case when kind = 'llm_call' then 'm' else 't' end as c, duration_ms from spans
    where kind in ('llm_call', 'tool_call', 'mcp_call', 'hook') and duration_ms > 0),
  pts as (select run_id, s as t from act union select run_id, e from act union select run_id, r0 from rng union select run_id, r1 from rng),
  el as (select run_id, t, lead(t) over (partition by run_id order by t) as e from pts),
  cat as (select el.run_id, el.t, el.e, case when exists (select 1 from act a where a.run_id = el.run_id and a.c = 'm' and a.s <= el.t and a.e >= el.e) then 'model'
      when exists (select 1 from act a where a.run_id = el.run_id and a.c = 't' and a.s <= el.t and a.e >= el.e) then 'tool'
      when el.e - el.t >= 60000 then 'idle' else 'coordination' end as category from el where el.e is not null),
  isl as (select *, sum(case when p is distinct from category then 1 else 0 end) over (partition by run_id order by t) as island from (
    select *, lag(category) over (partition by run_id order by t) as p from cat))"""


@register("u10_time_segments", v1("select run_id, category, min(t) as seg_start, max(e) as seg_end from isl group by run_id, island, category", SEG))
def u10(spark, sf):
    t = event_trace(spark, sf)
    return L.time_segments(t.spans, chunked=t.chunked)


@register("u10b_time_breakdown", v1("""select c.run_id, coalesce(sum(e - t) filter (category = 'model'), 0)::bigint as model_ms, coalesce(sum(e - t) filter (category = 'tool'), 0)::bigint as tool_ms, 0::bigint as waiting_ms,
  coalesce(sum(e - t) filter (category = 'coordination'), 0)::bigint as coordination_ms, coalesce(sum(e - t) filter (category = 'idle'), 0)::bigint as idle_ms, any_value(r1 - r0) as wall_ms,
  any_value(busy) / sum(e - t) filter (category in ('model', 'tool'))::bigint as parallelism
  from cat c join rng using (run_id) join (select run_id, sum(duration_ms)::bigint as busy from act group by 1) using (run_id) group by c.run_id""", SEG))
def u10b(spark, sf):
    t = event_trace(spark, sf)
    return L.time_breakdown(t.spans, chunked=t.chunked)


CURVE = """cc as (select run_id, start_ms + duration_ms as t, sum(cost)::bigint as step_micro from calls where cost is not null group by 1, 2),
  curve as (select *, sum(step_micro) over (partition by run_id order by t)::bigint as cum_micro from cc)"""


@register("u11_cost_curve", v1("select * from curve", CURVE))
def u11(spark, sf):
    t = event_trace(spark, sf)
    return L.cost_curve(t.spans, t.chunked)


@register("u11b_cost_at", v1("""select run_id, floor((start_ms + end_ms) / 2)::double as t, coalesce((select max(cum_micro) from curve c where c.run_id = tot.run_id
  and c.t <= floor((start_ms + end_ms) / 2)), 0) as cum_micro from tot""", CURVE))
def u11b(spark, sf):
    t = event_trace(spark, sf)
    return L.cost_at(t.spans, t.totals.select("run_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("t")))


@register("u12_spend_spine", v1("""select run_id, i as segment, case when total > 0 then a / total else 0.0 end as c0, case when total > 0 then b / total else 0.0 end as c1,
  case when b - a <= 0 or peak <= 0 then 0 when (b - a) / peak > 2 / 3e0 then 3 when (b - a) / peak > 1 / 3e0 then 2 else 1 end as heat from (
  select *, max(b - a) over (partition by run_id) as peak from (
    select run_id, i, total, lag(b) over (partition by run_id order by i) as a, b from (
      select r.run_id, g.i, coalesce(max(c.cum_micro), 0) as b, (select max(cum_micro) from curve z where z.run_id = r.run_id) as total
      from rng r cross join (select unnest(generate_series(0, 40)) as i) g
      left join curve c on c.run_id = r.run_id and c.t <= r.r0 + (r.r1 - r.r0) * g.i / 40 group by r.run_id, g.i)) where i > 0)""", SEG + ", " + CURVE))
def u12(spark, sf):
    return L.spend_spine(event_trace(spark, sf).spans, 40)



@register("f3_closed_duration", v1("""select run_id, span_id, case when status = 'in_progress' then null else coalesce(duration_ms, greatest(0, end_ms - start_ms)) end as dur, ctx as context_tokens, tot as total_tokens
  from spans"""))
def f3(spark, sf):
    from ..functions.money import closed_duration, context_tokens, total_tokens
    return event_trace(spark, sf).spans.select("run_id", "span_id", closed_duration().alias("dur"), context_tokens().alias("context_tokens"),
                                               total_tokens().alias("total_tokens"))


@register("f7_effective_write_rate", v1("select run_id, span_id, one_h, w1h_u / 1000000e0 as write_1h_rate, eff_write as effective_rate from calls where pattern is not null"))
def f7(spark, sf):
    from ..functions.money import clamped_1h, effective_write_rate, write_1h_rate
    return event_trace(spark, sf).spans.filter("kind = 'llm_call' and pattern is not null").select(
        "run_id", "span_id", clamped_1h().alias("one_h"), (write_1h_rate() / 1e6).alias("write_1h_rate"), effective_write_rate().alias("effective_rate"))


@register("f9_break_shape", v1("""select run_id, a_id, span_id, case when ctx < 0.6e0 * a_ctx then 'compaction' when tok_cache_read < 5000 then 'front' else 'history' end as shape
  from pairs where a_id is not null"""))
def f9(spark, sf):
    from ..functions.money import break_shape, nz
    p = R.live_cache_1h(event_trace(spark, sf)).filter("a is not null")
    return p.select("run_id", F.col("a.span_id").alias("a_id"), "span_id", break_shape(F.col("a.ctx"), F.col("ctx"), nz("tok_cache_read")).alias("shape"))


@register("f17_model_tier", v1("""select model, case when c like 'claude-%' then 'claude' when c like 'gpt-5%' then 'gpt' end as family,
  case when c like 'claude-%-opus%' or c like 'claude-opus%' then 1 when c like 'claude-sonnet%' then 2 when c like 'gpt-5%-mini%' then 1 end as stage from canon"""))
def f17(spark, sf):
    from ..operators.pricing import model_tier
    d = event_trace(spark, sf).spans.filter("model is not null").select("model").distinct()
    return d.select("model", model_tier().alias("t")).select("model", "t.family", "t.stage")


@register("f22_run_keys", vf("select run_id, project, branch, day from facts"))
def f22(spark, sf):
    from ..functions.text import branch_key, local_day, project_key
    return facts(spark, sf).select("run_id", project_key().alias("project"), branch_key().alias("branch"), local_day("start_ms").alias("day"))


@register("k3_day_model_pivot", vf("""select day, sum(cost_micro)::bigint as cost_micro, sum(wasted_micro)::bigint as wasted_micro, count(*) as runs,
  sum((select coalesce(sum(cost), 0) from bymodel b where b.run_id = f.run_id and b.model = 'claude-opus-4.5'))::bigint as opus,
  sum((select coalesce(sum(cost), 0) from bymodel b where b.run_id = f.run_id and b.model = 'gpt-5.4-mini'))::bigint as mini from facts f group by day"""))
def k3(spark, sf):
    from ..sinks.export import day_model_pivot
    return day_model_pivot(facts(spark, sf)).select("day", "cost_micro", "wasted_micro", "runs", F.col("`claude-opus-4.5`").alias("opus"), F.col("`gpt-5.4-mini`").alias("mini"))


@register("k3b_day_model_costs", vf("select f.day, b.model, sum(b.cost)::bigint as cost_micro from facts f join bymodel b using (run_id) group by 1, 2 having sum(b.cost) is not null"))
def k3b(spark, sf):
    from ..sinks.export import day_model_costs
    return day_model_costs(facts(spark, sf))


@register("u4_hook_summary", v1("""select run_id, parent_id as span_id, count(*) as hook_count, case when count(tool_id) = count(*) and min(tool_id) = max(tool_id) and min(activity) = max(activity)
   or count(*) = 1 then min(tool_id) end as tool_id from ft where name = 'Bash' group by 1, 2"""))
def u4(spark, sf):
    s = event_trace(spark, sf).spans.filter("name = 'Bash' and status = 'error'").select("run_id", F.col("parent_id").alias("span_id"), "tool_id", "activity")
    n = s.groupBy("run_id", "span_id").agg(F.count("*").cast("int").alias("hook_count"))
    return U.hook_summary_identity(s.join(n, ["run_id", "span_id"])).select("run_id", "span_id", "hook_count", "tool_id")


@register("s34_scale_up", v2("select run_id, kind, count(*) * 3 - case when kind = 'session' then 2 * count(*) else 0 end as spans, sum(coalesce(tot, 0))::bigint * 3 as tokens from ls group by 1, 2"))
def s34(spark, sf):
    from ..functions.money import nz, total_tokens
    from ..sources.drill import scale_up
    from .views import raw_line_spans
    d = scale_up(raw_line_spans(spark, sf), 3)
    return d.groupBy("run_id", "kind").agg(F.count("*").alias("spans"), nz(F.sum(F.when(F.col("model").isNotNull(), total_tokens()))).alias("tokens"))
