"""Triage and diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import triage as E
from ..operators.tree import subtree_rollup
from ..skew import global_row_number
from .catalog import register
from .catalog_rules import OCC, findings, trace, vr
from .oracle import v1, v2
from .views import line_trace

# class by the k of the event: the view's texts are known, so the check lists them instead of matching
CLS = """fails as (select s.*, case when kind = 'llm_call' then 'model-server' when k % 12 = 0 then 'missing-binary' when k % 12 = 1 then 'edit-anchor-miss'
    when k % 12 = 2 then 'read-before-write' when k % 12 = 3 then 'http-error' when k % 12 = 4 then 'check-failed' when k % 12 = 5 then 'script-error'
    when k % 12 = 6 then 'port-in-use' when k % 12 = 7 then 'path-not-found' when k % 12 = 8 then 'shell-syntax' when k % 12 = 11 then 'http-error' else 'exit-nonzero' end as error_class
  from spans s where status = 'error' and kind <> 'hook'),
  fc as (select *, case when error_class in ('missing-binary', 'http-error', 'port-in-use', 'shell-syntax') then 'you' when error_class = 'model-server' then 'model'
    when error_class in ('check-failed', 'exit-nonzero') then 'work' else 'agent' end as owner, case when kind = 'llm_call' then model else name end as tool from fails)"""

NEXT = CLS + """, peers as (select *, case when kind = 'llm_call' then '#' else name end as peer from spans where kind in ('tool_call', 'mcp_call', 'llm_call')),
  pn as (select run_id, span_id, lead(span_id) over w as next_id, lead(status) over w as next_status, lead(start_ms) over w as next_ms from peers
    window w as (partition by run_id, scope_id, peer order by start_ms, span_id)),
  o as (select f.*, p.next_id, case when next_id is null then 'none' when next_status = 'error' then 'error' else 'ok' end as recovery, greatest(0, next_ms - f.start_ms) as after_ms
    from fc f join pn p using (run_id, span_id))"""


@register("e1_classify_errors", v1("select run_id, span_id, error_class, owner from fc", CLS))
def e1(spark, sf):
    return E.classify_errors(trace(spark, sf).spans).select("run_id", "span_id", "error_class", "owner")


def occurrences(spark, sf):
    t = trace(spark, sf)
    return t.once("occurrences", lambda: E.error_occurrences(t))


def clusters(spark, sf):
    t = trace(spark, sf)
    return t.once("error_clusters", lambda: E.error_clusters(t, occurrences(spark, sf), findings(spark, sf)))


# greedy claim as a recursion over the failures of a scope in start order
CLAIM = NEXT + """, cidx as (select run_id, scope_id, span_id, start_ms, cost, row_number() over (partition by run_id, scope_id order by start_ms, span_id) as idx from calls),
  ford as (select o.run_id, o.scope_id, o.span_id, row_number() over (partition by o.run_id, o.scope_id order by o.start_ms, o.span_id) as j,
    1 + (select count(*) from cidx c where c.run_id = o.run_id and c.scope_id = o.scope_id and c.start_ms < coalesce(o.end_ms, o.start_ms)) as f from o),
  claim as (with recursive g(run_id, scope_id, j, span_id, idx, taken) as (
      select run_id, scope_id, j, span_id, f, [f] from ford where j = 1
      union all
      select n.run_id, n.scope_id, n.j, n.span_id, x.idx, list_append(g.taken, x.idx) from g join ford n on n.run_id = g.run_id and n.scope_id = g.scope_id and n.j = g.j + 1,
        lateral (select min(v) as idx from (select unnest(generate_series(n.f, n.f + len(g.taken))) as v) where not list_contains(g.taken, v)) x)
    select * from g),
  re as (select c.run_id, c.span_id, coalesce(k.cost, 0) as reaction_micro from claim c join cidx k on k.run_id = c.run_id and k.scope_id = c.scope_id and k.idx = c.idx)"""


@register("e2_error_occurrences", v1("""select run_id, span_id, error_class, owner, tool, recovery, after_ms, next_id, coalesce(reaction_micro, 0) as reaction_micro
  from o left join re using (run_id, span_id)""", CLAIM))
def e2(spark, sf):
    return occurrences(spark, sf).select("run_id", "span_id", "error_class", "owner", "tool", "recovery", "after_ms", "next_id", "reaction_micro")


CLU = OCC + ", " + CLAIM + """, os as (select *, lag(next_id) over (partition by run_id, error_class, tool order by start_ms, span_id) as p_next from o),
  ost as (select *, sum(case when p_next is distinct from span_id then 1 else 0 end) over (partition by run_id, error_class, tool order by start_ms, span_id) as st from os),
  lng as (select run_id, error_class, tool, max(n) as longest from (select run_id, error_class, tool, st, count(*) as n from ost group by all) group by all),
  cit as (select o.run_id, o.error_class, o.tool, count(distinct e.finding_id) as findings, bool_or(e.rule = 'retry-loop') as in_retry
    from o join ev0 e using (run_id, span_id) group by all),
  ec as (select run_id, error_class, tool, any_value(owner) as owner, count(*) as failures, min(start_ms) as first_ms, max(start_ms) as last_ms,
    coalesce(sum(reaction_micro), 0)::bigint as reaction_micro, any_value(longest) as longest, coalesce(any_value(findings), 0) as findings,
    case when arg_max(recovery, seq) <> 'ok' then 'unrecovered' when any_value(longest) >= 3 or coalesce(any_value(in_retry), false) then 'looping' else 'recovered' end as outcome
    from o left join re using (run_id, span_id) join lng using (run_id, error_class, tool) left join cit using (run_id, error_class, tool) group by run_id, error_class, tool)"""


@register("e3_error_clusters", vr("select * from ec", CLU))
def e3(spark, sf):
    return clusters(spark, sf).drop("label", "kind", "mcp_server")


@register("e3b_cluster_findings", vr("select distinct run_id, error_class, tool, e.finding_id, e.rule from o join ev0 e using (run_id, span_id)", OCC + ", " + NEXT))
def e3b(spark, sf):
    return E.cluster_findings(trace(spark, sf), occurrences(spark, sf), findings(spark, sf))


@register("e4_triage_run", vr("""select s.run_id, s.cancelled, coalesce(tool_errors, 0) as tool_errors, coalesce(model_errors, 0) as model_errors, coalesce(reaction, 0)::bigint as reaction_micro,
    coalesce(recovered, 0) as recovered, coalesce(redacted, false) as redacted, coalesce(oy, 0) as owner_you, coalesce(oa, 0) as owner_agent, coalesce(om, 0) as owner_model, coalesce(ow, 0) as owner_work,
    coalesce(att, false) as needs_attention, case when coalesce(tool_errors, 0) + coalesce(model_errors, 0) = 0 then 'none' when att then 'alarm' else 'quiet' end as tone
  from (select run_id, count(*) filter (status = 'cancelled' and kind <> 'hook') as cancelled, max(start_ms) filter (kind in ('tool_call', 'mcp_call') and status = 'ok') as last_ok from spans group by 1) s
  left join (select run_id, count(*) filter (kind <> 'llm_call') as tool_errors, count(*) filter (kind = 'llm_call') as model_errors, sum(reaction_micro) as reaction,
    count(*) filter (recovery = 'ok') as recovered, bool_or(trim(output_preview) = '') as redacted, count(*) filter (owner = 'you') as oy, count(*) filter (owner = 'agent') as oa,
    count(*) filter (owner = 'model') as om, count(*) filter (owner = 'work') as ow from o left join re using (run_id, span_id) group by 1) x using (run_id)
  left join (select ec.run_id, bool_or(owner = 'you' or (outcome = 'unrecovered' and owner <> 'work' and (last_ok is null or last_ms > last_ok))) as att from ec
    join (select run_id, max(start_ms) filter (kind in ('tool_call', 'mcp_call') and status = 'ok') as last_ok from spans group by 1) using (run_id) group by 1) a using (run_id)""", CLU))
def e4(spark, sf):
    return E.triage_run(trace(spark, sf), occurrences(spark, sf), clusters(spark, sf)).select(
        "run_id", "cancelled", "tool_errors", "model_errors", "reaction_micro", "recovered", "redacted", "owner_you", "owner_agent", "owner_model",
        "owner_work", "needs_attention", "tone")


@register("e5_error_label", v1("""select run_id, case when te + me = 0 then null else (case when te > 0 then te || ' errors' else me || ' model error' || case when me = 1 then '' else 's' end end)
   || case when oy > 0 then ' · ' || oy || ' yours to fix' else '' end end as error_label
  from (select s.run_id, count(f.span_id) filter (f.kind <> 'llm_call') as te, count(f.span_id) filter (f.kind = 'llm_call') as me, count(f.span_id) filter (owner = 'you') as oy
    from (select distinct run_id from spans) s left join fc f using (run_id) group by 1)""", CLS))
def e5(spark, sf):
    return E.triage_run(trace(spark, sf), occurrences(spark, sf), clusters(spark, sf)).select("run_id", "error_label")


# pairs by rank of the order key: first with second, third with fourth, so every order takes part
def pairs(spark, sf):
    def make():
        r = line_trace(spark, sf).runs.select(F.substring("run_id", 2, 20).cast("bigint").alias("n"))
        p = global_row_number(r, ["n"], "rn").withColumn("pair", F.floor((F.col("rn") - 1) / 2))
        p = p.groupBy("pair").agg(F.min("n").alias("a"), F.max("n").alias("b")).filter("a < b")
        return p.select(F.col("a").alias("pair_id"), F.concat(F.lit("o"), "a").alias("a_run"), F.concat(F.lit("o"), "b").alias("b_run"))
    return line_trace(spark, sf).once("pairs", make)


def aligned(spark, sf):
    t = line_trace(spark, sf)
    if "aligned" not in t.memo:  # diff_many lands it
        t.memo["aligned"] = D.diff_many(t.spans, pairs(spark, sf), t.chunked)
    return t.memo["aligned"]


DIFF = """ks as (select *, row_number() over (partition by run_id, parent_id, kind, name order by start_ms, span_id) as kk from ls),
  pk as (select c.run_id, c.span_id, string_agg(a.kind || '/' || a.name || '/' || a.kk, '>' order by c.dist desc) as pkey from lself c join ks a on a.run_id = c.run_id and a.span_id = c.ancestor_id group by 1, 2),
  bounds as (select run_id, min(start_ms) as t0 from ls group by 1), dp as (select l.run_id, count(t.ancestor_id) as depth, l.span_id from ls l left join ltree t using (run_id, span_id) group by all),
  full_ as (select l.*, p.pkey, l.start_ms - b.t0 as offset_ms, coalesce(l.cost, 0) as c, coalesce(l.tot, 0) as tk, d.depth from ls l join pk p using (run_id, span_id) join bounds b using (run_id) join dp d using (run_id, span_id)),
  pr as (select order_key as pair_id, next_key as b_key from (select order_key, lead(order_key) over (order by order_key) as next_key, row_number() over (order by order_key) as rn
    from (select distinct order_key from ls)) where rn % 2 = 1 and next_key is not null),
  fa as (select pair_id, f.* from pr join full_ f on f.order_key = pair_id), fb as (select pair_id, f.* from pr join full_ f on f.order_key = b_key),
  al as (select coalesce(fa.pair_id, fb.pair_id) as pair_id, case when fb.span_id is null then 'removed' when fa.span_id is null then 'added' else 'matched' end as side,
    fa.span_id as a_id, fb.span_id as b_id, fa.kind as a_kind, fb.kind as b_kind, fa.name as a_name, fb.name as b_name, fa.c as a_c, fb.c as b_c, fa.tk as a_tk, fb.tk as b_tk,
    fa.duration_ms as a_d, fb.duration_ms as b_d, fa.status as a_s, fb.status as b_s, fa.offset_ms as a_o, fb.offset_ms as b_o, fa.depth as a_dep, fb.depth as b_dep
    from fa full join fb on fa.pair_id = fb.pair_id and fa.pkey = fb.pkey)"""


@register("df1_diff_header", v2("""select pair_id, metric, a, b, b - a as delta, case when a <> 0 then (b - a) / a end as pct from (
  select pair_id, unnest(['cost_micro', 'tok_total', 'llm_calls', 'duration_ms']) as metric, unnest([x.c, x.tk, x.n, x.d]) as a, unnest([y.c, y.tk, y.n, y.d]) as b
  from pr join h x on x.order_key = pair_id join h y on y.order_key = b_key)""",
    DIFF + """, h as (select order_key, coalesce(sum(cost), 0)::bigint as c, coalesce(sum(tot), 0)::bigint as tk, count(cost) as n, max(end_ms) - min(start_ms) as d from ls group by 1)"""))
def df1(spark, sf):
    t = line_trace(spark, sf)
    return D.diff_header(t.totals, pairs(spark, sf)).filter(F.col("metric").isin("cost_micro", "tok_total", "llm_calls", "duration_ms"))


@register("df2_diff_align", v2("select pair_id, side, a_id, b_id from al", DIFF))
def df2(spark, sf):
    return aligned(spark, sf).select("pair_id", "side", F.col("a_span_id").alias("a_id"), F.col("b_span_id").alias("b_id"))


@register("df3_diff_pairs", v2("""select pair_id, a_id, b_id, a_kind as kind, a_name as name, b_c - a_c as cost_delta, b_tk - a_tk as tokens_delta, b_d - a_d as duration_delta,
  case when a_s <> b_s then a_s || '>' || b_s end as status_change from al where side = 'matched'""", DIFF))
def df3(spark, sf):
    return D.diff_pairs(aligned(spark, sf))


@register("df4_diff_subtrees", v2("""select pair_id, a_id, b_id, a_name as name, x.c as a_micro, y.c as b_micro, y.c - x.c as delta_micro from al join st x on x.span_id = a_id join st y on y.span_id = b_id
  where side = 'matched' and a_kind = 'subagent'""", DIFF + ", st as (select c.ancestor_id as span_id, coalesce(sum(cost), 0)::bigint as c from lself c join ls using (run_id, span_id) group by 1)"))
def df4(spark, sf):
    return D.diff_subtrees(aligned(spark, sf), subtree_rollup(line_trace(spark, sf).spans), pairs(spark, sf))


@register("df5_worst_regressions", v2("""select pair_id, row_number() over (partition by pair_id order by b_c - a_c desc, a_id) as rank, a_kind as kind, a_name as name, a_id, b_c - a_c as cost_delta
  from al where side = 'matched' and b_c > a_c qualify row_number() over (partition by pair_id order by b_c - a_c desc, a_id) <= 5""", DIFF))
def df5(spark, sf):
    return D.worst_regressions(D.diff_pairs(aligned(spark, sf)))


@register("df5b_diff_rows", v2("""select pair_id, side, coalesce(a_kind, b_kind) as kind, coalesce(a_name, b_name) as name, coalesce(a_dep, b_dep) as depth, coalesce(a_o, b_o) as offset_ms, a_id, b_id,
  b_c - a_c as cost_delta, case when side = 'matched' then 0 else coalesce(a_c, b_c) end as own_cost, case when side = 'matched' then 0 else coalesce(a_d, b_d) end as own_duration,
  coalesce(b_c - a_c, 0) > 0 as regressed from al""", DIFF))
def df5b(spark, sf):
    return D.diff_rows(aligned(spark, sf))
