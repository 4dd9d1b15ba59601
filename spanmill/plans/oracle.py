"""Equivalent DuckDB SQL for the registered queries (check side only).

The leaf rows share their text with the Spark views; everything above them is written
independently: recursive trees, plain windows, range joins.
"""

from __future__ import annotations

from .views import base_events_sql, base_lines_sql, rate_values


V1 = f"""
ev as ({base_events_sql("(epoch_us(ts) // 1000)", "chr(10)")}),
leaf as (select *, start_ms + duration_ms as end_ms,
  last_value(case when kind = 'llm_call' then span_id end ignore nulls) over (
    partition by container order by start_ms, span_id rows between unbounded preceding and 1 preceding) as prev_call from ev),
box as (
  select run_id, session_id as span_id, cast(null as varchar) as parent_id, 'session' as kind, 'session' as name,
    min(start_ms) as start_ms, max(coalesce(end_ms, start_ms)) as end_ms, any_value(user_id) as user_id from leaf group by run_id, session_id
  union all
  select run_id, container, session_id, 'subagent', 'worker-' || (day_no % 4), min(start_ms), max(coalesce(end_ms, start_ms)), any_value(user_id)
  from leaf where container <> session_id group by run_id, container, session_id, day_no),
spans0 as (
  select run_id, span_id, case when kind = 'llm_call' then container else coalesce(prev_call, container) end as parent_id, kind, name,
    status, start_ms, end_ms, duration_ms, model, tok_input, tok_output, tok_cache_read, tok_cache_write, tok_reasoning,
    cache_write_1h, mcp_server, exit_code, output_bytes, lines_added, lines_removed, target_key, target_kind, target_label,
    output_preview, prompt_preview, tool_id, tool_sub, activity, container as scope_id,
    case when container = session_id then 'session' else 'subagent' end as scope_kind,
    case when container = session_id then null else container end as owner_id, user_id, k from leaf
  union all by name
  select run_id, span_id, parent_id, kind, name, 'ok' as status, start_ms, end_ms, end_ms - start_ms as duration_ms,
    span_id as scope_id, kind as scope_kind, cast(null as varchar) as owner_id, user_id from box),
rates as (select model_pattern as pattern, cast(round(input_per_mtok * 1000000) as bigint) as in_u,
  cast(round(output_per_mtok * 1000000) as bigint) as out_u, cast(round(cache_read_per_mtok * 1000000) as bigint) as read_u,
  cast(round(cache_write_per_mtok * 1000000) as bigint) as write_u, cast(round(cache_write_1h_per_mtok * 1000000) as bigint) as write1h_u, pos
  from {rate_values()}),
canon as (select distinct model, regexp_replace(regexp_replace(trim(lower(model)), '^[a-z0-9_.-]+/', ''), '-latest$', '') as c
  from spans0 where model is not null),
loose as (select model, c, regexp_replace(c, '([0-9])\\.([0-9])', '\\1-\\2', 'g') as l from canon),
hits as (select model, r.*, case when c = pattern then 0 when l = lp then 1 else 2 end as cls, length(pattern) as len,
    case when starts_with(c, pattern) then 1 else 0 end as verb
  from loose, (select *, regexp_replace(pattern, '([0-9])\\.([0-9])', '\\1-\\2', 'g') as lp from rates) r
  where c = pattern or l = lp or (starts_with(c, pattern) and substr(c, length(pattern) + 1, 1) in ('-', '.', ':', '@'))
     or (starts_with(l, lp) and substr(l, length(lp) + 1, 1) in ('-', '.', ':', '@'))),
matched as (select * from hits qualify row_number() over (partition by model order by cls, case when cls < 2 then 0 else -len end, -verb, pos) = 1),
sp as (select s.*, m.pattern, m.in_u, m.out_u, m.read_u, m.write_u, coalesce(m.write1h_u, case when m.pattern like '%claude%' then m.in_u * 2 else m.write_u end) as w1h_u,
    least(greatest(coalesce(cache_write_1h, 0), 0), greatest(coalesce(tok_cache_write, 0), 0)) as one_h,
    coalesce(tok_input, 0) + coalesce(tok_cache_read, 0) + coalesce(tok_cache_write, 0) as ctx,
    coalesce(tok_input, 0) + coalesce(tok_cache_read, 0) + coalesce(tok_cache_write, 0) + coalesce(tok_output, 0) + coalesce(tok_reasoning, 0) as tot
  from spans0 s left join matched m using (model)),
spans as (select *, case when kind = 'llm_call' and pattern is not null then
    (tok_input * in_u + (tok_output + coalesce(tok_reasoning, 0)) * out_u + tok_cache_read * read_u
      + (tok_cache_write - one_h) * write_u + one_h * w1h_u + 500000) // 1000000 end as cost,
    case when kind <> 'llm_call' then null when pattern is not null then 'computed' else 'unknown' end as cost_source,
    case when tok_cache_write > 0 then ((tok_cache_write - one_h) * write_u + one_h * w1h_u) / tok_cache_write / 1000000e0 else write_u / 1000000e0 end as eff_write,
    row_number() over (partition by run_id order by start_ms, span_id) as seq
  from sp),
calls as (select * from spans where kind = 'llm_call'),
tools as (select * from spans where kind in ('tool_call', 'mcp_call')),
runs as (select 'run_' || user_id as run_id, user_id,
    case when user_id % 3 = 0 then 'claude-code' when user_id % 3 = 1 then 'opencode' else 'otlp' end as source,
    case when user_id % 9 <> 0 then 'Session ' || user_id end as title,
    case when user_id % 12 <> 0 then 'proj' || (user_id % 12) end as project_name,
    case when user_id % 5 = 0 then null when user_id % 5 = 1 then '' else 'br' || (user_id % 5) end as git_branch
  from (select distinct user_id from ev)),
tree as (with recursive r(run_id, span_id, ancestor_id, dist) as (
    select run_id, span_id, parent_id, 1 from spans where parent_id is not null
    union all
    select r.run_id, r.span_id, s.parent_id, r.dist + 1 from r join spans s on s.run_id = r.run_id and s.span_id = r.ancestor_id where s.parent_id is not null)
  select * from r),
depths as (select s.run_id, s.span_id, coalesce(max(t.dist), 0) as depth from spans s left join tree t using (run_id, span_id) group by 1, 2),
tot as (select s.run_id, coalesce(sum(tok_input), 0)::bigint as tok_input, coalesce(sum(tok_output), 0)::bigint as tok_output,
    coalesce(sum(tok_cache_read), 0)::bigint as tok_cache_read, coalesce(sum(tok_cache_write), 0)::bigint as tok_cache_write,
    coalesce(sum(tok_reasoning), 0)::bigint as tok_reasoning, coalesce(sum(tot) filter (kind = 'llm_call'), 0)::bigint as tok_total,
    coalesce(sum(cost), 0)::bigint as cost_micro, count(*) filter (kind = 'llm_call') as llm_calls,
    count(*) filter (kind in ('tool_call', 'mcp_call')) as tool_calls,
    count(*) filter (kind in ('tool_call', 'mcp_call') and status = 'error') as tool_errors,
    count(*) filter (kind = 'subagent') as subagents, max(depth) as max_depth,
    case when coalesce(sum(tok_cache_read), 0) + coalesce(sum(tok_input), 0) = 0 then 0.0 else
      floor(sum(tok_cache_read) / (sum(tok_cache_read) + sum(tok_input)) * 10000e0 + 0.5) / 10000e0 end as hit_rate,
    case when count(lines_added) > 0 then sum(case when kind = 'tool_call' then lines_added end)::bigint end as lines_added,
    case when count(lines_added) > 0 then sum(case when kind = 'tool_call' then lines_removed end)::bigint end as lines_removed,
    min(start_ms) as start_ms, max(coalesce(end_ms, start_ms)) as end_ms
  from spans s join depths using (run_id, span_id) group by s.run_id),
bymodel as (select run_id, model, sum(cost)::bigint as cost, sum(tot)::bigint as tok, coalesce(sum(tok_input + tok_cache_read), 0) as t from calls group by 1, 2),
dom as (select run_id, model, m.in_u as d_in, m.read_u as d_read, m.pattern as d_pattern from (
    select * from bymodel qualify row_number() over (partition by run_id order by t desc, model) = 1) left join matched m using (model)),
ft as (select * from tools where status = 'error'),
tseq as (select *, coalesce(target_key, '') as tk, row_number() over (partition by run_id, scope_id order by start_ms, span_id) as tool_seq from tools),
tl as (select *, lag(status) over w as p_status, lag(tool_seq) over w as p_seq from tseq
  window w as (partition by run_id, scope_id, name, tk order by start_ms, span_id)),
ti as (select *, sum(case when status = 'error' and (p_seq is null or p_status <> 'error' or tool_seq - p_seq - 1 > 3) then 1 else 0 end) over (
    partition by run_id, scope_id, name, tk order by start_ms, span_id) as island from tl),
tf as (select *, count(*) over w as n, min(start_ms) over w as w_start, max(start_ms) over w as w_end,
    first_value(span_id) over (partition by run_id, scope_id, name, tk, island order by start_ms, span_id) as first_id
  from ti where status = 'error' window w as (partition by run_id, scope_id, name, tk, island)),
clus as (select * from tf where n >= 3),
heads as (select * from clus where span_id = first_id),
claimpairs as (
  select h.run_id, c.span_id as call_id, h.w_start, h.first_id, c.cost from heads h join calls c on c.run_id = h.run_id and c.scope_id = h.scope_id
    and c.start_ms between h.w_start and h.w_end
  union
  select f.run_id, c.span_id, f.w_start, f.first_id, c.cost from clus f join calls c on c.run_id = f.run_id and c.span_id = f.parent_id),
claimed as (select * from claimpairs qualify row_number() over (partition by run_id, call_id order by w_start, first_id) = 1),
pair0 as (select *, last_value(case when tok_cache_write > 0 then coalesce(cache_write_1h, 0) > 0 and one_h * 2 >= tok_cache_write end ignore nulls) over w as live
  from calls window w as (partition by run_id, scope_id, model order by start_ms, span_id rows between unbounded preceding and current row)),
pairs as (select *, lag(span_id) over w as a_id, lag(start_ms) over w as a_start, lag(coalesce(end_ms, start_ms)) over w as a_end,
    lag(tok_cache_read) over w as a_read, lag(tok_cache_write) over w as a_write, lag(ctx) over w as a_ctx, lag(coalesce(live, false)) over w as a_live
  from pair0 window w as (partition by run_id, scope_id, model order by start_ms, span_id)),
idle as (select *, (start_ms - a_end >= (case when a_live then 60 else 5 end) * 60000 and tok_cache_write >= 10000) as is_idle from pairs where a_id is not null),
mainc as (select *, row_number() over (partition by run_id order by start_ms, span_id) as pos, count(*) over (partition by run_id) as n_main
  from calls where scope_kind <> 'subagent'),
xedge as (select run_id, list_sort(list(ctx order by pos) filter (pos <= 3))[2] as baseline,
    list_sort(list(ctx order by pos) filter (pos > n_main - 3))[2] as last_median, list(span_id order by pos) filter (pos > n_main - 3) as last_ids,
    max(n_main) as n_main from mainc where n_main >= 6 group by run_id),
xcall as (select m.run_id, m.ctx, e.baseline, case when m.pattern is not null then
      (m.tok_input * m.in_u + m.tok_cache_read * m.read_u + (m.tok_cache_write - one_h) * m.write_u + one_h * w1h_u) / m.ctx / 1000000e0
    when d.model is not null then (m.tok_input * dm.in_u + m.tok_cache_read * dm.read_u + (m.tok_cache_write - one_h) * dm.write_u
      + one_h * coalesce(dm.write1h_u, case when dm.pattern like '%claude%' then dm.in_u * 2 else dm.write_u end)) / m.ctx / 1000000e0 end as rate
  from mainc m join xedge e using (run_id) left join dom d on d.run_id = m.run_id left join matched dm on dm.model = d.model where m.pos > 3)
"""

V2 = f"""
li as ({base_lines_sql("(epoch_us(l_shipdate) // 1000)")}),
ls as (select *, start_ms + duration_ms as end_ms, case when kind = 'llm_call' then
    (tok_input * 3000000 + tok_output * 15000000 + 500000) // 1000000 end as cost,
    case when kind = 'llm_call' then tok_input + tok_output end as tot,
    row_number() over (partition by run_id order by start_ms, span_id) as seq from li),
ltree as (with recursive r(run_id, span_id, ancestor_id, dist) as (
    select run_id, span_id, parent_id, 1 from ls where parent_id is not null
    union all
    select r.run_id, r.span_id, s.parent_id, r.dist + 1 from r join ls s on s.run_id = r.run_id and s.span_id = r.ancestor_id where s.parent_id is not null)
  select * from r),
lself as (select run_id, span_id, span_id as ancestor_id, 0 as dist from ls union all select * from ltree)
"""


def v1(body: str, extra: str = "") -> str:
    return f"with {V1.strip()}{extra and ', ' + extra} {body}"


def v2(body: str, extra: str = "") -> str:
    return f"with {V2.strip()}{extra and ', ' + extra} {body}"


