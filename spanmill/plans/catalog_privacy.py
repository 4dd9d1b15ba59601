"""Privacy, text function and command queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import privacy as V
from ..operators import rules as R
from ..operators.known_names import names_in_texts
from .catalog import register
from .catalog_rules import OCC, findings, trace, vr
from .oracle import v1
from .views import event_trace, read


@register("x1_redact_text", v1("""select run_id, span_id, prompt_preview is null as was_empty, cast(null as varchar) as prompt_preview, cast(null as varchar) as output_preview,
  kind in ('llm_call', 'subagent') or output_preview is not null as content_redacted from spans"""))
def x1(spark, sf):
    t = event_trace(spark, sf)
    s, _ = V.redact_text(t.spans.withColumn("was_empty", F.col("prompt_preview").isNull()), t.runs)
    return s.select("run_id", "span_id", "was_empty", "prompt_preview", "output_preview", "content_redacted")


@register("x2_scrub_attributes", v1("select run_id, span_id, 'targetKey' as keys from spans where k % 10 = 3 and kind not in ('session', 'subagent')"))
def x2(spark, sf):
    t = event_trace(spark, sf)
    return V.scrub_attributes(t.spans).filter("attributes is not null").select(
        "run_id", "span_id", F.array_join(F.map_keys("attributes"), ",").alias("keys"))


IDS = """vals as (select distinct 'project' as kind, '/home/dev/proj' || (user_id % 12) as value from runs where user_id % 12 <> 0
    union select distinct 'branch', git_branch from runs where git_branch <> '' union select distinct 'transcript', '/home/dev/logs/' || user_id || '.jsonl' from runs),
  ids as (select kind, value, kind || '-' || row_number() over (partition by kind order by value) as alias from vals)"""


@register("x3_identity_table", v1("select * from ids", IDS))
def x3(spark, sf):
    t = event_trace(spark, sf)
    return V.identity_table(t.runs, t.spans)


@register("x4_scrub_identity", v1("""select r.run_id, p.alias as project_name, p.alias as project_path, case when git_branch is null then null else coalesce(b.alias, 'branch-1') end as git_branch,
  f.alias as files, cast(null as varchar) as title from runs r left join ids p on p.kind = 'project' and user_id % 12 <> 0 and p.value = '/home/dev/proj' || (user_id % 12)
  left join ids b on b.kind = 'branch' and b.value = git_branch left join ids f on f.kind = 'transcript' and f.value = '/home/dev/logs/' || user_id || '.jsonl'""", IDS))
def x4(spark, sf):
    t = event_trace(spark, sf)
    r, _, _ = V.scrub_identity(t.runs, t.spans, V.identity_table(t.runs, t.spans))
    return r.select("run_id", "project_name", "project_path", "git_branch", F.array_join("files", ",").alias("files"), "title")


@register("x5_prune_to_metadata", v1("select run_id, span_id, parent_id, kind from box join spans using (run_id, span_id, parent_id, kind) union all select run_id, span_id, null, kind from box where parent_id is null"))
def x5(spark, sf):
    return V.prune_to_metadata(event_trace(spark, sf).spans).select("run_id", "span_id", "parent_id", "kind")


@register("t13_reanchor_evidence", vr("""select e.run_id, finding_id, s.scope_id as span_id, min(pos) - 1 as pos from ev0 e join spans s using (run_id, span_id) group by 1, 2, 3""", OCC))
def t13(spark, sf):
    t = trace(spark, sf)
    return V.reanchor_evidence(R.evidence_rows(t, findings(spark, sf)), t.spans)


@register("x6_manifest", v1("select 'metadata-only' as profile, true as text_redacted, true as paths_scrubbed, true as spans_pruned, count(*) as spans from box"))
def x6(spark, sf):
    t = event_trace(spark, sf)
    r, s, _ = V.sanitize(t.runs, t.spans, "metadata-only")
    return V.manifest(s, "metadata-only")


@register("x7_path_hits", v1("""select 'prompt_preview' as column, count(*) as hits from calls
  union all select 'attributes', count(*) from spans where k % 10 = 3 and kind not in ('session', 'subagent')"""))
def x7(spark, sf):
    return V.path_hits(event_trace(spark, sf).spans.drop("path"))


@register("x7b_clean_export", "select cast(null as varchar) as column, cast(null as bigint) as hits where false")
def x7b(spark, sf):
    t = event_trace(spark, sf)
    r, s, _ = V.sanitize(t.runs, t.spans, "sanitized")
    return V.path_hits(s.drop("path")).unionByName(V.path_hits(r))


@register("x7c_known_names", v1("""select 'prompt_preview' as column, name, count(*) as cells from (select distinct prompt_preview as text, span_id from calls) c
  join (select distinct 'dev' || user_id as name from runs) n on contains(c.text, n.name) group by 2"""))
def x7c(spark, sf):
    """Home folders of all users, found inside the sentences of the previews."""
    t = event_trace(spark, sf)
    return names_in_texts(t.spans.select("prompt_preview"), t.runs.select(F.concat(F.lit("dev"), F.regexp_extract("run_id", "[0-9]+", 0)).alias("name")))


@register("x7d_names_in_documents", """select 'text' as column, w as name, count(*) as cells from documents d
  join (select distinct split_part(trim(text), ' ', 1) as w from benchmark) b on w <> '' and contains(d.text, w) group by 2""")
def x7d(spark, sf):
    """First words of all benchmark items, wherever whole documents hold them, inside longer words too."""
    names = read(spark, sf, "benchmark").select(F.split(F.trim("text"), " ").getItem(0).alias("name"))
    return names_in_texts(read(spark, sf, "documents").select("text"), names)


@register("f8_canonical_model", v1("select model, c as canonical, l as loose from loose"))
def f8(spark, sf):
    from ..functions.money import canonical_model, loose_model
    c = canonical_model("model")
    return event_trace(spark, sf).spans.filter("model is not null").select("model").distinct().select(
        "model", c.alias("canonical"), loose_model(c).alias("loose"))


@register("f11_error_preview", v1("""select run_id, span_id, case k % 12 when 0 then 'bash: foo: command not found' when 4 then 'error TS2345: bad argument' || chr(10) || '0 errors ignored' else output_preview end as preview,
  case k % 12 when 0 then 127 when 4 then 1 end as code, case k % 12 when 0 then 'Exit code 127' when 4 then 'Exit code 1' when 10 then null else output_preview end as snippet, false as rejected from ft where name = 'Bash'"""))
def f11(spark, sf):
    return event_trace(spark, sf).spans.filter("name = 'Bash' and status = 'error'").select(
        "run_id", "span_id", X.error_preview("output_preview").alias("preview"), X.exit_code("output_preview").alias("code"),
        X.error_snippet("output_preview").alias("snippet"), X.is_user_rejection("output_preview").alias("rejected"))


@register("f16_tool_class", v1("select run_id, span_id, case when kind = 'mcp_call' then 'mcp' when name = 'Bash' then 'shell' when name = 'Edit' then 'edit' else 'other' end as tool_class from tools"))
def f16(spark, sf):
    return event_trace(spark, sf).tools.select("run_id", "span_id", X.tool_class().alias("tool_class"))


HASH = """select doc_id, concat('run_', h1, h2) as stable_id from (select doc_id, h1, printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(k || h1, ''), lambda x: unicode(x)::bigint)),
    lambda h, c: ((xor(h, c) * 16777619) & 4294967295))) as h2 from (
  select doc_id, k, printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(k, ''), lambda x: unicode(x)::bigint)), lambda h, c: ((xor(h, c) * 16777619) & 4294967295))) as h1
  from (select doc_id, source || '/' || doc_id || '/' || lang as k from documents)))"""


@register("f26_stable_run_id", HASH)
def f26(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.stable_run_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"), "lang")).alias("stable_id"))


@register("f21_path_shapes", """select doc_id, len(regexp_extract_all(lower(text), '(?:/users/|/home/)[^\\s"''`<>]+|file://[^\\s"''`<>]*')) as hits from documents""")
def f21(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(X.path_shapes("text")).cast("bigint").alias("hits"))


@register("f18_script_activity", v1("""select run_id, span_id, script, case when k % 4 = 0 then 'test' when k % 4 = 1 then 'data' when k % 4 = 2 then 'build' else 'run' end as act
  from (select *, case when k % 4 = 0 then 'ci:e2e' when k % 4 = 1 then 'db:reset' when k % 4 = 2 then 'assembleDebug' else 'misc' end as script from ft where name = 'Bash')"""))
def f18(spark, sf):
    t = event_trace(spark, sf).spans.filter("name = 'Bash' and status = 'error'")
    s = F.when(F.col("tool_id") == "git", "ci:e2e").when(F.col("tool_id") == "npm", "db:reset").when(
        F.col("tool_id") == "pytest", "assembleDebug").otherwise("misc")
    return t.select("run_id", "span_id", s.alias("script"), X.script_activity(s).alias("act"))


@register("u2_classify_commands")
def u2(spark, sf):
    """Command lines derived from the failing calls; classified once per distinct text, joined back."""
    from ..operators.commands import with_command_tools
    t = event_trace(spark, sf).spans.filter("name = 'Bash'").select("run_id", "span_id", "target_label", "exit_code", "tool_id", "tool_sub", "activity", "tools_also", "lines_added")
    cmd = F.when(F.col("tool_id") == "git", F.lit("cd src && git status | head -5")).when(
        F.col("tool_id") == "npm", F.lit("FOO=1 npm run test:unit -- --watch=false")).when(
        F.col("tool_id") == "pytest", F.lit("bash -lc 'uv run pytest -q; echo done'")).otherwise(F.concat(F.lit("./bin/"), "target_label"))
    return with_command_tools(t.withColumn("command", cmd)).select(
        "run_id", "span_id", "tool_id", "tool_sub", "activity", F.array_join("tools_also", ",").alias("tools_also"))
