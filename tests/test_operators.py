"""Random runs against short plain-Python readings of the rules' wording, and edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanmill import skew
from spanmill.functions import money as M
from spanmill.functions import text as X
from spanmill.operators import commands, diff, filters, pricing, privacy, rules, toolusage, tree, triage
from spanmill.plans import views
from spanmill.schema import conform

T0 = 1767607200000


def frame(spark, rows):
    return conform(spark.createDataFrame(rows, "run_id string, span_id string, parent_id string, kind string, name string, status string, start_ms bigint, "
                                               "end_ms bigint, model string, cost_micro bigint, target_key string, tok_input bigint"))


def random_runs(seed, n_runs=25, n=40):
    rnd, out = random.Random(seed), []
    for r in range(n_runs):
        ids = [f"r{r}s0"]
        out.append((f"run{r}", ids[0], None, "session", "session", "ok", T0, T0 + 9 * 10**6, None, None, None, None))
        boxes = [ids[0]]
        for i in range(1, n):
            k = rnd.choice(["llm_call", "llm_call", "tool_call", "tool_call", "tool_call", "subagent"])
            if k == "subagent" and rnd.random() > 0.3:
                k = "tool_call"
            sid, st = f"r{r}s{i:02d}", T0 + rnd.randrange(60) * 1000
            parent = rnd.choice(boxes if k != "tool_call" else ids)
            llm = k == "llm_call"
            out.append((f"run{r}", sid, parent, k, "m" if llm else rnd.choice(["A", "B"]), rnd.choice(["error", "ok"]) if k != "subagent" else "ok", st,
                        st + rnd.choice([0, 500, 20_000]), "gpt-5.4" if llm else None, rnd.randrange(1000) if llm else None,
                        rnd.choice(["x", None]) if k == "tool_call" else None, 10 if llm else None))
            ids.append(sid)
            if k == "subagent":
                boxes.append(sid)
    return out


@pytest.fixture(scope="module")
def runs(spark):
    data = random_runs(11)
    raw = frame(spark, data)
    placed, warn, chunked = tree.place(raw)
    keep = placed.withColumns({c: F.lit(None).cast("string" if c == "pattern" else "bigint") for c in pricing.RATES})
    t = rules.Trace(keep.cache(), conform(raw.select("run_id").distinct(), "run_id STRING, source STRING"), views.pricing(spark), chunked)
    cols = ["run_id", "span_id", "parent_id", "kind", "name", "status", "start_ms", "end_ms", "model", "cost_micro", "target_key", "tok_input"]
    return t, [dict(zip(cols, r)) for r in data]


def scopes(spans):
    by = {(s["run_id"], s["span_id"]): s for s in spans}

    def up(s):
        while s["kind"] not in ("session", "subagent"):
            s = by[(s["run_id"], s["parent_id"])]
        return s["span_id"]
    return {k: up(s) for k, s in by.items()}


def test_scope_depth_owner(runs):
    t, spans = runs
    sc = scopes(spans)
    got = {(r["run_id"], r["span_id"]): r for r in t.spans.collect()}
    by = {(s["run_id"], s["span_id"]): s for s in spans}
    for k, s in by.items():
        d, cur, owner = 0, s, None
        while cur["parent_id"]:
            cur, d = by[(cur["run_id"], cur["parent_id"])], d + 1
            owner = owner or (cur["span_id"] if cur["kind"] == "subagent" else None)
        assert (got[k]["depth"], got[k]["scope_id"], got[k]["owner_id"]) == (d, sc[k], owner)


def test_reactions_claim_each_call_once(runs):
    t, spans = runs
    sc = scopes(spans)
    order = sorted(spans, key=lambda s: (s["run_id"], s["start_ms"], s["span_id"]))
    claimed, want = set(), {}
    for f in order:
        if f["status"] != "error" or f["kind"] not in ("tool_call", "llm_call"):
            continue
        k = (f["run_id"], f["span_id"])
        for c in order:
            ck = (c["run_id"], c["span_id"])
            if c["run_id"] == f["run_id"] and c["kind"] == "llm_call" and sc[ck] == sc[k] and c["start_ms"] >= f["end_ms"] and ck not in claimed and ck != k:
                claimed.add(ck)
                want[k] = c["span_id"]
                break
    fails = triage.classify_errors(t.spans)
    got = {(r["run_id"], r["span_id"]): r["call_id"] for r in triage.claim_reactions(t, fails).collect()}
    assert got == want and len(want) > 100


def test_retry_clusters_by_walking(runs):
    t, spans = runs
    sc = scopes(spans)
    done, open_ = [], {}
    for s in sorted((s for s in spans if s["kind"] == "tool_call"), key=lambda s: (s["run_id"], s["start_ms"], s["span_id"])):
        box, key = (s["run_id"], sc[(s["run_id"], s["span_id"])]), (s["name"], s["target_key"] or "")
        mine = open_.setdefault(box, {})
        for k in list(mine):
            if k != key:
                mine[k][1] += 1
                if mine[k][1] > 3:
                    done.append(mine.pop(k)[0])
        if s["status"] == "error":
            e = mine.setdefault(key, [[], 0])
            e[0].append(s["span_id"])
            e[1] = 0
        elif key in mine:
            done.append(mine.pop(key)[0])
    done += [e[0] for m in open_.values() for e in m.values()]
    want = sorted(tuple(d) for d in done if len(d) >= 3)
    got = sorted(tuple(r["evidence"]) for r in rules.retry_loop(t).collect())
    assert got == want and want


def test_diff_paths_pair_siblings(runs):
    t, spans = runs
    al = diff.diff_align(t.spans, "run0", "run1").collect()
    kids = {}
    for s in sorted(spans, key=lambda s: (s["start_ms"], s["span_id"])):
        kids.setdefault((s["run_id"], s["parent_id"]), []).append(s)
    pairs = set()

    def walk(a, b):
        left = list(b)
        for x in a:
            m = next((y for y in left if (y["kind"], y["name"]) == (x["kind"], x["name"])), None)
            if m:
                left.remove(m)
                pairs.add((x["span_id"], m["span_id"]))
                walk(kids.get(("run0", x["span_id"]), []), kids.get(("run1", m["span_id"]), []))
    walk(kids[("run0", None)], kids[("run1", None)])
    assert {(r["a_span_id"], r["b_span_id"]) for r in al if r["side"] == "matched"} == pairs
    assert len(al) == 80 - len(pairs)


def test_repair_cycles_and_dangling(spark):
    mk = lambda i, p, k="tool_call": ("r", i, p, k, i, "ok", T0, T0, None, None, None, None)
    raw = frame(spark, [mk("root", None, "session"), mk("a", "gone"), mk("c1", "c2"), mk("c2", "c3"), mk("c3", "c1"), mk("d", "c1"), mk("e", "d"), mk("self", "self")])
    fixed, warn = tree.repair_tree(raw)
    got = {r["span_id"]: (r["parent_id"], [p["id"] for p in r["path"]]) for r in fixed.collect()}
    assert {k: v[0] for k, v in got.items()} == {"root": None, "a": "root", "c1": "root", "c2": "root", "c3": "root", "d": "c1", "e": "d", "self": "root"}
    assert got["e"][1] == ["d", "c1", "root"]
    assert "5 span(s)" in warn.first()["message"] and "(a, c1, c2, c3, self)" in warn.first()["message"]


def test_match_models(spark):
    rates = spark.createDataFrame([("claude-sonnet-4", 1.0, 1.0, 1.0, 1.0, None, 0), ("claude-sonnet-4-5", 2.0, 1.0, 1.0, 1.0, None, 1), ("gpt-5.4", 3.0, 1.0, 1.0, 1.0, None, 2),
                                   ("gpt-5", 4.0, 1.0, 1.0, 1.0, None, 3)], "model_pattern string, input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, "
                                  "cache_write_per_mtok double, cache_write_1h_per_mtok double, pos int")
    names = {"claude-sonnet-4.5": 2, "Anthropic/claude-sonnet-4-5-latest": 2, "claude-sonnet-4-5-20250929": 2, "claude-sonnet-4.5-x": 2, "claude-sonnet-40": None, "claude-sonnet-4@x": 1,
             "gpt-5-4": 3, "gpt-5.4-pro": 3, "gpt-5:free": 4, "gpt-5x": None, "al": 4}
    d = spark.createDataFrame([(n,) for n in names], "model string")
    got = {r["model"]: r["in_u"] // 10**6 for r in pricing.match_models(d, rates, {"al": "gpt-5"}).collect()}
    assert got == {k: v for k, v in names.items() if v}


def test_text_functions(spark):
    d = spark.createDataFrame([("Exit code 2\nall fine\n1 error found\nno errors left",), ("Exit code 1\nplain",), ("  \n",), ("The user doesn't want to proceed",)], "t string")
    r = d.select(X.error_preview("t").alias("p"), X.exit_code("t").alias("c"), X.is_user_rejection("t").alias("j"), X.error_snippet("t").alias("s")).collect()
    assert r[0]["p"].startswith("1 error found") and r[0]["c"] == 2 and r[1]["p"] == "plain" and r[2]["s"] is None and r[3]["j"]
    e = spark.sql("select 1").select(X.posix_relative_path(F.lit("C:\\a\\b\\c.txt"), "C:/a").alias("p"), X.script_activity(F.lit("x:db:reset")).alias("a"),
                                     X.mcp_tool_name(F.lit("mcp__srv__do__it")).alias("m"), M.loose_model(F.lit("a-4.5.1")).alias("l"),
                                     F.size(X.path_shapes(F.lit("see /home/me/x and C:\\Users\\me and file:///z"))).alias("n")).first()
    assert tuple(e) == ("b/c.txt", "data", "do__it", "a-4-5-1", 3)


def test_commands(spark):
    want = {"cd src && git status | head -5": ("git", None, "vcs", []), "FOO=1 sudo npm run test:unit": ("npm", "run", "test", []),
            "bash -lc 'uv run pytest -q; echo done'": ("pytest", None, "test", []), "npm install && cargo build": ("cargo", None, "build", ["npm"]),
            "echo 'a && rm -rf x' ": ("echo", None, "system", []), "./tool --x": (None, None, "other", []), "npx eslint . ; git push": ("eslint", None, "check", ["git"])}
    d = spark.createDataFrame([(k,) for k in want], "command string")
    got = {r["command"]: (r["tool_id"], r["tool_sub"], r["activity"], r["tools_also"]) for r in commands.classify_commands(d).collect()}
    assert got == want


def test_hook_summary(spark):
    rows = [("r", "a", 2, "eslint", "check"), ("r", "a", 2, "eslint", "check"), ("r", "b", 2, "eslint", "check"), ("r", "b", 2, "git", "vcs"), ("r", "c", 3, "git", "vcs")]
    d = spark.createDataFrame(rows, "run_id string, span_id string, hook_count int, tool_id string, activity string")
    assert {r["span_id"]: r["tool_id"] for r in toolusage.hook_summary_identity(d).collect()} == {"a": "eslint", "b": None, "c": None}


def test_limit_window_config():
    cfg, warn = filters.LimitWindow.of(days=3, reset_day="wed", reset_hour=99, budget_usd=-1, nonsense=1)
    assert (cfg.days, cfg.reset_day, cfg.reset_hour, cfg.budget_usd) == (3, "wed", 0, None) and len(warn) == 3


def test_select_run_and_valid_values(spark, sf):
    t = views.event_trace(spark, sf)
    f = t.totals.join(t.runs.select("run_id", "source", "project_name", "git_branch"), "run_id")
    some = f.first()["run_id"]
    assert filters.select_run(f, some).count() == 1
    with pytest.raises(ValueError):
        filters.select_run(f, "run_")
    assert filters.valid_filter_values(f, t.spans, {"source": "opencode", "model": "nope", "tool": "Edit"}) == {"source": "opencode", "tool": "Edit"}


def test_path_check_fails_the_job(spark, sf):
    t = views.event_trace(spark, sf)
    with pytest.raises(ValueError):
        privacy.assert_no_paths(t.spans.drop("path"))
    r, s, _ = privacy.sanitize(t.runs, t.spans, "sanitized")
    privacy.assert_no_paths(r, s.drop("path"), basenames=spark.createDataFrame([("proj1",)], "name string"))
    with pytest.raises(ValueError):
        privacy.assert_no_paths(t.runs.select("project_name"), basenames=spark.createDataFrame([("proj1",)], "name string"))


def test_thresholds():
    t = rules.Thresholds.of(retry_min_consecutive=5, cache_max_hit_rate=0.9)
    assert t.retry_min_failures == 5 and t.cache_target_hit_rate == 0.9
    with pytest.raises(ValueError):
        rules.Thresholds.of(nope=1)


def test_no_product_plans(spark, sf):
    """No cartesian or nested-loop join hides in the rule and roll-up plans."""
    t = views.event_trace(spark, sf)
    for df in [r(t) for r in rules.REGISTRY] + [triage.error_occurrences(t), tree.subtree_rollup(t.spans), pricing.reprice_run(t.spans, t.pricing)[0]]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def greedy_claims(spans):
    """Failures in start order, each with the first free call of its scope at or after its end."""
    out = {}
    for scope in {s["scope_id"] for s in spans}:
        mine = sorted((s for s in spans if s["scope_id"] == scope), key=lambda s: (s["start_ms"], s["span_id"]))
        calls, taken = [s for s in mine if s["kind"] == "llm_call"], set()
        for f in (s for s in mine if s["status"] == "error"):
            end = f["start_ms"] if f["end_ms"] is None else max(f["end_ms"], f["start_ms"])
            for c in calls:
                if c["start_ms"] >= end and c["span_id"] not in taken and c is not f:
                    taken.add(c["span_id"])
                    out[f["span_id"]] = c["span_id"]
                    break
    return out


@pytest.mark.parametrize("limit", [0, 15])
@pytest.mark.parametrize("seed,width", [(1, 6), (2, 40), (3, 400)])
def test_claims_equal_brute_force(spark, seed, width, limit):
    rnd = random.Random(seed)
    spans = []
    for i in range(160):
        start, kind = rnd.randrange(width), rnd.choice(["llm_call", "tool_call"])
        end = rnd.choice([None, start, start, start + rnd.randrange(5), start + rnd.randrange(width)])
        spans.append(dict(run_id="r", scope_id=rnd.choice("aab"), span_id=f"s{rnd.randrange(10**6):06d}{i}", kind=kind, start_ms=start, end_ms=end,
                          status=rnd.choice(["ok", "error"]), cost_micro=i))
    df = spark.createDataFrame(spans, "run_id string, scope_id string, span_id string, kind string, start_ms long, end_ms long, status string, cost_micro long")
    df, hot = skew.with_chunks(df, ["run_id"], ["start_ms"], limit=limit) if limit else (df.withColumn("chunk", F.lit(0)), False)
    assert hot == bool(limit)
    t = rules.Trace(df, None, None, chunked=hot)
    got = triage.claim_reactions(t, df.filter("status = 'error'")).collect()
    assert {r["span_id"]: r["call_id"] for r in got} == greedy_claims(spans) and len(got) == len({r["call_id"] for r in got}) > 5


def test_failures_in_step_need_no_hand_out(spark, monkeypatch):
    """A scope of 4,000 failures before its last calls: at most as many rows as calls reach the hand-out."""
    spans = [("r", "a", f"f{i:05d}", "tool_call", i, 9000 - i, "error", 0) for i in range(4000)]
    spans += [("r", "a", f"m{i}", "llm_call", 9500 + i, None, "ok", i) for i in range(3)]
    df = spark.createDataFrame(spans, "run_id string, scope_id string, span_id string, kind string, start_ms long, end_ms long, status string, cost_micro long")
    seen = spark.sparkContext.accumulator(0)
    plain = triage._hand_out

    def counted():
        run = plain()

        def assign(piece):
            seen.add(len(piece))
            return run(piece)
        return assign
    monkeypatch.setattr(triage, "_hand_out", counted)
    t = rules.Trace(df.withColumn("chunk", F.lit(0)), None, None)
    got = triage.claim_reactions(t, t.spans.filter("status = 'error'")).collect()
    assert {(r["span_id"], r["call_id"]) for r in got} == {("f00000", "m0"), ("f00001", "m1"), ("f00002", "m2")} and seen.value <= 3
