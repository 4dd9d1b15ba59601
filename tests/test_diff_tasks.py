"""Diffs folded and matched in tasks against the joins, and span tables that are bucketed by run."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanmill import skew
from spanmill.operators import diff, forest, tree
from spanmill.plans import views
from spanmill.schema import conform

DDL = "run_id string, span_id string, parent_id string, kind string, name string, status string, start_ms long, duration_ms long, model string, tok_input long, tok_output long, cost_source string, depth int"


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans(spark, runs=24):
    rng, out = random.Random(3), []
    for r in range(runs):
        deep = []
        for i in range(rng.randint(1, 25)):
            at = None if i == 0 or rng.random() < 0.05 else rng.randrange(i)
            up = None if at is None else f"s{at}"
            deep.append(0 if at is None else deep[at] + 1)
            kind = rng.choice(["subagent", "llm_call", "tool_call", None])
            out.append((f"r{r}", f"s{i}", up, kind, rng.choice(["x", "y", "", None]), rng.choice(["ok", "error", None]), rng.choice([None, *range(9)]), rng.choice([None, 5, 7]), "m", i, 1, "computed", deep[i]))
    tail = ("ok", 1, 1, "m", 1, 1, "computed", 0)
    out += [("twice", "a", None, "session", "x", *tail), ("twice", "b", "a", "subagent", "x", *tail), ("twice", "b", "a", "subagent", "x", *tail), ("nulls", None, None, "session", "x", *tail),
            ("nulls", "b", "a", "subagent", "x", *tail), ("ring", "a", "b", "session", "x", *tail), ("ring", "b", "a", "session", "x", *tail), (None, "a", None, "session", "x", *tail),
            ("lost", "a", "gone", "llm_call", "x", *tail), ("lost", "b", "gone2", "llm_call", "x", *tail)]
    d = spark.createDataFrame(out, DDL)
    return conform(d.drop("depth")).withColumn("cost_micro", F.col("tok_input") * 3).join(d.select("run_id", "span_id", "depth").distinct(), ["run_id", "span_id"], "left")


def some_pairs(spark):
    p = [(f"p{i}", f"r{2 * i}", f"r{2 * i + 1}") for i in range(10)]
    p += [("same", "r1", "r1"), ("again", "r0", "r5"), ("again", "r2", "r7"), (None, "r3", "r4"), ("half", "r8", "none"), ("none", "none", "no"), ("open", None, "r9"), ("both", "r20", "r21"), ("both", "r20", "r21"),
          ("t", "twice", "r22"), ("n", "r22", "nulls"), ("c", "ring", "r23"), ("l", "lost", "lost")]
    return spark.createDataFrame(p, "pair_id string, a_run string, b_run string")


def test_pairs_in_tasks_equal_joins(spark, monkeypatch):
    s, p, joined = spans(spark), some_pairs(spark), []
    by_joins = diff._diff_by_joins
    monkeypatch.setattr(diff, "_diff_by_joins", lambda *a: joined.append(rows(a[1].select("pair_id").distinct())) or by_joins(*a))
    got = diff.diff_many(s, p)
    assert joined == [sorted(f"Row(pair_id={x!r})" for x in (None, "again", "both", "t", "n", "c", "l"))]
    want = by_joins(s, p, False)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert rows(got) == rows(want) and {r["side"] for r in got.select("side").distinct().collect()} == {"matched", "added", "removed"}
    monkeypatch.setattr(forest, "RUN_ROWS", 30)
    assert rows(diff.diff_many(s, p)) == rows(want)
    assert diff.diff_many(s.limit(0), p).count() == 0 and diff.diff_many(s, p.limit(0)).count() == 0


def test_ordinary_pairs_need_no_join_on_paths(spark, monkeypatch):
    """One shuffle by run and one by pair; a run that lies in many pairs takes part in each."""
    def none(*a):
        raise AssertionError("joined")
    monkeypatch.setattr(diff, "_diff_by_joins", none)
    s = spans(spark).filter("run_id like 'r_'")
    p = spark.range(40).select("id", F.lit("r1").alias("a_run"), F.concat(F.lit("r"), F.col("id") % 10).alias("b_run")).withColumnRenamed("id", "pair_id")
    got = diff.diff_many(s, p)
    one = s.filter("run_id = 'r1'").count()
    assert got.filter("a_span_id is not null").count() == 40 * one and got.filter("pair_id % 10 = 1 and side <> 'matched'").count() == 0


def test_spans_bucketed_by_run_are_not_shuffled(spark, monkeypatch):
    """The build shuffles the raw spans once; roll-ups and pairs read the runs where they lie, whole, with the rows of the plain build."""
    monkeypatch.setattr(skew, "TASK_ROWS", 80)
    raw = spans(spark).drop("depth").filter("run_id like 'r%'")
    n, rates = raw.count(), views.pricing(spark)
    plain = views.build_trace(spark, raw, raw, rates)
    plans, land = [], forest.land
    monkeypatch.setattr(forest, "land", lambda d, *a: plans.append(plan(d)) or land(d, *a))
    laid = views.build_trace(spark, raw, lambda r: r.select("run_id").distinct(), rates, parts=-(-n // 80))
    assert n > 240 and not any("Exchange hashpartitioning" in x for x in plans) and rows(laid.spans) == rows(plain.spans) and laid.runs.count() == 25
    assert "Exchange hashpartitioning" not in plan(laid.spans.groupBy("run_id").count())
    want = rows(tree.subtree_rollup(plain.spans))
    plans.clear()
    assert rows(tree.subtree_rollup(laid.spans)) == want and not any("Exchange hashpartitioning" in x for x in plans)
    p = some_pairs(spark)
    assert rows(diff.diff_many(laid.spans, p)) == rows(diff.diff_many(plain.spans, p))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("spanmill_")]
