"""Tree operators on deep chains, random forests and broken links, against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanmill.operators import diff, tree
from spanmill.schema import conform

DDL = "run_id string, span_id string, parent_id string, kind string, name string, start_ms long"


def walk(rows):
    """(run, span) -> ancestors, nearest first."""
    by = {(r[0], r[1]): r for r in rows}
    out = {}
    for k, r in by.items():
        up, p = [], r[2]
        while p is not None:
            up.append(by[r[0], p])
            p = by[r[0], p][2]
        out[k] = up
    return out


@pytest.fixture(scope="module")
def forest(spark):
    r = random.Random(4)
    rows = []
    for run in range(12):
        n = r.randrange(1, 60)
        for i in range(n):
            parent = None if i == 0 or r.random() < 0.04 else f"s{r.randrange(max(0, i - 4), i)}"
            rows.append((f"r{run}", f"s{i}", parent, r.choice(["session", "subagent", "llm_call", "tool_call", "turn"]), r.choice("ab"), 90_000_000 + r.randrange(20)))
    return rows, conform(spark.createDataFrame(rows, DDL))


def test_place_and_subtree(forest):
    rows, df = forest
    up = walk(rows)
    placed, _, _ = tree.place(df)
    near = lambda a, kinds: next((x[1] for x in a if x[3] in kinds), None)
    for x in placed.collect():
        a = up[x["run_id"], x["span_id"]]
        box = ("session", "subagent")
        assert x["depth"] == len(a) and x["owner_id"] == near(a, ("subagent",)) and x["call_id"] == near(a, ("llm_call",)) and x["container_id"] == near(a, box)
        assert x["parent_kind"] == (a[0][3] if a else None)
        assert x["scope_id"] == (x["span_id"] if x["kind"] in box else near(a, box) or (a[-1][1] if a else x["span_id"]))
    got = {(x["run_id"], x["span_id"]): (x["n"], x["lo"], x["hi"]) for x in tree.subtree(placed, {
        "n": ("sum", F.lit(1).cast("long")), "lo": ("min", F.col("start_ms")), "hi": ("max", F.when(F.col("kind") == "turn", F.col("start_ms")))}).collect()}
    under = {k: [] for k in up}
    for r in rows:
        for x in [r, *up[r[0], r[1]]]:
            under[x[0], x[1]].append(r)
    assert got == {k: (len(v), min(x[5] for x in v), max((x[5] for x in v if x[3] == "turn"), default=None)) for k, v in under.items()}
    # a hit and all above it; agents below a root
    found = {(x["run_id"], x["span_id"]) for x in tree.find_spans(placed, "A").collect()}
    assert found == {k for k, v in under.items() if any(x[4] == "a" for x in v)}
    roots = placed.filter("kind = 'subagent' and name = 'a'").select("run_id", F.col("span_id").alias("root_id"))
    want = {(r[0], r[1], near([r, *[x for x in up[r[0], r[1]] if x[3] == "subagent"]], ("subagent",)) if r[4] == "a" else
             next((x[1] for x in up[r[0], r[1]] if x[3] == "subagent" and x[4] == "a"), None)) for r in rows if r[3] == "subagent"}
    assert {tuple(x) for x in tree.agents_within(placed, roots).select("run_id", "agent_id", "root_id").collect()} == {x for x in want if x[2]}


def test_intervals_tell_ancestors(forest):
    rows, df = forest
    up = walk(rows)
    placed, _, _ = tree.place(df)
    at = {(x["run_id"], x["span_id"]): (x["enter"], x["leave"]) for x in tree.intervals(placed).collect()}
    for run in {r[0] for r in rows}:
        ids = [k for k in at if k[0] == run]
        assert sorted(at[k][0] for k in ids) == list(range(len(ids)))
        for a in ids:
            for b in ids:
                assert (at[a][0] < at[b][0] <= at[a][1]) == (a[1] in [x[1] for x in up[b]])
    order = [(x["run_id"], x["span_id"]) for x in tree.tree_preorder(placed).collect()]
    keys = {(x["run_id"], x["span_id"]): x["order_path"] for x in tree.preorder_key(placed).collect()}
    assert order == sorted(keys, key=lambda k: (k[0], keys[k]))


def chain(spark, run, p, n):
    i = F.col("id")
    kind = F.when(i == 0, "session").when(i % 1000 == 0, "subagent").otherwise("tool_call")
    return conform(spark.range(n).select(F.lit(run).alias("run_id"), F.concat(F.lit(p), i).alias("span_id"), F.when(i > 0, F.concat(F.lit(p), i - 1)).alias("parent_id"), kind.alias("kind"),
                                         F.lit("x").alias("name"), (i + 90_000_000).alias("start_ms")))


def test_chain_of_100_000(spark):
    """A chain whose ancestor lists would hold five billion entries."""
    placed, warn, _ = tree.place(chain(spark, "a", "s", 100_000))
    x = placed.filter("span_id = 's99999'").first()
    assert (x["depth"], x["owner_id"], x["container_id"], x["scope_id"]) == (99_999, "s99000", "s99000", "s99000") and warn.count() == 0


def test_chains_are_numbered_and_paired(spark):
    n = 2500
    placed, _, _ = tree.place(chain(spark, "a", "s", n).unionByName(chain(spark, "b", "t", n)))
    placed = placed.withColumn("cost_source", F.lit("unknown")).cache()
    iv = tree.intervals(placed).join(placed.select("run_id", "span_id", "depth"), ["run_id", "span_id"])
    assert iv.filter((F.col("enter") != F.col("depth")) | (F.col("leave") != n - 1)).count() == 0
    al = diff.diff_align(placed, "a", "b").cache()
    assert al.groupBy("side").count().collect() == [("matched", n)] and al.filter("substr(a_span_id, 2) <> substr(b_span_id, 2)").count() == 0


def test_long_cycles_and_tails(spark):
    """A cycle of 40 with a tail of 70 behind it, in a run with a long sound chain; another run is untouched."""
    rows = [("r", "root", None, "session", "x", 90_000_000)] + [("r", f"k{i}", "root" if i == 0 else f"k{i - 1}", "turn", "x", 90_000_001) for i in range(130)]
    rows += [("r", f"c{i:02d}", f"c{(i + 1) % 40:02d}", "turn", "x", 90_000_002) for i in range(40)] + [("r", f"t{i}", "c05" if i == 0 else f"t{i - 1}", "turn", "x", 90_000_003) for i in range(70)]
    rows += [("q", "root", None, "session", "x", 90_000_000), ("q", "k0", "root", "turn", "x", 90_000_000)]
    fixed, warn = tree.repair_tree(conform(spark.createDataFrame(rows, DDL)))
    got = {(x["run_id"], x["span_id"]): (x["parent_id"], len(x["path"])) for x in fixed.collect()}
    assert all(got["r", f"c{i:02d}"] == ("root", 1) for i in range(40)) and got["r", "t69"] == ("t68", 71) and got["r", "k129"] == ("k128", 130) and got["q", "k0"] == ("root", 1)
    assert "40 span(s)" in warn.collect()[0]["message"] and warn.count() == 1
    with pytest.raises(ValueError):
        tree.subtree(conform(spark.createDataFrame(rows[131:133], DDL)).withColumn("parent_id", F.when(F.col("span_id") == "c00", "c01").otherwise("c00")), {"n": ("sum", F.lit(1).cast("long"))})
