"""Tables that grow with the input: never broadcast by their compressed size, cut into tasks by their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill import skew
from spanmill.operators import diff, forest, tree
from spanmill.schema import conform
from spanmill.session import BROADCAST_ROWS, land


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_landed_table_is_not_broadcast(spark):
    """Constant columns make these rows a few KB, far below Spark's threshold."""
    few = lambda n: land(spark.range(n).select((F.col("id") % 7).alias("k"), *[F.lit(i).alias(f"c{i}") for i in range(12)]))
    big, small = few(BROADCAST_ROWS + 1), few(BROADCAST_ROWS)
    other = spark.range(1 << 40).select((F.col("id") % 7).alias("k"))
    assert "Broadcast" not in plan(other.join(big.select("k").distinct(), "k", "left_semi"))
    assert "Broadcast" not in plan(other.join(big.select("k", "c1"), "k", "left"))
    assert "Broadcast" in plan(other.join(small.select("k", "c1"), "k", "left"))
    assert "Broadcast" in plan(big.join(F.broadcast(spark.range(3).select(F.col("id").alias("k"))), "k"))


def test_lookup_is_cut_by_rows(spark):
    a = spark.range(9).select(F.col("id").cast("string").alias("run_id"), F.col("id").alias("ptr"))
    b = a.withColumn("x", F.lit(1))
    on, n = ["run_id", "ptr"], 10 * skew.TASK_ROWS
    j = skew.lookup(a, b, on, rows=n)
    assert plan(j).count("hashpartitioning(run_id") == 2 and "Broadcast" not in plan(j) and j.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, j.collect())) == sorted(map(tuple, skew.lookup(a, b, on).collect())) and j.count() == 9


def test_last_rounds_with_few_open_rows(spark, monkeypatch):
    """Rounds in which only few rows are open, over many that are finished, give the same places; so do spread tables."""
    rows = []
    for run in range(6):
        for i in range(40):
            parent = None if i == 0 else f"s{i - 1}" if run == 0 else "gone" if run == 1 and i == 7 else f"s{i // 2}" if i > 1 else "s0"
            rows.append((f"r{run}", f"s{i}", parent, ["session", "subagent", "llm_call"][i % 3], "x", 90_000_000 + i))
    df = conform(spark.createDataFrame(rows, "run_id string, span_id string, parent_id string, kind string, name string, start_ms long"))
    cols = ["run_id", "span_id", "parent_id", "depth", "scope_id", "owner_id", "call_id", "container_id", "parent_kind", "span_seq"]
    read = lambda: sorted(map(tuple, tree.place(df)[0].select(*cols).collect()), key=str)
    sums = lambda: sorted(map(tuple, tree.subtree(df.filter("run_id <> 'r1'"), {"n": ("sum", F.lit(1).cast("long"))}).collect()))
    want = read(), sums()
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 60)
    monkeypatch.setattr(tree, "BROADCAST_ROWS", 60)
    assert (read(), sums()) == want


def odd_runs(spark):
    """Ordinary runs and such with broken links, cycles, repeated or null ids, no root, and a chain."""
    rows = []
    for run in range(6):
        for i in range(30):
            parent = None if i == 0 else f"s{i // 2}" if i > 1 else "s0"
            parent = {(1, 7): "gone", (2, 9): "s18", (2, 20): "s20", (4, 5): "s29"}.get((run, i), f"s{i - 1}" if run == 3 and i else parent)
            rows.append((f"r{run}", f"s{i}", parent, ["session", "subagent", "llm_call", None][i % 4], f"n{i % 3}", 90_000_000 + i * 7 % 11, i))
    rows += [("twice", "a", None, "session", "x", 1, 1), ("twice", "b", "a", "subagent", "x", 2, 2), ("twice", "b", "a", "llm_call", "x", 2, 3), ("twice", "c", "b", "llm_call", "x", 3, 4),
             ("rootless", "a", "b", "session", "x", 1, 1), ("rootless", "b", "a", "session", "x", 2, 2), ("rootless", "c", "b", None, "x", 2, 2),
             ("nulls", None, None, "session", "x", 1, 1), ("nulls", "b", "zz", "llm_call", "x", None, None), (None, "a", None, "session", "x", 1, 1), (None, "b", "a", "hook", "x", 1, 1)]
    ddl = "run_id string, span_id string, parent_id string, kind string, name string, start_ms long, tok_input long"
    return conform(spark.createDataFrame(rows, ddl))


def test_runs_in_tasks_equal_joins(spark, monkeypatch):
    """Every tree operator gives the same rows whether runs are folded in tasks or by joins."""
    df = odd_runs(spark)
    rows = lambda d: sorted(map(str, d.collect()))

    def read():
        placed, warn, chunked = tree.place(df)
        fixed, warn2 = tree.repair_tree(df)
        whole = placed.filter("run_id not in ('twice', 'nulls')")
        sums = {"n": ("sum", F.lit(1).cast("long")), "lo": ("min", F.col("start_ms")), "hi": ("max", F.when(F.col("kind") == "hook", F.col("start_ms"))), "t": ("sum", F.col("tok_input"))}
        out = [placed.select(sorted(placed.columns)), warn, fixed, warn2, tree.repaired_parents(df), tree.subtree(placed, sums), tree.subtree(placed, sums, ["kind"]), tree.intervals(whole),
               tree.preorder_key(whole), tree.closure(placed), tree.agent_tree_rollup(placed.withColumn("cost_micro", F.col("tok_input"))), diff.path_keys(whole, keep=["kind", "offset_ms"])]
        return [rows(d) for d in out], chunked

    got = read()
    assert len(got[0][0]) > 190 and len(got[0][1]) == 5
    monkeypatch.setattr(forest, "RUN_ROWS", 0)
    want = read()
    for a, b in zip(got[0], want[0], strict=True):
        assert a == b
    assert not got[1] and not want[1]


def test_ordinary_runs_need_no_joins(spark, monkeypatch):
    """Repair, places, sums and numbers of runs that fit a task: one shuffle by run, no round of joins."""
    def none(*a, **k):
        raise AssertionError("joined")
    monkeypatch.setattr(tree, "lookup", none)
    df = odd_runs(spark).filter("run_id like 'r_'")
    placed = tree.place(df)[0]
    assert tree.subtree(placed, {"n": ("sum", F.lit(1).cast("long"))}).agg(F.max("n")).first()[0] == 30
    assert tree.intervals(placed).agg(F.max("leave")).first()[0] == 29 and tree.closure(placed).count() > 400


def test_wide_rows_are_shuffled_once(spark, monkeypatch):
    """The join of rows with their places and the windows inside runs use one shuffle by run."""
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    seen = []
    monkeypatch.setattr(forest, "land", lambda d: (seen.append((plan(d), d.sparkSession.conf.get("spark.sql.requireAllClusterKeysForCoPartition"))), land(d))[1])
    tree.place(odd_runs(spark).filter("run_id like 'r_'"))
    assert [p.count("Exchange hashpartitioning") for p, _ in seen] == [1, 2] and seen[1][1] == "false"
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def reads_spans(df, t):
    return bool(set(df.inputFiles()) & set(t.spans.inputFiles()))


def test_usage_reads_the_spans_once(spark, sf):
    """The identity of the tool spans is landed: the figures hang on it, not on repeated joins over the spans."""
    from spanmill.operators import toolusage
    from spanmill.plans.catalog_rules import trace
    t = trace(spark, sf)
    ident = toolusage.tool_identity(t.spans)
    assert reads_spans(ident, t)
    assert not reads_spans(toolusage.tool_usage(ident), t) and not reads_spans(toolusage.tool_usage_subs(ident), t)


def test_rules_read_the_spans_once(spark, sf):
    """Frames that a rule uses several times are landed, so its windows run once."""
    from spanmill.operators import rules
    from spanmill.plans.catalog_rules import trace
    t = trace(spark, sf)
    assert not reads_spans(rules.duplicate_reads(t), t)
    clusters = rules._retry_clusters(t)
    assert not reads_spans(clusters, t) and clusters.count() > 0


def test_written_tables_move_the_spans_once(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from spanmill.plans.catalog_rules import trace
    from spanmill.sinks import export
    t, by, plain = trace(spark, sf), [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: by.append(a) or plain(self, *a))

    def written(name, spans):
        by.clear()
        export.write_tables(str(tmp_path / name), t.runs, spans)
        rows = spark.read.parquet(str(tmp_path / name / "spans")).select("run_id", "span_id", "source", F.col("start_day").cast("string"))
        return sorted(map(tuple, rows.collect())), any("chunk" in a for a in by)

    want, moved = written("cold", t.spans)
    assert len(want) == t.spans.count() and not moved
    hot = t.spans.withColumn("chunk", F.pmod(F.hash("span_id"), F.lit(3)))
    assert written("hot", hot) == (want, True)
    monkeypatch.setattr(skew, "TASK_ROWS", 300)
    assert written("spread", t.spans) == (want, False)
