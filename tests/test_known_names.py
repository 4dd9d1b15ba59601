"""Known names inside texts, against a plain substring search."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanmill.operators import known_names as K
from spanmill.operators import privacy
from spanmill.sinks import export

DDL = "text string, tags array<string>, more map<string,string>, n int, `a.b` string"


def brute(rows, names):
    c = Counter()
    for text, tags, more, _, dotted in rows:
        for col, cells in (("text", [text]), ("tags", tags or []), ("more", (more or {}).values()), ("a.b", [dotted])):
            for cell in cells:
                c.update((col, n) for n in {n for n in names if n} if cell and n in cell)
    return dict(c)


def found(df):
    return {(r["column"], r["name"]): r["cells"] for r in df.collect()}


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    abc = "ab-é😀\n/"
    word = lambda lo, hi: "".join(rng.choice(abc) for _ in range(rng.randint(lo, hi)))
    names = ["", None, "a", "secret-app", "secret-app", *[word(1, 40) for _ in range(60)], "x" * 5000]
    rows = [(word(0, 400), [word(0, 30), None], {"k": word(0, 30)}, 1, word(0, 9)) for _ in range(40)]
    # names at the seams of pieces, in very long texts, at both ends, repeated
    rows += [("z" * (K.PIECE - i) + "secret-app" + "z" * 9000, None, None, None, None) for i in range(0, 12, 3)]
    rows += [("q" * 300_000 + "x" * 5000 + "q", ["secret-app" * 3], {}, None, ""), (None, [], None, None, None), ("in my-secret-app/src", None, {"k": None}, 2, "secret-ap")]
    return spark.createDataFrame(rows, DDL), spark.createDataFrame([(n,) for n in names], "name string"), brute(rows, names)


def test_equals_substring_search(case):
    df, names, want = case
    assert found(K.names_in_texts(df, names)) == want and want[("text", "secret-app")] == 5 and want[("text", "x" * 5000)] == 1


def test_blocks_change_nothing(case, monkeypatch):
    df, names, want = case
    monkeypatch.setattr(K, "BLOCK_ROWS", 7)
    assert found(K.names_in_texts(df, names)) == want


def test_texts_are_not_shuffled(case):
    df, names, _ = case
    plan = K.names_in_texts(df, names)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "hashpartitioning(piece" not in plan and "hashpartitioning(gram" not in plan


def test_empty_inputs(spark, case):
    df, names, _ = case
    assert not found(K.names_in_texts(df.limit(0), names)) and not found(K.names_in_texts(df, names.limit(0)))
    assert not found(K.names_in_texts(df.select("n"), names))


def test_known_names_of_runs(spark):
    runs = spark.createDataFrame([("app", "/work/app"), (None, "C:\\src\\other\\"), ("", None)], "project_name string, project_path string")
    assert sorted(r["name"] for r in privacy.known_project_names(runs).collect()) == sorted({"app", "/work/app", "C:\\src\\other\\", "other"})


def test_sinks_refuse_to_write(spark, tmp_path):
    f = spark.createDataFrame([("r", 1_700_000_000_000, "about my-secret-app", {"m": 1}, 1, 0)], "run_id string, start_ms bigint, note string, by_model map<string,bigint>, cost_micro bigint, wasted_micro bigint")
    private = spark.createDataFrame([("secret-app",)], "name string")
    s = f.select("run_id", F.lit("x").alias("span_id"), F.lit(0).alias("chunk"), F.lit(0).alias("span_seq"))
    head = f.select("run_id", "start_ms", "note", F.lit("claude-code").alias("source"))
    with pytest.raises(ValueError, match="known name"):
        export.write_tables(str(tmp_path / "t"), head, s, private)
    assert not (tmp_path / "t").exists()
    export.write_tables(str(tmp_path / "t"), head.drop("note"), s, private)
    assert (tmp_path / "t" / "spans").exists()
    with pytest.raises(ValueError, match="known name"):
        export.day_aggregates_csv(f.withColumn("by_model", F.create_map(F.lit("secret-app-7b"), F.lit(1).cast("bigint"))), str(tmp_path / "d"), private=private)
