"""Hot groups: with a tiny limit every run is cut into chunks; all results must stay the same."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from spanmill import skew
from spanmill.operators import diff, rules, timeline, triage
from spanmill.operators.pricing import context_cap_estimates
from spanmill.operators.tree import concurrency_groups
from spanmill.plans import views
from spanmill.plans.catalog_rules import OVERRIDES


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_scan_equals_plain_windows(spark):
    rnd = random.Random(3)
    data = [(f"k{rnd.choice([0, 0, 0, 1, 2])}", rnd.randrange(60), i, rnd.choice([None, rnd.randrange(9)])) for i in range(400)]
    df = spark.createDataFrame(data, "run_id string, t int, i int, v int")
    specs = {n: (n, F.col("v")) for n in ("sum", "max", "prev_max", "last", "prev_last", "next_first", "lag", "lead")}
    specs["rownum"] = ("rownum", None)
    cut, hot = skew.with_chunks(df, ["run_id"], ["t"], limit=40)
    assert hot and cut.select("chunk").distinct().count() > 3
    cols = ["run_id", "t", "i", *specs]
    assert rows(skew.scan(df, ["run_id"], ["t", "i"], specs).select(cols)) == rows(skew.scan(cut, ["run_id"], ["t", "i"], specs, True).select(cols))


def test_lookup_with_hot_keys(spark):
    left = spark.createDataFrame([("a", f"s{i}") for i in range(200)] + [("b", "z")], "k string, span_id string")
    right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    hot = skew.hot_groups(left, ["k"], 50)
    assert hot.count() == 1
    assert rows(skew.lookup(left, right, ["k"]).select("span_id", "x")) == rows(skew.lookup(left, right, ["k"], hot=hot).select("span_id", "x"))


def test_global_row_number(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("x"))
    got = skew.global_row_number(df, ["x"]).orderBy("x").select("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 501))


@pytest.fixture(scope="module")
def traces(spark, sf):
    th = rules.Thresholds.of(**OVERRIDES)
    plain = replace(views.event_trace(spark, sf), thresholds=th, memo={})
    assert not plain.chunked
    spark.conf.set(skew.HOT_ROWS_CONF, "12")
    try:
        hot = views.build_trace(spark, views.raw_event_spans(spark, sf), plain.runs, plain.pricing, th)
    finally:
        spark.conf.unset(skew.HOT_ROWS_CONF)
    assert hot.chunked and hot.spans.select("chunk").distinct().count() > 10
    return plain, hot


def test_silver_equal(traces):
    p, h = traces
    cols = ["run_id", "span_id", "parent_id", "span_seq", "depth", "scope_id", "owner_id", "cost_micro"]
    assert rows(p.spans.select(cols)) == rows(h.spans.select(cols))


def test_rules_equal(traces):
    p, h = traces
    cols = ["run_id", "finding_id", "rule", "severity", "waste_micro", "evidence"]
    a, b = rows(rules.apply_rules(p).select(cols)), rows(rules.apply_rules(h).select(cols))
    assert len(a) > 50 and a == b


def test_triage_equal(traces):
    p, h = traces
    cols = ["run_id", "span_id", "error_class", "reaction_micro", "recovery", "next_id"]
    oa, ob = triage.error_occurrences(p), triage.error_occurrences(h)
    assert rows(oa.select(cols)) == rows(ob.select(cols))
    assert rows(triage.error_clusters(p, oa)) == rows(triage.error_clusters(h, ob))


def test_timeline_equal(traces):
    p, h = traces
    for f in (timeline.time_segments, timeline.time_breakdown):
        assert rows(f(p.spans)) == rows(f(h.spans, chunked=True))
    assert rows(timeline.cost_curve(p.spans)) == rows(timeline.cost_curve(h.spans, True))


def test_caps_groups_paths_equal(traces):
    p, h = traces
    assert rows(context_cap_estimates(p.spans, p.pricing, (40_000,))) == rows(context_cap_estimates(h.spans, h.pricing, (40_000,), True))
    assert rows(concurrency_groups(p.spans)) == rows(concurrency_groups(h.spans, True))
    assert rows(diff.path_keys(p.spans)) == rows(diff.path_keys(h.spans, True))


def test_evidence_beyond_the_array(traces, monkeypatch):
    p, _ = traces
    f = rules.apply_rules(p)
    whole = rows(rules.evidence_rows(p, f).select("run_id", "finding_id", "span_id", "pos"))
    monkeypatch.setattr(rules, "EVIDENCE_ARRAY", 3)
    f2 = rules.apply_rules(p)
    assert rows(rules.evidence_rows(p, f2).select("run_id", "finding_id", "span_id", "pos")) == whole


def test_evidence_array_is_whole_at_every_size(traces, monkeypatch, tmp_path, spark):
    from spanmill.sinks import export
    p, _ = traces
    cols = ["run_id", "finding_id", "evidence"]
    f = rules.apply_rules(p)
    whole = rows(f.select(cols))
    assert f.filter("rule = 'retry-loop' and size(evidence) > 2").count() > 0
    monkeypatch.setattr(rules, "EVIDENCE_ARRAY", 2)
    f2 = rules.apply_rules(p)
    assert rows(f2.select(cols)) == whole
    export.write_trace_json(p.runs, p.spans, f2, str(tmp_path / "j"))
    back = spark.read.schema("run_id string, insight struct<id:string,spanIds:array<string>>").json(str(tmp_path / "j" / "findings"))
    assert rows(back.select("run_id", "insight.id", "insight.spanIds")) == whole
