"""Streams over chunked input give the batch answers, with duplicate, late and out-of-order chunks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanmill.operators import overview, rules
from spanmill.plans import views
from spanmill.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(df, name, mode, tmp):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / f"ck-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def chunks(spark, sf, tmp_path_factory):
    """Spans of twenty runs as five landed chunks; rows of a run are spread over chunks out of order."""
    t = views.event_trace(spark, sf)
    keep = t.spans.select("run_id").distinct().orderBy("run_id").limit(20)
    s = t.spans.join(F.broadcast(keep), "run_id", "left_semi").select(
        "run_id", "scope_id", "span_id", "kind", "name", "status", "start_ms", "end_ms", "model", "target_key", "tok_input", "tok_output", "tok_cache_read",
        "tok_cache_write", "tok_reasoning", "cache_write_1h", "cost_micro").cache()
    path = str(tmp_path_factory.mktemp("chunks"))
    for i in range(5):
        s.filter(F.pmod(F.hash("span_id"), F.lit(5)) == i).coalesce(1).write.mode("append").parquet(path)
    # one row far in the future closes every window
    last = s.agg(F.max("start_ms")).first()[0]
    return t, s, path, last


def stream(spark, chunks, n=1):
    return live.live_spans(spark, chunks[2], chunks[1].schema, n)


def test_run_totals(spark, chunks, tmp_path):
    got = run(live.live_run_totals(stream(spark, chunks)), "totals", "complete", tmp_path)
    want = overview.run_totals(chunks[1].withColumns({"depth": F.lit(0), "lines_added": F.lit(None).cast("long"), "lines_removed": F.lit(None).cast("long")}))
    cols = ["run_id", "cost_micro", "tok_total", "llm_calls", "tool_calls", "tool_errors"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_windows_and_sessions(spark, chunks, tmp_path):
    s = chunks[1].withColumn("event_ts", F.timestamp_millis("start_ms"))
    for name, f in (("day", lambda d: live.spend_windows(d, "1 day", watermark="60 days")), ("slide", lambda d: live.spend_windows(d, "1 hour", "10 minutes", "60 days")),
                    ("burst", lambda d: live.session_activity(d, "30 minutes", "60 days"))):
        got = run(f(stream(spark, chunks)), name, "complete", tmp_path)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(s).collect()))


def test_dedupe_and_pairing(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    rec = lambda u, sec, **k: json.dumps({"uuid": u, "type": "user", "sessionId": "s", "timestamp": f"2026-01-05T10:00:{sec:02d}Z", **k})
    (src / "a.jsonl").write_text("\n".join([rec("1", 1), rec("2", 2), "{bad", rec("1", 1)]))
    (src / "b.jsonl").write_text("\n".join([rec("2", 2), rec("3", 3)]))
    d = live.dedupe_stream(live.live_lines(spark, str(src), 1).drop("v"), ["uuid"])
    assert sorted(r["uuid"] for r in run(d, "dedupe", "append", tmp_path).collect()) == ["1", "2", "3"]
    c, r = tmp_path / "calls", tmp_path / "results"
    mk = lambda p, rows, ddl: spark.createDataFrame(rows, ddl).selectExpr("*").coalesce(1).write.mode("append").parquet(str(p))
    cd, rd = "transcript string, tool_use_id string, t bigint", "r_transcript string, r_tool_use_id string, t bigint, r_status string"
    mk(c, [("f", "t1", 1000), ("f", "t2", 2000)], cd)
    mk(r, [("f", "t1", 1060, "ok")], rd)
    calls = spark.readStream.schema(cd).parquet(str(c)).withColumn("call_ts", F.timestamp_seconds("t")).drop("t")
    res = spark.readStream.schema(rd).parquet(str(r)).withColumn("result_ts", F.timestamp_seconds("t")).drop("t")
    q = live.pair_stream(calls, res).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    # later rows move both watermarks past the bound
    mk(c, [("f", "t9", 900_000)], cd)
    mk(r, [("x", "y", 900_000, "ok")], rd)
    q.processAllAvailable()
    mk(c, [("f", "t10", 900_001)], cd)
    q.processAllAvailable()
    q.stop()
    got = {x["tool_use_id"]: x["status"] for x in spark.table("pairs").collect()}
    assert got["t1"] == "ok" and got["t2"] == "in_progress"


def test_alerts_equal_batch_rules(spark, chunks, tmp_path):
    t, s, path, last = chunks
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    end = spark.createDataFrame([("zzz", "zzz", "zzz", "llm_call", "m", "ok", last + 10 * 86_400_000)], "run_id string, scope_id string, span_id string, kind string, name string, status string, start_ms bigint")
    tail = tmp_path / "tail"
    s.coalesce(1).write.parquet(str(tail))
    df = live.live_alerts(live.live_spans(spark, str(tail), s.schema, 1), "1 minute")
    q = df.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cka")).start()
    q.processAllAvailable()
    for k in range(2):
        end.withColumn("start_ms", F.col("start_ms") + k).write.mode("append").parquet(str(tail))
        q.processAllAvailable()
    q.stop()
    got = sorted((r["run_id"], r["alert"], r["span_id"]) for r in spark.table("alerts").collect())
    one = rules.Trace(t.spans.join(s.select("run_id").distinct(), "run_id", "left_semi"), t.runs, t.pricing)
    want = [(r["run_id"], "retry-loop", r["evidence"][2]) for r in rules.retry_loop(one).collect()]
    for f in (rules.idle_cache_expiry, rules.cache_prefix_break):
        want += [(r["run_id"], r["rule"], r["evidence"][1]) for r in f(one).collect()]
    assert got == sorted(want) and got


def test_silent_scopes_leave_no_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ddl = ("run_id string, scope_id string, span_id string, kind string, name string, status string, start_ms bigint, end_ms bigint, model string, target_key string, "
           "tok_input bigint, tok_output bigint, tok_cache_read bigint, tok_cache_write bigint, tok_reasoning bigint, cache_write_1h bigint, cost_micro bigint")
    t0, hour = 1_767_600_000_000, 3_600_000
    src = tmp_path / "in"

    def add(*rows):
        full = [(r, r, f"{r}{ms}", kind, "Bash", "error" if kind == "tool_call" else "ok", t0 + ms, t0 + ms, "m" if kind == "llm_call" else None, "k",
                 1, 1, 5, 5, 0, 0, 7) for r, kind, ms in rows]
        spark.createDataFrame(full, ddl).coalesce(1).write.mode("append").parquet(str(src))

    def states(ck, name=None):
        r = spark.read.format("statestore")
        return {k["key"][0] for k in (r.option("stateVarName", name) if name else r).load(str(ck)).select("key").collect()}

    add(("a", "tool_call", 0), ("a", "llm_call", 10), ("a", "tool_call", 20), ("b", "llm_call", 30))
    alerts = live.live_alerts(live.live_spans(spark, str(src), ddl, 1), "1 minute", forget_ms=2 * hour)
    bursts = live.live_burst_totals(live.live_spans(spark, str(src), ddl, 1), "30 minutes", "1 minute")
    qs = [d.writeStream.format("memory").queryName(n).outputMode("append").option("checkpointLocation", str(tmp_path / n)).start() for n, d in (("al", alerts), ("bu", bursts))]

    def done():
        for q in qs:
            q.processAllAvailable()

    try:
        done()
        # the third failure within two hours still meets the first two
        add(("a", "tool_call", hour), ("b", "tool_call", hour + 1))
        done()
        add(("z", "llm_call", 2 * hour))
        done()
        add(("z", "llm_call", 2 * hour + 1))
        done()
        held = {n: states(tmp_path / "al", n) for n in ("open", "last", "seq", "seen")}
        assert held["seen"] >= {"a", "b"} and "a" in held["last"]
        for i in range(3):
            add(("z", "llm_call", 9 * hour + i))
            done()
    finally:
        for q in qs:
            q.stop()
    assert [(r["alert"], r["run_id"]) for r in spark.table("al").collect()] == [("retry-loop", "a")]
    for n in ("wait", "open", "last", "seq", "seen"):
        assert not states(tmp_path / "al", n) & {"a", "b"}, n
    got = {(r["run_id"], r["last_ms"] - t0): (r["cost_micro"], r["tok_total"], r["llm_calls"], r["tool_calls"], r["tool_errors"]) for r in spark.table("bu").collect()}
    assert got[("a", 20)] == (7, 12, 1, 2, 2) and got[("a", hour)] == (0, 0, 0, 1, 1) and got[("b", 30)][2] == 1
    assert not states(tmp_path / "bu") & {"a", "b"}
    with pytest.raises(ValueError):
        live.alert_processor(slack_ms=5, forget_ms=5)


def test_budget_gate(spark, chunks, tmp_path):
    seen = []
    w = live.spend_windows(stream(spark, chunks, 10), "1 day", watermark="60 days")
    q = live.budget_gate(w, 1, str(tmp_path / "over"), seen.append)
    q.processAllAvailable()
    q.stop()
    over = spark.read.parquet(str(tmp_path / "over"))
    assert seen and over.count() == over.filter("cost_micro > 1").count() > 0
