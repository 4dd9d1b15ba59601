"""Refreshes of a store against one full load of the same folder."""

from __future__ import annotations

import json
import os
import shutil

import fixtures as X
import pytest
from pyspark.sql import functions as F

from spanmill.plans import incremental, views
from spanmill.sources import common
from spanmill.sources.session_jsonl import SessionJsonlSource, read_records

TABLES = ["runs", "spans", "findings", "wasted", "rejects", "repairs", "warnings"]


def session(path, sid, sec, n, cwd="/work/b"):
    """A session with ``n`` failing calls of one command."""
    rows = [{"type": "user", "uuid": sid + "u", "timestamp": X.ts(sec), "sessionId": sid, "cwd": cwd, "message": {"role": "user", "content": "go"}}]
    for i in range(n):
        rows.append({"type": "assistant", "uuid": f"{sid}a{i}", "timestamp": X.ts(sec + 2 * i), "sessionId": sid, "message": {
            "id": f"{sid}m{i}", "model": "claude-sonnet-4-5", "usage": {"input_tokens": 10, "output_tokens": 5},
            "content": [{"type": "tool_use", "id": f"{sid}t{i}", "name": "Bash", "input": {"command": "make"}}]}})
        rows.append({"type": "user", "uuid": f"{sid}r{i}", "timestamp": X.ts(sec + 2 * i + 1), "sessionId": sid, "message": {
            "role": "user", "content": [{"type": "tool_result", "tool_use_id": f"{sid}t{i}", "is_error": True, "content": "Exit code 2\nmake: failed"}]}})
    X._w(path, rows)


def rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(*sorted(df.columns)).collect())



@pytest.fixture(scope="module")
def story(spark, tmp_path_factory):
    """Three refreshes with what each read, and the tables of one full load of the last state."""
    root = tmp_path_factory.mktemp("logs x")
    X.transcript(root)
    session(root / "proj" / "two.jsonl", "two", 100, 4)
    session(root / "proj" / "three.jsonl", "three", 200, 1)
    session(root / "proj" / "copy.jsonl", "two", 90, 2, "/work/copy")  # a second copy of run "two"
    store = incremental.Store(spark, str(tmp_path_factory.mktemp("store")))
    price = views.pricing(spark)
    read = lambda s: s.refresh(SessionJsonlSource(), str(root), price)
    steps = [read(store)]
    kept = rows(store.table("spans").filter("prov_file like '%/proj/sess-1%'"))
    session(root / "proj" / "two.jsonl", "two", 100, 5)
    session(root / "proj" / "four.jsonl", "four", 300, 3)
    (root / "proj" / "three.jsonl").unlink()
    steps += [read(store), read(store)]
    full = incremental.Store(spark, str(tmp_path_factory.mktemp("full")))
    read(full)
    return root, store, steps, full, kept


def opened(root, step):
    return sorted(r["path"].removeprefix("file:").removeprefix(str(root) + "/proj/") for r in step.files.collect())


def test_reads_only_what_changed(story):
    root, _, (first, second, third), _, _ = story
    assert len(opened(root, first)) == 10 and first.number == 0
    # the changed transcript, the new one, and the unchanged one that holds a copy of a changed run
    assert opened(root, second) == ["copy.jsonl", "four.jsonl", "two.jsonl"] and second.number == 1
    assert third.number is None and third.files.isEmpty()


def test_tables_equal_a_full_load(story):
    _, store, _, full, kept = story
    for name in TABLES:
        assert rows(store.table(name)) == rows(full.table(name)), name
    got = store.table("spans").filter("prov_file like '%/proj/sess-1%'")
    assert rows(got) == kept and store.table("findings").filter("rule = 'retry-loop'").count() == 2
    assert not store.table("runs").isEmpty() and store.table("spans").filter("prov_file like '%three.jsonl'").isEmpty()


def test_interrupted_refresh_is_not_read(spark, story, tmp_path):
    root, store, _, full, _ = story
    at = tmp_path / "store"
    shutil.copytree(store.path, at)
    # rows of a refresh that never wrote its ledger
    for name in ("runs", "spans", "touched"):
        spark.read.parquet(f"{at}/{name}/batch=0").write.parquet(f"{at}/{name}/batch=2")
    again = incremental.Store(spark, str(at))
    assert rows(again.table("runs")) == rows(full.table("runs"))
    copy = tmp_path / "logs"
    shutil.copytree(root, copy)
    shutil.rmtree(copy / "proj")
    assert again.refresh(SessionJsonlSource(), str(copy), views.pricing(spark)).number == 2
    assert all(again.table(n).isEmpty() for n in TABLES) and again.ledger().isEmpty()


def test_window_leaves_the_rest(spark, story):
    root, store, _, full, _ = story
    day = 86_400_000
    at = int(os.path.getmtime(root / "proj" / "four.jsonl") * 1000)
    r = store.refresh(SessionJsonlSource(), str(root), views.pricing(spark), window="1d", now_ms=at + 9 * day)
    assert r.number is None and rows(store.table("runs")) == rows(full.table("runs"))
    with pytest.raises(ValueError):
        store.refresh(SessionJsonlSource(), str(root), views.pricing(spark), window="soon", now_ms=at)
    f = common.list_sources(spark, str(root), "*.jsonl", F.col("path"))
    assert common.since(f, "2h", at).count() == f.count() and common.since(f, "1d", at + 9 * day).isEmpty()


def test_many_chosen_files_join_the_scan(spark, story, monkeypatch):
    root = story[0]
    files = common.list_files(spark, str(root), "*.jsonl").filter("path not like '%copy%'")
    want = rows(read_records(spark, str(root), files=files)[0].select("file", "line", "uuid"))
    monkeypatch.setattr(common, "LISTED", 2)
    assert rows(read_records(spark, str(root), files=files)[0].select("file", "line", "uuid")) == want and want
