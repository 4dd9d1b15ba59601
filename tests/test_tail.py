"""Growing files: every finished line once, over restarts, split ranges, small steps and rotation."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanmill.streaming import live
from spanmill.streaming.tail import ByteRange, Ledger, TailReader, lines_of, opened


def line(i: int, pad: int = 0) -> str:
    return json.dumps({"uuid": f"u{i}", "type": "user", "sessionId": "s", "timestamp": "2026-01-05T10:00:00Z", "pad": "é" * pad}) + "\n"


def start(spark, src, tmp, **options):
    d = live.tailed_records(spark, str(src), str(tmp / "ledger"), **options).select("file", "position", "uuid")
    return d.writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "ck")).start()


def seen(spark, tmp):
    return sorted((r["file"].rsplit("/", 1)[1], r["position"], r["uuid"]) for r in spark.read.parquet(str(tmp / "out")).collect())


def wanted(src):
    out = []
    for f in sorted(src.rglob("*.jsonl")):
        at = 0
        for x in f.read_bytes().split(b"\n")[:-1]:
            out += [(f.name, at, json.loads(x)["uuid"])] if x.startswith(b"{") else []
            at += len(x) + 1
    return sorted(out)


def test_a_file_grows_twice_over_a_restart(spark, tmp_path):
    src = tmp_path / "logs"
    (src / "deep").mkdir(parents=True)
    a, b = src / "a.jsonl", src / "deep" / "b.jsonl"
    a.write_text("".join(line(i) for i in range(50)))
    (src / "other.txt").write_text(line(999))
    q = start(spark, src, tmp_path)
    q.processAllAvailable()
    assert seen(spark, tmp_path) == wanted(src)
    with a.open("a") as f:
        f.write("".join(line(i, 300) for i in range(50, 90)) + "not json\n\n" + line(90)[:20])  # the last line is not finished
    q.processAllAvailable()
    assert len(seen(spark, tmp_path)) == 90
    q.stop()
    with a.open("a") as f:
        f.write(line(90)[20:])
    b.write_text("".join(line(i) for i in range(100, 130)))
    q = start(spark, src, tmp_path)
    q.processAllAvailable()
    got = seen(spark, tmp_path)
    assert got == wanted(src) and len(got) == 121 == len(set(got))
    a.write_text(line(500))  # rotated in place
    q.processAllAvailable()
    q.stop()
    assert seen(spark, tmp_path) == sorted([*got, ("a.jsonl", 0, "u500")])


def test_small_steps_and_splits(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.jsonl").write_text("".join(line(100 * k + i, 17 * i) for i in range(40)))
    q = start(spark, src, tmp_path, max_bytes=3000, split_bytes=700)
    q.processAllAvailable()
    q.stop()
    assert seen(spark, tmp_path) == wanted(src)
    assert Ledger(str(tmp_path / "ledger")).step > 10


@pytest.mark.parametrize("split", [1, 2, 7, 1000])
def test_every_split_gives_each_line_once(tmp_path, split):
    data = b"one\n\nthree\r\n" + b"x" * 100_000 + b"\nlast\nopen"
    (tmp_path / "f.jsonl").write_bytes(data)
    end = data.rindex(b"\n") + 1
    files, path = opened(str(tmp_path / "f.jsonl"))
    cuts = range(0, end, split * 997 if split == 1000 else max(split, end // 50))
    with files.open_input_file(path) as f:
        got = [x for lo in cuts for x in lines_of(f, ByteRange(path, lo, min(lo + cuts.step, end), lo == 0), len(data))]
    assert [x for _, x in got] == data[: end - 1].split(b"\n") and [p for p, _ in got] == [0, 4, 5, 12, 100_013]


def test_ledger_survives_a_lost_offset(tmp_path):
    """A step that was written but never logged by Spark is kept, and compacted ledgers give the same positions."""
    src = tmp_path / "logs"
    src.mkdir()
    (src / "a.jsonl").write_text(line(1))
    options = {"path": str(src), "ledger": "file://" + str(tmp_path / "ledger")}
    first = TailReader(options)
    assert first.initialOffset() == {"step": 0} and first.latestOffset() == {"step": 1} == first.latestOffset()
    again = TailReader(options)
    assert again.latestOffset() == {"step": 1}
    assert [(p.start, p.end) for p in again.partitions({"step": 0}, {"step": 1})] == [(0, len(line(1)))]
    for i in range(120):
        with (src / "a.jsonl").open("a") as f:
            f.write(line(i))
        again.latestOffset()
    third = TailReader(options)
    assert third.latestOffset() == {"step": 121} and third.ledger.at == again.ledger.at
    assert third.partitions({"step": 3}, {"step": 3}) == [] and list(TailReader({**options, "path": str(tmp_path / "none")})._growth()) == []


def test_columns(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    d = live.tailed_records(spark, str(tmp_path / "logs"), str(tmp_path / "ledger"))
    assert d.isStreaming and d.columns[:3] == ["file", "position", "uuid"] and d.select(F.col("position")).schema[0].dataType.simpleString() == "bigint"
