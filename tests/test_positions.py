"""Records by position against the lines of the files."""

from __future__ import annotations

import random

from spanmill.sources.positions import line_blocks, records_at


def test_records_at_equal_the_lines(spark, tmp_path):
    rnd, want = random.Random(5), {}
    for k in range(3):
        lines = ["x" * rnd.choice([0, 1, 7, 90, 700]) + f"ł{i}" * rnd.randrange(2) for i in range(900)]
        (tmp_path / f"log {k}.jsonl").write_bytes(("\r\n" if k == 1 else "\n").join(lines).encode())
        want |= {(f"log {k}", i + 1): t for i, t in enumerate(lines)}
    (tmp_path / "empty.jsonl").write_bytes(b"")
    blocks = line_blocks(spark, str(tmp_path), block=256, range_bytes=4096).cache()
    names = {r["path"].rsplit("/", 1)[1].removesuffix(".jsonl"): r["file"] for r in blocks.select("file", "path").distinct().collect()}
    assert set(names) == {"log 0", "log 1", "log 2"}
    ask = rnd.sample(sorted(want), 400) + [("log 0", 1), ("log 0", 900), ("log 0", 901), ("log 2", 5000), ("log 2", 0)]
    pos = spark.createDataFrame([(names[f], n) for f, n in ask + ask[:9]] + [("file:///gone.jsonl", 1), (None, 1), (names["log 0"], None)], "file string, line int")
    back = {v: k for k, v in names.items()}
    got = [((back[r["file"]], r["line"]), r["text"]) for r in records_at(pos, blocks, parts=3).collect()]
    # a last line without any text is no line
    assert len(got) == len(dict(got)) and dict(got) == {p: want[p] for p in ask if p in want and (want[p] or p[1] < 900)}
    assert records_at(pos.limit(0), blocks).count() == 0
