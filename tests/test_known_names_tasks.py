"""Known names by windows of bytes: seams, shared grams, long names and one count per name and task."""

from __future__ import annotations

import pyarrow as pa

from spanmill.operators import known_names as K


def block(names):
    """A block of names that are looked up by their first gram."""
    q = [next(k for k in K.GRAMS if k <= len(n.encode())) for n in names]
    return K.Names(pa.table({"name": pa.array(names), "q": pa.array(q, pa.int32()), "at": pa.array([0] * len(names), pa.int32())}))


def test_windows_equal_substring_search(monkeypatch):
    monkeypatch.setattr(K, "PIECE", 11)  # every name crosses a seam somewhere
    names = ["a", "ab", "abc", "ßé", "é", "😀", "x" * 15, "x" * 16, "x" * 200, "x" * 100 + "y", "x" * 99 + "yy", "prefix-shared-by-1", "prefix-shared-by-2", "\x00", "\x00\x00\x00"]
    texts = ["", None, "abc", "ab", "c", "ßé😀", "x" * 300, "x" * 100 + "yy", "in prefix-shared-by-2", "\x00\x00", "z" * 40 + "ab", ""]
    want = {(i, n) for i, t in enumerate(texts) for n in names if t and n in t}
    for arr in (pa.array(texts), pa.array(["abc", *texts])[1:], pa.array(texts, pa.large_string())):
        row, name = block(names).found(arr)
        got = [(r, names[n]) for r, n in zip(row.tolist(), name.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(block(names).found(pa.array([], pa.string()))[0]) == 0


def test_positions_make_no_rows(spark):
    """A window of a text is no row of a join: a task returns counts."""
    df = spark.createDataFrame([("ab" * 50, ["ab", None]), ("b", None)], "text string, tags array<string>")
    found = K.names_in_texts(df, spark.createDataFrame([("ab",), ("b",), ("zz",)], "name string"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "BroadcastHashJoin" not in text
    assert sorted(map(tuple, found.collect())) == [("tags", "ab", 1), ("tags", "b", 1), ("text", "ab", 1), ("text", "b", 2)]
