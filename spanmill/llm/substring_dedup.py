"""Substring de-duplication: word windows that occurred earlier are cut out.

Every window of ``n`` consecutive words gets a Rabin-Karp hash. A window is a repeat if the same words also start
earlier (smaller id, or earlier in the document). Repeats merge into maximal removal intervals.

Counting in Spark, in two steps so that windows seen once need not travel one by one:
1. A window's *anchor* is the smallest hash among its runs of ``GRAM`` words. Equal windows have equal anchors, and neighbouring windows
   mostly share one (about one anchor for eight windows at n = 20). Anchors are counted over all documents; a window under an
   anchor with one occurrence is counted as one.
2. Windows under repeated anchors are dealt by anchor, as runs that share it. Windows with the same anchor and the same hash (128 bits
   together) are equal, and the smallest (id, start) of each is found.

Hot passages: within each chunk of text a task keeps one representative per anchor or window and settles the others on the spot,
so a passage in a third of all documents sends one row per chunk, not one per document. A document's own starts are the largest group.

Cases: a null or empty text has no words; fewer than ``n`` words are never removed; rows with one id are one document each, and
windows at the same id and start do not remove each other, so equal rows get equal results; a null id counts as the smallest;
ids are integers; an empty table gives an empty result; extra columns stay in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import chunks, keyed
from .tokens import SPACED, Words

N, GRAM, WIDE = 20, 6, 31  # WIDE: windows of a run, one bit each
NULL_ID = int(np.iinfo(np.int64).min)
PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("bits", pa.int32())]))


def _column(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def window_anchors(w: Words, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, anchor hash and anchor place of every window inside one text."""
    from .tokens import run_hashes
    h = run_hashes(w.h[0], gram)
    span = n - gram + 1
    low, at = h, np.arange(len(h))
    width = 1
    while width < span and len(low):
        step = min(width, span - width)
        m = len(low) - step
        if m <= 0:
            low, at = low[:0], at[:0]
            break
        right = low[step:] < low[:m]  # the leftmost of equal ones
        low, at = np.where(right, low[step:], low[:m]), np.where(right, at[step:], at[:m])
        width += step
    i = np.flatnonzero(w.place[: len(low)] + n <= w.count[w.text[: len(low)]])
    return i, low[i], at[i]


def anchors_task(n: int, gram: int, schema: pa.Schema):
    """(anchor, did, k1, occurrences, salt): one representative per anchor and chunk; the other holders of an anchor that repeats
    inside the chunk are settled already and only pass through (salted). Rows of a document stay together, so they compress."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            w = Words(texts, SPACED, pair=False)
            i, a, at = window_anchors(w, n, gram)
            if not len(i):
                continue
            text = w.text[i]
            new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
            a, text = a[new], text[new]
            order = np.lexsort((text, a))
            a, text = a[order], text[order]
            first = np.r_[True, a[1:] != a[:-1]]
            count = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
            keep = first | np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])]
            a, text, first, count = a[keep], text[keep], first[keep], count[keep]
            order = np.argsort(text, kind="stable")
            a, text, first, count = a[order], text[order], first[order], count[order]
            rows = pa.array(text)
            salt = np.where(first, 0, np.arange(len(a)) % 997 + 1)
            yield pa.RecordBatch.from_arrays([_longs(a), _column(part, "did").take(rows), _column(part, "k1").take(rows), pa.array(np.minimum(count, 2), pa.int32()), pa.array(salt, pa.int32())], schema=schema)
    return run


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut rows into runs of at most WIDE rows in which the last key rises by one and the others stay: (first row, place in the run)."""
    *fixed, start = keys
    change = np.r_[True, start[1:] != start[:-1] + 1]
    for k in fixed:
        change[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(change)
    place = np.arange(len(start)) - first[np.cumsum(change) - 1]
    return np.flatnonzero(place % WIDE == 0), place % WIDE


def windows_task(n: int, gram: int, schema: pa.Schema):
    """Windows under repeated anchors. One representative (smallest id, start) per window and chunk, as runs that share the anchor:
    (a, did, k1, start, hashes). Later ones in the chunk are known repeats: one row per document with (start, bits) pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            w = Words(texts, SPACED, pair=False)
            i, a, _ = window_anchors(w, n, gram)
            anchors = _column(part, "anchors")
            sizes = anchors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            # (text, anchor) pairs as one number each, so one look-up serves all texts of the chunk; a chance hit only ships a window more
            wanted = np.sort(_pair(np.repeat(np.arange(len(texts)), sizes), flat.view(np.uint64)))
            have = _pair(w.text[i], a)
            hit = wanted[np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)] == have
            i, a = i[hit], a[hit]
            if not len(i):
                continue
            did = _column(part, "did").to_numpy(zero_copy_only=False).astype(np.int64)
            at, h = w.runs(n, 0)
            h, text, start = h[np.searchsorted(at, i)], w.text[i], w.place[i]
            order = np.lexsort((start, did[text], h, a))
            h, a, text, start = h[order], a[order], text[order], start[order]
            first = np.r_[True, (a[1:] != a[:-1]) | (h[1:] != h[:-1])]
            least = np.flatnonzero(first)[np.cumsum(first) - 1]
            same = (did[text] == did[text[least]]) & (start == start[least])  # representatives, and rows repeated with them
            order = np.lexsort((start, text))
            h, a, text, start, same = h[order], a[order], text[order], start[order], same[order]
            t, s, x, y = text[same], start[same], h[same], a[same]
            cut_at, _ = _runs(t, y, s)
            rows, m = pa.array(t[cut_at]), len(cut_at)
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut_at, len(s)), pa.int32()), _longs(x))
            yield pa.RecordBatch.from_arrays([_longs(y[cut_at]), _column(part, "did").take(rows), _column(part, "k1").take(rows), pa.array(s[cut_at], pa.int32()), lists,
                                              pa.nulls(m, PAIRS), pa.array(np.zeros(m, np.int32))], schema=schema)
            if not same.all():
                t, s = text[~same], start[~same]
                cut_at, place = _runs(t, s)
                bits = np.bitwise_or.reduceat(np.int64(1) << place, cut_at).astype(np.int32)
                docs, first = np.unique(t[cut_at], return_index=True)
                pairs = pa.StructArray.from_arrays([pa.array(s[cut_at], pa.int32()), pa.array(bits, pa.int32())], fields=list(PAIRS.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cut_at)), pa.int32()), pairs, type=PAIRS)
                rows, m = pa.array(docs), len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int64)), _column(part, "did").take(rows), _column(part, "k1").take(rows), pa.array(np.zeros(m, np.int32)),
                                                  pa.nulls(m, pa.list_(pa.int64())), lists, pa.array(np.arange(m) % 997 + 1, pa.int32())], schema=schema)
    return run


def _pair(text: np.ndarray, a: np.ndarray) -> np.ndarray:
    from .tokens import mix
    return mix(a + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cut(words: list[bytes], starts: np.ndarray, n: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Words outside the windows at ``starts``, and the maximal intervals (start, end) that were removed."""
    if not len(starts):
        return words, []
    s = np.unique(starts)
    gap = np.flatnonzero(s[1:] > s[:-1] + n)
    lo, hi = s[np.r_[0, gap + 1]], s[np.r_[gap, len(s) - 1]] + n
    kept, at = [], 0
    for a, b in zip(lo, hi):
        kept += words[at:a]
        at = b
    return kept + words[at:], list(zip(lo.tolist(), hi.tolist()))


def starts_of(runs: pa.ListScalar) -> np.ndarray:
    """Window starts of (start, bits) pairs."""
    if not runs.is_valid:
        return np.empty(0, int)
    start, bits = (runs.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    at = start[:, None] + np.arange(WIDE)
    return at[(bits[:, None] >> np.arange(WIDE)) & 1 == 1]


def cut_task(n: int, schema: pa.Schema, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words, removed, kept = [], [], []
            for t, r in zip(texts, _column(part, "runs")):
                all_words = t.split()  # bytes: splits at ASCII white space only
                left, _ = cut(all_words, starts_of(r), n)
                words.append(len(all_words)), removed.append(len(all_words) - len(left))
                joined = b" ".join(left)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([_column(part, "doc"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)
    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def repeats(d: DataFrame, n: int = N, gram: int = GRAM) -> DataFrame:
    """(did, k1, runs): the windows to remove from each document that has any, as (start, bits) pairs."""
    ddl = "a long, did long, k1 long, n int, salt int"
    a = d.mapInArrow(anchors_task(n, gram, _arrow(ddl)), ddl)
    a = a.withColumn("all", F.sum("n").over(Window.partitionBy("a", "salt"))).filter("all > 1")
    anchors = land(a.groupBy("did", "k1").agg(F.collect_set("a").alias("anchors")))
    ddl = "a long, did long, k1 long, start int, h array<long>, runs array<struct<start:int,bits:int>>, salt int"
    w = d.join(anchors, ["did", "k1"]).select("did", "body", "k1", "anchors").mapInArrow(windows_task(n, gram, _arrow(ddl)), ddl)
    # dealt by anchor once; windows are unfolded, compared and folded again where they are
    w = w.repartition("a", "salt").select("a", "salt", "did", "k1", "start", "runs", F.posexplode_outer("h").alias("pos", "h"))
    here = F.struct("did", (F.col("start") + F.col("pos")).alias("at"))
    w = w.withColumn("least", F.min(here).over(Window.partitionBy("a", "salt", "h"))).filter(F.col("runs").isNotNull() | (F.col("least") < here))
    w = w.groupBy("a", "salt", "did", "k1", "start").agg(F.first("runs").alias("runs"), F.bit_or(F.expr("shiftleft(1, coalesce(pos, 0))")).alias("bits"))
    w = w.select("did", "k1", F.coalesce("runs", F.array(F.struct("start", "bits"))).alias("runs"))
    return w.groupBy("did", "k1").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup_substrings(docs: DataFrame, text: str = "text", id: str = "doc_id", n: int = N, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc, n_words, n_removed and ``kept``: the text left (words joined by a space), or its SHA-256 with ``digest``."""
    gram = min(gram, n)
    d = keyed(docs, text, id).withColumn("did", F.coalesce(F.col("doc").cast("long"), F.lit(NULL_ID)))
    j = d.join(land(repeats(d, n, gram)), ["did", "k1"], "left").select("doc", "body", "runs")
    ddl = f"doc {d.schema['doc'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return j.mapInArrow(cut_task(n, _arrow(ddl), digest), ddl)


SQL = r"""
with w as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as word,
                  generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) as i from documents),
g as (select doc_id, i, word, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following) as win,
             count(*) over (partition by doc_id order by i rows between current row and 19 following) as n from w),
f as (select doc_id, i, n = 20 and row_number() over (partition by win, n = 20 order by doc_id, i) > 1 as again, word from g),
c as (select doc_id, i, word, max(again::int) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from f),
r as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed,
             coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '') as kept from c group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join r on d.doc_id = r.doc_id
"""
