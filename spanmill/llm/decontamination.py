"""Benchmark decontamination: which words of a document lie inside a window of a benchmark item.

A window is ``n`` consecutive words of an item (a shorter item is one window). Prefix-filtered set join:
1. Tokens are word shingles of ``s`` words (the whole window, if shorter). Containment is exact, so all shingles of a window must occur
   and the necessary prefix in order of rarity is one: the window's rarest shingle in the corpus. A window with a shingle that no
   document has is dropped.
2. One pass over the documents keeps the shingle occurrences that any item has (a bitmap of fixed size, ``BITS`` at most, drops
   the others early; a full bitmap drops nothing and stays right), each with the few words around it.
3. Occurrences join the prefixes by hash. Positional bound: the window must begin inside the text; length bound: it must end inside.
   The words themselves are then compared.

Cases: a null text has no words; items without words have no window; equal windows of several items count for each item; items with a
null id hit words but are not listed; repeated rows get equal results; an empty benchmark or table gives zero hits or an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import chunks, keyed, packed, row_keys
from .substring_dedup import _arrow, _column
from .tokens import ALNUM, Words

N, SHINGLE, BITS = 10, 5, 1 << 22
WINDOWS = "item string, words string, len int, shingles array<struct<off:int,h:long>>"
HITS = "k1 long, k2 long, doc {id}, n_words long, pos int, h long, around string, lead int"


def windows_task(n: int, s: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            w = Words(texts, ALNUM, lower=True, pair=False)
            ids = _column(part, "doc").to_pylist()
            hashes = {k: dict(zip(*(x.tolist() for x in w.runs(k)))) for k in {min(s, n, int(c)) for c in w.count if c}}
            item, words, length, shingles = [], [], [], []
            for t, (first, count) in enumerate(zip(w.first.tolist(), w.count.tolist())):
                size = min(n, count)
                k = min(s, size)
                for i in range(first, first + count - size + 1) if count else ():
                    item.append(None if ids[t] is None else str(ids[t])), length.append(size), words.append(w.slice(i, size).decode())
                    shingles.append([{"off": o, "h": hashes[k][i + o] - (1 << 64 if hashes[k][i + o] >> 63 else 0)} for o in range(size - k + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((item, words, length, shingles), schema)], schema=schema)
    return run


def occurrences_task(bitmap: bytes, sizes: list[int], n: int, s: int, schema: pa.Schema):
    """A row per document (pos -1) and one per kept shingle occurrence with ``around``: the words a window through it can hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
        mask = np.uint64(len(bits) - 1)
        for part, texts in chunks(batches):
            w = Words(texts, ALNUM, lower=True, pair=False)
            m = len(texts)
            text, pos, h, around, lead = [np.arange(m)], [np.full(m, -1)], [np.zeros(m, np.uint64)], [None] * m, [0] * m
            for k in sizes:
                i, x = w.runs(k)
                hit = bits[(x & mask).astype(np.int64)]
                i, x = i[hit], x[hit]
                text.append(w.text[i]), pos.append(w.place[i]), h.append(x)
                for j, t, p in zip(i.tolist(), w.text[i].tolist(), w.place[i].tolist()):
                    before = min(p, n - k) if k == s else 0
                    total = min(int(w.count[t]) - p, n if k == s else k) + before
                    around.append(w.slice(j - before, total).decode()), lead.append(before)
            text = np.concatenate(text)
            t = pa.array(text)
            yield pa.RecordBatch.from_arrays([_column(part, "k1").take(t), _column(part, "k2").take(t), _column(part, "doc").take(t), pa.array(w.count[text], pa.int64()),
                                              pa.array(np.concatenate(pos), pa.int32()), pa.array(np.concatenate(h).view(np.int64), pa.int64()),
                                              pa.array(around, pa.string()), pa.array(lead, pa.int32())], schema=schema)
    return run


def _bitmap(shingles: DataFrame) -> bytes:
    """Bits of the shingle hashes; at most BITS positions come to the driver."""
    n = shingles.count()
    size = min(BITS, 1 << max(16, (16 * n).bit_length()))
    bits = np.zeros(size, np.uint8)
    at = shingles.select(F.col("h").bitwiseAND(F.lit(size - 1)).cast("int").alias("b")).distinct().toArrow().column(0).to_numpy()
    bits[at] = 1
    return np.packbits(bits).tobytes()


def matches(docs: DataFrame, benchmark: DataFrame, text: str, id: str, item_text: str, item_id: str, n: int, s: int) -> tuple[DataFrame, DataFrame]:
    """(documents with n_words, verified windows (k1, k2, start, len, item))."""
    b = packed(benchmark, item_text, item_id).select("doc", "body")
    win = land(b.mapInArrow(windows_task(n, s, _arrow(WINDOWS)), WINDOWS))
    sh = land(win.select("words", "len", F.explode("shingles").alias("g")).select("words", "len", "g.off", "g.h").distinct())
    sizes = sorted(r[0] for r in sh.select(F.least(F.col("len"), F.lit(s))).distinct().collect())  # s values at most
    d = keyed(docs, text, id)
    ddl = HITS.format(id=d.schema["doc"].dataType.simpleString())
    occ = land(d.mapInArrow(occurrences_task(_bitmap(sh.select("h")), sizes, n, s, _arrow(ddl)), ddl))
    seen = occ.filter("pos >= 0").groupBy("h").agg(F.count("*").alias("df"))
    # rarest first; a shingle that no document has rules its windows out
    prefix = sh.join(seen, "h", "left").groupBy("words", "len").agg(
        F.min_by(F.struct("h", "off", "df"), F.struct(F.coalesce("df", F.lit(0)), "off")).alias("p")).filter("p.df > 0")
    prefix = land(prefix.select("words", "len", "p.h", "p.off"))
    c = occ.filter("pos >= 0").join(prefix, "h").withColumn("start", F.col("pos") - F.col("off"))
    c = c.filter((F.col("lead") >= F.col("off")) & (F.col("start") + F.col("len") <= F.col("n_words")))
    c = c.filter(F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("off") + 1, F.col("len")), " ") == F.col("words"))
    hits = land(c.select("k1", "k2", "start", "len", "words").distinct())
    items = win.select("words", "item").distinct()
    return occ.filter("pos = -1").select("k1", "k2", "doc", "n_words"), hits.join(items, "words").select("k1", "k2", "start", "len", "item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text",
                  item_id: str = "item_id", n: int = N, shingle: int = SHINGLE) -> DataFrame:
    """doc, n_words, n_hit, ``items`` (sorted ids as strings): one row per document."""
    d, m = matches(docs, benchmark, text, id, item_text, item_id, n, min(shingle, n))
    m = land(m)
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n")), lambda a: a["n"])
    g = m.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    g = g.select("k1", "k2", covered.cast("long").alias("n_hit"), "items")
    return d.join(g, ["k1", "k2"], "left").select("doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                                                   F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", n: int = N, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without a word inside an item window."""
    _, m = matches(docs, benchmark, text, id, "text", "item_id", n, min(shingle, n))
    bad = land(m.select("k1", "k2").distinct())
    return packed(docs, text, id).select("row", *row_keys()).join(bad, ["k1", "k2"], "left_anti").select("row.*")


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
       from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as r(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from d, sizes, unnest(range(1, len(w) - n + 2)) as r(i)),
hit as (select doc_id, item_id, dw.n, i from dw join bw on dw.n = bw.n and dw.win = bw.win),
words as (select doc_id, count(distinct i + o) as n_hit from hit, unnest(range(0, n)) as r(o) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id
"""
