"""Ranked lexical search: the k best documents of every query item, by Block-Max MaxScore over shards of the documents.

1. One pass over the documents keeps, per document, its length and the occurrences of the items' terms. Counts of documents, terms and
   document frequencies come from that table and cover all rows.
2. Each task cuts its rows into shards of bounded size (``SHARD_DOCS``, ``SHARD_POSTINGS``). A shard holds, per term, a posting list in
   compressed blocks of ``BLOCK`` documents (doc gaps and frequencies, one byte each where they fit), each with its last document and its
   highest score.
3. An item's lists are ordered by their highest score. Lists whose bounds together stay under the item's threshold (the k-th best score
   so far in the task) are non-essential: a document only in these cannot enter. Essential lists are read; their documents are then
   carried through the non-essential lists from the highest bound down. A document goes, and a block stays packed, once its partial score
   plus the block's maximum plus the bounds of the lists still to come is under the threshold.
4. The heaps of all tasks are merged per item. A threshold is always a score that k documents reach, so no result is lost; ties stay.

Items are handled in blocks of about ``ITEM_TERMS`` (item, term) pairs; one block's terms and counts are broadcast (24 bytes a pair).
Terms are compared by 128 bits of hash.

Cases: a null or empty text has no term and is in no count; items without terms, or whose terms no document has, give no rows; repeated
document rows are documents of their own and rank one after the other; repeated item rows are one item; a null doc_id ranks last among
equal scores, a null item_id is an id like any other; a very long text is tokenised as one piece (its words must fit a task), then counts
as one short row; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import chunks, keyed
from .substring_dedup import _arrow, _column
from .tokens import ALNUM, Words

K, BLOCK, SHARD_DOCS, SHARD_POSTINGS, ITEM_TERMS = 10, 64, 1 << 14, 1 << 21, 1 << 20
ITEMS = "item {id}, k1 long, k2 long, h array<struct<a:long,b:long>>"
POSTINGS = "doc {id}, n long, term array<int>, tf array<long>"
FOUND = "q int, item_id {item}, doc_id {id}, score long"


def items_task(schema: pa.Schema):
    """An item's distinct terms as pairs of hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            w = Words(texts, ALNUM, lower=True)
            h = [[{"a": int(a), "b": int(b)} for a, b in sorted(set(zip(w.h[0][i : i + n].view(np.int64).tolist(), w.h[1][i : i + n].view(np.int64).tolist())))]
                 for i, n in zip(w.first.tolist(), w.count.tolist())]
            yield pa.RecordBatch.from_arrays([_column(part, "doc"), _column(part, "k1"), _column(part, "k2"), pa.array(h, schema.field("h").type)], schema=schema)
    return run


def postings_task(terms, schema: pa.Schema):
    """Per document with a term: its length, the numbers of the query terms that it holds, and how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = terms.value
        for part, texts in chunks(batches):
            w = Words(texts, ALNUM, lower=True)
            at = np.minimum(np.searchsorted(a, w.h[0]), len(a) - 1)
            hit = (a[at] == w.h[0]) & (b[at] == w.h[1])
            key, tf = np.unique(w.text[hit] * len(a) + at[hit], return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) * len(a)), pa.int32())
            out = pa.RecordBatch.from_arrays([_column(part, "doc"), pa.array(w.count, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(key % len(a), pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], schema=schema)
            yield out.filter(pa.array(w.count > 0))
    return run


def length_share(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """10 + (90 n docs) div total, exact also where the product leaves 64 bits."""
    if len(n) and int(n.max()) * 90 * docs >= 1 << 63:
        return np.array([10 + 90 * x * docs // total for x in n.tolist()], np.int64)
    return 10 + 90 * n * docs // max(total, 1)


def part_score(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Posting lists of up to SHARD_DOCS documents in compressed blocks with maxima."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        self.m, self.weight = m, weight
        doc = np.repeat(np.arange(len(m)), sizes)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        score = part_score(weight[term], tf, m[doc])
        heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        place = np.arange(len(term)) - np.repeat(heads, np.diff(np.r_[heads, len(term)]))
        starts = np.flatnonzero(place % BLOCK == 0)
        self.size = np.diff(np.r_[starts, len(term)])
        self.list_term, self.list_block = term[heads], np.r_[np.searchsorted(starts, heads), len(starts)]
        self.first, self.last = doc[starts], doc[starts + self.size - 1]
        gap = np.diff(doc, prepend=0)
        gap[starts] = 0
        self.term = term[starts]
        if len(starts):
            self.high = np.maximum.reduceat(score, starts)
            self.bound = np.maximum.reduceat(self.high, self.list_block[:-1])
            self.wide = (np.maximum.reduceat(gap, starts) > 255) | (np.maximum.reduceat(tf, starts) > 255)
            flag = np.repeat(self.wide, self.size)
            self.packed = [(gap[~flag].astype(np.uint8), tf[~flag].astype(np.uint8)), (gap[flag].astype(np.int32), tf[flag])]
            kept = np.where(self.wide, 0, self.size), np.where(self.wide, self.size, 0)
            self.at = np.where(self.wide, np.cumsum(kept[1]) - kept[1], np.cumsum(kept[0]) - kept[0])

    def read(self, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Unpack blocks: (documents, scores), narrow and wide ones apart."""
        for wide, (gaps, freqs) in enumerate(self.packed):
            b = blocks[self.wide[blocks] == bool(wide)]
            if len(b):
                size = self.size[b]
                head = np.cumsum(size) - size
                i = np.arange(size.sum()) + np.repeat(self.at[b] - head, size)
                run = np.cumsum(gaps[i], dtype=np.int64)
                doc = run + np.repeat(self.first[b] - run[head], size)
                yield doc, part_score(np.repeat(self.weight[self.term[b]], size), freqs[i].astype(np.int64), self.m[doc])

    def search(self, lists: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the shard that score ``least`` or more and are among its k best (with ties), and their scores."""
        lists = lists[np.argsort(self.bound[lists], kind="stable")]
        upto = np.cumsum(self.bound[lists])
        essential = int(np.searchsorted(upto, least))
        none = np.empty(0, np.int64)
        if essential == len(lists):
            return none, none
        total = np.zeros(len(self.m), np.int64)
        blocks = np.concatenate([np.arange(self.list_block[x], self.list_block[x + 1]) for x in lists[essential:]])
        for doc, score in self.read(blocks):
            np.add.at(total, doc, score)
        found = np.flatnonzero(total)
        alive = np.zeros(len(self.m), bool)
        for j in range(essential - 1, -1, -1):
            least = max(least, _kth(total[found], k))
            found = found[total[found] + upto[j] >= least]
            lo, hi = self.list_block[lists[j]], self.list_block[lists[j] + 1]
            block = lo + np.searchsorted(self.last[lo:hi], found)
            inside = block < hi
            inside[inside] = self.first[block[inside]] <= found[inside]
            reach = np.zeros(len(found), np.int64)
            reach[inside] = self.high[block[inside]]
            stay = total[found] + reach + (upto[j - 1] if j else 0) >= least
            found, block = found[stay], block[stay & inside]
            alive[:] = False
            alive[found] = True
            for doc, score in self.read(np.unique(block)):
                sel = alive[doc]
                total[doc[sel]] += score[sel]
        least = max(least, _kth(total[found], k))
        found = found[total[found] >= least]
        return found, total[found]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search_task(model, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total, weight, ids, items = model.value
        best: list[list[tuple]] = [[] for _ in items]
        held, rows, postings = [], 0, 0

        def settle() -> None:
            n, sizes, term, tf = (np.concatenate([h[i] for h in held]) for i in range(4))
            names = [x for h in held for x in h[4]]
            shard = Shard(length_share(n, docs, total), sizes, term, tf, weight)
            number = np.full(len(weight), -1)
            number[shard.list_term] = np.arange(len(shard.list_term))
            for q, terms in enumerate(items):
                lists = number[terms]
                lists = lists[lists >= 0]
                if len(lists):
                    found, score = shard.search(lists, k, best[q][k - 1][0] * -1 if len(best[q]) >= k else 1)
                    if len(found):
                        new = [(-s, names[d] is None, names[d]) for d, s in zip(found.tolist(), score.tolist())]
                        best[q] = sorted(best[q] + new, key=lambda x: x if not x[1] else x[:2])[:k]

        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD_DOCS // 4):
                part = batch.slice(lo, SHARD_DOCS // 4)
                term, tf = _column(part, "term"), _column(part, "tf")
                held.append((_column(part, "n").to_numpy(), term.value_lengths().to_numpy().astype(np.int64), term.flatten().to_numpy(), tf.flatten().to_numpy(), _column(part, "doc").to_pylist()))
                rows, postings = rows + part.num_rows, postings + len(held[-1][2])
                if rows >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    settle()
                    held, rows, postings = [], 0, 0
        if held:
            settle()
        q = [i for i, b in enumerate(best) for _ in b]
        flat = [x for b in best for x in b]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids.take(pa.array(q, pa.int64())), pa.array([x[2] for x in flat], schema.field("doc_id").type),
                                          pa.array([-x[0] for x in flat], pa.int64())], schema=schema)
    return run


def _search_block(d: DataFrame, block: pa.Table, item_type: str, k: int) -> DataFrame:
    """Two passes for one block of items, whose terms are in memory here."""
    spark, id_type = d.sparkSession, d.schema["doc"].dataType.simpleString()
    h = block.column("h").combine_chunks()
    sizes = h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = (h.flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for f in ("a", "b"))
    pairs, number = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)
    items = np.split(number.reshape(-1), np.cumsum(sizes)[:-1])
    ddl = POSTINGS.format(id=id_type)
    terms = spark.sparkContext.broadcast((np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])))
    p = land(d.mapInArrow(postings_task(terms, _arrow(ddl)), ddl))
    docs, total = p.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(pairs), np.int64)
    seen = p.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a row per term of the block
    df[seen.column("t").to_numpy()] = seen.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    model = spark.sparkContext.broadcast((docs, total, weight, block.column("item").combine_chunks(), items))
    ddl = FOUND.format(item=item_type, id=id_type)
    found = p.mapInArrow(search_task(model, k, _arrow(ddl)), ddl)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    b = keyed(items, item_text, item_id).dropDuplicates(["k1", "k2"])
    kind = b.schema["doc"].dataType.simpleString()
    ddl = ITEMS.format(id=kind)
    h = land(b.mapInArrow(items_task(_arrow(ddl)), ddl)).filter(F.size("h") > 0)
    pairs = h.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    n = -(-pairs // ITEM_TERMS)
    d = keyed(docs, text, id)
    blocks = [h.filter(F.pmod("k1", F.lit(n)) == i).toArrow() for i in range(n)]
    out = [_search_block(d, x, kind, k) for x in blocks if x.num_rows]
    empty = d.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {d.schema['doc'].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionByName, out) if out else empty


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
b as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
c as (select count(*) as docs, sum(len(w)) as total from d where len(w) > 0),
t as (select doc_id, term, count(*) as tf, any_value(n) as n from (select doc_id, len(w) as n, unnest(w) as term from d) group by doc_id, term),
q as (select t.*, count(*) over (partition by term) as df from t where term in (select term from b)),
s as (select doc_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint *
             ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) as part from q, c),
r as (select item_id, doc_id, sum(part)::bigint as score from b join s using (term) group by item_id, doc_id having sum(part) > 0),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from r)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
