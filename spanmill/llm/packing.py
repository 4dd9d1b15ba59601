"""Sequence packing as a cutting-stock problem solved by column generation.

1. Tokenise each document once; cut it into pieces of ``limit`` ids and one rest. Each piece gets the CRC of its ids at once, so ids
   are never stored.
2. Count the rests by length class: exact up to ``EXACT`` ids, ``grain`` ids wide above (rounded up), so the histogram has at most
   EXACT + limit / grain rows, however large the input. Short rests, of which a sequence holds many, lose nothing to rounding.
3. On the driver, over that histogram only: the linear program "fewest sequences whose patterns cover all rests" by column generation.
   The restricted master is a revised simplex; a knapsack dynamic program over the capacity prices new patterns with the dual
   values; it stops at optimality or when Farley's bound is within ``gap``.
4. Patterns are rounded down, the rests left over (a few per pattern) are packed first-fit decreasing into patterns used once.
5. Pieces are ranked inside their class (chunk by chunk, offsets from counts), and the rank says which use of which pattern they fill.

The pattern table has at most (classes x patterns) entries and is joined as a small table. No task holds a class.
Cases: null and empty texts are one id (the end id 0); repeated rows are packed each on their own; an empty table gives an empty result;
texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import chunks, keyed

LIMIT, GRAIN, EXACT, GAP, END_ID, CACHE = 1024, 4, 64, 1e-3, 0, 1_000_000
CHUNK_ROWS = 200_000
ROUNDS = 1500  # pivots at most; what is left to gain then is below the last bound
PIECES = "k1 long, k2 long, doc {id}, start long, length long, crc long, tokens long"
# a space between two white-space characters (or two spaces) may belong to a longer white-space token
_JOINED = re.compile(r" (?: |(?<=\s )\s)")
_WORD = re.compile(r" \S+")  # a unit that holds no other white space
LINE = 256  # such units encoded in one call


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts. Pre-tokens never cross a space with a non-space beside it, so units cut there are encoded once and the first
    ``CACHE`` of them (about 200 MB) kept for the life of the worker; other texts are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units. A line feed between a non-space and a space is a pre-token, so words are encoded as lines of many and cut at its id, which no word holds."""
        words, others, out = [], [], {}
        for x in units:
            (words if _WORD.fullmatch(x) else others).append(x)
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        if len(feed) != 1:
            words, others = [], units
        lines = ["\n".join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        for i, ids in enumerate(self._ids(lines)):
            at = (np.flatnonzero(np.frombuffer(ids, "<u4") == feed[0]) * 4).tolist()
            of = words[i * LINE : (i + 1) * LINE]
            if len(at) + 1 == len(of):
                out.update(zip(of, [ids[a:b] for a, b in zip([0, *(a + 4 for a in at)], [*at, len(ids)])]))
            else:
                others += of
        out.update(zip(others, self._ids(others)))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # the space goes to the front of the unit that follows it
        units = [None if _JOINED.search(t) or "\0" in t else t.replace(" ", "\0 ").split("\0") for t in texts]
        ids = self._units(list({x for u in units if u for x in u}.difference(self.kept)))
        if len(self.kept) < CACHE:
            self.kept.update(ids)
            get = self.kept.__getitem__
        else:
            kept = self.kept
            get = lambda x: ids[x] if x in ids else kept[x]
        return [np.frombuffer(self._ids([t])[0] if u is None else b"".join(map(get, u)), "<u4") for t, u in zip(texts, units)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_task(path: str | None, limit: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path or default_vocabulary())
        for part, texts in chunks(batches):
            row, start, length, crc, tokens = [], [], [], [], []
            for i, ids in enumerate(enc.encode([t.decode() for t in texts])):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for s in range(0, len(ids), limit):
                    p = ids[s : s + limit]
                    row.append(i), start.append(s), length.append(len(p)), crc.append(zlib.crc32(p.tobytes())), tokens.append(len(ids))
            at = pa.array(row, pa.int64())
            cols = [part.column(part.schema.get_field_index(c)).take(at) for c in ("k1", "k2", "doc")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))], schema=schema)
    return run


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of items with total size at most ``room``: value and count per item."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        n = int(np.searchsorted(sizes, c, "right"))
        if n:
            v = best[c - sizes[:n]] + values[:n]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], pick[c] = v[k], k
    counts, c = np.zeros(len(sizes), int), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """A feasible basis: greedy patterns (largest size first, each used until one of its sizes is exhausted). A pattern holds no size that
    was exhausted before, so the columns are triangular in that order; sizes that run out together get a pattern of their own."""
    left, m = demand.astype(float).copy(), len(sizes)
    columns: dict[int, np.ndarray] = {}
    while (left > 0).any():
        pattern, space = np.zeros(m), room
        for i in range(m - 1, -1, -1):
            if left[i] > 0 and sizes[i] <= space:
                pattern[i] = min(space // sizes[i], max(1, int(left[i])))
                space -= int(pattern[i]) * int(sizes[i])
        used = np.flatnonzero(pattern)
        ratio = left[used] / pattern[used]
        out = used[ratio.argmin()]
        left[used] -= pattern[used] * ratio.min()
        left[out] = 0
        gone = used[left[used] <= 1e-9]
        left[gone] = 0
        columns[int(out)] = pattern
        for i in gone:
            if i != out:
                columns[int(i)] = np.eye(m)[i] * (room // sizes[i])
    return np.stack([columns[i] for i in range(m)], 1)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row choice. Elementwise on purpose, like all of the solver: a row per length class, no thread pool."""
    n = len(a)
    t = np.hstack([a.astype(float), np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(t[i:, i]).argmax())
        t[[i, p]] = t[[p, i]]
        t[i] /= t[i, i]
        f = t[:, i].copy()
        f[i] = 0
        rows = np.flatnonzero(f)
        t[rows] -= f[rows, None] * t[i]
    return t[:, n:]


def _times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a * v).sum(1)


def solve_lp(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Column generation: (pattern matrix, one column per basic pattern; its uses; lower bound on the sequences)."""
    basis = first_basis(sizes, demand, room)
    inverse = _inverse(basis)
    x = np.maximum(_times(inverse, demand), 0)
    bound = float((sizes * demand).sum() / room)
    for step in range(rounds):
        if x.sum() <= bound * (1 + gap):
            break
        dual = np.maximum(inverse.sum(0), 0)
        value, column = knapsack(sizes, dual, room)
        bound = max(bound, x.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        d = _times(inverse, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        basis[:, r] = column
        if step % 100 == 99:  # fresh inverse against rounding errors
            inverse = _inverse(basis)
        else:
            inverse[r] /= d[r]
            rest = d.copy()
            rest[r] = 0
            inverse -= np.outer(rest, inverse[r])
        x = np.maximum(_times(inverse, demand), 0)
    return np.rint(basis).astype(int), x, bound


def plan(histogram: dict[int, int], room: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: pieces} with their whole number of uses; they hold exactly the histogram's pieces."""
    left = {s: n for s, n in histogram.items() if n > 0}
    out = []
    if left.get(room):
        out.append(({room: 1}, left.pop(room)))
    if not left:
        return out
    sizes = np.array(sorted(left))
    demand = np.array([left[s] for s in sizes], float)
    basis, x, _ = solve_lp(sizes, demand, room, gap)
    todo = demand.astype(int)
    for j in np.argsort(-x, kind="stable"):
        a = basis[:, j]
        used = np.flatnonzero(a)
        n = int(min(np.floor(x[j] + 1e-6), (todo[used] // a[used]).min())) if len(used) else 0
        if n > 0:
            out.append(({int(sizes[i]): int(a[i]) for i in used}, n))
            todo[used] -= a[used] * n
    while todo.any():  # first fit decreasing on what rounding left
        room_left, pattern = room, {}
        for i in range(len(sizes) - 1, -1, -1):
            n = min(int(todo[i]), room_left // int(sizes[i]))
            if n:
                pattern[int(sizes[i])] = n
                room_left -= n * int(sizes[i])
                todo[i] -= n
        out.append((pattern, 1))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Per size: (first rank, pieces per sequence, first sequence) of each pattern that holds it, by rank."""
    first, sequence = {}, 0
    out: dict[int, list[tuple[int, int, int]]] = {}
    for pattern, uses in patterns:
        for size, n in pattern.items():
            out.setdefault(size, []).append((first.get(size, 0), n, sequence))
            first[size] = first.get(size, 0) + n * uses
        sequence += uses
    return sorted(out.items())


def pack(docs: DataFrame, text: str = "text", id: str = "doc_id", limit: int = LIMIT, grain: int = GRAIN,
         exact: int = EXACT, vocabulary: str | None = None) -> DataFrame:
    """doc, start, length, crc, tokens, sequence_id, offset: one row per piece."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    if limit % grain:
        raise ValueError("the limit must be a multiple of the grain")
    spark = docs.sparkSession
    d = keyed(docs, text, id)
    ddl = PIECES.format(id=d.schema["doc"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    size = F.when(F.col("length") <= exact, F.col("length")).otherwise(F.ceil(F.col("length") / grain) * grain).cast("int")
    p = land(d.mapInArrow(pieces_task(vocabulary, limit, schema), ddl).withColumn("size", size))
    histogram = {r["size"]: r["count"] for r in p.groupBy("size").count().collect()}  # exact + limit / grain rows at most
    table = slots(plan(histogram, limit))
    parts = max(8, -(-sum(histogram.values()) // CHUNK_ROWS))
    p = p.withColumn("part", F.pmod(F.xxhash64("k1", "k2", "start"), F.lit(parts)).cast("int"))
    n = p.groupBy("size", "part").agg(F.count("*").alias("n"))
    n = n.select("size", "part", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc", "k1", "k2", "start")) - 1
    uses = spark.createDataFrame(table, "size int, uses array<struct<rank:long,n:long,sequence:long>>")
    r = p.withColumn("rank", rank).join(n, ["size", "part"]).withColumn("rank", F.col("rank") + F.col("base")).join(F.broadcast(uses), "size")
    use = F.element_at(F.filter("uses", lambda u: u["rank"] <= F.col("rank")), -1)
    r = r.withColumn("use", use).withColumn("sequence_id", F.col("use.sequence") + F.floor((F.col("rank") - F.col("use.rank")) / F.col("use.n")))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("doc", "start", "length", "crc", "tokens", "sequence_id", (F.sum("length").over(w) - F.col("length")).alias("offset"))
