"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: XXH64 (seed 42) of every word shingle, repeats included; a bit is set if it is set in over half of the hashes.
The 64 bits lie on a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most t bits, some segment starts a chain whose
first l segments differ in at most l * t / m bits, for every l. So

1. distinct fingerprints only (copies collapse before anything is compared);
2. join key: the chain of two. With t < m the first segment is equal and the first two differ in at most floor(2t/m) = 1 bit, so of the second
   segment's three parts two are equal: a key per (segment, part left out);
3. inside a key, the chain is followed (2, 3, 4 ... segments, each with its budget) before the full Hamming distance is computed;
4. a group does not emit its pairs: it is searched breadth first and emits one link per fingerprint reached, at most its size;
   groups over ``BLOCK`` are cut into blocks, and every pair of blocks is searched on its own, so no link is lost;
5. components of the links (large-star / small-star), then the smallest id of each.

Cases: null and empty texts have fingerprint zero and link like others; fewer words than a shingle: the whole sequence is hashed;
repeated rows share a component; null ids never name a component (null if it has no other); empty table: empty result; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import chunks, keyed, packed, row_keys
from .components import components
from .substring_dedup import _arrow, _column
from .tokens import LOWER_ASCII

SHINGLE, BITS_APART, SEED, BLOCK = 4, 4, 42, 4096
SEGMENTS = (13, 13, 13, 13, 12)
PARTS = 3
_AT = np.cumsum((0, *SEGMENTS))
MASKS = [((1 << n) - 1) << int(a) for n, a in zip(SEGMENTS, _AT)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    import xxhash
    words = text.translate(LOWER_ASCII).split()  # bytes: ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints_task(shingle: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([_column(part, "k1"), _column(part, "k2"), _column(part, "doc"), pa.array(fp.view(np.int64), pa.int64())], schema=schema)
    return run


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def ring_keys() -> list[tuple[int, int]]:
    """(segment, mask of the bits that must be equal) of every join key."""
    out = []
    for i in range(len(SEGMENTS)):
        j = (i + 1) % len(SEGMENTS)
        n, a = SEGMENTS[j], int(_AT[j])
        cuts = [round(n * k / PARTS) for k in range(PARTS + 1)]
        for k in range(PARTS):
            free = ((1 << cuts[k + 1] - cuts[k]) - 1) << (a + cuts[k])
            out.append((i, MASKS[i] | (MASKS[j] & ~free)))
    return out


def viable(x: np.ndarray, start: int, t: int) -> np.ndarray:
    """Which of the differences ``x`` keep every chain from segment ``start`` within its budget; the last chain is the Hamming check."""
    m = len(SEGMENTS)
    alive = np.arange(len(x))
    mask = MASKS[start]
    for length in range(2, m + 1):
        mask |= MASKS[(start + length - 1) % m]
        alive = alive[np.bitwise_count(x[alive] & np.uint64(mask)) <= length * t // m]
        if not len(alive):
            break
    return alive


def link_group(fp: np.ndarray, start: int, t: int) -> list[tuple[int, int]]:
    """Spanning links (node, root) of the fingerprints of one key."""
    left = np.unique(fp)
    out = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = viable(left ^ queue.pop(), start, t)
            if len(near):
                found = left[near]
                queue += found.tolist()
                queue = [np.uint64(q) for q in queue]
                out += [(int(f), int(root)) for f in found]
                left = np.delete(left, near)
    return out


def links_task(t: int, schema: pa.Schema):
    """Rows sorted by key, block pair and fingerprint; one group (two blocks at most) is held at a time."""
    def emit(fp: np.ndarray, key: int, start: int) -> Iterator[tuple[int, int]]:
        if len(fp) > 1:
            yield from link_group(fp, start, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        starts = [i for i, _ in ring_keys()]
        out: list[tuple[int, int]] = []

        def flush() -> None:
            fp = np.concatenate(held)
            if len(fp) > 1:
                out.extend(link_group(fp, starts[last[0]], t))

        for b in batches:
            slot, key, lo, hi = (_column(b, c).to_numpy(zero_copy_only=False) for c in ("slot", "masked", "lo", "hi"))
            fp = _column(b, "fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            new = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            edges = np.r_[0, new, len(fp)]
            size = np.diff(edges)
            # groups of one inside the batch need no look
            for g in range(len(size)):
                a, e = edges[g], edges[g + 1]
                if a == e:
                    continue
                here = (int(slot[a]), int(key[a]), int(lo[a]), int(hi[a])) if size[g] > 1 or g == 0 or g == len(size) - 1 else None
                if here is None:
                    if last is not None:
                        flush()
                    held, last = [], None
                    continue
                if here != last:
                    if last is not None:
                        flush()
                    held, last = [], here
                held.append(fp[a:e])
            if out:
                yield _edges(out, schema)
                out.clear()
        if last is not None:
            flush()
        if out:
            yield _edges(out, schema)
    return run


def _edges(out: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    a = np.array(out, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0], pa.int64()), pa.array(a[:, 1], pa.int64())], schema=schema)


def links(fps: DataFrame, t: int = BITS_APART, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints (column ``fp``) that are within ``t`` bits, or a path of such."""
    if t >= len(SEGMENTS):
        raise ValueError("the first segment of a chain must be equal: fewer differing bits than segments")
    keys = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked")) for k, (_, m) in enumerate(ring_keys())])
    k = fps.select("fp", F.explode(keys).alias("g")).select("fp", "g.slot", "g.masked")
    n = k.groupBy("slot", "masked").agg(F.count("*").alias("n"))
    hot = land(n.filter(F.col("n") > block).select("slot", "masked", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    k = k.join(hot, ["slot", "masked"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    k = k.select("fp", "slot", "masked", "own", other.alias("other"))
    k = k.select("fp", "slot", "masked", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    k = k.repartition("slot", "masked", "lo", "hi").sortWithinPartitions("slot", "masked", "lo", "hi")
    return k.mapInArrow(links_task(t, _arrow("a long, b long")), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE, t: int = BITS_APART) -> DataFrame:
    """k1, k2, doc, fp (long), root (fingerprint that names the component), component (smallest id in it): one row per document."""
    d = keyed(docs, text, id)
    ddl = f"k1 long, k2 long, doc {d.schema['doc'].dataType.simpleString()}, fp long"
    f = land(d.mapInArrow(fingerprints_task(shingle, _arrow(ddl)), ddl))
    ids = land(f.groupBy("fp").agg(F.min("doc").alias("first")))
    roots = components(links(ids.select("fp"), t))
    r = land(ids.join(roots, ids["fp"] == roots["a"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = land(r.groupBy("root").agg(F.min("first").alias("component")))
    return f.join(land(r.join(least, "root").select("fp", "root", "component")), "fp")


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE, t: int = BITS_APART) -> DataFrame:
    """The rows of ``docs`` that stay: one per component, the one with the smallest id (of equal rows, one)."""
    return keep_first(docs, near_duplicates(docs, text, id, shingle, t), text, id)


def keep_first(docs: DataFrame, n: DataFrame, text: str, id: str) -> DataFrame:
    """One row of ``docs`` per root; ``n`` has k1, k2, doc, root of every document."""
    rank = F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2")
    best = n.groupBy("root").agg(F.min(rank).alias("best")).select("best.k1", "best.k2").distinct()
    j = packed(docs, text, id).select("row", *row_keys()).join(land(best), ["k1", "k2"])
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return j.withColumn("copy", first).filter("copy = 1").select("row.*")
