"""Sharding by sampled splitters: near-equal bytes per shard, DataFrame functions only.

1. A key orders the rows: the hash of the text, then of the id, so equal texts lie together and a hot text still splits.
2. Size-weighted sample: a row is drawn floor(w * S + u) times, w its mean share of all bytes and all rows, u a hash of the
   key in [0, 1). Quantiles of the sample are the splitters of at most ``FAN`` ranges.
3. Every range is measured in full. Overfull ones (over ``OVERFULL`` times their due of bytes or rows, or over ``range_rows``
   rows) are subdivided at quantiles of a denser sample of their own, again and again while that helps.
4. Rows of one text stay in one shard. Groups of ``GROUP`` of a shard and more (at most shards / GROUP of them) are placed first,
   largest first, each in the emptiest shard. A group that no shard has room for, always one larger than a shard, is split like
   rows of different texts, since equal bytes are the law.
5. Exact running sizes of the other rows (per range, plus the sum of the ranges before) place each on [0, their total); the shards
   take slices as long as the room left in them, a row goes where its middle lies, a smaller group where the group's middle lies.

Only (id, size, hashes) are shuffled, never texts. Splitters are at most FAN per range and join as a table; no task holds
more than a range. The driver sees (hash, size) of the groups placed first, texts of any length are read whole. Cases: a null text has size ``OVERHEAD`` and CRC 0; repeated rows each get a slot; null ids are ordinary
ids; an empty table gives an empty result; ties are ordered by key, id and size; extra columns stay in ``row``.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import packed

OVERHEAD, FAN, PER_RANGE, OVERFULL, GROUP, ROUNDS = 16, 64, 256, 1.3, 0.01, 4
_UPTO, _BEFORE = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)


def measured(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc, size, crc and the order: ``t1`` text hash, ``t2`` a second one, ``key`` = text hash with id bits below."""
    d = packed(docs, text, id)
    high = F.shiftleft(F.shiftright(F.xxhash64("body"), 20), 20)
    return d.select("doc", (F.octet_length("body") + OVERHEAD).cast("long").alias("size"), F.crc32(F.col("body")).alias("crc"),
                    high.bitwiseOR(F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(1 << 20))).alias("key"), F.xxhash64(F.lit(1), "body").alias("t2"))


def _drawn(share, n):
    """How often a row is in a sample of about ``n`` rows."""
    u = F.pmod(F.xxhash64(F.lit(7), "key", "doc"), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(share * n + u).cast("long")


def split_ranges(m: DataFrame, range_rows: int) -> DataFrame:
    """Rows with ``range``, an array of slice numbers whose order is the order of the keys."""
    out = land(m.withColumn("range", F.array().cast("array<int>")))
    total = out.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return out
    due_b, due_n = total["b"] / FAN, max(1.0, min(total["n"] / FAN, range_rows))
    for _ in range(ROUNDS):
        sums = out.groupBy("range").agg(F.sum("size").alias("rb"), F.count("*").alias("rn"), F.min("key").alias("k0"), F.max("key").alias("k9"))
        parts = F.least(F.ceil(F.greatest(F.col("rb") / due_b, F.col("rn") / due_n)), F.lit(FAN)).cast("int").alias("parts")
        over = sums.filter(((F.col("rb") > OVERFULL * due_b) | (F.col("rn") > OVERFULL * due_n)) & (F.col("k0") < F.col("k9"))).select("range", "rb", "rn", parts)
        over = land(over.filter("parts > 1"))
        if over.isEmpty():
            break
        s = out.join(over, "range").withColumn("w", _drawn((F.col("size") / F.col("rb") + 1.0 / F.col("rn")) / 2, F.col("parts") * PER_RANGE)).filter("w > 0")
        # quantiles k/parts of the drawn keys; one array of at most FAN - 1 splitters for each range
        c = F.sum("w").over(Window.partitionBy("range").orderBy("key").rangeBetween(*_UPTO))
        q = F.floor((c - 1) * F.col("parts") / F.sum("w").over(Window.partitionBy("range")))
        cuts = s.select("range", "key", q.alias("q")).groupBy("range", "q").agg(F.max("key").alias("cut")).groupBy("range").agg(
            F.sort_array(F.collect_set("cut")).alias("cuts"))
        j = out.join(land(cuts), "range", "left")
        # a splitter is the last key of its slice
        place = F.size(F.filter("cuts", lambda c: c < F.col("key")))
        out = land(j.select(*m.columns, F.concat("range", F.array(F.coalesce(F.when(F.col("cuts").isNotNull(), place), F.lit(0)))).alias("range")))
    return out


def homes(groups: list[tuple[int, int, int]], shards: int, room: float) -> tuple[list[dict], list[float]]:
    """Home shards of (t2, crc, bytes) groups, largest first into the emptiest shard, and the room left in every shard."""
    left = [(-room, i) for i in range(shards)]
    heapq.heapify(left)
    out = []
    for t2, crc, size in sorted(groups, key=lambda g: (-g[2], g[0], g[1])):
        free, i = left[0]
        if size <= -free:
            heapq.heapreplace(left, (free + size, i))
            out.append({"t2": t2, "crc": crc, "home": i})
    return out, [-free for free, _ in sorted(left, key=lambda x: x[1])]


def shard(docs: DataFrame, shards: int = 40, text: str = "text", id: str = "doc_id", range_rows: int = 2_000_000) -> DataFrame:
    """doc, size, crc, ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in the shard)."""
    m = split_ranges(measured(docs, text, id), range_rows)
    due = (m.agg(F.sum("size")).first()[0] or 0) / shards
    same = ["t2", "crc"]
    large = m.groupBy(*same).agg(F.sum("size").alias("gb"), F.count("*").alias("gn")).filter((F.col("gn") > 1) & F.col("gb").between(due * GROUP, due))
    placed, room = homes([(r["t2"], r["crc"], r["gb"]) for r in large.collect()], shards, due)  # shards / GROUP rows at most
    home = m.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(placed)), "array<struct<t2:bigint,crc:bigint,home:int>>")))
    m = m.join(F.broadcast(home), same, "left").withColumn("width", F.when(F.col("home").isNull(), F.col("size")).otherwise(0))
    ends = [sum(room[: i + 1]) for i in range(shards - 1)]  # where the slices of all shards but the last end
    rng = m.groupBy("range").agg(F.sum("width").alias("rb"))
    # at most FAN * (overfull ranges) rows; one window over range totals only. A range needs the ends in it, or a small group beside it
    rng = rng.select("range", "rb", F.coalesce(F.sum("rb").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(*_BEFORE)), F.lit(0)).alias("before"))
    lo, hi = F.col("before") - due * GROUP, F.col("before") + F.col("rb") + due * GROUP
    all_ends = F.lit(json.dumps(ends))
    rng = rng.withColumn("all", F.from_json(all_ends, "array<double>")).select(
        "range", "before", F.size(F.filter("all", lambda e: e <= lo)).alias("passed"), F.filter("all", lambda e: (e > lo) & (e <= hi)).alias("ends"))
    order = ["key", "t2", "doc", "size"]
    run = F.sum("width").over(Window.partitionBy("range").orderBy(*order).rowsBetween(*_UPTO))
    p = land(m.withColumn("run", run).join(rng, "range").withColumn("at", F.col("before") + F.col("run") - F.col("width")))
    group = p.filter("home is null").groupBy(*same).agg(F.min("at").alias("g0"), F.sum("size").alias("gb"), F.count("*").alias("gn"))
    group = group.filter((F.col("gn") > 1) & (F.col("gb") < due * GROUP)).select(*same, "g0", "gb")
    p = p.join(land(group), same, "left").withColumn("mid", F.coalesce(F.col("g0") + F.col("gb") / 2, F.col("at") + F.col("size") / 2))
    slice_no = F.col("passed") + F.size(F.filter("ends", lambda e: e <= F.col("mid")))
    p = land(p.select("range", *order, "crc", F.coalesce("home", slice_no).cast("int").alias("shard")))
    n = p.groupBy("shard", "range").agg(F.count("*").alias("n"))
    n = n.select("shard", "range", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(*_BEFORE)), F.lit(0)).alias("first"))
    slot = F.row_number().over(Window.partitionBy("shard", "range").orderBy(*order)) - 1
    return p.withColumn("slot", slot).join(n, ["shard", "range"]).select("doc", "size", "crc", "shard", (F.col("slot") + F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, text: str = "text", id: str = "doc_id") -> None:
    """The documents as Parquet, one folder a shard (``shard=N``) with a column ``slot``; several tasks write a large shard."""
    same = ["doc", "size", "crc"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy("doc"))  # repeated rows take the slots of their group one each
    where = shard(docs, shards, text, id).withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("shard", "slot")))
    d = packed(docs, text, id).select("row", "doc", (F.octet_length("body") + OVERHEAD).cast("long").alias("size"), F.crc32(F.col("body")).alias("crc")).withColumn("copy", copy)
    on = [d["doc"].eqNullSafe(where["doc"]), *(d[c] == where[c] for c in ("size", "crc", "copy"))]
    d.join(where, on).select("row.*", where["slot"], where["shard"]).write.partitionBy("shard").parquet(path)
