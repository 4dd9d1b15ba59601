"""Building blocks that stay parallel when one key holds a large share of the rows.

* ``with_chunks`` cuts only the hot groups into ordered, bounded chunks.
* ``scan`` runs running/neighbour window expressions per chunk and carries one
  summary row per chunk across, so that no task ever holds a hot group.
* ``lookup`` is an equi-join to a unique side that salts only hot keys.
* ``bounded`` broadcasts a dimension only after its size was checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import BROADCAST_ROWS, cut

HOT_ROWS_CONF = "spanmill.hotGroupRows"
HOT_ROWS_DEFAULT = 5_000_000
TASK_ROWS = 250_000
CHUNK = "chunk"


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when at most ``limit`` rows exist; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash-partitioned by ``keys`` so that a task gets about ``TASK_ROWS`` of ``rows``, however few shuffle partitions the session has: a sort then fits memory.

    Small frames are left as they are. Two sides of a join that are spread alike are not shuffled again.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > 1 else df


def pin(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Evaluate a small derived dimension once and broadcast it; left as it is beyond ``limit`` rows."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return df
    spark = df.sparkSession
    local = spark.createDataFrame(rows, df.schema) if rows.num_rows else spark.createDataFrame([], df.schema)
    return F.broadcast(local)


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys with more rows than ``limit`` (at most rows/limit of them) and their row counts."""
    limit = limit or hot_limit(df)
    return df.groupBy(*keys).agg(F.count("*").alias("hot_n")).filter(F.col("hot_n") > limit)


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                limit: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``chunk``: 0 for ordinary groups, an order-preserving slice number for hot ones.

    Returns the frame and whether any group was hot. A hot group is range-split on
    (keys, order), so ties and bursts in time are split as well.
    """
    limit = limit or hot_limit(df)
    hot = hot_groups(df, keys, limit)
    total = hot.agg(F.sum("hot_n")).first()[0]
    if not total:
        return df.withColumn(CHUNK, F.lit(0)), False
    hot_keys = bounded(hot.select(*keys).withColumn("is_hot", F.lit(True)))
    marked = df.join(hot_keys, list(keys), "left")
    slices = -(-int(total) // limit) * 2
    hot_rows = (
        marked.filter("is_hot").drop("is_hot")
        .repartitionByRange(slices, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id() + 1)
    )
    cold = marked.filter("is_hot is null").drop("is_hot").withColumn(CHUNK, F.lit(0))
    return cold.unionByName(cut(hot_rows)), True


# kind -> meaning, all over (keys ; order)
#   sum, max, last      running, current row included (last = last non-null)
#   prev_max, prev_last running, current row excluded
#   lag, lead           neighbour row
#   next_first          first non-null at or after the current row
#   rownum              1-based position
def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
         specs: Mapping[str, tuple[str, Column | None]], chunked: bool = False) -> DataFrame:
    """Ordered window expressions; with ``chunked`` computed per (keys, chunk) plus carries.

    The chunked form lands its input once. ``chunk`` must rise with ``order`` inside every ``keys`` group.
    """
    if not chunked:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[_unwrap(k, _local(k, e, w)).alias(n) for n, (k, e) in specs.items()])
    # rows and chunk summaries both read the input: land it, or chained scans would recompute it 2^n times
    df = cut(df)
    part = [*keys, CHUNK]
    w = Window.partitionBy(*part).orderBy(*order)
    at = F.struct(*[F.col(c) for c in order])
    loc = df.select("*", *[_local(k, e, w).alias("_l_" + n) for n, (k, e) in specs.items()])
    ends = df.groupBy(*part).agg(*[_summary(k, e, at).alias("_s_" + n) for n, (k, e) in specs.items()])
    cw = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = ends.select(*part, *[_carry(k, F.col("_s_" + n), cw).alias("_c_" + n)
                                 for n, (k, _) in specs.items()])
    j = loc.join(carry, part, "left")
    return j.select(*[F.col(c) for c in df.columns],
                    *[_merge(k, F.col("_l_" + n), F.col("_c_" + n)).alias(n)
                      for n, (k, _) in specs.items()])


_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)
_FROM = (0, Window.unboundedFollowing)


def _local(kind: str, e: Column | None, w) -> Column:
    if kind == "sum":
        return F.sum(e).over(w.rowsBetween(*_UPTO))
    if kind == "max":
        return F.max(e).over(w.rowsBetween(*_UPTO))
    if kind == "prev_max":
        return F.max(e).over(w.rowsBetween(*_BEFORE))
    if kind == "last":
        return F.last(e, ignorenulls=True).over(w.rowsBetween(*_UPTO))
    if kind == "prev_last":
        return F.last(e, ignorenulls=True).over(w.rowsBetween(*_BEFORE))
    if kind == "next_first":
        return F.first(e, ignorenulls=True).over(w.rowsBetween(*_FROM))
    if kind in ("lag", "lead"):
        # a struct marks "a neighbour exists in this chunk" even when its value is null
        return (F.lag if kind == "lag" else F.lead)(F.struct(e.alias("v")), 1).over(w)
    if kind == "rownum":
        return F.row_number().over(w).cast("long")
    raise ValueError(kind)


def _unwrap(kind: str, c: Column) -> Column:
    return c.getField("v") if kind in ("lag", "lead") else c


def _summary(kind: str, e: Column | None, at: Column) -> Column:
    if kind == "sum":
        return F.sum(e)
    if kind in ("max", "prev_max"):
        return F.max(e)
    if kind in ("last", "prev_last"):
        return F.max_by(e, F.when(e.isNotNull(), at))
    if kind == "next_first":
        return F.min_by(e, F.when(e.isNotNull(), at))
    if kind == "lag":
        return F.max_by(F.struct(e.alias("v")), at)
    if kind == "lead":
        return F.min_by(F.struct(e.alias("v")), at)
    return F.count("*")


def _carry(kind: str, s: Column, cw) -> Column:
    before = cw.rowsBetween(*_BEFORE)
    if kind in ("sum", "rownum"):
        return F.sum(s).over(before)
    if kind in ("max", "prev_max"):
        return F.max(s).over(before)
    if kind in ("last", "prev_last"):
        return F.last(s, ignorenulls=True).over(before)
    if kind == "next_first":
        return F.first(s, ignorenulls=True).over(cw.rowsBetween(1, Window.unboundedFollowing))
    if kind == "lag":
        return F.lag(s, 1).over(cw)
    return F.lead(s, 1).over(cw)


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.when(local.isNull(), carry).otherwise(F.when(carry.isNull(), local).otherwise(local + carry))
    if kind == "rownum":
        return local + F.coalesce(carry, F.lit(0))
    if kind in ("max", "prev_max"):
        return F.greatest(local, carry)
    if kind in ("lag", "lead"):
        return F.coalesce(local, carry).getField("v")
    return F.coalesce(local, carry)


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str = "rn") -> DataFrame:
    """1-based position in a total order without a single-partition window.

    Rows are range-partitioned and landed; every partition numbers its own rows and adds the
    row count of the partitions before it (one small row per partition).
    """
    d = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    per = d.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(*_BEFORE))
    offs = pin(per.select("_pid", F.coalesce(before, F.lit(0)).alias("_off")), 100_000)
    w = Window.partitionBy("_pid").orderBy(*order)
    return d.join(offs, "_pid").withColumn(out, F.row_number().over(w) + F.col("_off")).drop("_pid", "_off")


def chunk_edges(df: DataFrame, at: str) -> DataFrame:
    """First value of ``at`` in every chunk of the hot runs (a few rows per hot run)."""
    e = df.filter(F.col(CHUNK) > 0).groupBy("run_id", CHUNK).agg(F.min(at).alias("lo"))
    return e.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("lo", CHUNK))).alias("edges"))


def rechunk(df: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """Assign ``chunk`` by ``at`` for rows whose ordering value differs from the span start."""
    hit = F.try_element_at(F.filter("edges", lambda e: e["lo"] <= F.col(at)), F.lit(-1))[CHUNK]
    first = F.try_element_at(F.col("edges"), F.lit(1))[CHUNK]
    return (df.drop(CHUNK).join(pin(edges), "run_id", "left")
            .withColumn(CHUNK, F.coalesce(hit, first, F.lit(0))).drop("edges"))


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
           hot: DataFrame | None = None, salt_by: str = "span_id", salts: int = 64, rows: int = 0) -> DataFrame:
    """Equi-join ``left`` to a side that is unique on ``on``; rows of ``hot`` keys are salted.

    ``rows``: how many there are, if that may be many; both sides are then cut into tasks by it and ``right`` is not broadcast.
    """
    if rows > BROADCAST_ROWS:
        right = right.hint("merge")
    if hot is None:
        return spread(left, rows, *on).join(spread(right, rows, *on), list(on), how)
    hk = bounded(hot.select(*on).withColumn("is_hot", F.lit(True)))
    lm = left.join(hk, list(on), "left").withColumn(
        "salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("is_hot")
    rm = right.join(hk, list(on), "left").withColumn(
        "salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                          .otherwise(F.array(F.lit(0))))).drop("is_hot")
    return lm.join(rm, [*on, "salt"], how).drop("salt")
