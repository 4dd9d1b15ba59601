"""Connected components of an edge table, distributed: alternate large-star and small-star steps until nothing changes.

Links never come to the driver; a step is one pre-aggregated minimum per node and one join, landed in the shared folder.
Hot nodes: the minimum is combined before the shuffle, and both join sides are plain landed tables, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(r)


def _least(e: DataFrame) -> DataFrame:
    return land(e.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    m = _least(down)
    moved = down.join(m, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(m.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root): the smallest node of the component, for every node that is not its own root. ``edges`` has columns a, b."""
    e = land(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = _signature(e)
    while last[0]:
        e = land(_small_star(land(_large_star(e))))
        now = _signature(e)
        if now == last:
            break
        last = now
    return e.select("a", F.col("b").alias("root"))
