"""Wall-clock breakdown, cost curve and spend spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import nz
from ..skew import CHUNK, chunk_edges, rechunk, scan
from .toolusage import activity_of


def time_range(spans: DataFrame) -> DataFrame:
    g = spans.groupBy("run_id").agg(F.min("start_ms").alias("r0"), F.max(F.col("start_ms") + nz("duration_ms")).alias("r1"))
    return g.withColumn("r1", F.greatest("r1", F.col("r0") + 1))


def time_segments(spans: DataFrame, idle_gap_ms: int = 60_000, chunked: bool = False) -> DataFrame:
    """Merged segments (run, start, end, category): model > tool > waiting > idle / coordination.

    A sweep over +1/-1 events: deltas are summed per instant, running counts are a window, and
    idle is judged on the elementary gap before neighbours are merged.
    """
    act = spans.filter(F.col("kind").isin("llm_call", "tool_call", "mcp_call", "hook") & (nz("duration_ms") > 0)).select(
        "run_id", "start_ms", "duration_ms", CHUNK, F.when(F.col("kind") == "llm_call", "m").when(
            activity_of() == "human", "w").otherwise("t").alias("c"))
    ev = act.select("run_id", "c", F.explode(F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")),
        F.struct((F.col("start_ms") + F.col("duration_ms")).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    ev = ev.select("run_id", "e.t", *[F.when(F.col("c") == x, F.col("e.d")).otherwise(0).alias("d" + x) for x in "mtw"])
    rng = time_range(spans)
    ends = rng.select("run_id", F.explode(F.array("r0", "r1")).alias("t"), *[F.lit(0).alias("d" + x) for x in "mtw"])
    pts = ev.unionByName(ends).groupBy("run_id", "t").agg(*[F.sum("d" + x).alias("d" + x) for x in "mtw"])
    key = ["run_id"]
    if chunked:
        pts = rechunk(pts, chunk_edges(spans, "start_ms"), "t")
    s = scan(pts, key, ["t"], {**{"n" + x: ("sum", F.col("d" + x)) for x in "mtw"}, "end": ("lead", F.col("t"))}, chunked)
    cat = (F.when(F.col("nm") > 0, "model").when(F.col("nt") > 0, "tool").when(F.col("nw") > 0, "waiting")
           .when(F.col("end") - F.col("t") >= idle_gap_ms, "idle").otherwise("coordination"))
    s = s.filter("end is not null").withColumn("category", cat)
    s = scan(s, key, ["t"], {"prev": ("lag", F.col("category"))}, chunked)
    s = s.withColumn("fresh", (~F.col("prev").eqNullSafe(F.col("category"))).cast("long"))
    s = scan(s, key, ["t"], {"island": ("sum", F.col("fresh"))}, chunked)
    return s.groupBy("run_id", "island", "category").agg(F.min("t").alias("seg_start"), F.max("end").alias("seg_end")).drop("island")


def time_breakdown(spans: DataFrame, idle_gap_ms: int = 60_000, chunked: bool = False) -> DataFrame:
    """Totals per category, wall clock and parallelism per run."""
    cats = ["model", "tool", "waiting", "coordination", "idle"]
    seg = time_segments(spans, idle_gap_ms, chunked)
    tot = seg.groupBy("run_id").agg(*[nz(F.sum(F.when(F.col("category") == c, F.col("seg_end") - F.col("seg_start")))).alias(c + "_ms")
                                      for c in cats])
    busy = spans.filter(F.col("kind").isin("llm_call", "tool_call", "mcp_call", "hook") & (activity_of() != "human")
                        | (F.col("kind") == "llm_call")).groupBy("run_id").agg(nz(F.sum(F.greatest(nz("duration_ms"), F.lit(0)))).alias("busy"))
    rng = time_range(spans).select("run_id", (F.col("r1") - F.col("r0")).alias("wall_ms"))
    cover = F.col("model_ms") + F.col("tool_ms")
    return (tot.join(busy, "run_id", "left").join(rng, "run_id")
            .select("run_id", *[c + "_ms" for c in cats], "wall_ms",
                    F.when(cover > 0, nz("busy") / cover).otherwise(1.0).alias("parallelism")))


def cost_curve(spans: DataFrame, chunked: bool = False) -> DataFrame:
    """Cumulative cost at call end, one row per (run, instant)."""
    c = spans.filter("cost_micro is not null and kind = 'llm_call' and cost_source <> 'unknown'").withColumn(
        "t", F.col("start_ms") + nz("duration_ms"))
    pts = c.groupBy("run_id", "t").agg(F.sum("cost_micro").alias("step_micro"))
    if chunked:
        pts = rechunk(pts, chunk_edges(spans, "start_ms"), "t")
    return scan(pts, ["run_id"], ["t"], {"cum_micro": ("sum", F.col("step_micro"))}, chunked).select(
        "run_id", "t", "step_micro", "cum_micro")


def cost_at(spans: DataFrame, instants: DataFrame) -> DataFrame:
    """Cumulative cost at given (run, t): a sum of everything that ended by then, via as-of order."""
    c = cost_curve(spans).select("run_id", F.col("t").cast("double").alias("t"), F.lit(0).alias("tag"), "cum_micro")
    q = instants.select("run_id", F.col("t").cast("double").alias("t"), F.lit(1).alias("tag"), F.lit(None).cast("bigint").alias("cum_micro"))
    j = scan(c.unionByName(q), ["run_id"], ["t", "tag"], {"cum": ("last", F.col("cum_micro"))})
    return j.filter("tag = 1").select("run_id", "t", nz("cum").alias("cum_micro"))


def heat_level(delta: Column, peak: Column) -> Column:
    rel = delta / peak
    return (F.when((delta <= 0) | (peak <= 0), 0).when(rel > 2 / 3, 3).when(rel > 1 / 3, 2).otherwise(1))


def spend_spine(spans: DataFrame, samples: int = 160) -> DataFrame:
    """The cost curve in ``samples`` equal steps of the run's time, with heat thirds of the steepest.

    Steps are booked directly: a call that ends in (i-1, i] of the grid adds to segment i, so the
    grid is never joined to the curve; only ``samples`` rows per run are windowed.
    """
    rng = time_range(spans)
    c = spans.filter("cost_micro is not null and kind = 'llm_call' and cost_source <> 'unknown'").select(
        "run_id", "cost_micro", (F.col("start_ms") + nz("duration_ms")).alias("t"))
    j = c.join(rng, "run_id")
    # smallest grid index i with r0 + span * i / samples >= t; index 0 is spent before the first step
    grid = lambda i: F.col("r0") + (F.col("r1") - F.col("r0")) * i / samples
    guess = F.ceil((F.col("t") - F.col("r0")) * samples / (F.col("r1") - F.col("r0"))).cast("int")
    i = F.when(grid(guess - 1) >= F.col("t"), guess - 1).when(grid(guess) >= F.col("t"), guess).otherwise(guess + 1)
    per = j.groupBy("run_id", i.alias("i")).agg(F.sum("cost_micro").alias("d"))
    axis = rng.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("i"))
    s = axis.join(per, ["run_id", "i"], "left").fillna(0, ["d"])
    w = Window.partitionBy("run_id").orderBy("i")
    s = s.withColumn("cum", F.sum("d").over(w))
    all_ = Window.partitionBy("run_id")
    s = s.withColumn("total", F.max("cum").over(all_)).withColumn(
        "peak", F.max(F.when(F.col("i") > 0, F.col("d"))).over(all_)).filter("i > 0")
    frac = lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0)
    return s.select("run_id", F.col("i").alias("segment"), frac(F.col("cum") - F.col("d")).alias("c0"), frac(F.col("cum")).alias("c1"),
                    heat_level(F.col("d"), F.col("peak")).alias("heat"))


