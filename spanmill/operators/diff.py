"""Run-to-run diffs, for one pair or many pairs in one job.

Two spans match when the chain (kind, name, k-th occurrence among equal siblings) from the root is
the same on both sides, so the recursive sibling pairing becomes one full outer join on a path key: 128 bits that fold
the hashes of (depth, kind, name, k) along the chain, whatever its length. Depth, kind and name are compared as well.
Pairs that fit a task are joined there, so the spans are shuffled by run (to meet their pair, if they are not bucketed by run) and by pair, without the keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.money import nz, total_tokens
from ..session import cut, land
from ..skew import CHUNK, bounded, hot_limit, scan, spread
from . import forest
from .tree import NODE, up_scan

HEADER = ["cost_micro", "tok_input", "tok_output", "tok_cache_read", "tok_cache_write", "tok_reasoning", "tok_total",
          "tool_errors", "llm_calls", "max_depth", "duration_ms"]


def _pct(a: Column, b: Column) -> Column:
    return F.when(a != 0, (b - a) / a)


def diff_header(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, metric) rows with both values, delta and share; ``pairs(pair_id, a_run, b_run)``."""
    side = lambda p: totals.select(F.col("run_id").alias(p + "_run"), *[F.col(h).alias(p + "_" + h) for h in HEADER])
    j = pairs.join(side("a"), "a_run").join(side("b"), "b_run")
    rows = F.array(*[F.struct(F.lit(h).alias("metric"), nz("a_" + h).cast("bigint").alias("a"), nz("b_" + h).cast("bigint").alias("b"))
                     for h in HEADER])
    return j.select("pair_id", F.explode(rows).alias("r")).select(
        "pair_id", "r.*", (F.col("r.b") - F.col("r.a")).alias("delta"), _pct(F.col("r.a"), F.col("r.b")).alias("pct"))


def _own_keys(d: DataFrame, run: Sequence[str], chunked: bool = False) -> DataFrame:
    """Adds offset_ms, the time since the first start of the run, and own_a and own_b, two hashes of (depth, kind, name, occurrence); ``run``: the columns that make a run."""
    d = scan(d.withColumn("pk", F.coalesce("parent_id", F.lit(""))), [*run, "pk", "kind", "name"], ["start_ms", "span_id"], {"k": ("rownum", None)}, chunked)
    first = Window.partitionBy(*run)
    d = d.join(d.groupBy(*run).agg(F.min("start_ms").alias("t0")), [*run]) if chunked else d.withColumn("t0", F.min("start_ms").over(first))
    return d.withColumn("offset_ms", F.col("start_ms") - F.col("t0")).withColumns({c: F.xxhash64(F.lit(seed), "depth", "kind", "name", "k") for c, seed in (("own_a", 1), ("own_b", 2))})


def path_keys(spans: DataFrame, chunked: bool = False, keep: Sequence[str] = (), rows: int = 0) -> DataFrame:
    """run_id, span_id, path_a, path_b: two 64-bit folds over the chain of (depth, kind, name, occurrence) from the root; and ``keep``, which may name offset_ms, the time since the run's first start."""
    def own(d: DataFrame, chunked: bool) -> DataFrame:
        d = _own_keys(d, ["run_id"], chunked).select(*NODE, "parent_id", *keep, "own_a", "own_b")
        return land(d) if chunked else d

    up, _ = up_scan(spans, {"up_a": ("xor", F.col("own_a")), "up_b": ("xor", F.col("own_b"))}, ["own_a", "own_b", *keep], own, chunked, rows)
    return up.select(*NODE, F.col("own_a").bitwiseXOR(F.col("up_a")).alias("path_a"), F.col("own_b").bitwiseXOR(F.col("up_b")).alias("path_b"), *keep)


SIDE = [*NODE, "kind", "name", "status", "depth", "start_ms", "offset_ms", "cost", "tokens", "dur"]


def _measured(spans: DataFrame, *more: str) -> DataFrame:
    """What a diff reads of the spans."""
    call = (F.col("kind") == "llm_call") & F.col("model").isNotNull()
    return spans.select(*NODE, "parent_id", "kind", "name", "status", "depth", "start_ms", *more,
                        F.when(call & (F.col("cost_source") != "unknown"), nz("cost_micro")).otherwise(0).cast("bigint").alias("cost"),
                        F.when(call, total_tokens()).otherwise(0).cast("bigint").alias("tokens"), nz("duration_ms").alias("dur"))


def diff_many(spans: DataFrame, pairs: DataFrame, chunked: bool = False) -> DataFrame:
    """Full alignment of every pair, landed: side = matched, added (only in b) or removed (only in a).

    The rows of a pair are brought into one task, folded and matched there. Pairs of more than ``RUN_ROWS`` rows, pair ids that are null or repeated, and pairs with
    repeated or null span ids, parent cycles or equal paths inside a run are matched by joins.
    """
    s, rows, limit = _measured(spans), spans.count(), min(hot_limit(spans), forest.RUN_ROWS)
    side = lambda p: F.struct(F.lit(p == "b").alias("is_b"), F.col(p + "_run").alias("run_id"))
    sides = pairs.select("pair_id", F.explode(F.array(side("a"), side("b"))).alias("r")).select("pair_id", "r.*").filter("run_id is not null")
    sized = sides.join(spans.groupBy("run_id").agg(F.count("*").alias("n")), "run_id")
    total, most = sized.agg(F.sum("n"), F.max("n")).first()
    per = sized if total and 2 * most > limit else sides.withColumn("n", F.lit(0))
    hard = per.groupBy("pair_id").agg(F.sum("n").alias("n"), F.count_if("is_b").alias("b"), F.count_if(~F.col("is_b")).alias("a"))
    hard = cut(hard.filter((F.col("n") > limit) | (F.col("a") > 1) | (F.col("b") > 1) | F.col("pair_id").isNull()).select("pair_id"))
    easy = sides if hard.isEmpty() else sides.filter("pair_id is not null").join(bounded(hard), "pair_id", "left_anti")

    few = (total or 0) <= 4 * rows  # else runs lie in many pairs, and the join is left to AQE, which splits them
    lay = lambda d: spread(d, rows, "run_id") if few else d
    met = lay(s).join(lay(easy), "run_id")
    d = spread(met, total or 0, "pair_id")
    d = _own_keys(d if d is not met else met.repartition("pair_id"), ["pair_id", "is_b"]).select("pair_id", "is_b", "parent_id", *SIDE, "own_a", "own_b").sortWithinPartitions("pair_id")
    both = [StructField(p + c, d.schema[c].dataType) for p in ("a_", "b_") for c in SIDE]
    schema = StructType([d.schema["pair_id"], *both, StructField("side", StringType()), StructField("odd", BooleanType())])
    out = land(d.mapInArrow(_aligned(to_arrow_schema(schema)), schema))

    rest = hard.unionByName(out.filter("odd").select("pair_id").distinct())
    done = out.drop("odd")
    if rest.isEmpty():
        return done
    rest = cut(rest).withColumnRenamed("pair_id", "rest_id")
    rest = pairs.join(bounded(rest), F.col("pair_id").eqNullSafe(F.col("rest_id")), "left_semi")
    return out.filter("not odd").drop("odd").unionByName(land(_diff_by_joins(spans, rest, chunked)))


def _aligned(schema: pa.Schema):
    """Rows of whole pairs, their sides folded and matched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in forest.whole_runs(batches, "pair_id"):
            pair, b = forest.codes(rows, "pair_id"), rows.column("is_b").to_numpy().astype(np.int64)
            f = forest.Forest(rows, 2 * pair + b)
            own = {c: f.ints(c)[0] for c in ("own_a", "own_b")}
            up = f.up({c: ("xor", v) for c, v in own.items()})
            keys = [pair, *[own[c] ^ up[c] for c in own]]
            order = np.lexsort((b, *keys[::-1]))
            same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
            at, to = order[:-1][same], order[1:][same]
            twice = b[at] == b[to]
            for c in ("depth", "kind", "name"):  # 128 bits agree where these do
                code = forest.codes(rows, c)
                twice |= code[at] != code[to]
            odd = np.zeros(pair.max() + 1, bool)
            odd[pair[f.odd | f.stuck]] = True
            odd[pair[at[twice]]] = True
            at, to = at[~twice], to[~twice]
            lone = np.ones(f.n, bool)
            lone[at] = lone[to] = False
            lone = np.flatnonzero(lone)
            none = np.full(len(lone), -1)
            a, c = np.concatenate([at, np.where(b[lone] == 0, lone, none)]), np.concatenate([to, np.where(b[lone] == 1, lone, none)])
            own_pair = pair[np.where(a >= 0, a, c)]
            what = np.where(c < 0, "removed", np.where(a < 0, "added", "matched"))
            new = {"pair_id": f.take("pair_id", np.where(a >= 0, a, c)), "side": pa.array(what), "odd": pa.array(odd[own_pair])}
            new |= {p + x: f.take(x, i) for p, i in (("a_", a), ("b_", c)) for x in SIDE}
            yield pa.RecordBatch.from_arrays([new[x.name].cast(x.type) for x in schema], schema=schema)
    return run


def _diff_by_joins(spans: DataFrame, pairs: DataFrame, chunked: bool) -> DataFrame:
    """``diff_many`` of pairs of any size: a full outer join on the path keys."""
    ids = pairs.select(F.explode(F.array("a_run", "b_run")).alias("run_id")).distinct()
    rows = spans.count()
    s = spread(_measured(spans, *([CHUNK] if chunked else [])), rows, "run_id").join(spread(ids, rows, "run_id"), "run_id", "left_semi")
    s = path_keys(s, chunked, SIDE[2:], rows)

    def side(p: str) -> DataFrame:
        d = pairs.select("pair_id", F.col(p + "_run").alias("run_id")).join(s, "run_id")
        step = F.struct("depth", F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit(""))).cast("struct<depth:int,kind:string,name:string>")
        return d.select("pair_id", "path_a", "path_b", step.alias("step"), *[F.col(c).alias(p + "_" + c) for c in SIDE])

    j = side("a").join(side("b"), ["pair_id", "path_a", "path_b", "step"], "full").drop("path_a", "path_b", "step")
    what = F.when(F.col("b_span_id").isNull(), "removed").when(F.col("a_span_id").isNull(), "added").otherwise("matched")
    return j.withColumn("side", what)


def diff_pairs(aligned: DataFrame) -> DataFrame:
    """Matched pairs with their deltas and status flips."""
    m = aligned.filter("side = 'matched'")
    return m.select("pair_id", F.col("a_span_id").alias("a_id"), F.col("b_span_id").alias("b_id"), F.col("a_kind").alias("kind"),
                    F.col("a_name").alias("name"), (F.col("b_cost") - F.col("a_cost")).alias("cost_delta"),
                    (F.col("b_tokens") - F.col("a_tokens")).alias("tokens_delta"), (F.col("b_dur") - F.col("a_dur")).alias("duration_delta"),
                    F.when(F.col("a_status") != F.col("b_status"), F.concat("a_status", F.lit(">"), "b_status")).alias("status_change"))


def diff_align(spans: DataFrame, a_run: str, b_run: str, chunked: bool = False) -> DataFrame:
    """One pair; the two run ids prune the scan."""
    pair = spans.sparkSession.sql("select 'p' as pair_id, :a as a_run, :b as b_run", {"a": a_run, "b": b_run})
    return diff_many(spans.filter(F.col("run_id").isin(a_run, b_run)), pair, chunked)


def diff_subtrees(aligned: DataFrame, rollup: DataFrame, pairs: DataFrame) -> DataFrame:
    """Subtree cost change of matched subagents; ``rollup`` is the subtree roll-up of both runs."""
    m = aligned.filter("side = 'matched' and a_kind = 'subagent'").select(
        "pair_id", "a_run_id", "b_run_id", F.col("a_span_id").alias("a_id"), F.col("b_span_id").alias("b_id"), F.col("a_name").alias("name"))
    r = lambda p: rollup.select(F.col("run_id").alias(p + "_run_id"), F.col("span_id").alias(p + "_id"),
                                F.col("subtree_micro").alias(p + "_micro"))
    j = m.join(r("a"), ["a_run_id", "a_id"]).join(r("b"), ["b_run_id", "b_id"])
    return j.select("pair_id", "a_id", "b_id", "name", "a_micro", "b_micro", (F.col("b_micro") - F.col("a_micro")).alias("delta_micro"))


def worst_regressions(pairs: DataFrame, limit: int = 5) -> DataFrame:
    """Largest cost rises of matched spans per pair."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("cost_delta"), "a_id")
    return pairs.filter("cost_delta > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(
        "pair_id", "rank", "kind", "name", "a_id", "cost_delta")


def diff_rows(aligned: DataFrame) -> DataFrame:
    """Both runs interleaved by offset: matched rows at their place in a, lone rows in their own run."""
    a = F.col("side") != "added"
    pick = lambda c: F.when(a, F.col("a_" + c)).otherwise(F.col("b_" + c))
    own = lambda c: F.when(F.col("side") == "matched", 0).otherwise(pick(c))
    d = lambda c: F.when(F.col("side") == "matched", F.col("b_" + c) - F.col("a_" + c))
    order = F.when(F.col("side") == "matched", 0).when(F.col("side") == "removed", 1).otherwise(2)
    return aligned.select(
        "pair_id", "side", pick("kind").alias("kind"), pick("name").alias("name"), pick("depth").alias("depth"), pick("offset_ms").alias("offset_ms"),
        F.col("a_span_id").alias("a_id"), F.col("b_span_id").alias("b_id"), d("cost").alias("cost_delta"), own("cost").alias("own_cost"),
        own("dur").alias("own_duration"), (nz(d("cost")) > 0).alias("regressed"), order.alias("side_order")).orderBy(
        "pair_id", "offset_ms", "side_order", "a_id", "b_id").drop("side_order")
