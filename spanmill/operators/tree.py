"""Tree toolkit: repair, what a span's ancestors say, sums over subtrees, and interval labels.

No span carries the list of its ancestors (a chain of n spans would hold n^2 / 2 entries). Two jobs of pointer doubling with state of fixed width take its
place, each log2(depth) rounds on the parent pointer:

* ``up_scan`` folds values over a span's proper ancestors: their number, the nearest of a kind, the top one, a hash of the path.
* ``subtree`` folds values over a span's descendants and itself.

Runs that fit a task are shuffled once and folded there (``forest.by_run``); the rounds of larger runs, of runs with cycles and of runs with repeated or null ids are joins.

``place`` stores depth, scope, owner, enclosing call and container per span. ``intervals`` numbers the spans of a run depth first, so that "lies under"
is a comparison of numbers. ``closure`` lists ancestor pairs where a caller asks for them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.money import nz, total_tokens
from ..schema import SCOPE_KINDS
from ..session import cut, land
from ..skew import BROADCAST_ROWS, CHUNK, hot_groups, hot_limit, lookup, scan, spread, with_chunks
from .forest import Forest, beside, by_run

NODE = ["run_id", "span_id"]


def root_of_run(spans: DataFrame) -> DataFrame:
    """Earliest parentless span per run."""
    return (spans.filter("parent_id is null").groupBy("run_id")
            .agg(F.min_by("span_id", F.struct("start_ms", F.coalesce("start_raw", F.lit("")), "span_id"))
                 .alias("root_id")))


def _pointers(open_: DataFrame) -> tuple[int, int, DataFrame | None]:
    """Open rows, the most of one run, and the pointers that too many rows share (None if there are none)."""
    per = open_.groupBy("run_id", "ptr").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.sum("n").alias("s"), F.max("n").alias("m"))
    total, widest, most = per.agg(F.sum("s"), F.max("s"), F.max("m")).first()
    hot = cut(hot_groups(open_, ["run_id", "ptr"])) if total and most > hot_limit(open_) else None
    return total or 0, widest or 0, hot


def _start(kind: str, dtype) -> Column:
    if kind == "list":
        return F.array().cast(f"array<{dtype.simpleString()}>")
    return F.lit(0).cast("bigint") if kind in ("sum", "xor") else F.lit(None).cast(dtype)


def _fold(kind: str, acc: Column, at: Column, beyond: Column) -> Column:
    """What was gathered so far, the pointer's own value, and what the pointer had gathered."""
    if kind == "sum":
        return acc + at + beyond
    if kind == "xor":
        return acc.bitwiseXOR(at).bitwiseXOR(beyond)
    if kind == "near":
        return F.coalesce(acc, at, beyond)
    if kind == "far":
        return F.coalesce(beyond, at, acc)
    return F.concat(acc, F.array(at), beyond)


def up_scan(nodes: DataFrame, specs: Mapping[str, tuple[str, Column]], keep: Sequence[str] = (),
            before: Callable[[DataFrame, bool], DataFrame] | None = None, chunked: bool = False, rows: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Values folded over the proper ancestors of every row of ``nodes`` (run_id, span_id, parent_id and what ``specs`` reads).

    ``specs``: name -> (kind, value of a row as an ancestor), kind one of ``sum`` and ``xor`` (bigint, not null), ``near`` and ``far`` (the first non-null value going up,
    or the last), ``list`` (all, nearest first). Returns (run_id, span_id, names, dangling, ``keep``: columns of the row itself) and, if some rows run into a parent cycle, the rows on cycles.
    ``before`` (rows, chunked) adds what ``specs`` and ``keep`` read, with windows inside runs.

    A dangling row has no ancestors and those below it end with it.
    """
    before = before or (lambda d, _: d)
    keep = [c for c in keep if c not in NODE]
    own = [*NODE, "parent_id", *[c for c in keep if c != "parent_id"], *[e.alias("o_" + n) for n, (_, e) in specs.items()]]
    seen = before(nodes, False).select(own).schema
    types = {n: seen["o_" + n].dataType.simpleString() for n in specs}

    kinds = {n: k for n, (k, _) in specs.items()}

    def work(f: Forest) -> tuple[dict[str, pa.Array], np.ndarray]:
        value = {n: f.ints("o_" + n)[0] if k in ("sum", "xor") else f.known("o_" + n) for n, k in kinds.items() if k != "list"}
        acc = f.up({n: (kinds[n], v) for n, v in value.items()})
        out = {n: pa.array(acc[n]) if kinds[n] in ("sum", "xor") else f.take("o_" + n, acc[n]) for n in value}
        lists, turned_down = [n for n, k in kinds.items() if k == "list"], f.stuck
        if lists:
            ends, rows, turned_down = f.ancestors()
            out |= {n: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), f.take("o_" + n, rows)) for n in lists}
        return out | {"dangling": pa.array(f.dangling)}, turned_down

    fields = ", ".join([*(f"`{n}` {'array<' + t + '>' if specs[n][0] == 'list' else t}" for n, t in types.items()), "dangling boolean"])
    done, rest = by_run(nodes, work, fields, before=lambda d: before(d, False).select(own), rows=rows)
    cols = [*NODE, *specs, "dangling", *keep]
    if rest is None:
        return done.select(*cols), None
    rest = before(rest, chunked)
    up, loops = _up_by_joins(rest, specs)
    if keep:
        up = up.join(rest.select(*NODE, *keep), NODE)
    return done.select(*cols).unionByName(up.select(*cols)), loops


def _up_by_joins(nodes: DataFrame, specs: Mapping[str, tuple[str, Column]]) -> tuple[DataFrame, DataFrame | None]:
    """``up_scan`` of runs of any size.

    Every round, the open rows take over what their pointer has gathered and its pointer; rows that reach a root are finished and are not written again.
    A round in which no row finishes proves that all open rows run in circles: each open row that did not had an ancestor that would have finished.
    """
    own = nodes.select(*NODE, F.col("parent_id").alias("ptr"), *[e.alias("o_" + n) for n, (_, e) in specs.items()])
    types = {n: own.schema["o_" + n].dataType for n in specs}
    state = land(own.select("*", *[_start(k, types[n]).alias("a_" + n) for n, (k, _) in specs.items()], F.lit(False).alias("dangling")))
    done, open_ = [state.filter("ptr is null")], state.filter("ptr is not null")
    hops, before, loops, rows = 1, None, None, state.count()
    while True:
        total, widest, hot = _pointers(open_)
        if total == 0:
            break
        if total == before and hops >= widest:
            loops = open_.select("run_id", F.col("ptr").alias("span_id")).distinct()
            done.append(open_)
            break
        info = reduce(DataFrame.unionByName, [*done, open_]).select(
            "run_id", F.col("span_id").alias("ptr"), F.col("ptr").alias("p_ptr"), *[F.col(c + n).alias("p_" + c + n) for n in specs for c in ("o_", "a_")], F.lit(True).alias("known"))
        few = total <= BROADCAST_ROWS < rows
        if few:  # the rows that nothing points at stay where they are
            info = info.join(F.broadcast(open_.select("run_id", "ptr").distinct()), ["run_id", "ptr"], "left_semi")
        step = lookup(open_, info, ["run_id", "ptr"], hot=hot, rows=0 if few else rows)
        acc = [F.when(F.col("known"), _fold(k, F.col("a_" + n), F.col("p_o_" + n), F.col("p_a_" + n))).otherwise(F.col("a_" + n)).alias("a_" + n) for n, (k, _) in specs.items()]
        new = land(step.select(*NODE, F.col("p_ptr").alias("ptr"), *["o_" + n for n in specs], *acc, (F.lit(before is None) & F.col("known").isNull()).alias("dangling")))
        done.append(new.filter("ptr is null"))
        open_, before, hops = new.filter("ptr is not null"), total, hops * 2
    out = reduce(DataFrame.unionByName, done)
    return out.select(*NODE, *[F.col("a_" + n).alias(n) for n in specs], "dangling"), loops


def subtree(spans: DataFrame, values: Mapping[str, tuple[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """run_id, span_id, per name a value folded over the span and all its descendants, and ``keep`` with parent_id; ``values``: name -> (sum, min or max, bigint). Parents must be repaired."""
    keep = [c for c in keep if c not in (*NODE, "parent_id")]
    own = spans.select(*NODE, "parent_id", *keep, *[v.alias("o_" + n) for n, (_, v) in values.items()])
    if any(own.schema["o_" + n].dataType != LongType() for n in values):
        raise TypeError("subtree folds bigint values")

    kinds = {n: k for n, (k, _) in values.items()}

    def work(f: Forest) -> tuple[dict[str, pa.Array], np.ndarray]:
        out = f.down({n: (k, *f.ints("o_" + n)) for n, k in kinds.items()})
        return {n: pa.array(v, mask=~ok) for n, (v, ok) in out.items()}, f.stuck

    done, rest = by_run(own, work, ", ".join(f"`{n}` bigint" for n in values))
    cols = [*NODE, *values, *(["parent_id"] if keep else []), *keep]
    done = done.select(*cols)
    if rest is None:
        return done
    sums = _subtree_by_joins(rest, {n: (k, F.col("o_" + n)) for n, (k, _) in values.items()})
    if keep:
        sums = sums.join(rest.select(*NODE, "parent_id", *keep), NODE)
    return done.unionByName(sums.select(*cols))


def _subtree_by_joins(spans: DataFrame, values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``subtree`` of runs of any size.

    Round k adds to every span what the rows 2^k below it have gathered, so the work is rows x log2(depth). Parents must be repaired.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0).cast("bigint")), "min": F.least, "max": F.greatest}
    state = land(spans.select(*NODE, F.col("parent_id").alias("ptr"), *[v.alias(n) for n, (_, v) in values.items()]))
    before, rows = None, state.count()
    while True:
        open_ = state.filter("ptr is not null")
        total, _, hot = _pointers(open_)
        if total == 0:
            return state.drop("ptr")
        if total == before:
            raise ValueError("parents form a cycle; repair the tree first")
        before = total
        give = open_.groupBy("run_id", F.col("ptr").alias("span_id")).agg(*[fold[k](n).alias("g_" + n) for n, (k, _) in values.items()])
        step = lookup(state, state.select("run_id", F.col("span_id").alias("ptr"), F.col("ptr").alias("p_ptr")), ["run_id", "ptr"], hot=hot, rows=rows)
        step = lookup(step, give, NODE, rows=rows)
        state = land(step.select(*NODE, F.col("p_ptr").alias("ptr"), *[join[k](F.col(n), F.col("g_" + n)).alias(n) for n, (k, _) in values.items()]))


def _places() -> dict[str, tuple[str, Column]]:
    """What ``place`` asks of the ancestors."""
    one = F.struct(F.col("span_id").alias("id"), F.col("kind").alias("kind"))
    return {"depth": ("sum", F.lit(1).cast("bigint")), "scope": ("near", F.when(F.col("kind").isin(SCOPE_KINDS), one)), "top": ("far", one),
            "owner_id": ("near", F.when(F.col("kind") == "subagent", F.col("span_id"))), "call_id": ("near", F.when(F.col("kind") == "llm_call", F.col("span_id"))),
            "parent_kind": ("near", F.col("kind"))}


def _repaired_by_joins(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Spans with repaired parents, the values of ``_places`` per span, broken spans. Only runs with broken links are ranked again."""
    ranks, loops = _up_by_joins(spans, _places())
    broken = ranks.filter("dangling").select(*NODE)
    broken = cut(broken.unionByName(loops) if loops is not None else broken)
    if broken.isEmpty():
        return spans, ranks.drop("dangling"), None
    roots = root_of_run(spans)
    fixed = (spans.join(broken.withColumn("broken", F.lit(True)), NODE, "left").join(roots, "run_id", "left")
             .withColumn("parent_id", F.when(F.col("broken") & ~F.col("span_id").eqNullSafe(F.col("root_id")),
                                             F.col("root_id")).otherwise(F.col("parent_id")))
             .drop("broken", "root_id"))
    fixed = land(fixed)
    touched = broken.select("run_id").distinct()
    again, _ = _up_by_joins(fixed.join(touched, "run_id", "left_semi"), _places())
    ranks = ranks.join(touched, "run_id", "left_anti").unionByName(again).drop("dangling")
    return fixed, ranks, broken


def _repair_warnings(broken: DataFrame) -> DataFrame:
    """One row per run with broken links."""
    ranked = _first_ids(broken)
    return (ranked.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("rn") <= 10, F.col("span_id")))).alias("ids"))
        .select("run_id", F.concat(
            F.lit("Flat Trace Fallback: "), F.col("n").cast("string"),
            F.lit(" span(s) with broken parent links re-attached to the run root ("),
            F.array_join("ids", ", "), F.when(F.col("n") > 10, F.lit(", …")).otherwise(F.lit("")), F.lit(")")
        ).alias("message"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("line")))


CANONICAL = ["start_ms", "start_raw", "span_id"]


def _repair(f: Forest) -> tuple[pa.Array, np.ndarray]:
    """Repaired parent ids and the broken rows, of rows in canonical order; ``f.parent`` is repaired too."""
    for _ in f.hops():
        pass
    broken, at = f.dangling | f.loop, np.arange(f.n)
    ups = f.rows.column("parent_id").combine_chunks()
    if not broken.any():
        return ups, broken
    roots = np.flatnonzero(f.rootless)
    root = np.full(f.run.max() + 1, -1)
    root[f.run[roots[::-1]]] = roots[::-1]  # the first of each run
    f.parent = np.where(broken, root[f.run], f.parent)
    at = np.where(broken, np.where(f.parent >= 0, f.n + f.parent, -1), at)
    both = pa.concat_arrays([ups, f.rows.column("span_id").combine_chunks()])
    return both.take(pa.array(at, mask=at < 0)), broken


def _in_runs(spans: DataFrame, work: Callable[[Forest], tuple[dict[str, pa.Array], np.ndarray]], fields: str, before: Callable[[DataFrame], DataFrame] | None = None,
             after: Callable[[DataFrame], DataFrame] = lambda s: s, parts: int = 0) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Repair and ``work`` per run: the rows with ``fields``, landed, the broken spans (None: none), the rows that need joins (None: none)."""
    def task(f: Forest) -> tuple[dict[str, pa.Array], np.ndarray]:
        parents, broken = _repair(f)
        out, turned_down = work(f)
        return {"parent_id": parents, "broken": pa.array(broken)} | out, turned_down

    order = [F.col("start_ms"), F.coalesce("start_raw", F.lit("")), F.col("span_id")]
    read = [*NODE, "parent_id", "kind", "start_ms", "start_raw"]
    done, rest = by_run(spans, task, fields + "broken boolean", order, read, before, parts=parts)
    broken = done.filter("broken").select(*NODE)
    wide = beside(spans.drop("parent_id"), done.drop("kind", "start_ms", "start_raw", "broken"), after, parts)
    return wide, None if broken.isEmpty() else broken, rest


def _warned(spans: DataFrame, *broken: DataFrame | None) -> DataFrame:
    found = [b for b in broken if b is not None]
    if not found:
        return spans.sparkSession.createDataFrame([], "run_id string, message string, file string, line bigint")
    return _repair_warnings(cut(reduce(DataFrame.unionByName, found)))


def repair_tree(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-attach dangling spans and members of parent cycles to the earliest root; with ``path``, the ancestors as (id, kind), nearest first.

    Returns the spans and one warning row per touched run. ``place`` does without the path.
    """
    def work(f: Forest) -> tuple[dict[str, pa.Array], np.ndarray]:
        ends, rows, turned_down = f.ancestors()
        up = pa.StructArray.from_arrays([f.take("span_id", rows), f.take("kind", rows)], ["id", "kind"])
        return {"path": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), up)}, turned_down

    spans = land(spans)
    done, broken, rest = _in_runs(spans, work, "path array<struct<id: string, kind: string>>, ")
    done = done.select(*spans.columns, "path")
    if rest is None:
        return done, _warned(spans, broken)
    fixed, _, more = _repaired_by_joins(rest)
    slow = fixed.join(_ancestors(fixed).withColumnRenamed("up", "path"), NODE, "left")
    return done.unionByName(slow), _warned(spans, broken, more)


def repaired_parents(spans: DataFrame) -> DataFrame:
    """The spans with repaired ``parent_id`` alone."""
    spans = land(spans)
    done, _, rest = _in_runs(spans, lambda f: ({}, f.stuck), "")
    done = done.select(*spans.columns)
    return done if rest is None else done.unionByName(_repaired_by_joins(rest)[0])


def _ancestors(spans: DataFrame) -> DataFrame:
    """run_id, span_id, up: all proper ancestors as (id, kind), nearest first; as long as the span is deep."""
    return up_scan(spans, {"up": ("list", F.struct(F.col("span_id").alias("id"), F.col("kind").alias("kind")))})[0].select(*NODE, "up")


def _first_ids(broken: DataFrame) -> DataFrame:
    b, chunked = with_chunks(broken, ["run_id"], ["span_id"])
    return scan(b, ["run_id"], ["span_id"], {"rn": ("rownum", None)}, chunked)


def place(spans: DataFrame, after: Callable[[DataFrame], DataFrame] = lambda s: s, parts: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """Repair, then add depth, scope, owner, enclosing call and container, ``chunk`` and ``span_seq``; the silver ``spans`` table, landed. ``after`` is applied before that.

    The scope is the nearest subagent or session, the span itself included, else the top-most ancestor; the owner is the nearest proper subagent (null: main
    session); the container is the nearest proper subagent or session. ``parts``: ``spans`` are bucketed by run into so many; so are the rows that need no joins.
    """
    def work(f: Forest) -> tuple[dict[str, pa.Array], np.ndarray]:
        kind = f.rows.column("kind").combine_chunks()
        of = lambda *k: pc.fill_null(pc.is_in(kind, pa.array(k)), False).to_numpy(zero_copy_only=False)
        up = f.up({"depth": ("sum", np.ones(f.n, np.int64)), "scope": ("near", of(*SCOPE_KINDS)), "top": ("far", np.ones(f.n, bool)), "owner": ("near", of("subagent")),
                   "call": ("near", of("llm_call")), "kind": ("near", f.known("kind"))})
        return {"depth": pa.array(up["depth"].astype(np.int32)), "owner_id": f.take("span_id", up["owner"]), "call_id": f.take("span_id", up["call"]), "parent_kind": f.take("kind", up["kind"]),
                "scope_of": f.take("span_id", up["scope"]), "kind_of": f.take("kind", up["scope"]), "top_of": f.take("span_id", up["top"]), "top_kind": f.take("kind", up["top"])}, f.stuck

    def seen(s: DataFrame) -> DataFrame:
        return after(_scopes(s, F.col("scope_of"), F.col("kind_of"), F.col("top_of"), F.col("top_kind")).drop("scope_of", "kind_of", "top_of", "top_kind"))

    ready = spans.withColumn("start_raw", F.coalesce("start_raw", F.lit("")))
    done, broken, rest = _in_runs(ready, work, "depth int, owner_id string, call_id string, parent_kind string, scope_of string, kind_of string, top_of string, top_kind string, ",
                                  lambda s: scan(s.withColumn(CHUNK, F.lit(0)), ["run_id"], CANONICAL, {"span_seq": ("rownum", None)}), seen, parts)
    cols = [*spans.columns, "depth", "owner_id", "call_id", "parent_kind", "container_id", "scope_id", "scope_kind", CHUNK, "span_seq"]
    cols += [c for c in done.columns if c not in cols]
    if rest is None:
        return done.select(*cols), _warned(spans, broken), False
    slow, more, chunked = _place_by_joins(rest)
    return land(done.select(*cols).unionByName(after(slow).select(*cols))), _warned(spans, broken, more), chunked


def _scopes(s: DataFrame, scope: Column, kind: Column, top: Column, top_kind: Column) -> DataFrame:
    own = F.col("kind").isin(SCOPE_KINDS)
    return s.withColumns({"container_id": scope, "scope_id": F.when(own, F.col("span_id")).otherwise(F.coalesce(scope, top, "span_id")),
                          "scope_kind": F.when(own, F.col("kind")).otherwise(F.coalesce(kind, top_kind, "kind"))})


def _place_by_joins(spans: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """``place`` of runs of any size, with the broken spans."""
    fixed, ranks, broken = _repaired_by_joins(spans)
    rows = spans.count()
    hot = not hot_groups(fixed.select("run_id"), ["run_id"]).isEmpty()
    s = lookup(fixed, ranks, NODE, rows=rows).withColumn("depth", F.col("depth").cast("int"))
    s = _scopes(s, F.col("scope.id"), F.col("scope.kind"), F.col("top.id"), F.col("top.kind")).drop("scope", "top")
    s, chunked = with_chunks(s, ["run_id"], ["start_ms"]) if hot else (spread(s, rows, "run_id").withColumn(CHUNK, F.lit(0)), False)
    return scan(s, ["run_id"], CANONICAL, {"span_seq": ("rownum", None)}, chunked), broken, chunked


def closure(spans: DataFrame) -> DataFrame:
    """(run, span, ancestor, dist) for every proper ancestor: as many rows as the depths add up to."""
    return _ancestors(spans).select(*NODE, F.posexplode("up").alias("pos", "anc")).select(
        *NODE, F.col("anc.id").alias("ancestor_id"), F.col("anc.kind").alias("ancestor_kind"), (F.col("pos") + 1).alias("dist"))


def intervals(spans: DataFrame, chunked: bool = False) -> DataFrame:
    """run_id, span_id, enter, leave: spans numbered depth first from 0, siblings by ``span_seq``; b lies under a if a.enter < b.enter <= a.leave.

    A span enters behind its parent and the subtrees of its earlier siblings, so its number is the sum of these steps along its path.
    """
    def work(f: Forest) -> tuple[dict[str, pa.Array], np.ndarray]:
        one = np.ones(f.n, np.int64)
        size = f.down({"size": ("sum", one, np.ones(f.n, bool))})["size"][0]
        seq, known = f.ints("span_seq")
        group = np.where(f.parent >= 0, f.parent, -1 - f.run)  # the siblings, or the roots of a run
        order = np.lexsort((seq, group))
        first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        past = np.concatenate([[0], np.cumsum(size[order])[:-1]])
        step = np.empty(f.n, np.int64)
        step[order] = past - np.maximum.accumulate(np.where(first, past, 0))
        step += ~f.rootless
        enter = f.up({"above": ("sum", step)})["above"] + step
        return {"enter": pa.array(enter), "leave": pa.array(enter + size - 1)}, f.stuck | f.dangling | ~known

    own = spans.select(*NODE, "parent_id", "span_seq", *(["chunk"] if chunked else []))
    done, rest = by_run(own, work, "enter bigint, leave bigint")
    done = done.select(*NODE, "enter", "leave")
    return done if rest is None else done.unionByName(_intervals_by_joins(rest, chunked))


def _intervals_by_joins(spans: DataFrame, chunked: bool) -> DataFrame:
    size = _subtree_by_joins(spans, {"size": ("sum", F.lit(1).cast("bigint"))})
    s = spans.select(*NODE, "parent_id", "span_seq", *(["chunk"] if chunked else []), F.coalesce("parent_id", F.lit("")).alias("pk")).join(size, NODE)
    s = scan(s, ["run_id", "pk"], ["span_seq"], {"upto": ("sum", F.col("size"))}, chunked)
    s = land(s.withColumn("step", F.col("upto") - F.col("size") + F.when(F.col("parent_id").isNull(), 0).otherwise(1)))
    up, _ = _up_by_joins(s, {"above": ("sum", F.col("step"))})
    enter = F.col("above") + F.col("step")
    return s.join(up, NODE).select(*NODE, enter.alias("enter"), (enter + F.col("size") - 1).alias("leave"))


def depth(spans: DataFrame) -> DataFrame:
    return spans.select(*NODE, "depth")


def scope_of(spans: DataFrame) -> DataFrame:
    return spans.select(*NODE, "scope_id", "scope_kind")


def owner_of(spans: DataFrame) -> DataFrame:
    return spans.select(*NODE, "owner_id")


def main_scope_calls(spans: DataFrame) -> DataFrame:
    return spans.filter((F.col("kind") == "llm_call") & F.col("model").isNotNull()
                        & (F.col("scope_kind") != "subagent"))


def subtree_rollup(spans: DataFrame) -> DataFrame:
    """Per span: priced cost, unpriced calls, tokens and calls of its subtree (itself included)."""
    call = (F.col("kind") == "llm_call") & F.col("model").isNotNull()
    known = call & (F.col("cost_source") != "unknown")
    count = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    return subtree(spans, {
        "subtree_micro": ("sum", F.when(known, nz("cost_micro")).otherwise(0).cast("bigint")), "unpriced_calls": ("sum", count(call & (F.col("cost_source") == "unknown"))),
        "subtree_tokens": ("sum", F.when(call, nz(total_tokens())).otherwise(0).cast("bigint")), "subtree_calls": ("sum", count(call))})


def agents(spans: DataFrame, *more: Column) -> DataFrame:
    """The tree of subagents: run_id, span_id, parent_id (the subagent around it), ``more``."""
    return spans.filter("kind = 'subagent'").select(*NODE, F.col("owner_id").alias("parent_id"), *more)


def agent_sums(spans: DataFrame, own: DataFrame, cols: list[str]) -> DataFrame:
    """run_id, agent_id and the sums of ``own`` (run_id, agent_id, cols) over each subagent and all below it."""
    a = agents(spans).join(own.withColumnRenamed("agent_id", "span_id"), NODE, "left").fillna(0, cols)
    return subtree(a, {c: ("sum", F.col(c).cast("bigint")) for c in cols}).withColumnRenamed("span_id", "agent_id")


def agents_within(spans: DataFrame, roots: DataFrame) -> DataFrame:
    """run_id, agent_id, root_id: the subagents that are or lie under one of ``roots`` (run_id, root_id), with the nearest one."""
    a = agents(spans).join(roots.select("run_id", F.col("root_id").alias("span_id"), F.col("root_id").alias("own")), NODE, "left")
    a = land(a)
    up, _ = up_scan(a, {"above": ("near", F.col("own"))}, keep=["own"])
    return up.select("run_id", F.col("span_id").alias("agent_id"), F.coalesce("own", "above").alias("root_id")).filter("root_id is not null")


def agent_subtree_costs(spans: DataFrame) -> DataFrame:
    """Own cost per innermost subagent plus the main session (dropped when zero)."""
    own = (spans.filter((F.col("kind") == "llm_call") & F.col("cost_micro").isNotNull())
           .groupBy("run_id", F.coalesce("owner_id", F.lit("")).alias("agent_id"))
           .agg(F.sum("cost_micro").alias("own_micro")))
    subs = spans.filter("kind = 'subagent'").select(
        "run_id", F.col("span_id").alias("agent_id"), F.coalesce("agent_name", "name").alias("agent_name"))
    full = own.join(subs, ["run_id", "agent_id"], "full")
    return (full.select("run_id", "agent_id", F.when(F.col("agent_id") == "", "main session")
                        .otherwise(F.col("agent_name")).alias("agent_name"), nz("own_micro").alias("own_micro"))
            .filter("agent_id <> '' or own_micro > 0"))


def agent_tree_rollup(spans: DataFrame) -> DataFrame:
    """Subagents nested by nearest subagent: own and total cost, tokens and calls."""
    call = (F.col("kind") == "llm_call") & F.col("model").isNotNull()
    m = (spans.filter(call).withColumn("tot", total_tokens()))
    named = agents(spans, F.coalesce("agent_name", "name").alias("agent_name"))
    sums = [nz(F.sum("cost_micro")).alias("own_micro"), nz(F.sum("tot")).alias("own_tokens"), F.count("*").alias("calls")]
    own = m.filter("owner_id is not null").groupBy("run_id", F.col("owner_id").alias("span_id")).agg(*sums)
    a = named.join(own, NODE, "left").fillna(0, ["own_micro", "own_tokens", "calls"])
    total = {n: ("sum", F.col(c).cast("bigint")) for n, c in (("total_micro", "own_micro"), ("total_tokens", "own_tokens"), ("total_calls", "calls"))}
    return subtree(a, total, ["agent_name", "own_micro", "own_tokens"]).select(
        "run_id", F.col("span_id").alias("agent_id"), F.col("parent_id").alias("parent_agent"), "agent_name", "own_micro", "own_tokens", *total)


def find_spans(spans: DataFrame, query: str) -> DataFrame:
    """Case-insensitive name match plus every ancestor of a match."""
    hit = F.coalesce(F.lower("name").contains(query.strip().lower()), F.lit(False))
    return subtree(spans, {"hits": ("sum", hit.cast("bigint"))}).filter("hits > 0").select(*NODE)


def concurrency_groups(spans: DataFrame, chunked: bool = False) -> DataFrame:
    """Overlapping consecutive siblings; groups of two or more get a start/mid/end position."""
    s = spans.filter("parent_id is not null").withColumn(
        "draw_end_ms", F.col("start_ms") + nz("duration_ms"))
    order, key = ["start_ms", "start_raw", "span_id"], ["run_id", "parent_id"]
    s = scan(s, key, order, {"prev_end": ("prev_max", F.col("draw_end_ms"))}, chunked)
    s = s.withColumn("new_island", (F.col("prev_end").isNull() | (F.col("start_ms") >= F.col("prev_end"))).cast("int"))
    s = scan(s, key, order, {"island": ("sum", F.col("new_island"))}, chunked)
    size = s.groupBy(*key, "island").agg(F.count("*").alias("group_size"),
                                         F.min("span_seq").alias("lo"), F.max("span_seq").alias("hi"))
    return (s.join(size.filter("group_size >= 2"), [*key, "island"]).select(
        *NODE, "parent_id", "island", "group_size",
        F.when(F.col("span_seq") == F.col("lo"), "start").when(F.col("span_seq") == F.col("hi"), "end")
        .otherwise("mid").alias("position")))


def preorder_key(spans: DataFrame) -> DataFrame:
    """Depth-first sort key per span: the canonical positions of root .. span."""
    up, _ = up_scan(spans, {"up": ("list", F.col("span_seq"))}, keep=["span_seq"])
    return up.select(*NODE, F.concat(F.reverse("up"), F.array("span_seq")).alias("order_path"))


def tree_preorder(spans: DataFrame, chunked: bool = False) -> DataFrame:
    """Depth-first listing of every run; a total sort by (run, enter), no per-run window."""
    return (intervals(spans, chunked).join(spans.select(*NODE, "depth", "name"), NODE)
            .orderBy("run_id", "enter"))
