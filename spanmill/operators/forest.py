"""Trees of whole runs inside a task, with numpy over batches of many runs.

``by_run`` shuffles the rows once, by run, and hands whole runs to ``work``. It takes the runs of at most ``RUN_ROWS`` rows whose span ids are there once and not null, and
which ``work`` does not turn down (parent cycles); the rows of all other runs come back untouched, for the joins of ``tree``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from ..session import cut, land, setting
from ..skew import bounded, hot_limit, spread

RUN_ROWS = 250_000
BATCH_ROWS = 65_536
LIST_DEPTH = 64  # a batch of rows holds at most this many list entries a row


class Forest:
    """Rows of whole runs (all rows of a run together) with ``parent``: the row of each row's parent, -1 if there is none.

    ``dangling``: the parent id is not in the run. ``odd``: rows of runs whose ids are null or repeated. ``run``: numbers that take the place of the run ids.
    """

    def __init__(self, rows: pa.Table, run: np.ndarray | None = None):
        self.rows, self.n = rows, rows.num_rows
        ids, ups = _flat(rows, "span_id"), _flat(rows, "parent_id")
        self.run = _codes(_flat(rows, "run_id")) if run is None else run
        code = _codes(pa.concat_arrays([ids, ups]))
        own, up = code[: self.n], code[self.n :]
        key, want = self.run * (2 * self.n + 1) + own, self.run * (2 * self.n + 1) + up
        order = np.argsort(key, kind="stable")
        there = key[order]
        at = np.minimum(np.searchsorted(there, want), self.n - 1)
        hit = (there[at] == want) & (up >= 0)
        self.parent = np.where(hit, order[at], -1)
        self.rootless = up < 0
        self.dangling = ~hit & (up >= 0)
        bad = own < 0
        bad[order[1:][there[1:] == there[:-1]]] = True
        self.odd = self.whole_runs(bad)

    def whole_runs(self, rows: np.ndarray) -> np.ndarray:
        """All rows of the runs of the given ones."""
        if not rows.any():
            return np.zeros(self.n, bool)
        runs = np.zeros(self.run.max() + 1, bool)
        runs[self.run[rows]] = True
        return runs[self.run]

    def ints(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """A bigint column and where it is not null."""
        a = _flat(self.rows, name)
        return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(np.int64), self.known(name)

    def known(self, name: str) -> np.ndarray:
        """Where a column is not null."""
        return _flat(self.rows, name).is_valid().to_numpy(zero_copy_only=False)

    def take(self, name: str, at: np.ndarray) -> pa.Array:
        """Values of the rows ``at``; null for -1."""
        return _flat(self.rows, name).take(pa.array(at, mask=at < 0))

    def hops(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rounds of pointer doubling: (open rows, their pointers). Rows that are still open behind the last round run into a cycle: ``self.stuck``, and its members ``self.loop``."""
        q, far = self.parent.copy(), 1
        self.stuck, self.loop = np.zeros(self.n, bool), np.zeros(self.n, bool)
        while True:
            m = np.flatnonzero(q >= 0)
            if not len(m):
                return
            if far > self.n:
                self.stuck[m], self.loop[q[m]] = True, True
                return
            yield m, q[m]
            q[m], far = q[q[m]], far * 2

    def up(self, specs: Mapping[str, tuple[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """Folds over the proper ancestors. ``sum`` and ``xor`` take int64 values; ``near`` and ``far`` take where there is a value and return its row (-1: none)."""
        acc = {n: np.zeros(self.n, np.int64) if k in ("sum", "xor") else np.full(self.n, -1) for n, (k, _) in specs.items()}
        for m, q in self.hops():
            for n, (kind, v) in specs.items():
                a = acc[n]
                if kind == "sum":
                    a[m] += v[q] + a[q]
                elif kind == "xor":
                    a[m] ^= v[q] ^ a[q]
                elif kind == "near":
                    a[m] = np.where(a[m] >= 0, a[m], np.where(v[q], q, a[q]))
                else:
                    a[m] = np.where(a[q] >= 0, a[q], np.where(v[q], q, a[m]))
        return acc

    def down(self, values: Mapping[str, tuple[str, np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Folds (sum, min, max) over a row and its descendants: name -> (values, where not null). A null stays null in a sum."""
        fold = {"sum": np.add, "min": np.minimum, "max": np.maximum}
        rest = {"sum": 0, "min": np.iinfo(np.int64).max, "max": np.iinfo(np.int64).min}
        out = {n: (np.where(ok, v, rest[k]), ok.copy()) for n, (k, v, ok) in values.items()}
        for m, q in self.hops():
            for n, (kind, _, _) in values.items():
                v, ok = out[n]
                give = ok[m]
                if kind == "sum":
                    give = give & ok[q]
                to, what = q[give], v[m[give]]
                fold[kind].at(v, to, what)
                ok[to] = True
        return out

    def ancestors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets and rows of all proper ancestors, nearest first; and the rows of runs left out, whose spans lie in cycles or deeper than ``LIST_DEPTH`` on average."""
        depth = self.up({"n": ("sum", np.ones(self.n, np.int64))})["n"]
        mean = np.bincount(self.run, np.where(self.stuck, 0, depth)) / np.bincount(self.run)
        out = self.whole_runs(self.stuck) | (mean > LIST_DEPTH)[self.run]
        up = np.where(out, -1, self.parent)
        ends = np.concatenate([[0], np.cumsum(np.where(out, 0, depth))])
        rows, m, level, q = np.empty(ends[-1], np.int64), np.arange(self.n), 0, up
        while True:
            m, q = m[q >= 0], q[q >= 0]
            if not len(m):
                return ends, rows, out
            rows[ends[m] + level] = q
            q, level = up[q], level + 1


def _flat(rows: pa.Table, name: str) -> pa.Array:
    c = rows.column(name)
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _codes(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def codes(rows: pa.Table, name: str) -> np.ndarray:
    """Numbers from 0 for the values of a column, -1 for null."""
    return _codes(_flat(rows, name))


def whole_runs(batches: Iterator[pa.RecordBatch], key: str = "run_id") -> Iterator[pa.Table]:
    """Tables of ``BATCH_ROWS`` rows or more, cut between the values of ``key``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= BATCH_ROWS:
            ids = b.column(b.schema.get_field_index(key))
            first = pc.index(ids, ids[-1]).as_py()
            if first > 0:  # the run before the last one ends in this batch
                yield pa.Table.from_batches([*held[:-1], b.slice(0, first)])
                held, n = [b.slice(first)], b.num_rows - first
    if held:
        yield pa.Table.from_batches(held)


Work = Callable[[Forest], tuple[dict[str, pa.Array], np.ndarray]]


def _task(work: Work, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            f = Forest(rows)
            new, turned_down = work(f)
            odd = f.odd | f.whole_runs(turned_down)
            new["odd"] = pa.array(odd)
            cols = [(new[x.name] if x.name in new else _flat(rows, x.name)).cast(x.type) for x in schema]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
    return run


def by_run(df: DataFrame, work: Work, fields: str, order: Sequence[Column | str] = (), columns: Sequence[str] = (),
           before: Callable[[DataFrame], DataFrame] | None = None, rows: int = 0, parts: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``df`` (run_id, span_id, parent_id and more; or its ``columns`` alone) with the ``fields`` (DDL) that ``work`` gives, landed; and the rows of the runs that need joins, if any.

    ``before`` adds columns per run while the rows lie by run (its windows need no shuffle; the second frame does not have them), ``order`` sorts inside the runs, ``rows`` sets the
    number of tasks where ``df`` already lies by run. ``parts``: the result is bucketed by run into so many, as ``df`` is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    limit = min(hot_limit(df), RUN_ROWS)
    per = df.groupBy("run_id").agg(F.count("*").alias("n"))
    total, most, lost = per.agg(F.sum("n"), F.max("n"), F.max(F.col("run_id").isNull())).first()
    big, easy = None, df
    if total and (most > limit or lost):
        big = cut(per.filter((F.col("n") > limit) | F.col("run_id").isNull()).select("run_id"))
        easy = df.filter("run_id is not null").join(bounded(big), "run_id", "left_anti")
    if columns:
        easy = easy.select(*columns)
    s = spread(easy, rows or total or 0, "run_id")
    s = s if s is not easy else easy.repartition("run_id")
    s = (before(s) if before else s).sortWithinPartitions("run_id", *order)
    schema = StructType([*s.schema.fields, *StructType.fromDDL(fields).fields]).add("odd", BooleanType())
    # a table bucketed alike is not shuffled again; then it has to be read by buckets, for no operator behind asks for whole runs
    with setting(df.sparkSession, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        out = s.mapInArrow(_task(work, to_arrow_schema(schema)), schema)
        out = land(out, "run_id", parts) if parts else land(out)
    odd = out.filter("odd").select("run_id").distinct()
    ids = [x for x in (big, None if odd.isEmpty() else odd) if x is not None]
    if not ids:
        return out.drop("odd"), None
    rest = cut(ids[0].unionByName(ids[1]) if len(ids) > 1 else ids[0]).withColumnRenamed("run_id", "rest_id")
    return out.filter("not odd").drop("odd"), land(df.join(bounded(rest), F.col("run_id").eqNullSafe(F.col("rest_id")), "left_semi"))


def beside(wide: DataFrame, narrow: DataFrame, after: Callable[[DataFrame], DataFrame], parts: int = 0) -> DataFrame:
    """Rows of ``wide`` with the columns that ``by_run`` gave for them, landed after ``after``.

    Both sides are shuffled by run alone, so the rows of a run stay together in the files; that a join on more columns may use this has to be allowed. With ``parts``
    the result is bucketed by run into so many; sides that are bucketed alike are not shuffled.
    """
    rows = narrow.count()
    with setting(wide.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        out = after(spread(wide, rows, "run_id").join(spread(narrow, rows, "run_id"), ["run_id", "span_id"]))
        return land(out, "run_id", parts) if parts else land(out)
