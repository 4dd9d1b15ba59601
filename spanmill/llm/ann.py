"""Approximate nearest neighbours by collision counting.

A block of vectors keeps ``m`` arrays, each the vectors' projections on one random line in sorted order. A query opens a window around
its own projection in every array (two binary searches); virtual rehashing widens all windows round by round. An array in whose window
a vector's rank lies is a collision, counted for the whole block at once. A vector whose count reaches the threshold is verified: its
exact cosine is computed in double precision. A query stops in a block
once enough verified vectors lie within the radius of the round: ``k``, or with many blocks ``SURPLUS`` times the block's share of k.

Scale: vectors and queries are cut into blocks of bounded size by hash; a task holds one block of each and returns at most k rows per
query, which a final top-k merges. The query set meets all rows in blocks, and no collision leaves its task.

Parameters come from the angles to be found: ``near`` is the distance (of unit vectors) at which a neighbour must be caught with
probability about 1 - ``miss`` in the round whose radius reaches it.

Cases: vectors that are null, zero, or hold nulls or non-finite numbers take no part; vectors of other lengths are never neighbours;
rows with a null id take no part; repeated ids count once (the smallest vector of the id); fewer than k candidates: all of them;
ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, M, SEED = 5, 128, 20240501
VECTORS, QUERIES = 4096, 2048  # mean rows in a block
HALF, RADII, MISS = 0.6, (0.8, 1.0, 1.1, 1.2, 1.3, 1.42), 0.03
SURPLUS = 3  # a block among b stops at SURPLUS * k / b neighbours inside the radius (k at most): its share of the k nearest, with room


@lru_cache(8)
def lines(dim: int, m: int, seed: int = SEED) -> np.ndarray:
    """Random directions; the same in every task."""
    return np.random.default_rng(seed).standard_normal((dim, m))


def thresholds(m: int, half: float, miss: float) -> int:
    """Collisions that a vector at the radius of the round reaches with probability 1 - miss (normal approximation)."""
    p = 2 * NormalDist().cdf(half) - 1
    return max(1, math.floor(m * p + NormalDist().inv_cdf(miss) * math.sqrt(m * p * (1 - p))))


class Block:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int):
        self.ids, self.vectors = ids, vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        p = (vectors / self.norm[:, None]) @ lines(vectors.shape[1], m)
        p = np.ascontiguousarray(p.T)
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, axis=1)
        # place of every vector in every array
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.rank = np.empty((m, len(ids)), kind)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=kind)[None, :], axis=1)
        self.m = m

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, half: float, radii: tuple[float, ...], miss: float, blocks: int = 1) -> list[tuple[int, int, float]]:
        enough = min(k, math.ceil(SURPLUS * k / blocks))
        n, need = len(self.ids), thresholds(self.m, half, miss)
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        at = (queries / norm[:, None]) @ lines(queries.shape[1], self.m)
        # ends of every window, all queries and rounds at once
        edge = [(np.stack([np.searchsorted(row, at[:, j] - half * r) for j, row in enumerate(self.sorted)], 1).astype(self.rank.dtype),
                 np.stack([np.searchsorted(row, at[:, j] + half * r, "right") for j, row in enumerate(self.sorted)], 1).astype(self.rank.dtype)) for r in radii]
        out = []
        for q in range(len(ids)):
            done = np.zeros(n, bool)
            found: list[np.ndarray] = []
            score: list[np.ndarray] = []
            for radius, (lo, hi) in zip(radii, edge):
                # lo <= rank < hi, as one comparison of unsigned numbers
                inside = (self.rank - lo[q][:, None]) < (hi[q] - lo[q])[:, None]
                count = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if self.m < 256 else np.uint32)
                new = np.flatnonzero((count >= need) & ~done)
                done[new] = True
                new = new[self.ids[new] != ids[q]]
                if len(new):
                    found.append(new)
                    score.append(np.einsum("ij,j->i", self.vectors[new], queries[q]) / (self.norm[new] * norm[q]))
                # the radius as a cosine: enough verified vectors inside it end the search
                if sum(int((s >= 1 - radius * radius / 2).sum()) for s in score) >= enough:
                    break
            else:
                if sum(map(len, found)) < k:  # the rest of a block with few collisions, so that none is missing
                    new = np.flatnonzero(~done & (self.ids != ids[q]))
                    found.append(new)
                    score.append(np.einsum("ij,j->i", self.vectors[new], queries[q]) / (self.norm[new] * norm[q]))
            if found:
                f, s = np.concatenate(found), np.concatenate(score)
                best = np.lexsort((self.ids[f], -s))[:k]
                out += [(int(ids[q]), int(self.ids[f[b]]), float(s[b])) for b in best]
        return out


def search_task(k: int, m: int, half: float, radii: tuple[float, ...], miss: float):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vectors) and len(queries):
            v = np.stack([np.asarray(x, np.float64) for x in vectors["v"]])
            q = np.stack([np.asarray(x, np.float64) for x in queries["v"]])
            rows = Block(vectors["id"].to_numpy(), v, m).search(queries["id"].to_numpy(), q, k, half, radii, miss, int(vectors["nv"].iloc[0]))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v, dim): one usable vector per id."""
    v = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    return v.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, is_query, id: str = "vec_id", vector: str = "embedding", k: int = K, m: int = M, half: float = HALF,
            radii: tuple[float, ...] = RADII, miss: float = MISS, block: tuple[int, int] = (VECTORS, QUERIES)) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for every vector whose id satisfies ``is_query`` (a Column -> Column function)."""
    from ..session import land
    v = land(usable(vectors, id, vector))
    sizes = v.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query(F.col("id"))).alias("q"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / block[0]).cast("int").alias("nv"), F.greatest(F.lit(1), F.ceil(F.col("q") / block[1])).cast("int").alias("nq"))
    v = v.join(land(sizes), "dim")
    vb, qb = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("nv")).alias("vb"), F.pmod(F.xxhash64(F.lit(2), "id"), F.col("nq")).alias("qb")
    left = v.select("dim", "id", "v", "nv", vb, F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq").cast("long") - 1)).alias("qb"))
    right = v.filter(is_query(F.col("id"))).select("dim", "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv").cast("long") - 1)).alias("vb"), qb)
    right = right.toDF("qdim", "id", "v", "qvb", "qqb")  # its own columns: both sides come from one table
    found = left.groupBy("dim", "vb", "qb").cogroup(right.groupBy("qdim", "qvb", "qqb")).applyInPandas(
        lambda a, b: search_task(k, m, half, radii, miss)(a, b), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
