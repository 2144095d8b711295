"""Approximate nearest neighbours by collision counting.

Each vector is projected on a few dozen random lines; a block keeps, for each line,
its vectors sorted by their projection. A query opens a window around its own
projection on every line and widens all of them step by step (virtual rehashing:
radius R, cR, ccR, ... over the same arrays). A vector inside the windows of enough
lines is a candidate and its true distance is computed. The search ends when the
k-th best distance is within the radius, at which a true neighbour would already
have collided on enough lines with high probability; in a block other than the query's
own, also when the radius passes the k-th distance found before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_blocks import clean_vectors, power_above, search_blocks, with_query_flag

#: Window width by radius: a vector at the radius collides on a line with probability 0.74.
WIDTH = 2.25
#: Vectors with larger components are divided by a power of two while they are searched.
LARGE = 2.0**500


class CollisionIndex:
    """scale: what the points were divided by; distances are of the vectors as they were."""

    nearest_first = True
    score_type = "double"

    def __init__(self, lines: int, enough: int, growth: float, seed: int, scale: float = 1.0):
        self.lines, self.enough, self.growth, self.seed, self.scale = lines, enough, growth, seed, scale

    def build(self, points: np.ndarray, k: int) -> dict[str, np.ndarray]:
        lines = np.random.RandomState(self.seed).randn(points.shape[1], self.lines)
        projected = np.ascontiguousarray((points @ lines).T)
        order = np.argsort(projected, axis=1, kind="stable")
        return {
            "points": points, "lines": lines, "order": order.astype(np.int32), "sorted": np.take_along_axis(projected, order, axis=1),
            "first": np.array(self._first_radius(points, k)),
        }

    @staticmethod
    def _first_radius(points: np.ndarray, k: int, sample: int = 48) -> float:
        """Below nearly all distances to the k-th neighbour, judged by a bounded sample of the block."""
        some = points[:: max(1, len(points) // sample)][:sample]
        square = (some * some).sum(1)[:, None] - 2 * some @ points.T + (points * points).sum(1)
        at = min(k, len(points) - 1)
        kth = np.sqrt(np.maximum(np.partition(square, at, axis=1)[:, at], 0))
        largest = float(np.abs(points).max())
        kth = np.sort(kth[kth > 1e-6 * largest])
        return float(kth[len(kth) // 10]) if len(kth) else 1e-6 * largest

    def as_queries(self, points: np.ndarray) -> np.ndarray:
        return points

    def reach(self, queries: np.ndarray, limits: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(limits), np.inf, limits / self.scale) * (1 + 1e-9)

    def search(self, index: dict[str, np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries go 256 at a time; those of one lot widen their windows through the same radii."""
        found = [self._lot(index, queries[s : s + 256], own[s : s + 256], k, limits[s : s + 256]) for s in range(0, len(queries), 256)]
        rows = np.concatenate([r + 256 * i for i, (r, _, _) in enumerate(found)])
        return rows, np.concatenate([v for _, v, _ in found]), np.concatenate([d for _, _, d in found])

    def _lot(self, index: dict[str, np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, order, ranked = index["points"], index["order"], index["sorted"]
        n = ranked.shape[1]
        limit = np.where(np.isnan(limits), np.inf, limits)
        centers = (queries @ index["lines"]).T
        low = np.stack([np.searchsorted(s, c) for s, c in zip(ranked, centers, strict=True)], axis=1)
        high = low.copy()
        hits = np.zeros((len(queries), n), np.int16)
        found: list[np.ndarray] = [np.empty(0, np.int64) for _ in queries]
        far: list[np.ndarray] = [np.empty(0) for _ in queries]
        done = np.zeros((len(queries), n), bool)
        for i in np.flatnonzero(own >= 0):
            done[i, own[i]] = True
        wanted = np.minimum(k, n - (own >= 0))
        active = np.flatnonzero(wanted > 0)
        radius = float(index["first"])
        while len(active):
            half = WIDTH * radius / 2
            reach = centers[:, active]
            new_low = np.stack([np.searchsorted(s, c - half, "left") for s, c in zip(ranked, reach, strict=True)], axis=1)
            new_high = np.stack([np.searchsorted(s, c + half, "right") for s, c in zip(ranked, reach, strict=True)], axis=1)
            staying = []
            for i, lo, hi in zip(active, np.minimum(new_low, low[active]), np.maximum(new_high, high[active]), strict=True):
                parts = [o[a:b] for o, a, b in zip(order, lo, low[i], strict=True) if a < b]
                parts += [o[a:b] for o, a, b in zip(order, high[i], hi, strict=True) if a < b]
                low[i], high[i] = lo, hi
                if parts:
                    hits[i] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                whole = bool((lo == 0).all() and (hi == n).all())
                new = np.flatnonzero((hits[i] >= self.enough) & ~done[i])
                if len(new):
                    done[i, new] = True
                    gap = (points[new] - queries[i]) * self.scale
                    with np.errstate(over="ignore"):
                        away = np.sqrt((gap * gap).sum(axis=1))
                    better = away <= (far[i][-1] if len(far[i]) >= wanted[i] else limit[i])
                    away, new = np.concatenate([far[i], away[better]]), np.concatenate([found[i], new[better]])
                    best = np.lexsort((new, away))[: wanted[i]]
                    found[i], far[i] = new[best], away[best]
                end = min(limit[i], far[i][-1] if len(far[i]) >= wanted[i] else np.inf)
                if not whole and end > radius * self.scale:
                    staying.append(i)
            active = np.array(staying, dtype=np.int64)
            radius *= self.growth
        rows = np.repeat(np.arange(len(queries)), [len(f) for f in found])
        return rows, np.concatenate(found), np.concatenate(far)


def nearest_vectors(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    lines: int = 60,
    enough: int = 42,
    growth: float = 1.15,
    block_rows: int = 8192,
    query_rows: int = 4096,
    seed: int = 3,
) -> DataFrame:
    """The k nearest found of each query by Euclidean distance: (query_id, rank, vec_id, score).

    ``df`` needs vec_id and embedding; ``is_query`` is a condition on vec_id. All other rows are
    candidates. A vector is verified when it collides on ``enough`` of ``lines`` lines. Distances are
    computed in double precision from the original vectors; ties go to the smaller vec_id. Vectors
    that are null, empty, zero or hold null or non-finite components take no part. Rows that
    repeat an id are rows of their own: such a query has its k neighbours once for each of its rows, and
    finds the other rows of its id. Queries meet only vectors of their own dimension.
    """
    vectors = with_query_flag(clean_vectors(df, False), is_query)
    largest = vectors.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("x")).first()["x"] or 0.0
    scale = power_above(largest) if largest > LARGE else 1.0
    points = F.transform("v", lambda x: x / F.lit(scale)) if scale != 1.0 else F.col("v")
    index = CollisionIndex(lines, enough, growth, seed, scale)
    return search_blocks(vectors.select("vec_id", points.alias("p"), "dim", "is_query"), k, index, block_rows, query_rows, seed=seed)
