"""Exact top-k by inner product with an M-tree, searched best first.

Largest inner product becomes nearest neighbour: with one more component that brings
every vector to the same length, the squared distance from a query (with a zero there)
is a constant less twice the inner product. The tree's top pages are the cells of
``vector_blocks``; each block holds the pages below as flat arrays: routing vectors with
covering radii and every entry's distance to its page's routing vector, so triangle
inequalities discard entries before their distance is computed. Bounds are floating
point with a margin; scores are exact integers.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_blocks import clean_vectors, power_above, search_blocks, with_query_flag

#: Relative margin for rounding in the bounds.
MARGIN = 1e-9
LONG = 2**63
#: Pages that a search takes from its heap at a time.
MOST_PAGES = 32
#: Part of a page's leaves from which on they are scored together.
NEARLY_ALL = 0.75
MOST = sys.float_info.max


def _floor(x: Column) -> Column:
    """As a double: from 2**52 on every double is whole. Infinite products become the largest double."""
    held = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x))
    return F.when(F.abs(held) < 2.0**52, F.floor(held).cast("double")).otherwise(held)


def _far(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class PageWriter:
    """Bulk load: a page's members are dealt to their nearest of a few routing vectors until they fit a leaf.

    pages: center, radius, leaf, and begin and end of its entries; an entry is a point (of a leaf) or a page, with its
    distance to the page's center. Points lie in the order of the leaves, so those below a page are a range (held) of
    the points; numbers says which they were.
    """

    def __init__(self, points: np.ndarray, page: int, seed: int):
        self.points, self.page = points, page
        self.rng = np.random.RandomState(seed)
        self.centers: list[np.ndarray] = []
        self.radius: list[float] = []
        self.leaf: list[bool] = []
        self.spans: list[tuple[int, int]] = []
        self.entries: list[np.ndarray] = []
        self.to_center: list[np.ndarray] = []
        self.written = self.placed = 0
        self.held: list[tuple[int, int]] = []
        self.numbers: list[np.ndarray] = []
        self._load(np.arange(len(points)), points[0])

    def _load(self, members: np.ndarray, center: np.ndarray) -> int:
        number = len(self.centers)
        away = _far(self.points[members], center)
        self.centers.append(center)
        self.radius.append(float(away.max()))
        leaf = len(members) <= self.page or away.max() == away.min() == 0
        self.leaf.append(leaf)
        self.spans.append((0, 0))
        self.held.append((0, 0))
        begin = self.placed
        if leaf:
            self.numbers.append(members)
            self.placed += len(members)
            members = np.arange(begin, self.placed)
        else:
            parts, seeds = self._deal(members)
            members = np.array([self._load(m, s) for m, s in zip(parts, seeds, strict=True) if len(m)])
            away = _far(np.stack([self.centers[m] for m in members]), center)
        self.held[number] = (begin, self.placed)
        self.spans[number] = (self.written, self.written + len(members))
        self.written += len(members)
        self.entries.append(members)
        self.to_center.append(away)
        return number

    def _deal(self, members: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        fan = min(self.page, max(2, 2 * len(members) // self.page))
        seeds = self.points[self.rng.choice(members, fan, replace=False)]
        own = self.points[members]
        nearest = ((own * own).sum(1)[:, None] - 2 * own @ seeds.T + (seeds * seeds).sum(1)).argmin(axis=1)
        parts = [members[nearest == i] for i in range(fan)]
        if max(map(len, parts)) == len(members):  # copies and ties: halve
            return [members[::2], members[1::2]], np.stack([self.points[members[0]], self.points[members[1]]])
        return parts, seeds

    def arrays(self) -> dict[str, np.ndarray]:
        numbers = np.concatenate(self.numbers)
        return {
            "points": self.points[numbers], "numbers": numbers, "held": np.array(self.held), "centers": np.stack(self.centers), "radius": np.array(self.radius), "leaf": np.array(self.leaf),
            "spans": np.array(self.spans), "entries": np.concatenate(self.entries), "to_center": np.concatenate(self.to_center),
        }


class Best:
    """The best k of one query so far, by exact inner product, smaller numbers first among ties."""

    def __init__(self, values: np.ndarray, known: np.ndarray, query: np.ndarray, own: int, k: int, constant: float, scale: float, least: float):
        self.values, self.known, self.query, self.own, self.k, self.constant, self.scale = values, known, query, own, k, constant, scale
        self.least = [least / scale / scale] if least > -LONG else []  # a score that others have reached already
        self.numbers = np.empty(0, np.int64)
        self.scores = np.empty(0, values.dtype)
        self.scored = 0

    def limit(self) -> float:
        """No point farther than this can still enter."""
        known = self.least
        if len(self.scores) == self.k:
            worst = self.scores[-1]
            known = [*known, worst / int(self.scale) ** 2 if isinstance(worst, int) else float(worst) / self.scale / self.scale]
        if not known:
            return float("inf")
        square = max(0.0, self.constant - 2 * max(known))
        return float(np.sqrt(square + MARGIN * self.constant)) * (1 + MARGIN)

    def offer(self, at: np.ndarray | slice) -> None:
        """at: places of points, or a range of them."""
        scores = self.values[at] @ self.query
        numbers = self.known[at]
        self.scored += len(numbers)
        if len(self.scores) == self.k:
            better = scores >= self.scores[-1]
            if not better.any():
                return
            numbers, scores = numbers[better], scores[better]
        if self.own in numbers:
            others = numbers != self.own
            numbers, scores = numbers[others], scores[others]
        if not len(numbers):
            return
        self.numbers = np.concatenate([self.numbers, numbers])
        self.scores = np.concatenate([self.scores, scores])
        best = np.lexsort((self.numbers, -self.scores))[: self.k]
        self.numbers, self.scores = self.numbers[best], self.scores[best]


class MTree:
    """The index of a block. Points are integer vectors divided by ``scale`` (a power of two), with a last component that makes all as long as the root of ``top``."""

    nearest_first = False
    score_type = "long"

    def __init__(self, page: int, seed: int, scale: float, top: float):
        self.page, self.seed, self.scale, self.top = page, seed, scale, top

    def build(self, points: np.ndarray, k: int) -> dict[str, np.ndarray]:
        return PageWriter(points, self.page, self.seed).arrays()

    def as_queries(self, points: np.ndarray) -> np.ndarray:
        return np.c_[points[:, :-1], np.zeros(len(points))]

    def _constant(self, queries: np.ndarray) -> np.ndarray:
        return (queries * queries).sum(axis=1) + self.top

    def reach(self, queries: np.ndarray, limits: np.ndarray) -> np.ndarray:
        constant = self._constant(queries)
        square = constant - 2 * np.where(limits > -LONG, limits, np.nan) / self.scale / self.scale
        return np.where(np.isnan(square), np.inf, np.sqrt(np.maximum(square, 0) + MARGIN * constant) * (1 + MARGIN))

    def search(self, index: dict[str, np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, numbers, scores, _ = self.search_counted(index, queries, own, k, limits)
        return rows, numbers, scores

    def search_counted(self, index: dict[str, np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """As ``search``, with the number of points that were scored."""
        values, asked = index["points"][:, :-1] * self.scale, queries[:, :-1] * self.scale
        largest = max(float(np.abs(values).max()), float(np.abs(asked).max()), 1.0)
        if largest * largest * values.shape[1] >= 2.0**52:  # sums of integers below that are exact in doubles
            values, asked = (np.array([[int(x) for x in r] for r in m], dtype=object) for m in (values, asked))
        constant = self._constant(queries)
        rows, numbers, scores, scored = [], [], [], 0
        for i in range(len(queries)):
            best = Best(values, index["numbers"], asked[i], int(own[i]), k, float(constant[i]), self.scale, float(limits[i]))
            self._walk(index, queries[i], best)
            rows.append(np.full(len(best.numbers), i))
            numbers.append(best.numbers)
            scores.append(np.array([min(max(int(s), -LONG), LONG - 1) for s in best.scores], dtype=np.int64))
            scored += best.scored
        return np.concatenate(rows), np.concatenate(numbers), np.concatenate(scores), scored

    @staticmethod
    def _walk(index: dict[str, np.ndarray], query: np.ndarray, best: Best) -> None:
        """Visit pages by their lower bound until none can hold a better entry; ``best`` collects the points.

        The best pages are taken several at a time, one at first and then up to ``MOST_PAGES``, and their entries looked at together. Where
        the bounds leave nearly all leaves of a page, its points are scored as one range.
        """
        centers, radius, leaf, spans, held, entries, to_center = (index[x] for x in ("centers", "radius", "leaf", "spans", "held", "entries", "to_center"))
        start = float(np.sqrt(((query - centers[0]) ** 2).sum()))
        heap: list[tuple[float, int, float]] = [(max(0.0, start - radius[0]), 0, start)]
        many = 1

        def inside(pages: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
            """Entries, and |d(query, center) - d(entry, center)|, which bounds an entry's distance from below."""
            at = [slice(*spans[p]) for p, _ in pages]
            away = np.repeat([d for _, d in pages], [x.stop - x.start for x in at])
            return np.concatenate([entries[x] for x in at]), np.abs(away - np.concatenate([to_center[x] for x in at]))

        while heap:
            limit = best.limit()
            taken: list[list[tuple[int, float]]] = [[], []]
            while heap and len(taken[0]) + len(taken[1]) < many and heap[0][0] <= limit:
                _, page, away = heapq.heappop(heap)
                taken[int(leaf[page])].append((page, away))
            if not taken[0] and not taken[1]:
                return
            many = min(MOST_PAGES, 2 * many)
            if taken[1]:
                members, spread = inside(taken[1])
                members = members[spread <= limit]
                if len(members):
                    best.offer(members)
                    limit = best.limit()
            for page, away in taken[0]:
                begin, end = spans[page]
                pages = entries[begin:end]
                near = np.abs(away - to_center[begin:end]) - radius[pages] <= limit
                pages = pages[near]
                far = _far(centers[pages], query)
                least = np.maximum(far - radius[pages], 0.0)
                kept = least <= limit
                if limit < np.inf and kept.sum() >= NEARLY_ALL * (end - begin) and leaf[pages].all():
                    best.offer(slice(*held[page]))
                    limit = best.limit()
                    continue
                for item in zip(least[kept].tolist(), pages[kept].tolist(), far[kept].tolist(), strict=True):
                    heapq.heappush(heap, item)


def top_inner_products(
    df: DataFrame, is_query: Column, k: int = 5, steps: float = 256.0, page: int = 32, block_rows: int = 8192, query_rows: int = 4096, seed: int = 3
) -> DataFrame:
    """The k largest inner products of each query's and the other vectors' integer components.

    Components x become floor(steps * x), x as double. Returns (query_id, rank, vec_id, score), ties
    by smaller vec_id; exact. ``df`` needs vec_id and embedding. Vectors that are null, empty or hold
    null or non-finite components take no part. Rows that repeat an id are rows of their own: such a
    query has its answers once for each of its rows, and the other rows of its id are candidates. Queries
    meet only vectors of their own dimension. Sums beyond 64 bits are ranked by their exact value and given as the nearest
    long, so among equal outputs of that kind the larger exact sum comes first, whatever its vec_id.
    """
    whole = F.transform("v", lambda x: _floor(F.lit(steps) * x))
    vectors = with_query_flag(clean_vectors(df, True), is_query).withColumn("w", whole)
    largest = vectors.agg(F.max(F.array_max(F.transform("w", F.abs))).alias("x")).first()["x"]
    scale = power_above(largest)
    vectors = vectors.withColumn("w", F.transform("w", lambda x: x / F.lit(scale))).withColumn("square", F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    top = vectors.agg(F.max("square").alias("x")).first()["x"] or 0.0
    point = F.concat("w", F.array(F.sqrt(F.greatest(F.lit(0.0), F.lit(top) - F.col("square")))))
    return search_blocks(vectors.select("vec_id", point.alias("p"), "dim", "is_query"), k, MTree(page, seed, scale, top), block_rows, query_rows, seed=seed)
