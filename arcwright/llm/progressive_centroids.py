"""Centroid clustering in whole numbers, nearest centroids by Walsh-Hadamard progressive search.

The Walsh-Hadamard transform adds and subtracts, so it is exact on integers, and the
squared distance of two transforms is their length times that of the vectors. A
vector and a centroid are compared coefficient by coefficient, coarse ones first: the
sum so far never exceeds the whole. The centroid that is best after the first
coefficients is finished and gives a limit; each further level adds its coefficients of
the centroids left and eliminates those strictly above the limit. What survives has
all its coefficients, so distances and ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components of a vector, a power of two.
LENGTH = 64
#: Coefficients that are compared after each level.
LEVELS = (2, 8, 16, 32, 64)
#: Below this size of every component all sums of squares stay within 64 bits.
PLAIN = 1 << 20
#: Digits that a long can't hold are given as the nearest long.
MOST = 2**63 - 1
#: A sum of components leaves its task as the digits of its size in this base.
BASE = 1 << 60


def _butterflies(x: np.ndarray) -> np.ndarray:
    n, out = x.shape[1], x
    step = 1
    while step < n:
        pairs = out.reshape(len(x), -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return out


#: Order of the coefficients by the number of sign changes of their pattern: coarse ones first.
SEQUENCY = np.argsort((np.diff(_butterflies(np.eye(LENGTH, dtype=np.int64)), axis=0) != 0).sum(axis=0), kind="stable")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, coefficients from coarse to fine."""
    return _butterflies(x)[:, SEQUENCY]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, coefficient differences taken) of each row; ties go to the smaller number.

    Both are integers; large ones are Python's own, so nothing overflows.
    """
    n, k = len(vectors), len(centroids)
    w, c = hadamard(vectors), hadamard(centroids)
    alive = np.ones((n, k), bool)
    sums = np.zeros((n, k), w.dtype)
    limit = None
    taken, begin = 0, 0
    for end in LEVELS:
        rows, cols = np.nonzero(alive)
        d = w[rows, begin:end] - c[cols, begin:end]
        sums[rows, cols] += (d * d).sum(axis=1)
        taken += d.size
        if limit is None:  # the best so far is finished, which bounds the least distance
            first = sums.argmin(axis=1)
            rest = w[:, end:] - c[first, end:]
            limit = sums[np.arange(n), first] + (rest * rest).sum(axis=1)
            taken += rest.size
        alive &= sums <= limit[:, None]
        begin = end
    rows, cols = np.nonzero(alive)
    least = limit.copy()
    np.minimum.at(least, rows, sums[rows, cols])
    hit = alive & (sums == least[:, None])
    return hit.argmax(axis=1), least // LENGTH, taken


def _numbers(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as 64-bit integers where squares can't overflow, else as Python's."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, LENGTH)
    with np.errstate(over="ignore"):
        x = np.floor(flat * float(scale))
    if not np.isfinite(x).all():  # scaled beyond a double: the exact product
        return np.array([[int(a * scale // 1) if np.isfinite(a * float(scale)) else int(a) * scale for a in row] for row in flat.tolist()], object).reshape(-1, LENGTH)
    if len(x) and np.abs(x).max() >= PLAIN:
        return np.array([[int(a) for a in row] for row in x.tolist()], object).reshape(-1, LENGTH)
    return x.astype(np.int64)


def _same_kind(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    large = x.dtype == object or any(abs(a) >= PLAIN for c in centroids for a in c)
    kind = object if large else np.int64
    return x.astype(kind), np.array(centroids, kind).reshape(-1, LENGTH)


def kept_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vector has exactly 64 components, none null or not finite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == LENGTH) & ~bad)


def _starts(rows: DataFrame, k: int, scale: int) -> list[list[int]]:
    place = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    # a null id has no hash and comes last; rows that repeat an id follow one another by their components
    first = rows.select("vec_id", "v", place.alias("place")).orderBy(F.asc_nulls_last("place"), "v").limit(k).select("v").collect()
    if not first:
        return []
    batch = pa.RecordBatch.from_arrays([pa.array([r["v"] for r in first], pa.list_(pa.float64()))], names=["v"])
    return [[int(a) for a in row] for row in _numbers(batch, scale)]


def _sums(rows: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """(cluster, j, place, digit, n): sums of each component of each cluster's vectors, in digits of ``BASE``; n: vectors."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, c = _same_kind(_numbers(batch, scale), centroids)
            of, _, _ = nearest(x, c)
            for k in np.unique(of):
                own = x[of == k]
                n, sums = total.get(int(k), (0, [0] * LENGTH))
                total[int(k)] = [n + len(own), [a + int(b) for a, b in zip(sums, own.sum(axis=0), strict=True)]]
        rows_out = []
        for k, (n, sums) in total.items():
            for j, s in enumerate(sums):
                size, place = abs(s), 0
                while size or not place:  # a sum of zero has one digit too
                    size, digit = divmod(size, BASE)
                    rows_out.append((k, j, place, digit if s >= 0 else -digit, n))
                    place += 1
        columns = zip(*rows_out, strict=True) if rows_out else ((),) * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "j", "place", "digit", "n"])

    out = rows.select("v").mapInArrow(add, "cluster int, j int, place int, digit long, n long")
    return out.groupBy("cluster", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"), F.sum("n").alias("n"))


def _assigned(rows: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    kind = rows.schema["vec_id"].dataType.simpleString()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of, away, _ = nearest(*_same_kind(_numbers(batch, scale), centroids))
            away = pa.array([min(MOST, int(a)) for a in away], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(of, pa.int32()), away, pa.array([digest[k] for k in of])], names=["vec_id", "cluster", "distance", "centroid_sha256"])

    return rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long, centroid_sha256 string")


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of 64 finite components.

    ``df`` needs vec_id and embedding; other columns and other vectors are left out. Components become floor(scale * x). Centroids start
    as the ``k`` vectors with the smallest SHA-256 of ``1:<vec_id>`` (fewer vectors: fewer centroids; a null id comes last, repeated ids by
    their components). A round gives every vector to the nearest centroid, the smaller number among ties, and replaces each centroid
    that has vectors by the floor of their mean; then vectors are given once more. Sums are exact however large; a distance or an
    inertia beyond a long is given as the largest long. Rows that repeat an id are rows of their own. Each round reads the vectors once and moves
    a row for each task, cluster and component; the driver holds the centroids.
    """
    rows = kept_vectors(df)
    centroids = _starts(rows, k, scale)
    for _ in range(rounds if centroids else 0):
        sums: dict[tuple[int, int], int] = {}
        vectors: dict[int, int] = {}
        for r in _sums(rows, centroids, scale).collect():  # k times 64 rows, of large numbers some more
            at = (r["cluster"], r["j"])
            sums[at] = sums.get(at, 0) + int(r["digit"]) * BASE ** r["place"]
            if r["place"] == 0:  # every vector's sum has a lowest digit
                vectors[r["cluster"]] = r["n"]
        centroids = [[sums[i, j] // vectors[i] for j in range(LENGTH)] if i in vectors else c for i, c in enumerate(centroids)]
    given = cut(_assigned(rows, centroids, scale))
    exact = F.col("distance").cast("decimal(38,0)")
    long = lambda c: F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    own = given.groupBy("cluster").agg(F.sum(exact).alias("sum"))
    every = own.agg(F.sum("sum").alias("all"))
    own = own.crossJoin(F.broadcast(every)).select("cluster", long(F.col("sum")).alias("cluster_inertia"), long(F.col("all")).alias("inertia"))  # k rows with one
    return given.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
