"""A stated set of query vectors against all vectors, placed once by routing vectors.

A few routing vectors, drawn from the table, cut space into cells; each vector lies in
the cell of its nearest one, and a cell of many vectors is dealt into blocks of a
bounded size. Each block's index is built once and kept. A query first searches its own
block, which gives a bound; then the blocks of all cells that the bound and the
triangle inequality (distance to the routing vector less the cell's radius) leave.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bound

#: Dimensions of vectors that have routing vectors, the commonest ones; vectors of another one share a cell.
ROUTED_DIMENSIONS = 16
#: Numbers that a block's vectors hold at most, whatever their dimension.
BLOCK_NUMBERS = 4_000_000


class BlockIndex(Protocol):
    """An index of one block of points (rows in order of their ids)."""

    nearest_first: bool
    score_type: str

    def build(self, points: np.ndarray, k: int) -> dict[str, np.ndarray]: ...

    def as_queries(self, points: np.ndarray) -> np.ndarray:
        """Where a query with these points stands in the space of the points."""

    def reach(self, queries: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The distance beyond which no point can have a score as good as the limit (NaN: none yet)."""

    def search(self, index: dict[str, np.ndarray], queries: np.ndarray, own: np.ndarray, k: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, point number, score) of up to k points as good as the limit or better; own: each query's own point, or -1."""


def clean_vectors(df: DataFrame, allow_zero: bool) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part.

    Null ids, null or empty vectors, vectors that hold null or non-finite components and
    (unless ``allow_zero``) vectors of zeros don't. Rows that repeat an id are rows of their own.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    if not allow_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def power_above(x: float | None) -> float:
    """The smallest power of two that isn't below x (the largest there is, beyond it)."""
    return 2.0 ** min(1023, math.ceil(math.log2(x))) if x else 1.0


def _dump(index: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **index)
    return out.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {name: z[name] for name in z.files}


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all x to all y; where they overflow, infinity."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)
    return np.sqrt(np.maximum(np.nan_to_num(square, nan=np.inf), 0))


def _centers(rows: DataFrame, block_rows: int, most_cells: int, seed: int) -> dict[int, np.ndarray]:
    """Routing vectors of the commonest dimensions: as many as they have blocks, ``most_cells`` at most."""
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(ROUTED_DIMENSIONS).collect()}
    wanted = {d: min(most_cells, max(1, n // block_rows)) for d, n in sizes.items()}
    low = F.lit(False)
    place = F.xxhash64("row", F.lit(seed))
    for d, n in sizes.items():
        low = low | ((F.col("dim") == d) & (place <= hash_bound(wanted[d], n)))
    first = Window.partitionBy("dim").orderBy("place")  # some twice the wanted rows
    some = rows.select("dim", "p", place.alias("place")).where(low).withColumn("nth", F.row_number().over(first))
    many = F.lit(0)
    for d, c in wanted.items():
        many = F.when(F.col("dim") == d, c).otherwise(many)
    got: dict[int, list] = {}
    for r in some.where(F.col("nth") <= many).orderBy("dim", "nth").select("dim", "p").collect():
        got.setdefault(r["dim"], []).append(r["p"])
    return {d: np.array(ps, dtype=float) for d, ps in got.items()}


def search_blocks(vectors: DataFrame, k: int, index: BlockIndex, block_rows: int, query_rows: int, most_cells: int = 256, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of each query row among all other rows of its dimension.

    vectors: vec_id, p (array of doubles), dim, is_query. Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select("vec_id", "p", "dim", "is_query", F.monotonically_increasing_id().alias("row")))
    centers = _centers(rows, block_rows, most_cells, seed)
    shared = spark.sparkContext.broadcast(centers)  # most_cells vectors of each routed dimension

    @F.pandas_udf("cell int, away double")
    def route(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, dim in batches:
            cell, away = np.zeros(len(p), np.int32), np.full(len(p), np.inf)
            for d in dim.unique():
                if int(d) in shared.value:
                    at = np.flatnonzero(dim == d)
                    far = _between(np.stack(p.iloc[at].to_numpy()), shared.value[int(d)])
                    cell[at] = far.argmin(axis=1)
                    away[at] = far.min(axis=1)
            yield pd.DataFrame({"cell": cell, "away": away})

    routed = rows.withColumn("to", route("p", "dim")).select("vec_id", "p", "dim", "is_query", "row", "to.cell", "to.away")
    routed = cut(routed)
    size = F.greatest(F.lit(256), F.least(F.lit(block_rows), F.lit(BLOCK_NUMBERS) / F.first("dim")))
    cells = cut(routed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")))
    placed = routed.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    keys = ["dim", "cell", "part"]
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["vec_id", "row"])
        made = index.build(np.stack(own["p"].to_numpy()), k)
        first = own.iloc[0]
        return pd.DataFrame({"dim": [first["dim"]], "cell": [first["cell"]], "part": [first["part"]], "vec_ids": [own["vec_id"].to_numpy()], "rows": [own["row"].to_numpy()], "made": [_dump(made)]})

    blocks = cut(placed.select(*keys, "vec_id", "row", "p").groupBy(*keys).applyInPandas(build, f"dim int, cell int, part int, vec_ids array<{id_type}>, rows array<long>, made binary"))
    queries = cut(placed.where("is_query").select(*keys, F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "p"))
    turns = max(1, -(-queries.count() // query_rows))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []})
        vec_ids, numbers = np.asarray(own["vec_ids"].iloc[0]), np.asarray(own["rows"].iloc[0])
        order = np.argsort(numbers)
        mine = order[np.minimum(np.searchsorted(numbers[order], asked["query_row"]), len(numbers) - 1)]
        mine = np.where(numbers[mine] == asked["query_row"], mine, -1)
        made = _load(own["made"].iloc[0])
        a, b, score = index.search(made, index.as_queries(np.stack(asked["p"].to_numpy())), mine, k, asked["limit"].to_numpy(float))
        return pd.DataFrame({"query_row": asked["query_row"].to_numpy()[a], "query_id": asked["query_id"].to_numpy()[a], "vec_id": vec_ids[b], "row": numbers[b], "score": score})

    def found(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_row", F.lit(1)), F.lit(turns)).cast("int"))
        met = blocks.join(asked.select(*keys, F.col("turn").alias("lot")).distinct(), keys)
        out = f"query_row long, query_id {id_type}, vec_id {id_type}, row long, score {index.score_type}"
        return met.groupBy(*keys, "lot").cogroup(asked.groupBy(*keys, "turn")).applyInPandas(search, out)

    home = cut(found(queries.withColumn("limit", F.lit(float("nan")))))
    best = F.sort_array(F.collect_list("score"), asc=index.nearest_first)  # k at most
    limits = home.groupBy("query_row").agg(F.get(best, F.lit(k - 1)).cast("double").alias("limit"))
    radii = {}
    for r in cells.where(F.col("dim").isin(list(centers))).collect():  # most_cells of each routed dimension
        radii.setdefault(r["dim"], {})[r["cell"]] = r["radius"]
    bounds = spark.sparkContext.broadcast(radii)

    @F.pandas_udf("array<int>")
    def left_cells(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, dim, limit in batches:
            out: list[list[int]] = [[0]] * len(p)
            for d in dim.unique():
                if int(d) in shared.value:
                    at = np.flatnonzero(dim == d)
                    asked = index.as_queries(np.stack(p.iloc[at].to_numpy()))
                    number = np.array(sorted(bounds.value[int(d)]))
                    radius = np.array([bounds.value[int(d)][c] for c in number])
                    reach = index.reach(asked, limit.to_numpy(float)[at])
                    near = _between(asked, shared.value[int(d)][number]) - radius <= reach[:, None]
                    for i, row in zip(at, near, strict=True):
                        out[i] = number[row].tolist()
            yield pd.Series(out)

    again = queries.withColumnsRenamed({"cell": "home_cell", "part": "home_part"}).join(limits, "query_row", "left")
    again = again.withColumn("limit", F.coalesce("limit", F.lit(float("nan"))))
    again = again.withColumn("cell", F.explode(left_cells("p", "dim", "limit"))).join(cells.select("dim", "cell", "parts"), ["dim", "cell"])
    again = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("cell <> home_cell OR part <> home_part")
    rest = found(again.select(*keys, "query_row", "query_id", "p", "limit"))
    order = Window.partitionBy("query_row").orderBy(F.col("score").asc() if index.nearest_first else F.col("score").desc(), "vec_id", "row")
    ranked = home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def with_query_flag(vectors: DataFrame, is_query: Column) -> DataFrame:
    return vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
