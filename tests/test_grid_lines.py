"""Grids by lines: no query makes all cells of a large grid, windows have every cell."""

import duckdb
import numpy as np
import pytest
from arcwright import plans
from arcwright.operators import ring as R
from pyspark.sql import functions as F

from .test_queries import DATA


def tables(path, suppliers, parts):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT s.* REPLACE (3 * i + 5 AS s_suppkey) FROM (FROM '{DATA}/supplier.parquet' LIMIT 1) s, range({suppliers}) n(i)) TO '{path}/supplier.parquet'")
    c.execute(f"COPY (FROM '{DATA}/part.parquet' LIMIT {parts}) TO '{path}/part.parquet'")
    return str(path)


def test_nearest_cell_of_800_million(spark, tmp_path):
    n, path = 20_000, tables(tmp_path, 20_000, 50)
    got = {r["candidate_id"]: r["value"] for r in plans.QUERIES["nearest_cell"](spark, path).collect()}
    for (key,) in duckdb.connect().execute(f"SELECT p_partkey FROM '{path}/part.parquet'").fetchall():
        lon, lat = key * 7919 % 36000 / 100 - 180, key * 104729 % 17000 / 100 - 85
        iy, ix = int((lat + 90) / (180 / n)), int((lon + 180) / (180 / n))
        assert got[f"arc_{key:06d}"] == ((3 * iy + 5) * 31 + ix * 7) % 1000 / 10
    assert len(got) == 50


@pytest.mark.parametrize("rows", [1, 2, 7, 36, 250])
def test_window_sums_are_those_of_the_cells(rows, spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 700)
    rng = np.random.RandomState(3)
    places = [(0.0, 89.0, 300.0), (-177.5, -88.0, 400.0), (179.99, 0.0, 500.0), (-180.0, 10.0, 90.0), (2.5, 84.0, 500.0), (0.0, 0.0, 5.0), (33.0, -84.99, 50.0), (-2.5, 87.5, 800.0), (1.0, None, 9.0)]
    places += [(float(rng.uniform(-180, 180)), float(rng.uniform(-85, 85)), float(rng.choice([5.0, 250.0, 3000.0]))) for _ in range(40)]
    c = spark.createDataFrame([(f"k{i % 45}", *p) for i, p in enumerate(places)], "candidate_id string, lon double, lat double, radius_km double")
    lines = spark.range(rows).select(F.col("id").alias("iy"), (F.col("id") * 13 % 17).alias("w"))
    got = {r[0]: r[1:] for r in R.window_sums(c, lines, lambda line, ix: line["w"] * 31 + ix % 11, rows).collect()}
    step = 180 / rows
    ids = F.explode(F.sequence(F.lit(0), F.lit(2 * rows - 1))).alias("ix")
    grid = lines.select("*", ids).select("iy", "ix", ((F.col("iy") + 0.5) * step - 90).alias("lat"), ((F.col("ix") + 0.5) * step - 180).alias("lon"), (F.col("w") * 31 + F.col("ix") % 11).alias("value"))
    cells = R.grid_window_join(c.where("lat IS NOT NULL"), grid, max_pixels=2 * rows + 2)
    want = {r[0]: r[1:] for r in cells.groupBy("candidate_id").agg(F.count(F.lit(1)), F.sum("value")).collect()}
    assert got == want


def test_windows_of_a_large_grid_are_read_by_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "grid_window_join", None)  # which meets the cells of windows one by one
    n, path = 3000, tables(tmp_path, 3000, 12)
    got = {r["candidate_id"]: r for r in plans.QUERIES["grid_window_cells"](spark, path).collect()}
    t = np.arange(2 * n)
    lon, lat = (t + 0.5) * (180 / n) - 180, (t[:n] + 0.5) * (180 / n) - 90
    for (key,) in duckdb.connect().execute(f"SELECT p_partkey FROM '{path}/part.parquet'").fetchall():
        lon0, lat0, a = key * 7919 % 36000 / 100 - 180, key * 104729 % 17000 / 100 - 85, 1.75 * (5 + key * 31 % 1000 / 2) / 6371.0088
        o = 180 if abs(lat0) + np.degrees(a) >= 89.9 else np.degrees(np.arcsin(min(1, np.sin(a) / np.cos(np.radians(lat0)))))
        y, x = np.flatnonzero(np.abs(lat - lat0) <= np.degrees(a)), np.flatnonzero(np.abs((lon - lon0 + 180) % 360 - 180) <= o)
        r = got[f"arc_{key:06d}"]
        assert r["n_cells"] == len(y) * len(x)
        assert abs(r["mean_value"] - (((3 * y[:, None] + 5) * 31 + x[None, :] * 7) % 1000 / 10).mean()) < 1e-5
