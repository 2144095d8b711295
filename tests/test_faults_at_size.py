"""Faults near many points: places and segments with the same ends meet once, pairs are not sorted, points of one id are one row."""

import numpy as np
from arcwright.operators import faults as A
from pyspark.sql import functions as F

SEGMENTS = "fault_id long, segment_no int, name string, slip_type string, lon1 double, lat1 double, lon2 double, lat2 double"


def plane(lon, lat, lon0, lat0):
    p0, p, dl = np.radians(lat0), np.radians(lat), np.radians(lon - lon0)
    cosc = max(-1.0, min(1.0, np.sin(p0) * np.sin(p) + np.cos(p0) * np.cos(p) * np.cos(dl)))
    c = np.arccos(cosc)
    k = 6371.0088 * (1.0 if np.sin(c) < 1e-12 else c / np.sin(c))
    return k * np.cos(p) * np.sin(dl), k * (np.cos(p0) * np.sin(p) - np.sin(p0) * np.cos(p) * np.cos(dl))


def measured(p, s):
    """(step, km, length within the radius) of a point and a segment."""
    lon, lat, r = p[1:]
    lon1, lat1, lon2, lat2 = s[4:]
    step = next((d for d in A.LADDER if min(lon1, lon2) <= lon + d and max(lon1, lon2) >= lon - d and min(lat1, lat2) <= lat + d and max(lat1, lat2) >= lat - d), None)
    (x1, y1), (x2, y2) = plane(lon1, lat1, lon, lat), plane(lon2, lat2, lon, lat)
    t = np.linspace(0, 1, 200_001)
    away = np.hypot(x1 + t * (x2 - x1), y1 + t * (y2 - y1))
    return step, away.min(), (away <= r).mean() * np.hypot(x2 - x1, y2 - y1)


def test_points_of_one_id_and_segments_with_the_same_ends(spark):
    rng = np.random.RandomState(5)
    at = [(0.0, 0.0), (0.3, 0.2), (6.0, 1.0), (100.0, -80.0), (-179.0, 60.0)]
    points = [(f"k{i % 12}", *at[rng.randint(5)], float(rng.choice([20.0, 120.0]))) for i in range(30)]
    ends = [(0.0, 0.5, 0.5, 0.75), (0.5, 0.75, 1.0, 1.0), (9.5, 1.0, 9.0, 1.5), (99.0, -80.1, 101.0, -80.0), (-178.0, 60.0, -178.5, 60.25)]
    segments = [(40 - i, i % 3, f"f{i}", "Normal" if i % 2 else None, *ends[i % 5]) for i in range(22)]
    got = {r["candidate_id"]: r for r in A.fault_metrics(spark.createDataFrame(points, "candidate_id string, lon double, lat double, radius_km double"), spark.createDataFrame(segments, SEGMENTS)).collect()}
    assert sorted(got) == sorted({p[0] for p in points})
    for key, r in got.items():
        met = [(*measured(p, s), s) for p in points if p[0] == key for s in segments]
        best = min(m[0] for m in met if m[0] is not None)
        own = [m for m in met if m[0] == best]
        least = min(m[1] for m in own)
        _, _, name, slip = min(m[3][:4] for m in own if m[1] <= least + 1e-6)
        assert (r["fault_search_degrees"], r["nearest_active_fault_name"], r["nearest_active_fault_slip_type"]) == (best, name, slip)
        assert abs(r["nearest_active_fault_km"] - least) < 1e-3 and abs(r["fault_length_within_radius_km"] - sum(m[2] for m in own)) < 0.05


def test_copies_of_places_and_segments_meet_once(spark, monkeypatch):
    points = spark.range(300).selectExpr("id AS candidate_id", "cast(id % 3 AS double) AS lon", "0.0D AS lat", "50.0D AS radius_km")
    segments = spark.range(300).selectExpr("1000 - id AS fault_id", "0 AS segment_no", "concat('f', id) AS name", "'Normal' AS slip_type", "id % 2 / 2D AS lon1", "0.5D AS lat1", "id % 2 / 2D AS lon2", "0.75D AS lat2")
    met, pairs = A._met, []

    def counted(*args):
        out = met(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(A, "_met", counted)
    out = A.fault_metrics(points, segments)
    assert pairs == [6, 6] and out.count() == 300
    plan = met(points.withColumn("_place", F.lit(1)), segments, 2, 2.0).groupBy("candidate_id").agg(F.min("at"), F.sum("inside"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    near = {r["nearest_active_fault_name"] for r in out.where("candidate_id % 3 = 0").collect()}
    assert near == {"f298"}  # of the even ones the smallest fault_id
