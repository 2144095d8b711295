"""Joins by place and by draws when tables grow: nothing exploded is broadcast, searches start near the rows' spacing."""

import numpy as np
from arcwright.operators import spatial as P
from arcwright.operators import stats as T
from pyspark.sql import functions as F


def test_exploded_rows_are_not_broadcast(spark):
    rows = spark.range(20).select(F.col("id").alias("k"), F.col("id").cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.lit(0.5).alias("v"))
    pairs = P.near_pairs(rows, rows, F.lit(50.0), F.array(P.level_of(F.lit(50.0))))
    draws = rows.select("k", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("null_index"), "v")
    for df in (pairs, T.candidate_p(rows.select("k", "v"), draws, "k", "v")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_nearest_within_matches_brute_force(spark, monkeypatch):
    rng = np.random.RandomState(4)
    make = lambda n, k, wide: [(k + i, float(rng.uniform(-wide, wide)), float(rng.uniform(-wide, wide)), float(rng.choice([8.0, 60.0, 900.0]))) for i in range(n)]
    left, right = make(60, 0, 3), make(200, 1000, 3)
    schema = "{} long, lon double, lat double, diameter_km double"
    a, b = spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b"))
    asked, near = [], P.near_pairs
    monkeypatch.setattr(P, "near_pairs", lambda x, y, reach, levels: asked.append(1) or near(x, y, reach, levels))
    monkeypatch.setattr(P, "_first_reach", lambda n, most: 10.0)
    got = {r["a"]: r["b"] for r in P.nearest_within(a, "a", b, "b").collect()}

    def km(p, q):
        x, y = np.radians([p[1], p[2]]), np.radians([q[1], q[2]])
        return 12742.0176 * np.arcsin(np.sqrt(np.sin((y[1] - x[1]) / 2) ** 2 + np.cos(x[1]) * np.cos(y[1]) * np.sin((y[0] - x[0]) / 2) ** 2))

    for p in left:
        fit = [(km(p, q), q[0]) for q in right if km(p, q) <= max(5.0, 0.25 * min(p[3], q[3]))]
        assert got[p[0]] == (min(fit)[1] if fit else None)
    assert len(asked) > 1


def test_the_first_reach_follows_the_spacing():
    assert [P._first_reach(n, 160.0) for n in (1, 1000, 60_000, 1_200_000, 10**9)] == [160.0, 160.0, 80.0, 20.0, 10.0]


def test_rows_of_one_key_have_one_nearest(spark):
    left = spark.createDataFrame([("a", 0.0, 0.0), ("a", 30.0, 0.0), ("b", 0.0, 60.0)], "a string, lon double, lat double")
    right = spark.createDataFrame([("x", 0.0, 5.0), ("y", 31.0, 0.0)], "b string, lon double, lat double")
    assert sorted((r["a"], r["b"]) for r in P.nearest_neighbour(left, "a", right, "b").collect()) == [("a", "y"), ("b", "x")]


def km_of(p, q):
    (x, a), (y, b) = np.radians(p), np.radians(q)
    return 12742.0176 * np.arcsin(min(1.0, np.sqrt(np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((y - x) / 2) ** 2)))


def crowd(spark):
    """Rows that share places, some of them ids too, with poles and the date line among them."""
    rng = np.random.RandomState(9)
    places = [(179.9, 0.0), (-179.9, 0.1), (10.0, 89.9), (-170.0, 89.8), (0.0, 0.0), (0.2, 0.1), (3.0, -1.0), (4.0, 2.0), (30.0, -88.0)]
    rows = [(f"k{i % 70:02d}", *places[i % 9], float(rng.choice([6.0, 30.0, 31.0, 45.0, 200.0, 900.0]))) for i in range(90)]
    return rows, spark.createDataFrame(rows, "k string, lon double, lat double, radius_km double")


def test_pairs_of_places_list_all_pairs_of_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "UNIT", 3)
    rows, df = crowd(spark)
    pairs = [(p, q, km_of(p[1:3], q[1:3])) for p in rows for q in rows]
    got = sorted((r["a"], r["b"]) for r in P.distance_self_join(df, "k", 500.0).collect())
    assert got == sorted((p[0], q[0]) for p, q, d in pairs if p[0] < q[0] and d <= 500)
    got = sorted((r["a"], r["b"]) for r in P.overlapping_pairs(df, "k").collect())  # rows with one id are no pair
    assert got == sorted((p[0], q[0]) for p, q, d in pairs if p[0] < q[0] and d <= p[3] + q[3])
    for low, high in ((1.2, None), (1.0, 1.5)):
        got = sorted((r["small"], r["large"]) for r in P.centered_pairs(df, "k", 0.25, low, high).collect())
        smaller = lambda p, q: p[3] < q[3] or (p[3] == q[3] and p[0] < q[0])
        assert got == sorted((p[0], q[0]) for p, q, d in pairs if smaller(p, q) and low <= q[3] / p[3] <= (high or 1e9) and d <= 0.25 * p[3])


def test_copies_of_a_place_meet_others_once(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id AS k", "cast(id % 3 AS double) AS lon", "0.0D AS lat", "200.0D AS radius_km")
    met, unit_pairs = [], P._unit_pairs

    def counted(*args):
        out = unit_pairs(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(P, "_unit_pairs", counted)
    n = [P.distance_self_join(rows, "k", 500.0).count(), P.overlapping_pairs(rows, "k").count(), P.centered_pairs(rows, "k", 1.5, 1.0, None).count()]
    assert n == [300 * 299 // 2] * 3 and max(met) <= 9


def test_records_meet_diameters_of_a_name_not_its_rows(spark, monkeypatch):
    from arcwright.operators import wiki as K

    records = spark.range(40).selectExpr("concat('r', id) AS record_id", "'One Name' AS name", "cast(id % 7 AS double) AS lon", "1.0D AS lat", "cast(id % 5 AS double) AS diameter_raw_km")
    rows = [(900 - i // 2, "one name", float(i % 9), 0.5 * (i % 3), [1.0, 3.0, None][i % 3]) for i in range(200)]
    source = spark.createDataFrame(rows, "source_id long, name string, lon double, lat double, diameter_km double")
    sizes, cut = [], K.cut
    monkeypatch.setattr(K, "cut", lambda df: [sizes.append((df.columns, df.count())), cut(df)][1])
    got = {r["record_id"]: (r["source_id"], round(r["distance_km"], 9)) for r in K.match_source(records, source).collect()}
    for r in records.collect():
        gap = lambda s: abs((s[4] if s[4] is not None else float("inf")) - r["diameter_raw_km"])
        want = min((gap(s), s[0], km_of((r["lon"], r["lat"]), s[2:4])) for s in rows)
        assert got[r["record_id"]] == (want[1], round(want[2], 9))
    assert [n for c, n in sizes if "_each" in c] == [3]
