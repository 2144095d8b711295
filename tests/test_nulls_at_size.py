"""Null draws when tables grow: rows are dealt before they are repeated, and the fewer side of a search takes the cubes around."""

from arcwright.operators import spatial as P
from arcwright.operators import stats as T
from pyspark.sql import functions as F


def test_repeated_rows_are_dealt_first(spark):
    one = spark.range(0, 400, 1, 1)
    used = T.replicates(one, 3).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_fewer_side_takes_the_cubes(spark, monkeypatch):
    asked, near = [], P.near_pairs
    monkeypatch.setattr(P, "near_pairs", lambda *a, **k: asked.append(k["spread_asked"]) or near(*a, **k))
    left = spark.range(50).select("id", (F.col("id") * 7.0 - 170).alias("lon"), (F.col("id") * 1.5 - 40).alias("lat"))
    right = left.where("id % 10 = 0").select(F.explode(F.array(F.col("id"), F.col("id") + 1000)).alias("k"), "lon", "lat")
    got = {r["id"]: (r["k"], r["distance_km"]) for r in P.nearest_neighbour(left, "id", right, "k").collect()}
    assert all(asked) and [got[i] for i in (0, 10, 40)] == [(0, 0.0), (10, 0.0), (40, 0.0)] and got[12][0] == 10 and got[18][0] == 20
    asked.clear()
    back = {r["k"]: r["id"] for r in P.nearest_neighbour(right, "k", left, "id").collect()}
    assert not any(asked) and back == {k: k % 1000 for k in back}


def test_samples_are_dealt_whole(spark):
    x, y = spark.range(70).select("id", (F.col("id") % 9 + 1).alias("v")), spark.range(70, 120).select("id", (F.col("id") % 5 + 1.0).alias("v"))
    got = {r["rep"]: r["ks"] for r in T.ks_permutation(x, y, "id", "v", 2, 7, 4, 1).collect()}
    pool = x.withColumn("s", F.lit(0)).unionByName(y.withColumn("s", F.lit(1)).withColumn("v", F.col("v").cast("double")), allowMissingColumns=True)
    for rep in (0, 1):
        rows = sorted(pool.select(T.draw(7, F.lit(rep), "s", "id").alias("d"), "v").collect())
        a, b = [r["v"] for r in rows[:70]], [r["v"] for r in rows[70:]]
        frames = [spark.createDataFrame([(float(v),) for v in s], "v double") for s in (a, b)]
        assert abs(T.ks_scaled(*frames, "v", 4, 1).first()["ks"] - got[rep]) < 1e-9
