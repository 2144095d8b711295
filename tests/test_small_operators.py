"""Readers, writers and small rules that no query reaches, each on hand-made rows."""

import datetime as D
import hashlib
import json

import pytest
from arcwright.functions import geo as G
from arcwright.functions import scoring as S
from arcwright.operators import jobs as J
from arcwright.operators import relational as L
from arcwright.operators import ring as R
from arcwright.sources import files as I
from arcwright.sources import sinks as K
from pyspark.sql import functions as F


def test_csv_readers(spark, tmp_path):
    (tmp_path / "large.csv").write_text("ID,Name,Km,Lon\n1,a,500,10\n2,b,x,20\n3,c,900,\n4,d,100,30\n")
    rows = I.read_large_catalogue(spark, str(tmp_path / "large.csv"), {"ID": "crater_id", "Name": "object", "Km": "diameter_km", "Lon": "lon"}, "Km", 200).collect()
    assert [(r["object"], r["diameter_km"], r["lon"]) for r in rows] == [("c", 900.0, None), ("a", 500.0, 10.0)]
    (tmp_path / "bare.csv").write_text(" Hellas , 2300 ,\n ,x,7\n")
    rows = I.read_positional_csv(spark, str(tmp_path / "bare.csv"), ["name", "km", "age"], ("km", "age")).collect()
    assert [tuple(r) for r in rows] == [("Hellas", 2300.0, None), (None, None, 7.0)]
    (tmp_path / "m.csv").write_text("candidate_id,score,note\n1,0.5,\n2,NaN,x\n")
    rows = I.read_metrics_csv(spark, str(tmp_path / "m.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", 0.5, None), ("2", None, "x")]


def test_fingerprints(spark, tmp_path):
    content = b"abc" * 1000
    (tmp_path / "f.bin").write_bytes(content)
    whole, head = (I.source_fingerprints(spark, str(tmp_path / "f.bin"), n).first() for n in (None, 10))
    assert (whole["bytes"], whole["sha256"]) == (3000, hashlib.sha256(content).hexdigest()) and head["sha256"] == hashlib.sha256(content[:10]).hexdigest()


def test_packets_and_requests(spark):
    rows = [("a", 0.9, 0.5, None, "ocean", "caldera", 10.0, 0.0, 100.0), ("b", None, 0.1, 0.2, "land", None, 20.0, 5.0, 5000.0), ("c", 0.95, None, None, None, None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "candidate_id string, followup_score double, gravity_bouguer_ring_score double, magnetic_ring_score double, domain string, near string, lon double, lat double, radius_km double")
    packets = {r["candidate_id"]: json.loads(r["packet"]) for r in K.review_packets(df, 2, "near").collect()}
    assert set(packets) == {"c", "a"}
    assert packets["a"]["alternatives"][0] == "control analogue: caldera" and [e["key"] for e in packets["a"]["evidence"]] == ["followup_score", "gravity_bouguer_ring_score"]
    assert len(packets["c"]["alternatives"]) == 5 and packets["c"]["falsification_tests"] == list(K.REFUTING_TESTS)
    boxes = {r["candidate_id"]: r for r in K.imagery_requests(df, "2024-01-01", "2024-02-01", 10).collect()}
    assert boxes["b"]["west"] == 5.0 and boxes["b"]["north"] == 20.0 and json.loads(boxes["a"]["request"])["query"]["eo:cloud_cover"]["lt"] == 10
    manifest = {r["output"]: r["rows"] for r in K.source_manifest({"x": df, "y": df.where("lat > 0")}).collect()}
    assert manifest == {"x": 3, "y": 1}


def test_filters_and_searches(spark):
    df = spark.createDataFrame([("a", "open", "Big Ring"), ("b", "shut", "small"), ("c", None, None)], "id string, status string, title string")
    ids = lambda d: {r["id"] for r in d.collect()}
    assert ids(L.id_filter(df, "id", " a, ,c")) == {"a", "c"} and ids(L.id_filter(df, "id", " , ")) == {"a", "b", "c"} and ids(L.id_filter(df, "id", None)) == {"a", "b", "c"}
    assert ids(L.status_filter(df, "status", "open", ("open", "shut"))) == {"a"} and ids(L.status_filter(df, "status", "odd", ("open", "shut"))) == {"a", "b", "c"}
    assert ids(L.record_search(df, "bIG r")) == {"a"} and ids(L.record_search(df, '"status":"shut"')) == {"b"}
    sizes = {(r["status"], r["n"]) for r in L.group_sizes(df, "status").collect()}
    assert sizes == {("open", 1), ("shut", 1), (None, 1)}
    mixed = spark.createDataFrame([(" ", "t1", float("nan"), 2.0), (None, None, 3.0, 4.0)], "name string, title string, d double, diameter_km double")
    got = [tuple(r) for r in L.first_of_aliases(mixed, {"shown": ["missing", "name", "title"], "km": ["d", "diameter_km"], "none": ["nowhere"]}).select("shown", "km", "none").collect()]
    assert got == [("t1", 2.0, None), (None, 3.0, None)]


def test_queue_pages(spark):
    at = lambda i: D.datetime(2026, 1, 1, 0, i)
    rows = [(1, "queued", 5, at(1), None), (2, "queued", 9, at(3), None), (3, "claimed", 9, at(2), at(5)), (4, "running", 9, at(0), at(50)), (5, "failed", 9, at(0), None), (6, "queued", 5, at(0), None)]
    jobs = spark.createDataFrame(rows, "job_id long, status string, priority int, created_at timestamp, lease_expires_at timestamp")
    now = F.lit(at(30))
    assert [r["job_id"] for r in J.queue_page(jobs, 100, now).collect()] == [3, 2, 6, 1]
    assert [r["job_id"] for r in J.queue_page(jobs, 0, now).collect()] == [3] and J.queue_page(jobs, 10**6, now).count() == 4
    assert {r["job_id"] for r in J.claimable(jobs, F.lit(at(4))).collect()} == {1, 2, 6}


def test_sizes_and_versions(spark):
    df = spark.createDataFrame([(2.0, None), (None, 9.0), (None, None), (1.0, 5.0)], "r double, d double")
    r, d = G.fill_size("r", "d")
    assert [tuple(x) for x in df.select(r, d).collect()] == [(2.0, 4.0), (4.5, 9.0), (None, None), (1.0, 5.0)]
    one = spark.range(1).select(S.valid_position(F.lit(181.0), F.lit(0.0)).alias("a"), S.valid_position(F.lit(None), F.lit(0.0)).alias("b"), S.non_negative(F.lit(float("nan"))).alias("c"), S.positive(F.lit(0.0)).alias("d")).first()
    assert tuple(one) == (False, False, False, False)


def test_grid_cells_are_written_by_tile(spark, tmp_path):
    grid = spark.range(12 * 24).select((F.col("id") / 24).cast("int").alias("iy"), (F.col("id") % 24).cast("int").alias("ix")).select("iy", "ix", (F.col("iy") * 15 - 82.5).alias("lat"), (F.col("ix") * 15 + 7.5).alias("lon"), F.col("ix").cast("double").alias("value"))
    K.write_grid_cells(grid, str(tmp_path / "grid"), 30)
    back = spark.read.parquet(str(tmp_path / "grid"))
    assert back.count() == 288 and back.select("ty", "tx").distinct().count() == 72
    for broken in (grid.where("iy <> 3 OR ix <> 3"), grid.withColumn("lat", -F.col("lat")), grid.unionByName(grid.limit(1))):
        with pytest.raises(ValueError):
            K.write_grid_cells(broken, str(tmp_path / "bad"))


def test_diagnostic_cells_of_the_best(spark):
    rows = [(k, y, x, (x - 4) / 3, (y - 4) / 3, ((x - 4) ** 2 + (y - 4) ** 2) ** 0.5 / 3, float(x * y), 50.0, 0.0, 0.1, 0.1) for k in ("a", "b") for y in range(9) for x in range(9)]
    cells = spark.createDataFrame(rows, "candidate_id string, iy int, ix int, x double, y double, rho double, value double, radius_km double, lat0 double, step_lon double, step_lat double")
    out = R.diagnostic_cells(cells, spark.createDataFrame([("a", 2), ("b", 1)], "candidate_id string, rank int"), 1)
    assert out.columns == ["candidate_id", "iy", "ix", "residual", "rho", "radial"] and {r["candidate_id"] for r in out.collect()} == {"b"} and out.count() == 81
