"""Operators on small hand-made tables, and properties that must hold whatever the rows."""

import json
import math

import numpy as np
import pytest
from arcwright.functions import geo as G
from arcwright.functions import scoring as S
from arcwright.functions import text as X
from arcwright.operators import cluster as C
from arcwright.operators import jobs as J
from arcwright.operators import ranking as R
from arcwright.operators import relational as L
from arcwright.operators import ring as O
from arcwright.operators import shortlist as H
from arcwright.operators import spatial as P
from arcwright.operators import stats as T
from arcwright.sources import files as I
from arcwright.sources import sinks as K
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_scores(spark):
    n = F.lit(None).cast("double")
    nan = F.lit(float("nan"))
    got = one(
        spark, S.harmonic_available(F.lit(0.5), n, nan), S.harmonic_available(F.lit(0.5), F.lit(1.0)), S.harmonic_available(F.lit(0.0), F.lit(1.0)), S.mean_available(n, nan),
        S.gravity_first_score(F.lit(0.7), F.lit(0.7), F.lit(0.0)) - S.gravity_first_score(F.lit(0.7), F.lit(0.7), F.lit(1.0)), S.at_least(nan, 0.5), S.domain(nan),
    )
    assert got[0] == 0.5 and abs(got[1] - 2 / 3) < 1e-12 and got[2] == 0 and got[3] is None and abs(got[4] - 0.1) < 1e-12 and got[5] is False and got[6] == "mixed"


def test_positions(spark):
    l = F.lit  # noqa: E741
    got = one(
        spark, G.great_circle_km(l(0.0), l(0.0), l(1.0), l(0.0)), G.great_circle_km(l(0.0), l(0.0), l(180.0), l(0.0)), G.wrap_lon(l(-190.0)), G.unwrap_lon(l(-179.0), l(179.0)),
        G.origin_to_segment_km(l(-1.0), l(1.0), l(1.0), l(1.0)), G.length_in_disk_km(l(-5.0), l(0.0), l(5.0), l(0.0), l(2.0)), G.length_in_disk_km(l(-5.0), l(3.0), l(5.0), l(3.0), l(2.0)),
        G.segments_cross(l(-1.0), l(0.0), l(1.0), l(0.0), l(0.0), l(-1.0), l(0.0), l(1.0)),
    )
    assert abs(got[0] - 111.195) < 1e-3 and abs(got[1] - math.pi * G.EARTH_RADIUS_KM) < 1e-6 and got[2] == 170 and got[3] == 181
    assert got[4] == 1 and abs(got[5] - 4) < 1e-12 and got[6] == 0 and got[7] is True
    ring = one(spark, G.circle_vertices(l(10.0), l(85.0), l(200.0), 96))[0]
    assert len(ring) == 97 and (ring[0]["lon"], ring[0]["lat"]) == (ring[-1]["lon"], ring[-1]["lat"])


def test_texts(spark):
    l = F.lit  # noqa: E741
    got = one(
        spark, X.first_number(l("{{sort|0032|32 km}}")), X.first_number(l("about 1,234.5")), X.plain_number(l("12 km")), X.plain_number(l(" 1,200 ")), X.wiki_name(l("[[Gosses Bluff crater|Gosses Bluff]]")),
        X.wiki_name(l("{{flag}} <b>Acraman</b>")), X.name_key(l("Sudbúry-Bässin 2")), X.name_key(l("Ångström ﬁ, Dvořák Š")), X.slug(l("  ")), X.coordinates(l("{{coord|32|1|S|135|27|E}} x {{Coord|5}}")),
        X.key_values(l("a: 1\nb : 2: 3\na: 4")), X.coordinate_list(l("1,2 3,4,5 bad")),
    )
    assert got[0] == 32 and got[1] == 1234.5 and got[2] is None and got[3] == 1200 and got[4] == "Gosses Bluff" and got[5] == "Acraman"
    assert got[6] == "sudburybassin2" and got[7] == "angstromfidvoraks" and got[8] == "unnamed_control"
    assert len(got[9]) == 1 and abs(got[9][0]["lat"] + 32 + 1 / 60) < 1e-9 and abs(got[9][0]["lon"] - 135.45) < 1e-9
    assert got[10] == {"b": "2: 3", "a": "4"} and [(p["lon"], p["lat"]) for p in got[11]] == [(1.0, 2.0), (3.0, 4.0)]


@pytest.mark.parametrize("kind,about,want", [("dome", None, "ring_complex"), (None, "Alkaline-igneous complex", "intrusive_complex"), ("instrusive", "old Ring Complex", "ring_complex"), (None, None, "caldera")])
def test_control_class(spark, kind, about, want):
    t = lambda v: F.lit(v).cast("string")
    assert one(spark, S.control_class(t(kind), t(about), F.lit("caldera")))[0] == want


def test_preservation(spark):
    rows = spark.createDataFrame([("a", "ocean", 50.0, 2.0, None), ("b", "land", 1200.0, None, None), ("c", "land", 10.0, float("nan"), 0.9), ("d", None, None, None, None)], "candidate_id string, domain string, diameter_km double, sediment_thickness_km double, gravity double")
    got = {r["candidate_id"]: r["preservation_state"] for r in H.preservation(rows).collect()}
    assert got == {"a": "buried_sedimentary", "b": "large_scale_regime_uncertain", "c": "fresh_or_shallow", "d": "insufficient_context"}


def test_ranks_match_pandas(spark):
    import pandas as pd

    rng = np.random.RandomState(3)
    pdf = pd.DataFrame({"id": range(500), "g": rng.choice(["x", "y", None], 500), "v": np.round(rng.rand(500), 2)})
    pdf.loc[rng.rand(500) < 0.1, "v"] = np.nan
    want = pdf.groupby("g", dropna=False)["v"].rank(pct=True)
    got = R.percentiles_within(spark.createDataFrame(pdf.where(pdf.notna(), None).astype({"g": object}), "id long, g string, v double"), "id", ["g"], {"v": "p"}).toPandas().set_index("id")["p"].sort_index()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)
    df = spark.createDataFrame(pdf[["id", "v"]])
    assert np.allclose(R.exact_quantiles(df, "v", [0.0, 0.13, 0.5, 1.0]), np.nanquantile(pdf["v"], [0.0, 0.13, 0.5, 1.0]))
    assert R.exact_quantiles(df.where("false"), "v", [0.5]) == []
    n = R.number_rows(df, "v", ["id"], "n").toPandas().set_index("id")["n"].sort_index()
    order = pdf.sort_values(["v", "id"], ascending=[False, True], na_position="last")["id"]
    assert n.to_numpy().tolist() == pd.Series(range(1, 501), index=order).sort_index().tolist()


CANDIDATES = "candidate_id string, source_index long, lon double, lat double, radius_km double, followup_score double, geometry_angular_coverage double"


def placed(spark, rows):
    return spark.createDataFrame([(f"c{i}", i, *r) for i, r in enumerate(rows)], CANDIDATES)


def brute(rows, reach):
    r = np.radians(np.array([[x[0], x[1]] for x in rows], float))
    a = np.sin((r[:, None, 1] - r[None, :, 1]) / 2) ** 2 + np.cos(r[:, None, 1]) * np.cos(r[None, :, 1]) * np.sin((r[:, None, 0] - r[None, :, 0]) / 2) ** 2
    d = 2 * G.EARTH_RADIUS_KM * np.arcsin(np.minimum(1, np.sqrt(a)))
    return d, {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if d[i, j] <= reach(i, j)}


@pytest.mark.parametrize("turn", [0.0, 137.0])
def test_distance_joins_match_brute_force(spark, turn):
    rng = np.random.RandomState(5)
    rows = [(float((x + turn + 180) % 360 - 180), float(y), float(r), 0.5, 1.0) for x, y, r in zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150), 10 ** rng.uniform(0, 3.7, 150))]
    rows += [(180.0, 0.0, 5.0, 0.5, 1.0), (-180.0, 0.0, 5.0, 0.5, 1.0), (0.0, 90.0, 5.0, 0.5, 1.0), (77.0, 90.0, 9.0, 0.5, 1.0), (10.0, -90.0, 4000.0, 0.5, 1.0)]
    df = placed(spark, rows)
    key = lambda r: tuple(sorted((int(r["a"][1:]), int(r["b"][1:]))))
    _, want = brute(rows, lambda i, j: 800.0)
    got = [key(r) for r in P.distance_self_join(df, "candidate_id", 800.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    _, want = brute(rows, lambda i, j: rows[i][2] + rows[j][2])
    got = [key(r) for r in P.overlapping_pairs(df, "candidate_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    _, want = brute(rows, lambda i, j: 0.25 * min(rows[i][2], rows[j][2]) if 1.2 <= max(rows[i][2], rows[j][2]) / min(rows[i][2], rows[j][2]) <= 30 else -1)
    got = [tuple(sorted((int(r["small"][1:]), int(r["large"][1:])))) for r in P.centered_pairs(df, "candidate_id", 0.25, 1.2, 30.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    d, _ = brute(rows, lambda i, j: -1)
    near = {int(r["candidate_id"][1:]): r for r in P.nearest_neighbour(df.where("source_index < 150"), "candidate_id", df.where("source_index >= 150").withColumnRenamed("candidate_id", "k"), "k").collect()}
    for i in range(150):
        assert abs(near[i]["distance_km"] - d[i, 150:].min()) < 1e-6
    none = P.nearest_neighbour(df, "candidate_id", df.where("false").withColumnRenamed("candidate_id", "k"), "k").collect()
    assert len(none) == len(rows) and all(r["k"] is None for r in none)


def test_consolidation_does_not_chain(spark):
    df = placed(spark, [(0.0, 0.0, 100.0, 0.9, 1.0), (0.15, 0.0, 100.0, 0.8, 1.0), (0.30, 0.0, 100.0, 0.7, 1.0)])
    got = C.consolidate(df).collect()
    sizes = {}
    for r in got:
        sizes[r["structure_id"]] = sizes.get(r["structure_id"], 0) + 1
    assert sizes == {"structure_0001": 2, "structure_0002": 1}
    again = C.consolidate(df.orderBy(F.desc("lon")).repartition(3)).collect()
    assert sorted(got) == sorted(again)


def test_consolidation_matches_the_plain_rule(spark):
    rng = np.random.RandomState(8)
    rows = [(float(x), float(y), float(r), float(s), 1.0) for x, y, r, s in zip(rng.uniform(0, 2, 60), rng.uniform(0, 2, 60), rng.uniform(60, 160, 60), np.round(rng.rand(60), 1))]
    d, _ = brute(rows, lambda i, j: -1)
    clusters = []
    for i in sorted(range(60), key=lambda i: (-rows[i][3], f"c{i}")):
        fits = [
            (d[i, c[0]] / min(rows[i][2], rows[c[0]][2]), k)
            for k, c in enumerate(clusters)
            if all(0.67 <= rows[i][2] / rows[m][2] <= 1.5 and d[i, m] <= 0.25 * min(rows[i][2], rows[m][2]) for m in c)
        ]
        if fits:
            clusters[min(fits)[1]].append(i)
        else:
            clusters.append([i])
    want = {frozenset(c) for c in clusters}
    got = {}
    for r in C.consolidate(placed(spark, rows)).collect():
        got.setdefault(r["structure_id"], set()).add(int(r["candidate_id"][1:]))
    assert {frozenset(c) for c in got.values()} == want


def test_ring_families(spark):
    a = placed(spark, [(0.0, 0.0, 10.0, 0.5, 1.0), (0.0, 0.0, 15.0, 0.5, 1.0), (50.0, 0.0, 30.0, 0.5, 1.0)])
    assert sorted(r["candidate_id"] for r in C.ring_families(a).collect()) == ["c0", "c1"]
    b = placed(spark, [(0.0, 0.0, 10.0, 0.5, 1.0), (0.0, 0.0, 10.7, 0.5, 1.0), (0.0, 0.0, 13.9, 0.5, 1.0)])
    assert sorted(r["candidate_id"] for r in C.ring_families(b).collect()) == ["c0", "c2"]


def test_controls(spark):
    c = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 20.0, 0.5, None), ("b", 50.0, 0.0, 10.0, 20.0, 0.5, None)], "candidate_id string, lon double, lat double, radius_km double, diameter_km double, morphology_score_used double, gravity_consensus_used double")
    k = spark.createDataFrame([("k", "caldera", 0.1, 0.0, 10.0, 20.0, None, None)], "negative_control_id string, negative_control_class string, lon double, lat double, radius_km double, diameter_km double, morphology_score_used double, gravity_consensus_used double")
    got = {r["candidate_id"]: r for r in P.match_controls(c, k).collect()}
    assert 11 < got["a"]["nearest_negative_control_distance_km"] < 12 and got["a"]["overlapping_negative_control"]
    assert got["b"]["control_similarity_score"] == 1 and not got["b"]["control_similarity_warning"]


def window(spark, ring: bool):
    n = 161
    axis = np.linspace(-1.75, 1.75, n)
    lon, lat = np.meshgrid(axis, axis)
    rho = np.hypot(lon, lat) * 111.2 / 100
    z = 20 * lon + 10 * lat + (300 * np.exp(-0.5 * ((rho - 1) / 0.055) ** 2) if ring else 0)
    iy, ix = np.mgrid[0:n, 0:n]
    rows = zip(*(a.ravel().tolist() for a in (iy, ix, lon * 1.112, lat * 1.112, rho, z)))
    return [("r" if ring else "p", *r, 100.0, 0.0, 3.5 / (n - 1), 3.5 / (n - 1)) for r in rows]


def test_rings_score_over_planes(spark):
    cells = spark.createDataFrame(window(spark, True) + window(spark, False), "candidate_id string, iy int, ix int, x double, y double, rho double, value double, radius_km double, lat0 double, step_lon double, step_lat double")
    got = {r["candidate_id"]: r for r in O.terrain_score(cells).collect()}
    assert got["r"]["topography_score"] > got["p"]["topography_score"] + 0.15
    assert abs(got["r"]["best_radius_ratio"] - 1) < 0.12 and got["r"]["angular_continuity"] > 0.8
    ring = {r["candidate_id"]: r["ring_score"] for r in O.scalar_ring_score(cells).collect()}
    assert ring["r"] > ring["p"] + 0.1
    classes = cells.where("candidate_id = 'r'").withColumn("tid", F.when(F.col("rho") < 1, 11).otherwise(40))
    t = O.source_type_metrics(classes).first()
    assert t["tid_transition_enrichment"] > 2 and t["tid_artifact_risk"] > 0.4


def test_smoothing_keeps_edges():
    a = np.arange(12.0).reshape(3, 4)
    assert np.allclose(O._smooth(np.full((3, 4), 7.0), 2.0, 0), 7.0)
    wide = np.pad(a, ((0, 0), (40, 40)), mode="edge")
    assert np.allclose(O._smooth(a, 2.0, 1), O._smooth(wide, 2.0, 1)[:, 40:44])


def test_null_p_and_draws(spark):
    reps = spark.createDataFrame([(-1, 5.0), *[(i, float(i)) for i in range(9)]], "rep int, x double")
    assert T.null_summary(reps, "x").first()["p"] == (1 + 4) / 10
    d = [r["d"] for r in spark.range(2000).select(T.draw(1, "id").alias("d")).collect()]
    assert 0 <= min(d) and max(d) < 1 and abs(np.mean(d) - 0.5) < 0.03


def test_features_round_trip(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "x", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4, 5]]}, "properties": {"Name": "A", "n": 3}},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": []}, "properties": {}},
    ]}
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(f))
    rows = I.read_features(spark, str(path))
    assert [(r["feature_id"], r["source_index"]) for r in rows.orderBy("source_index").collect()] == [("x", 0), ("candidate_0001", 1)]
    assert I.explode_vertices(rows).count() == 6
    out = spark.createDataFrame([("a", 1.0, 2.0, float("nan"))], "candidate_id string, lon double, lat double, score double")
    got = json.loads(K.as_features(out).first()["value"])
    assert got["geometry"]["coordinates"] == [1.0, 2.0] and got["properties"] == {"candidate_id": "a", "score": None}
    K.write_sorted_csv(out, str(tmp_path / "csv"))
    back = I.read_metrics_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["candidate_id", "lat", "lon", "score"] and back.first()["score"] is None
    controls = tmp_path / "calderas.geojson"
    controls.write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"Name": "Test Ring", "Type": "dome"}}]}))
    c = I.read_controls(spark, [str(controls), str(controls)]).collect()
    assert [(r["negative_control_id"], r["negative_control_class"]) for r in c] == [("control_test_ring", "ring_complex")]


def test_kml(spark, tmp_path):
    ring = "0,0 1,0 1,1 0,1 0,0"
    path = tmp_path / "p.kml"
    path.write_text(
        f"<kml><Document><Placemark><name>P</name><description>prov_type: Craton&lt;br&gt;age: old</description><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs>"
        f"<innerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark></Document></kml>"
    )
    rows = I.read_kml_provinces(spark, str(path)).collect()
    assert sorted((r["is_hole"], len(r["ring"])) for r in rows) == [(False, 5), (True, 5)] and rows[0]["properties"]["prov_type"] == "Craton"


def test_grid_from_sequence(spark):
    v = spark.range(12).select(F.col("id").alias("n"), (F.col("id") * 2).alias("value"))
    assert I.sequence_to_grid(v, "n", "value", 3, 4).where("iy = 2 AND ix = 1").first()["value"] == 18
    with pytest.raises(ValueError):
        I.sequence_to_grid(v.where("n <> 5"), "n", "value", 3, 4)


def test_fields_and_merges(spark):
    assert L.detect_field(["Follow-Up_Score", "x"], ["morphology_score", "followup_score"]) == "Follow-Up_Score"
    assert L.detect_field(["my_tid_risk_2"], ["tid_risk"]) == "my_tid_risk_2" and L.detect_field(["x"], ["y"]) is None
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    r = L.assert_one_to_one(a, b, "k").first()
    assert (r["left_only"], r["right_only"], r["repeated"], r["ok"]) == (1, 1, 1, False)
    assert one(spark, L.ratios(F.array(*map(F.lit, [400.0, 100.0, 200.0]))))[0] == [2.0, 2.0]


EVENTS = "event_id long, job_id long, event_ts timestamp, event string, worker_id string"


def events():
    import datetime as D

    at = lambda s: D.datetime(2026, 1, 1) + D.timedelta(seconds=s)
    return [
        (1, 1, at(0), "queued", "w0"), (2, 1, at(10), "claimed", "a"), (3, 1, at(20), "claimed", "b"), (4, 1, at(30), "heartbeat", "b"), (5, 1, at(40), "heartbeat", "a"), (6, 1, at(50), "succeeded", "a"), (7, 1, at(60), "heartbeat", "a"),
        (8, 2, at(0), "queued", "w0"), (9, 2, at(10), "claimed", "a"), (10, 2, at(3000), "claimed", "b"), (11, 3, at(5), "queued", "w0"), (12, 3, at(6), "cancelled", "w0"), (13, 3, at(7), "succeeded", "a"),
    ]


def test_job_lifecycle_in_batch_and_stream(spark, tmp_path):
    from arcwright.streaming import jobs as ST

    rows = spark.createDataFrame(events(), EVENTS)
    got = {r["job_id"]: r for r in J.job_states(rows).collect()}
    assert (got[1]["status"], got[1]["attempt_count"], got[1]["rejected"]) == ("succeeded", 1, 3)
    assert (got[2]["status"], got[2]["attempt_count"], got[2]["worker_id"]) == ("claimed", 2, "b")
    assert (got[3]["status"], got[3]["rejected"]) == ("cancelled", 1)
    rows.unionByName(rows.where("event_id % 3 = 0")).repartition(3).write.parquet(str(tmp_path / "in"))  # shuffled, some twice
    out = ST.replay(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), "states").where("cause = 'event'")
    last = {r["job_id"]: r for r in out.collect()}
    for k, r in got.items():
        assert (last[k]["status"], last[k]["attempt_count"], last[k]["rejected"]) == (r["status"], r["attempt_count"], r["rejected"])


def test_intake(spark):
    rows = [("s", "d" * 80, "A good title", "A rim", "a volcanic caldera would", "u", "30 m", ["gravity", "magnetic", "rumour"], True, True, True, 0.0, 0.0, 50.0)]
    schema = "submission_id string, description string, source_title string, observed_feature string, endogenic_alternative string, source_uri string, source_resolution string, independent_evidence array<string>, original_trace_available boolean, has_geometry boolean, terms_confirmed boolean, longitude double, latitude double, diameter_km double"
    study = spark.createDataFrame([("far", 90.0, 0.0, 50.0)], "candidate_id string, lon double, lat double, diameter_km double")
    r = J.score_submissions(spark.createDataFrame(rows, schema), study).first()
    assert r["intake_score"] == 0.85 and not r["feature_identified"] and not r["passed"]
    twin = spark.createDataFrame([("twin", 0.05, 0.0, 50.0)], "candidate_id string, lon double, lat double, diameter_km double")
    assert J.score_submissions(spark.createDataFrame(rows, schema), twin).first()["duplicate_of"] == "twin"


def test_geodesics(spark):
    from arcwright.functions.geodesic import geodesic_km, inverse_km

    a = np.array
    got = inverse_km(a([0.0, 0.0, 0.0, 10.0]), a([0.0, 0.0, 0.0, 50.0]), a([1.0, 0.0, 179.9, 10.0]), a([0.0, 1.0, 0.1, 50.0]))
    assert abs(got[0] - 111.3195) < 1e-3 and abs(got[1] - 110.5744) < 1e-3 and got[2] > 19_900 and got[3] == 0
    rows = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (0.0, None, 1.0, 0.0)], "a double, b double, c double, d double")
    assert [r["k"] is None for r in rows.select(geodesic_km("a", "b", "c", "d").alias("k")).collect()] == [False, True]


def test_arcs_along_boundaries(spark):
    from arcwright.operators import boundaries as B

    arcs = spark.createDataFrame([("on", 0.0, 0.0, 1.0, 0.0), ("half", 0.5, 0.0, 1.5, 0.0), ("off", 0.0, 3.0, 1.0, 3.0), ("across", 0.5, -1.0, 0.5, 1.0)], "candidate_id string, lon1 double, lat1 double, lon2 double, lat2 double")
    centers = spark.createDataFrame([(k, 0.5, 0.0, 50.0) for k in ("on", "half", "off", "across")], "candidate_id string, lon double, lat double, radius_km double")
    sides = spark.createDataFrame([("p", "Craton", 0.0, 0.0, 1.0, 0.0)], "province_id string, prov_type string, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {r["candidate_id"]: r for r in B.boundary_coincidence(arcs, centers, sides).collect()}
    assert got["on"]["coincidence"] > 0.99 and got["off"]["coincidence"] == 0 and got["off"]["nearby_types"] == ""
    assert abs(got["half"]["coincidence"] - (0.5 + 5 / 111.2)) < 0.02
    assert abs(got["across"]["coincidence"] - 10 / 222.4) < 0.01 and got["across"]["crossings"] == 1 and got["across"]["nearby_types"] == "Craton"
    square = spark.createDataFrame([("s", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)])], "k string, seq int, lon double, lat double")
    c = B.polygon_centers(square, "k").first()
    assert abs(c["lon"] - 1) < 1e-9 and abs(c["lat"] - 1) < 1e-9 and 156 < c["radius_km"] < 158


def test_image_patches(spark):
    n = 96
    iy, ix = np.mgrid[0:n, 0:n]
    rho = np.hypot(ix - (n - 1) / 2, iy - (n - 1) / 2) / (n / 3.5)
    ring = 100 * np.exp(-0.5 * ((rho - 1) / 0.1) ** 2)
    noise = np.random.RandomState(0).rand(n, n)
    rows = [(k, int(y), int(x), float(v)) for k, z in (("ring", ring), ("noise", noise)) for y, x, v in zip(iy.ravel(), ix.ravel(), z.ravel())]
    got = {r["candidate_id"]: r["imagery_score"] for r in O.patch_score(spark.createDataFrame(rows, "candidate_id string, iy int, ix int, value double"), n).collect()}
    assert got["ring"] == 1 and got["noise"] < 0.4


def test_draws_keep_the_domain(spark):
    grid = spark.range(36 * 18).select((F.col("id") / 36).cast("int").alias("iy"), (F.col("id") % 36).alias("ix")).select(
        "iy", "ix", (F.col("iy") * 10 - 85.0).alias("lat"), (F.col("ix") * 10 - 175.0).alias("lon"), F.when(F.col("ix") < 18, 0).otherwise(40).alias("value")
    )
    c = spark.createDataFrame([("l", 0.0, 800.0, "land"), ("o", 10.0, 800.0, "ocean")], "candidate_id string, lat double, radius_km double, domain string")
    got = O.domain_matched_draws(c, grid, k=5, attempts=10).collect()
    assert sorted((r["candidate_id"], r["null_index"]) for r in got) == [(k, i) for k in "lo" for i in range(5)]
    assert all((r["null_lon"] < 5) == (r["candidate_id"] == "l") or abs(r["null_lon"]) > 170 for r in got)


@pytest.fixture(scope="module")
def grids(spark):
    # 0.5 degree cells of a band around the equator, with rings at two places
    cells = spark.range(80 * 720).select((F.col("id") / 720).cast("int").alias("iy"), (F.col("id") % 720).alias("ix"))
    cells = cells.select("iy", "ix", (F.col("iy") * 0.5 - 19.75).alias("lat"), (F.col("ix") * 0.5 - 179.75).alias("lon"))
    far = F.least(G.great_circle_km("lon", "lat", F.lit(10.0), F.lit(0.0)), G.great_circle_km("lon", "lat", F.lit(179.9), F.lit(2.0)))
    height = cells.withColumn("value", 500 * F.exp(-F.pow((far - 800) / 60, F.lit(2.0)) / 2) + F.col("lat"))
    land = cells.withColumn("value", F.when(F.col("lon") < 60, 0).otherwise(40))
    c = spark.createDataFrame([("ring", 10.0, 0.0, 800.0, "land"), ("edge", 179.9, 2.0, 800.0, "ocean"), ("flat", 90.0, 0.0, 800.0, "ocean")], "candidate_id string, lon double, lat double, radius_km double, domain string")
    return height.cache(), land.cache(), c


def test_terrain_ranking_and_enrichment(spark, grids):
    from arcwright.plans import studies

    height, land, c = grids
    ranked = {r["candidate_id"]: r for r in studies.terrain_ranking(c, height).collect()}
    assert ranked["flat"]["rank"] == 3 and min(ranked["ring"]["followup_score"], ranked["edge"]["followup_score"]) > ranked["flat"]["followup_score"] + 0.1
    rich = {r["candidate_id"]: r for r in studies.enrichment(c, {"gravity": height}, land).collect()}
    assert rich["ring"]["gravity_ring_score"] > rich["flat"]["gravity_ring_score"] + 0.1 and rich["ring"]["tid_land_fraction"] == 1.0 and rich["flat"]["tid_land_fraction"] == 0.0


def test_matched_draw_study(spark, grids):
    from arcwright.plans import studies

    height, land, c = grids
    out = studies.matched_draw_study(c.where("candidate_id <> 'edge'"), land, height, k=3, replicates=20)
    assert out["draws"].count() == 6
    assert {r["candidate_id"]: r["n_null"] for r in out["candidates"].collect()} == {"ring": 3, "flat": 3}
    assert out["summary"].count() == 1


def test_structure_study_and_export(spark):
    from arcwright.plans import studies

    rows = placed(spark, [(0.0, 0.0, 100.0, 0.9, 1.0), (0.15, 0.0, 100.0, 0.8, 1.0), (30.0, 10.0, 50.0, 0.7, 1.0)]).withColumn("review_tier", F.lit("C_morphology")).withColumn("domain", F.lit("land"))
    faults = spark.createDataFrame([(1, 0, "f", "Normal", -1.0, 0.0, 0.0, 0.0), (1, 1, "f", "Normal", 0.0, 0.0, 1.0, 0.0)], "fault_id long, segment_no int, name string, slip_type string, lon1 double, lat1 double, lon2 double, lat2 double")
    out = studies.structure_study(rows, faults)
    got = {r["structure_id"]: r for r in out["structures"].collect()}
    assert got["structure_0001"]["fault_control_flag"] == "intersects_active_fault" and abs(got["structure_0001"]["fault_length_within_radius_km"] - 200) < 1
    assert got["structure_0002"]["fault_control_flag"] == "no_mapped_active_fault_within_radius" and got["structure_0002"]["fault_search_degrees"] == 40
    table, checks = studies.study_export(rows.select("candidate_id", "source_index"), rows, out["structures"], out["membership"], {"manual_note": "string"})
    assert checks.first()["ok"] and table.count() == 3 and {r["structure_id"] for r in table.collect()} == {"structure_0001", "structure_0002"}


def test_medians_draws_and_numbers_by_ranges(spark):
    import pandas as pd
    from arcwright.operators import ranking as R

    rng = np.random.RandomState(3)
    rows = [(["a", "b", None][i % 3] if i < 900 else "few", float(v), i) for i, v in enumerate(np.round(rng.exponential(2, 903), 1))] + [("few", None, 1), ("none", None, 2), ("few", float("nan"), 3)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    pdf = pd.DataFrame(rows, columns=["g", "v", "k"]).dropna(subset=["v"])
    got = {r["g"]: r["m"] for r in R.group_medians(df, ["g"], "v", "m").collect()}
    assert got == {None if g != g else g: v for g, v in pdf.groupby("g", dropna=False)["v"].median().items()}
    draws = spark.range(4000).select((F.col("id") % 4).alias("g"), F.col("id").alias("k"), (F.floor(F.rand(2) * 50) / 50).alias("d"))
    draws = spark.createDataFrame(draws.toPandas()).where("g < 3 OR k < 40")
    for k in (1, 37, 1000, 5000):
        found = {(r["g"], r["k"]) for r in R.smallest_draws(draws, "g", 4, "d", ["k"], k, 16).collect()}
        assert found == {(r.g, r.k) for _, own in draws.toPandas().groupby("g") for r in own.sort_values(["d", "k"]).head(k).itertuples()}
    numbered = R.number_sorted(draws.withColumn("s", F.concat(F.lit("x"), F.col("k").cast("string"))), ["g"], ["s"], "n").toPandas()
    assert all((own.sort_values("s")["n"] == range(1, len(own) + 1)).all() for _, own in numbered.groupby("g"))


def test_ecdf_needs_no_single_task(spark):
    from arcwright.operators import ranking as R

    ref = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    rows = spark.createDataFrame([("0", 10.0), ("1", -5.0), ("2", 5000.0), ("other", 500.0), (None, 500.5), ("0", None), ("0", 10.0)], "g string, v double")
    out = R.ecdf_percentile(rows, ref, ["g"], "v", "p")
    have = ref.toPandas()
    want = []
    for g, v in [tuple(r) for r in rows.collect()]:
        own = have[have["g"] == g]["v"] if g in ("0", "1", "2") else have["v"]
        want.append(None if v is None else float((own <= v).sum() / len(own)))
    key = lambda r: (r is None, r)
    assert sorted([r["p"] for r in out.collect()], key=key) == sorted(want, key=key)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    below = [next(x for x in lines[i:] if "Exchange" in x) for i, x in enumerate(lines) if "Window [" in x]
    assert below and all("hashpartitioning" in x and "_range" in x for x in below)


@pytest.mark.parametrize("kind", ["pareto", "lognormal", "few", "equal"])
def test_tail_bounds_keep_the_best(spark, kind):
    rng = np.random.RandomState(9)
    x = {"pareto": 10 * (1 - rng.rand(3000)) ** (-1 / 1.7), "lognormal": np.exp(rng.randn(3000)), "few": rng.choice([1.0, 2.0, 3.0, 8.0], 200), "equal": np.full(50, 3.0)}[kind]
    if kind == "pareto":
        x = np.concatenate([x, rng.rand(2000) * 10])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (0.0,), (-1.0,), (float("nan"),)], "v double")
    best, tried = None, 0
    s = np.sort(x)
    for xmin in np.unique(s)[:-1]:
        t = s[s >= xmin]
        n = len(t)
        if n < 25:
            continue
        alpha = 1 + n / np.log(t / xmin).sum()
        model = 1 - (t / xmin) ** (1 - alpha)
        at = np.searchsorted(t, t, "right"), np.searchsorted(t, t, "left") + 1
        ks = max(np.abs(at[0] / n - model).max(), np.abs(at[1] / n - model).max())
        tried += 1
        best = min(best or (9, 0), (ks, xmin))
    got = T.power_law_tail(df, "v", few_pairs=0).collect()
    assert len(got) == (best is not None) and got == T.power_law_tail(df, "v").collect()
    if best:
        assert got[0]["xmin"] == pytest.approx(best[1]) and got[0]["ks"] == pytest.approx(best[0], abs=1e-12)
        sums, tails = T._tail_rows(df, "v", 25)
        assert tails.count() == tried and (tried < 100 or T.tails_left(sums, tails).count() < 0.1 * tried)


def test_scale_permutations_match_plain_numpy(spark):
    from arcwright.operators.stats import draw, ks_permutation

    rng = np.random.RandomState(4)
    x, y = np.exp(rng.randn(40) + 1), np.exp(rng.randn(25))
    frame = lambda v: spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "id long, v double")
    got = {r["rep"]: r for r in ks_permutation(frame(x), frame(y), "id", "v", 3, 7, steps=10, rounds=2).collect()}
    pool = [(0, str(i), float(np.log(v))) for i, v in enumerate(x)] + [(1, str(i), float(np.log(v))) for i, v in enumerate(y)]
    keyed = spark.createDataFrame([(r, s, k, v) for r in range(3) for s, k, v in pool], "rep int, _side int, _key string, v double").withColumn("d", draw(7, "rep", "_side", "_key")).toPandas()

    def gap(a, b):
        at = np.sort(np.concatenate([a, b]))
        return np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()

    for rep in (-1, 0, 1, 2):
        if rep < 0:
            a, b = np.log(x), np.log(y)
        else:
            own = keyed[keyed["rep"] == rep].sort_values(["d", "_side", "_key"])["v"].to_numpy()
            a, b = own[: len(x)], own[len(x) :]
        mid, half = np.median(a) - np.median(b), 5.0
        for _ in range(2):
            tries = [(gap(a, b + (mid + half * (2 * i / 10 - 1))), mid + half * (2 * i / 10 - 1)) for i in range(11)]
            ks, mid = min(tries)
            half *= 2 / 10
        assert got[rep]["ks"] == pytest.approx(ks) and math.log(got[rep]["scale"]) == pytest.approx(mid)


def test_every_exclusion_counts(spark):
    records = spark.range(12_001).select(F.col("id").cast("string").alias("record_id"))
    exclusions = spark.range(12_000).select(F.col("id").cast("string").alias("record_id"), F.lit("kept").alias("duplicate_of"), F.lit("copy").alias("note"))
    out = L.without_duplicates(records, exclusions)
    assert out.columns == ["record_id", "duplicate_of", "note", "analytical_include"] and out.count() == 12_001
    assert [r["record_id"] for r in out.where("analytical_include").collect()] == ["12000"]


def plain_cliques(pairs):
    of, members = {}, {}
    beside = {}
    for a, b, w in pairs:
        beside.setdefault(b, {})[a] = w
        beside.setdefault(a, {})
    for row in sorted(beside):
        fits = [(beside[row][f], f) for f, own in members.items() if f in beside[row] and all(m in beside[row] for m in own)]
        of[row] = min(fits)[1] if fits else row
        members.setdefault(of[row], []).append(row)
    return of


@pytest.mark.parametrize(("most_pairs", "n"), [(1000, 10_000), (7, 120)])
def test_long_components_take_blocks(spark, most_pairs, n):
    import random

    from arcwright.operators.cluster import ordered_cliques

    draw = random.Random(5)
    pairs = [(i, i + 1, float(i % 3)) for i in range(n - 1)] if n > 1000 else sorted({(a, b, float((a * b) % 5)) for a in range(n) for b in range(a + 1, min(n, a + 6)) if draw.random() < 0.8})
    rows = spark.range(n).select(F.concat(F.lit("c"), "id").alias("key"), F.col("id").alias("rank"))
    df = spark.createDataFrame(pairs, "a long, b long, weight double").select(F.concat(F.lit("c"), "a").alias("early"), F.concat(F.lit("c"), "b").alias("late"), "weight")
    got = {r["key"]: r["first"] for r in ordered_cliques(rows, "key", df, most_pairs).collect()}
    assert got == {f"c{k}": f"c{v}" for k, v in plain_cliques(pairs).items()}


@pytest.mark.parametrize("most_pairs", [40, 1_000_000])
def test_clusters_in_order_match_a_plain_loop(spark, most_pairs):
    import random

    from arcwright.operators.cluster import consolidate

    draw = random.Random(3)
    rows = [(i, draw.random() * 1.2, draw.random() * 1.2, 80 + 30 * draw.random(), round(draw.random(), 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "candidate_id long, lon double, lat double, radius_km double, followup_score double")

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    groups = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        fits = [
            (km(r, g[0]) / min(r[3], g[0][3]), i)
            for i, g in enumerate(groups)
            if all(km(r, m) <= 0.25 * min(r[3], m[3]) and 0.67 <= r[3] / m[3] <= 1.5 for m in g)
        ]
        groups[min(fits)[1]].append(r) if fits else groups.append([r])
    want = {m[0]: (g[0][0], f"structure_{i + 1:04d}") for i, g in enumerate(groups) for m in g}
    assert max(map(len, groups)) > 3
    got = {r["candidate_id"]: (r["representative_id"], r["structure_id"]) for r in consolidate(df, most_pairs=most_pairs).collect()}
    assert got == want
