"""Whole studies end to end, window scores against plain numpy, and geometry and grids by hand."""

import math

import numpy as np
import pytest
from arcwright.functions import geo as G
from arcwright.operators import boundaries as B
from arcwright.operators import cluster as C
from arcwright.operators import ring as O
from arcwright.operators import shortlist as H
from arcwright.plans import studies
from arcwright.plans.views import view
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
KM = math.pi / 180 * G.EARTH_RADIUS_KM
WINDOW = "candidate_id string, iy int, ix int, x double, y double, rho double, value double, radius_km double, lat0 double, step_lon double, step_lat double"


def smoothed(z, sigma_y, sigma_x):
    for axis, sigma in ((0, sigma_y), (1, sigma_x)):
        reach = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        w /= w.sum()
        wide = np.pad(z, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        z = np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), axis, wide)  # noqa: B023
    return z


def sectors_over(theta, e, where, n, least, limit):
    at = np.minimum(n - 1, np.floor(theta / (2 * math.pi) * n))
    return sum(1 for s in range(n) if (where & (at == s)).sum() >= least and np.median(e[where & (at == s)]) > limit) / n


def plain_window(w, factor, region):
    """Residual, radial gradient and anisotropy of a window's dense arrays."""
    z = w["value"]
    inside = z[(w["rho"] <= region) & np.isfinite(z)]
    z = np.where(np.isfinite(z), z, np.median(inside))
    dy, dx = w["step_lat"] * KM, w["step_lon"] * KM * max(0.05, math.cos(math.radians(w["lat0"])))
    residual = z - smoothed(z, max(1.0, w["radius"] / dy * factor), max(1.0, w["radius"] / dx * factor))
    north, east = np.gradient(residual, dy, dx)
    size = np.maximum(np.hypot(w["x"], w["y"]), np.finfo(float).tiny)
    ux, uy = w["x"] / size, w["y"] / size
    radial, turned = east * ux + north * uy, east * uy - north * ux
    return residual, np.abs(radial), (np.abs(radial) - np.abs(turned)) / (np.hypot(north, east) + 1e-8), math.sqrt(dx * dy)


def relief(rho, residual, inner, outer, roi):
    ring = (rho >= 0.85) & (rho <= 1.15)
    q1, q3 = np.quantile(residual[roi], [0.25, 0.75])
    scale = max(q3 - q1, 0.25 * residual[roi].std(), 1e-6)
    return scale, abs(np.median(residual[ring]) - 0.5 * (np.median(residual[inner]) + np.median(residual[outer]))) / scale


def between(a, lo, hi):
    return (a >= lo) & (a <= hi)


def plain_terrain(w):
    rho, theta = w["rho"], np.mod(np.arctan2(w["x"], w["y"]), 2 * math.pi)
    residual, energy, alignment, pixel = plain_window(w, 0.35, 1.65)
    ring, back = between(rho, 0.85, 1.15), between(rho, 0.45, 0.78) | between(rho, 1.22, 1.55)
    align = np.median(alignment[ring])
    curve = []
    for b in range(60):
        own = energy[(np.floor((rho - 0.35) / (1.2 / 60) + 1e-12) == b) & (rho < 1.55)]
        if len(own) >= 8:
            curve.append((0.35 + (b + 0.5) * 0.02, np.median(own)))
    centers, e = np.array(curve).T
    at_one = e[np.abs(centers - 1) <= 0.12].max()
    ratio = centers[np.argmax(e)]
    bg = np.median(energy[back])
    limit = bg + 0.5 * np.median(np.abs(energy[back] - bg))
    cover = sectors_over(theta, energy, ring, 72, 3, limit)
    tried = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            own = between(np.hypot(w["x"] - i * 0.1, w["y"] - j * 0.1), 0.88, 1.12)
            tried.append((np.median(energy[own]), i * 0.1, j * 0.1))
    shift = math.hypot(*max(tried)[1:])
    _, rel = relief(rho, residual, between(rho, 0.58, 0.78), between(rho, 1.22, 1.42), rho <= 1.65)
    quality = min(1, max(0, (2 * w["radius"] / pixel - 8) / 32)) * np.isfinite(w["value"])[rho <= 1.65].mean()
    raw = 0.24 * min(1, max(0, (align + 1) / 2)) + 0.22 * (e <= at_one).mean() + 0.18 * cover + 0.14 * math.exp(-((abs(ratio - 1) / 0.16) ** 2)) + 0.12 * math.exp(-((shift / 0.14) ** 2)) + 0.10 * math.tanh(rel)
    return {"radial_alignment": align, "hough_percentile": (e <= at_one).mean(), "best_radius_ratio": ratio, "angular_continuity": cover, "centre_shift_ratio": shift, "annular_relief_normalized": rel, "data_quality": quality, "topography_score": quality * raw}


def plain_scalar(w):
    rho, theta = w["rho"], np.mod(np.arctan2(w["x"], w["y"]), 2 * math.pi)
    residual, energy, alignment, pixel = plain_window(w, 0.55, 1.55)
    ring, back, inner = between(rho, 0.85, 1.15), between(rho, 0.45, 0.75) | between(rho, 1.25, 1.55), rho <= 0.70
    bg = np.median(energy[back])
    cover = sectors_over(theta, energy, ring, 36, 2, bg + 0.5 * np.median(np.abs(energy[back] - bg)))
    scale, _ = relief(rho, residual, inner, between(rho, 1.25, 1.55), rho <= 1.55)
    rich = np.median(energy[ring]) / max(bg, 1e-8)
    valid = np.isfinite(w["value"])[rho <= 1.55].mean()
    align = np.median(alignment[ring])
    score = valid * min(1, max(0, (2 * w["radius"] / pixel - 4) / 16)) * (0.35 * min(1, max(0, (align + 1) / 2)) + 0.35 * cover + 0.30 * math.tanh(max(0, rich - 1)))
    return {"radial_alignment": align, "angular_continuity": cover, "annular_gradient_enrichment": rich, "central_annular_contrast": (np.median(residual[inner]) - np.median(residual[ring])) / scale, "ring_score": score}


def some_windows():
    rng = np.random.RandomState(7)
    out = {}
    for i, (n, m, lat0, radius, amount) in enumerate([(45, 51, 0.0, 100.0, 60.0), (37, 37, 48.0, 80.0, 0.0), (61, 41, -20.0, 120.0, 200.0)]):
        lat, lon = np.linspace(-1.75, 1.75, n) * radius / KM, np.linspace(-1.75, 1.75, m) * radius / KM / math.cos(math.radians(lat0))
        x = np.radians(lon)[None, :] * math.cos(math.radians(lat0)) * G.EARTH_RADIUS_KM / radius + np.zeros((n, 1))
        y = np.radians(lat)[:, None] * G.EARTH_RADIUS_KM / radius + np.zeros((1, m))
        rho = np.hypot(x, y)
        z = amount * np.exp(-0.5 * ((rho - 1) / 0.1) ** 2) + rng.randn(n, m) * 20 + 5 * x
        z[rng.rand(n, m) < 0.03] = np.nan
        out[f"w{i}"] = {"x": x, "y": y, "rho": rho, "value": z, "radius": radius, "lat0": lat0, "step_lat": float(lat[1] - lat[0]), "step_lon": float(lon[1] - lon[0])}
    return out


@pytest.fixture(scope="module")
def windows(spark):
    rows = []
    for k, w in some_windows().items():
        for (iy, ix), v in np.ndenumerate(w["value"]):
            rows.append((k, iy, ix, float(w["x"][iy, ix]), float(w["y"][iy, ix]), float(w["rho"][iy, ix]), None if np.isnan(v) else float(v), w["radius"], w["lat0"], w["step_lon"], w["step_lat"]))
    return spark.createDataFrame(rows, WINDOW).repartition(4)


@pytest.mark.parametrize(("score", "plain"), [(O.terrain_score, plain_terrain), (O.scalar_ring_score, plain_scalar)])
def test_window_scores_match_plain_numpy(windows, score, plain):
    got = {r["candidate_id"]: r for r in score(windows).collect()}
    for k, w in some_windows().items():
        for name, value in plain(w).items():
            assert got[k][name] == pytest.approx(value, abs=1e-9), (k, name)


def test_steps_are_medians_of_the_axes(spark):
    lat, lon = [0.0, 1.0, 2.0, 3.0, 4.0, 9.0], [10.0, 10.5, 11.0, 11.5, 14.0]
    grid = spark.createDataFrame([(y, x, a, o, 1.0) for y, a in enumerate(lat) for x, o in enumerate(lon) if (y, x) != (2, 2)], "iy int, ix int, lat double, lon double, value double")
    axes = O.grid_axes(grid)
    assert (axes["step_lat"], axes["step_lon"], axes["first_lat"], axes["ix_high"]) == (1.0, 0.5, 0.0, 4)
    holes = O.grid_axes(grid.where("iy <> 1"))  # a missing row is two steps, not one of double size
    assert holes["step_lat"] == 1.0
    one = O.grid_axes(grid.where("iy = 0"))
    assert one["step_lat"] == 0.0
    c = spark.createDataFrame([("a", 11.0, 2.0, 100.0)], "candidate_id string, lon double, lat double, radius_km double")
    assert O.grid_window_join(c, grid).select("step_lat", "step_lon").first() == (1.0, 0.5)


def test_draws_equal_a_count_of_cells(spark):
    from arcwright.functions.scoring import domain
    from arcwright.operators.stats import draw

    n = 90
    grid = spark.range(n * 2 * n).select((F.col("id") / (2 * n)).cast("int").alias("iy"), (F.col("id") % (2 * n)).alias("ix"))
    land = (F.sin(F.col("ix") / 9.0) * F.cos(F.col("iy") / 6.0) + F.sin(F.col("ix") / 3.0) * 0.3) > 0.1
    grid = grid.select("iy", "ix", (F.col("iy") * 2 - 89.0).alias("lat"), (F.col("ix") * 2 - 179.0).alias("lon"), F.when(land, 0).when(F.col("ix") % 7 > 0, 40).alias("value")).cache()
    rows = [(f"c{i}", lat, r, d) for i, (lat, r) in enumerate([(0.0, 400.0), (55.0, 900.0), (-87.0, 700.0), (89.0, 500.0), (-40.0, 5000.0), (10.0, 30.0)]) for d in ("land", "ocean")]
    c = spark.createDataFrame([(f"{k}{d}", *r, d) for k, *r, d in rows], "candidate_id string, lat double, radius_km double, domain string")
    for pixels in (512, 20):
        got = {tuple(r) for r in O.domain_matched_draws(c, grid, k=3, attempts=6, max_pixels=pixels).collect()}
        tries = c.select("candidate_id", "lat", "radius_km", "domain", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("attempt")).withColumn("lon", 360 * draw(20260621, "attempt", "candidate_id") - 180)
        cells = O.grid_window_join(tries.withColumnRenamed("domain", "target"), grid, max_pixels=pixels).where("rho <= 1.55")
        share = cells.groupBy("candidate_id", "attempt", "lon0", "lat0", "radius_km", "target").agg(F.avg((F.col("value") == 0).cast("double")).alias("land"))
        want, seen = set(), {}
        for r in share.where(domain("land") == F.col("target")).orderBy("candidate_id", "attempt").collect():
            i = seen.setdefault(r["candidate_id"], 0)
            if i < 3:
                want.add((r["candidate_id"], i, r["lon0"], r["lat0"], r["radius_km"], r["target"]))
            seen[r["candidate_id"]] = i + 1
        assert got == want and len(got) > 10


def test_line_centers_and_what_they_fill(spark):
    rows = [
        ("bend", 1, 1, 0.0, 0.0), ("bend", 1, 2, 2.0, 0.0), ("bend", 1, 3, 2.0, 1.0), ("two", 1, 1, 0.0, 0.0), ("two", 1, 2, 1.0, 0.0), ("two", 2, 1, 10.0, 10.0), ("two", 2, 2, 10.0, 13.0),
        ("dot", 1, 1, 5.0, 6.0), ("dot", 1, 2, 5.0, 6.0), ("gone", 1, 1, None, 3.0),
    ]
    v = spark.createDataFrame(rows, "id string, part int, seq int, lon double, lat double")
    got = {r["id"]: r for r in B.line_centers(v, "id", ["seq"], "part").collect()}
    assert set(got) == {"bend", "two", "dot"}
    assert (got["bend"]["lon"], got["bend"]["lat"]) == pytest.approx((4 / 3, 1 / 6)) and (got["two"]["lon"], got["two"]["lat"]) == pytest.approx((30.5 / 4, 34.5 / 4))
    assert (got["dot"]["lon"], got["dot"]["lat"], got["dot"]["radius_km"], got["dot"]["n_vertices"]) == (5.0, 6.0, 0.0, 2)
    h = math.sin(math.radians(1 / 12)) ** 2 + math.cos(0) * math.cos(math.radians(1 / 6)) * math.sin(math.radians(2 / 3)) ** 2
    assert got["bend"]["radius_km"] == pytest.approx(2 * G.EARTH_RADIUS_KM * math.asin(math.sqrt(h)))
    controls = spark.createDataFrame([("bend", None, None, None), ("two", 1.0, 2.0, 30.0), ("dot", 5.0, None, None), ("none", None, None, 8.0), ("bend", 2.0, 0.0, None)], "id string, lon double, lat double, diameter_km double")
    out = {(r["id"], r["lon"]): r for r in B.filled_from_geometry(controls, "id", v, ["seq"], "part").collect()}
    assert out["two", 1.0]["radius_km"] == 15.0 and out["none", None]["radius_km"] == 4.0 and out["none", None]["lat"] is None
    assert out["dot", 5.0]["lat"] == 6.0 and out["dot", 5.0]["diameter_km"] == 0.0
    assert out["bend", 2.0]["radius_km"] == pytest.approx(KM * 2) and out["bend", 2.0]["diameter_km"] == pytest.approx(KM * 4)
    assert [r["radius_km"] for k, r in out.items() if k[0] == "bend" and k[1] != 2.0][0] == pytest.approx(got["bend"]["radius_km"])


def test_named_regional_cases(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0), ("b", 2, 1.0, 0.0, 10.0)], "candidate_id string, source_index long, lon double, lat double, radius_km double")
    cases = spark.createDataFrame([("a", "known"), ("a", "again"), ("x", "other")], "candidate_id string, special_regional_case string")
    got = {r["candidate_id"]: r["special_regional_case"] for r in C.regional_families(rows, cases=cases).collect()}
    assert got == {"a": "again", "b": None}
    assert {r["special_regional_case"] for r in C.regional_families(rows).collect()} == {None}


def test_size_study_runs(spark):
    fits = view(spark, SF, "vertices").where("candidate_id < 'arc_000400'")
    out = studies.size_study(fits, view(spark, SF, "catalogue"), replicates=9, shape_replicates=4)
    n = fits.select("candidate_id").distinct().count()
    assert out["fits"].count() == n and out["bins"].count() == 8
    tests = {(r["test"], r["statistic"]): r for r in out["tests"].collect()}
    assert len(tests) == 4 and all(0.1 <= r["p"] <= 1 for r in tests.values())
    assert out["scale"].count() == 1 and 0 < out["shape"].first()["p"] <= 1
    assert out["tail"].count() <= 1


def study_rows(spark):
    k = F.col("source_index")
    c = view(spark, SF, "candidates").select("candidate_id", "source_index", "lon", "lat", "radius_km", "diameter_km", "tid_land_fraction", "tid_artifact_risk", "sediment_thickness_km", "geometry_angular_coverage", "followup_score", *H.METRICS)
    return c.withColumns({"morphology": F.col("followup_score"), "gravity": F.col("gravity_bouguer_ring_score"), "magnetic": F.col("magnetic_ring_score"), "risk": F.col("tid_artifact_risk"), "domain": F.when(k % 2 == 0, "land").otherwise("ocean"), "morphology_score_used": F.col("followup_score"), "gravity_consensus_used": F.col("gravity_bouguer_ring_score")})


def test_screening_study_runs(spark):
    seed = spark.createDataFrame([("seed", "Basin", "Moon", "certain", 900.0, [900.0, 450.0, 600.0])], "source string, object string, body string, certainty string, diameter_km double, ring_diameters_km array<double>")
    large = spark.createDataFrame([("Crater", 300.0)], "object string, diameter_km double")
    rows = study_rows(spark)
    out = studies.screening_study(rows, view(spark, SF, "controls"), planetary=(seed, large), packets=5)
    n = rows.count()
    assert out["ranked"].count() == out["controls"].count() == out["preservation"].count() == out["regions"].count() == n
    assert out["packets"].count() == 5 and out["comparison"].count() >= 2
    parts = {}
    for r in out["summary"].collect():
        parts[r["section"]] = parts.get(r["section"], 0) + r["value"]
    assert parts["warning"] == parts["state"] == parts["region"] == parts["case"] == n and parts["library"] == view(spark, SF, "controls").count() and parts["planetary"] == out["comparison"].count()


def test_planetary_study_runs(spark):
    seed = spark.createDataFrame([("seed", "Basin", "Moon", "certain", 900.0, [900.0, 450.0, 600.0]), ("seed", "Other", None, "likely", 90.0, None)], "source string, object string, body string, certainty string, diameter_km double, ring_diameters_km array<double>")
    large = spark.createDataFrame([("Crater", 300.0)], "object string, diameter_km double")
    families = spark.createDataFrame([("f1", "10.000-25.500")], "family_id string, diameter_range_km string")
    prints = spark.createDataFrame([("p", 3, "abc")], "path string, bytes long, sha256 string")
    out = studies.planetary_study(seed, large, families, prints)
    assert {r["object"]: r["number_of_nested_rings"] for r in out["rings"].collect()} == {"Basin": 3, "Other": 0}
    assert {(r["source"], r["body"]): r["n"] for r in out["sizes"].collect()} == {("seed", "Moon"): 1, ("seed", None): 1, ("large_catalogue", "Moon"): 1}
    assert {(r["object"], r["diameter_km"]) for r in out["comparison"].collect()} == {("Basin", 900.0), ("Other", 90.0), ("Crater", 300.0), ("f1", 25.5)}
    assert {r["output"]: r["rows"] for r in out["manifest"].collect()} == {"rings": 2, "planetary": 3, "comparison": 4, "source": None}


def test_traces_are_scored_against_the_study(spark):
    cells = spark.range(80 * 720).select((F.col("id") / 720).cast("int").alias("iy"), (F.col("id") % 720).alias("ix"))
    cells = cells.select("iy", "ix", (F.col("iy") * 0.5 - 19.75).alias("lat"), (F.col("ix") * 0.5 - 179.75).alias("lon"))
    far = G.great_circle_km("lon", "lat", F.lit(10.0), F.lit(0.0))
    height = cells.withColumn("value", 500 * F.exp(-F.pow((far - 800) / 60, F.lit(2.0)) / 2) + F.col("lat")).cache()
    turns = [2 * math.pi * i / 48 for i in range(48)]
    vertices = spark.createDataFrame([(k, lon + 7.2 * math.cos(t), 7.2 * math.sin(t)) for k, lon in (("ring", 10.0), ("flat", 90.0)) for t in turns], "candidate_id string, lon double, lat double")
    study = H.review_shortlist(study_rows(spark).drop("domain"))
    classes = cells.withColumn("value", F.when(F.col("lon") < 60, 0).otherwise(40))
    out = {r["candidate_id"]: r for r in studies.score_traces(vertices, study, height, {"gravity_bouguer": height}, classes).collect()}
    assert out["ring"]["followup_score"] > out["flat"]["followup_score"] + 0.1 and out["ring"]["domain"] == "land"
    assert out["ring"]["method_version"].endswith("+geophysics-v1") and out["ring"]["review_tier"] is not None
    for r in out.values():
        assert r["magnetic_ring_score_stratified_percentile"] is None and 0 <= r["gravity_bouguer_ring_score_stratified_percentile"] <= 1


def test_matched_draws_with_strata(spark):
    n = 60
    grid = spark.range(n * 2 * n).select((F.col("id") / (2 * n)).cast("int").alias("iy"), (F.col("id") % (2 * n)).alias("ix")).select("iy", "ix", (F.col("iy") * 3 - 88.5).alias("lat"), (F.col("ix") * 3 - 178.5).alias("lon"))
    classes = grid.withColumn("value", F.when(F.col("ix") < n, 0).otherwise(40)).cache()
    channel = grid.withColumn("value", F.sin(F.col("ix") / 5.0) * 10 + F.cos(F.col("iy") / 4.0)).cache()
    rows = [(f"c{i}", -170.0 + 25 * i, 5.0 * (i % 5), 1500.0, "land" if i < 7 else "ocean", i / 14) for i in range(14)]
    c = spark.createDataFrame(rows, "candidate_id string, lon double, lat double, radius_km double, domain string, followup_score double")
    out = studies.matched_draw_study(c, classes, channel, k=2, replicates=9, strata=["domain"])
    assert [r["test"] for r in out["summary"].collect()] == ["matched rotation", "stratified permutation"]
    assert out["concordance"].count() == 10
