"""Whole studies as chains of operators. Each returns lazy tables; the caller writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import arcs as A
from ..operators import boundaries as B
from ..operators import cluster as C
from ..operators import faults as D
from ..operators import relational as L
from ..operators import ring as R
from ..operators import spatial as P
from ..operators import stats as T
from ..operators.checkpoints import cut
from ..operators.ranking import number_rows
from ..sources import sinks as K


def size_study(vertices: DataFrame, catalogue: DataFrame, replicates: int = 999, seed: int = 20260619, shape_replicates: int = 199) -> dict[str, DataFrame]:
    """Sizes of fitted arcs, their power-law tail, and whether matched catalogue records lie near them by chance.

    vertices: see ``arcs.spherical_fit``; catalogue: record_id, lon, lat, diameter_km, eid_match.
    """
    fits = cut(A.spherical_fit(vertices))
    matched = catalogue.where("eid_match")
    near = cut(P.nearest_neighbour(catalogue, "record_id", fits, "candidate_id").join(catalogue.select("record_id", "eid_match"), "record_id"))
    turned = cut(T.rotation_null(matched, "record_id", fits, "candidate_id", replicates, seed))
    labels = cut(T.label_null(near, "record_id", "eid_match", "distance_km", replicates, seed))
    tests = [
        K.result_rows(T.null_summary(reps, value, larger), name, value)
        for name, reps in (("longitude rotation", turned), ("label permutation", labels))
        for value, larger in (("count_within", True), ("median_km", False))
    ]
    return {
        "fits": fits,
        "tail": T.power_law_tail(fits, "diameter_km"),
        "bins": T.labelled_bins(fits, "diameter_km", [10.0, 50.0, 100.0, 200.0, 400.0, 1000.0, 2500.0, 5000.0]),
        "scale": T.ks_scaled(fits, catalogue, "diameter_km"),
        "shape": T.null_summary(cut(T.ks_permutation(fits.select(F.col("candidate_id").alias("id"), "diameter_km"), catalogue.select(F.col("record_id").alias("id"), "diameter_km"), "id", "diameter_km", shape_replicates, seed)), "ks"),
        "tests": reduce(DataFrame.unionByName, tests),
    }


def terrain_ranking(candidates: DataFrame, terrain: DataFrame, arcs: DataFrame | None = None, sides: DataFrame | None = None) -> DataFrame:
    """Candidates with terrain metrics, geology independence, follow-up score and rank.

    candidates: candidate_id, lon, lat, radius_km; terrain: a grid (see ``ring.grid_window_join``); arcs and sides: see ``boundaries.boundary_coincidence``;
    without them arcs count as independent of geology.
    """
    scores = R.terrain_score(R.grid_window_join(candidates.select("candidate_id", "lon", "lat", "radius_km"), terrain))
    rows = candidates.join(scores, "candidate_id", "left")
    if arcs is not None and sides is not None:
        rows = rows.join(B.boundary_coincidence(arcs, candidates, sides), "candidate_id", "left")
    else:
        rows = rows.withColumn("independence", F.lit(1.0))
    rows = rows.withColumn("followup_score", S.priority_score("data_quality", "topography_score_unweighted", "independence"))
    return number_rows(cut(rows), "followup_score", ["candidate_id"], "rank")


def enrichment(candidates: DataFrame, channels: dict[str, DataFrame], classes: DataFrame | None = None, max_pixels: int = 384) -> DataFrame:
    """Candidates with the ring metrics of each channel's grid (prefixed by its name), and source-type metrics of a class grid.

    A channel that isn't there adds no columns; evidence replaces columns of the same name.
    """
    places = candidates.select("candidate_id", "lon", "lat", "radius_km")
    rows = candidates
    for name, grid in channels.items():
        ring = R.scalar_ring_score(R.grid_window_join(places, grid, max_pixels=max_pixels), channel=name).drop("channel")
        rows = L.override(rows, L.prefixed(ring, f"{name}_", ["candidate_id"]), "candidate_id")
    if classes is not None:
        cells = R.grid_window_join(places, classes, max_pixels=max_pixels).withColumn("tid", F.col("value").cast("int"))
        rows = L.override(rows, R.source_type_metrics(cells), "candidate_id")
    return rows


def matched_draw_study(candidates: DataFrame, classes: DataFrame, channel: DataFrame, k: int = 19, replicates: int = 999, seed: int = 20260621, strata: list[str] | None = None) -> dict[str, DataFrame]:
    """Ring scores of candidates against those of domain-matched longitudes: draws, p by candidate, and the summary over all.

    candidates: candidate_id, lon, lat, radius_km, domain; classes and channel: grids. With ``strata`` (columns of the candidates) and a column followup_score, also how the channel's scores
    rank with those of the shape, against shuffles within the strata: ``concordance``, and a row of the summary.
    """
    draws = cut(R.domain_matched_draws(candidates, classes, k, seed))
    moved = draws.select(F.concat_ws("#", "candidate_id", "null_index").alias("candidate_id"), F.col("null_lon").alias("lon"), "lat", "radius_km")
    null = R.scalar_ring_score(R.grid_window_join(moved, channel)).select("candidate_id", "ring_score")
    null = cut(null.select(F.substring_index("candidate_id", "#", 1).alias("candidate_id"), F.substring_index("candidate_id", "#", -1).cast("int").alias("null_index"), "ring_score"))
    observed = cut(R.scalar_ring_score(R.grid_window_join(candidates.select("candidate_id", "lon", "lat", "radius_km"), channel)).select("candidate_id", "ring_score"))
    reps = T.global_null(observed, null, "candidate_id", "ring_score", replicates, seed)
    out = {"draws": null, "candidates": T.candidate_p(observed, null, "candidate_id", "ring_score"), "summary": K.result_rows(T.null_summary(cut(reps), "median"), "matched rotation", "median ring score")}
    if strata:
        rows = candidates.select("candidate_id", *strata, "followup_score").join(observed, "candidate_id")
        mixed = cut(T.stratified_null(rows, "candidate_id", strata, "followup_score", "ring_score", replicates, seed))
        out |= {"concordance": mixed, "summary": out["summary"].unionByName(K.result_rows(T.null_summary(mixed, "rho"), "stratified permutation", "rank correlation with shape"))}
    return out


def structure_study(candidates: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """Structures of candidates with fault metrics and flags, membership, and counts by setting. See ``cluster.structures`` and ``faults``."""
    membership = cut(C.consolidate(candidates))
    found = cut(C.structures(candidates, membership))
    metrics = D.fault_metrics(found, segments, "structure_id")
    flagged = D.with_fault_flag(found.join(metrics, "structure_id"))
    return {"structures": flagged, "membership": membership, "sensitivity": C.consolidation_sensitivity(candidates)}


def screening_study(candidates: DataFrame, controls: DataFrame, regional_km: float = 500.0, planetary: tuple[DataFrame, DataFrame] | None = None, cases: DataFrame | None = None, packets: int = 25) -> dict[str, DataFrame]:
    """Gravity-first ranks, nearest controls, ring and regional families, preservation, packets of the best candidates, and a summary of all sections.

    candidates: candidate_id, source_index, lon, lat, radius_km, diameter_km, morphology, gravity, magnetic, risk, domain, sediment_thickness_km, geometry_angular_coverage,
    morphology_score_used, gravity_consensus_used. planetary: seed and large catalogue (see ``planetary_study``), compared with the ring families; cases: see ``cluster.regional_families``.
    """
    from ..operators import shortlist as H

    ranked = cut(H.gravity_first(candidates))
    out = {
        "ranked": ranked,
        "controls": cut(P.match_controls(ranked, controls)),
        "rings": cut(C.ring_families(candidates)),
        "regions": cut(C.regional_families(candidates, regional_km, cases)),
        "preservation": cut(H.preservation(candidates)),
    }
    near = out["controls"].select("candidate_id", F.col("nearest_negative_control_class").alias("_near"))
    best = ranked.join(near, "candidate_id", "left").withColumn("followup_score", F.col("gravity_first_review_score"))
    out["packets"] = K.review_packets(best, packets, "_near")
    parts = {
        "warning": (out["controls"], "control_similarity_warning"), "library": (controls, "negative_control_class"), "state": (out["preservation"], "preservation_state"), "family": (out["rings"], "member_count"),
        "region": (out["regions"], "regional_family_member_count"), "case": (out["regions"], "special_regional_case"),
    }
    if planetary is not None:
        families = out["rings"].select(F.col("ring_family_id").alias("family_id"), "diameter_range_km").distinct()
        planets = planetary_study(*planetary, families)
        out |= {"planetary": planets["planetary"], "comparison": planets["comparison"]}
        parts["planetary"] = (out["comparison"], "body")
    return out | {"summary": K.screening_summary(parts)}


def study_export(features: DataFrame, results: DataFrame, structures: DataFrame, membership: DataFrame, capture: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, checks): every feature once, with its results, its structure's fields as structure_*, and empty reviewer fields; and
    whether features and results map one to one."""
    checks = L.assert_one_to_one(features, results, "candidate_id")
    own = membership.select("candidate_id", "structure_id").join(structures, "structure_id")
    copied = L.prefixed(own.withColumnRenamed("structure_id", "id"), "structure_", ["candidate_id"])
    fresh = [c for c in results.columns if c not in features.columns or c == "candidate_id"]
    rows = features.join(results.select(*fresh), "candidate_id", "left").join(copied, "candidate_id", "left")
    return L.with_capture_fields(rows, capture), checks


#: Name of the follow-up method; with geophysical evidence it says so.
METHOD_VERSION = "terrain-geology-v1"


def score_traces(vertices: DataFrame, study: DataFrame, terrain: DataFrame, channels: dict[str, DataFrame], classes: DataFrame | None = None, arcs: DataFrame | None = None, sides: DataFrame | None = None) -> DataFrame:
    """Submitted traces with the study's scores, their percentiles among the study's candidates of their domain and size, tier and method version.

    vertices: candidate_id, lon, lat of each trace (a circle of ``geo.circle_vertices`` where there is none); study: a shortlist (see
    ``shortlist.review_shortlist``); grids as in ``terrain_ranking`` and ``enrichment``, channels named gravity_bouguer, gravity_freeair and magnetic.
    A domain and size class that the study has no candidate in is compared with all of it.
    """
    from ..operators.ranking import bins_left_closed, ecdf_percentile, exact_quantiles
    from ..operators.shortlist import METRICS

    rows = terrain_ranking(A.spherical_fit(vertices), terrain, arcs, sides).drop("rank")
    rows = enrichment(rows, channels, classes)
    for c in (*METRICS, "tid_artifact_risk", "tid_land_fraction"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    edges = exact_quantiles(study.withColumn("_log", F.log10("diameter_km")), "_log", [i / 10 for i in range(1, 10)])
    placed = lambda d: d.withColumn("domain", S.domain("tid_land_fraction")).withColumn("_bin", bins_left_closed(F.log10(F.greatest("diameter_km", F.lit(1e-6))), edges))
    rows, reference = cut(placed(rows)), cut(placed(study))
    for m in METRICS:
        rows = ecdf_percentile(rows, reference, ["domain", "_bin"], m, f"{m}_stratified_percentile")
    b, f = (F.col(f"{m}_stratified_percentile") for m in METRICS[:2])
    n = b.isNotNull().cast("int") + f.isNotNull().cast("int")
    rows = rows.withColumn("gravity_consensus_percentile", F.when(n > 0, (F.coalesce(b, F.lit(0.0)) + F.coalesce(f, F.lit(0.0))) / n))
    both = F.coalesce(F.least(b, f) >= 0.75, F.lit(False))
    rows = rows.withColumn("review_tier", S.review_tier("followup_score", "gravity_consensus_percentile", both, "tid_artifact_risk"))
    rows = rows.withColumn("geophysical_sources_available", F.coalesce(*METRICS).isNotNull())
    version = F.concat(F.lit(METHOD_VERSION), F.when(F.col("geophysical_sources_available"), "+geophysics-v1").otherwise(""))
    return rows.withColumn("method_version", version).drop("_bin")


def planetary_study(seed: DataFrame, large: DataFrame, families: DataFrame, fingerprints: DataFrame | None = None) -> dict[str, DataFrame]:
    """Planetary ring sets and large craters in one table, compared with terrestrial families, and a manifest.

    seed: source, object, body, certainty, diameter_km, ring_diameters_km; large: see ``files.read_large_catalogue``, with object and diameter_km; families: see ``cluster.ring_families``,
    with family_id.
    """
    rings = L.planetary_rings(seed)
    every = rings.unionByName(large.withColumns({"body": F.lit("Moon"), "source": F.lit("large_catalogue")}), allowMissingColumns=True)
    compared = L.compare_planetary(families, every)
    return {"rings": rings, "planetary": every, "comparison": compared, "sizes": L.group_sizes(every, "source", "body"), "manifest": K.source_manifest({"rings": rings, "planetary": every, "comparison": compared}, fingerprints)}
