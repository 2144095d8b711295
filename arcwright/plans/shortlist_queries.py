"""Ranking, percentile and scoring queries over candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import ranking as R
from ..operators import shortlist as L
from .registry import query, rounded
from .views import duck, view

_STRATA = """, strata AS (
  SELECT c.*, CASE WHEN tid_land_fraction >= 0.8 THEN 'land' WHEN tid_land_fraction <= 0.2 THEN 'ocean' ELSE 'mixed' END AS domain,
    log10(greatest(diameter_km, 1e-6)) AS lg FROM candidates c
), edges AS (
  SELECT list_distinct(quantile_cont(lg, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM strata
), binned AS (
  SELECT strata.*, greatest(0, len(list_filter(e, lambda x: x < lg)) - 1)::INTEGER AS diameter_decile FROM strata, edges
)"""


def _pct(metric: str, name: str) -> str:
    return f"""CASE WHEN {metric} IS NULL THEN NULL ELSE
      (rank() OVER (PARTITION BY domain, diameter_decile ORDER BY {metric} NULLS LAST)
       + (count(*) OVER (PARTITION BY domain, diameter_decile, {metric}) - 1) / 2)
      / count({metric}) OVER (PARTITION BY domain, diameter_decile) END AS {name}"""


_SHORT = (
    duck("candidates")
    + _STRATA
    + f""", pct AS (
  SELECT *, {_pct("gravity_bouguer_ring_score", "pb")}, {_pct("gravity_freeair_ring_score", "pf")}, {_pct("magnetic_ring_score", "pm")} FROM binned
), cons AS (
  SELECT *, (coalesce(pb, 0) + coalesce(pf, 0)) / nullif((pb IS NOT NULL)::INT + (pf IS NOT NULL)::INT, 0) AS consensus,
    coalesce(least(pb, pf) >= 0.75, false) AS both_strong FROM pct
), tiered AS (
  SELECT *, CASE WHEN followup_score >= 0.75 AND both_strong AND tid_artifact_risk <= 0.25 THEN 'A_cross_layer'
    WHEN followup_score >= 0.75 AND consensus >= 0.75 AND tid_artifact_risk <= 0.35 THEN 'B_gravity_supported'
    WHEN followup_score >= 0.75 THEN 'C_morphology' ELSE 'D_background' END AS review_tier FROM cons
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY review_tier, followup_score DESC, coalesce(consensus, -1) DESC, candidate_id) AS review_rank FROM tiered
)"""
)


@query(
    "review_shortlist",
    _SHORT
    + """ SELECT candidate_id, domain, diameter_decile, review_tier, round(consensus, 6) AS consensus, round(pm, 6) AS magnetic_percentile,
      both_strong, review_rank FROM ranked""",
)
def review_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.review_shortlist(view(spark, sf_dir, "candidates"), ("candidate_id", "source_index"))  # six-digit ids repeat from a million candidates on
    return rounded(
        out.select(
            "candidate_id", "domain", "diameter_decile", "review_tier", F.col("gravity_consensus_percentile").alias("consensus"),
            F.col("magnetic_ring_score_stratified_percentile").alias("magnetic_percentile"),
            F.col("gravity_both_strong").alias("both_strong"), F.col("geophysical_review_rank").alias("review_rank"),
        )
    )


@query(
    "tier_counts",
    _SHORT
    + """ SELECT nth::INTEGER AS nth, value, (SELECT count(*) FROM ranked WHERE review_tier = value)::BIGINT AS n
      FROM (VALUES (0, 'A_cross_layer'), (1, 'B_gravity_supported'), (2, 'C_morphology'), (3, 'D_background')) t(nth, value)""",
)
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_in_order(L.review_shortlist(view(spark, sf_dir, "candidates")), "review_tier", S.TIERS)


@query(
    "evidence_matrix",
    _SHORT
    + """, chosen AS (SELECT * FROM ranked WHERE review_tier IN ('A_cross_layer', 'B_gravity_supported'))
      SELECT candidate_id, review_tier, round(followup_score, 6) AS morphology,
        round((count(*) OVER () - rank() OVER (ORDER BY followup_score DESC) - (count(*) OVER (PARTITION BY followup_score) - 1) / 2 + 1) / count(*) OVER (), 6) AS morphology_percentile,
        round(pb, 6) AS bouguer, round(pf, 6) AS freeair, round(pm, 6) AS magnetic, round(1 - tid_artifact_risk, 6) AS cleanliness FROM chosen""",
)
def evidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.review_shortlist(view(spark, sf_dir, "candidates")).where(F.col("review_tier").isin(*S.TIERS[:2]))
    rows = R.percentiles_within(rows, "candidate_id", [], {"followup_score": "morphology_percentile"})
    return rounded(
        rows.select(
            "candidate_id", "review_tier", F.col("followup_score").alias("morphology"), "morphology_percentile",
            *[F.col(f"{m}_stratified_percentile").alias(n) for m, n in zip(L.METRICS, ("bouguer", "freeair", "magnetic"), strict=True)],
            (1 - F.col("tid_artifact_risk")).alias("cleanliness"),
        )
    )


@query(
    "domain_percentile_descending",
    duck("candidates")
    + _STRATA
    + """ SELECT candidate_id, domain, round((rank() OVER (PARTITION BY domain ORDER BY followup_score DESC)
        + (count(*) OVER (PARTITION BY domain, followup_score) - 1) / 2) / count(*) OVER (PARTITION BY domain), 6) AS pct FROM strata""",
)
def domain_percentile_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates").withColumn("domain", S.domain("tid_land_fraction"))
    return rounded(R.percentiles_within(rows, "candidate_id", ["domain"], {"followup_score": "pct"}, descending=True).select("candidate_id", "domain", "pct"))


@query(
    "ecdf_percentile",
    duck("candidates", "controls")
    + _STRATA
    + """, ref AS (SELECT domain, gravity_bouguer_ring_score AS v FROM strata WHERE gravity_bouguer_ring_score IS NOT NULL AND domain <> 'mixed'),
      asked AS (SELECT negative_control_id, CASE WHEN radius_km > 300 THEN 'land' WHEN radius_km > 200 THEN 'mixed' ELSE 'ocean' END AS domain, gravity_consensus_used AS v FROM controls)
      SELECT negative_control_id, domain, round(CASE WHEN v IS NULL THEN NULL ELSE coalesce(
          (SELECT count(*) FILTER (WHERE r.v <= asked.v) / nullif(count(*), 0) FROM ref r WHERE r.domain = asked.domain),
          (SELECT count(*) FILTER (WHERE r.v <= asked.v) / count(*) FROM ref r)) END, 6) AS pct FROM asked""",
)
def ecdf_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = view(spark, sf_dir, "candidates").select(S.domain("tid_land_fraction").alias("domain"), F.col("gravity_bouguer_ring_score").alias("v")).where("domain <> 'mixed'")
    size = F.when(F.col("radius_km") > 300, "land").when(F.col("radius_km") > 200, "mixed").otherwise("ocean")
    rows = view(spark, sf_dir, "controls").select("negative_control_id", size.alias("domain"), F.col("gravity_consensus_used").alias("v"))
    return rounded(R.ecdf_percentile(rows, ref, ["domain"], "v", "pct").select("negative_control_id", "domain", "pct"))


@query(
    "decile_right_side",
    duck("candidates", "controls")
    + """, edges AS (SELECT quantile_cont(log10(diameter_km), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM candidates)
      SELECT negative_control_id, len(list_filter(e, lambda x: x <= log10(diameter_km)))::INTEGER AS decile FROM controls, edges""",
)
def decile_right_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = view(spark, sf_dir, "candidates").select(F.log10("diameter_km").alias("v"))
    edges = R.exact_quantiles(ref, "v", [i / 10 for i in range(1, 10)])
    return view(spark, sf_dir, "controls").select("negative_control_id", R.bins_left_closed(F.log10("diameter_km"), edges).alias("decile"))


@query(
    "equal_count_bins",
    duck("candidates")
    + """, r AS (SELECT candidate_id, row_number() OVER (ORDER BY radius_km, candidate_id) AS rn, count(*) OVER () AS n FROM candidates)
      SELECT candidate_id, greatest(0, ceil(5.0::DOUBLE * (rn - 1) / (n - 1)) - 1)::INTEGER AS bin FROM r""",
)
def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.equal_count_bins(view(spark, sf_dir, "candidates"), "radius_km", ["candidate_id"], 5, "bin").select("candidate_id", "bin")


@query(
    "gravity_first",
    duck("candidates")
    + """, s AS (
      SELECT candidate_id, followup_score AS m, gravity_bouguer_ring_score AS g, magnetic_ring_score AS mag, tid_artifact_risk AS r, diameter_km AS d FROM candidates
    ), w AS (
      SELECT *, (0.45::DOUBLE * m + coalesce(0.45::DOUBLE * g, 0) + 0.10::DOUBLE * (1 - r)) / (0.45::DOUBLE + CASE WHEN g IS NULL THEN 0 ELSE 0.45::DOUBLE END + 0.10::DOUBLE) AS score,
        CASE WHEN g IS NULL THEN m WHEN m = 0 OR g = 0 THEN 0 ELSE 2 / (1 / m + 1 / g) END AS agreement FROM s
    )
    SELECT candidate_id, round(score, 6) AS score, round(agreement, 6) AS agreement, coalesce(g >= 0.75, false) AS gravity_strong, coalesce(g <= 0.25, false) AS gravity_weak,
      coalesce(mag >= 0.75, false) AS magnetic_supporting, coalesce(mag <= 0.25, false) AS magnetic_discordant, r > 0.25 AS tid_risk_high,
      d >= 1000 AS large_scale_regime, d < 10 AS sub_10km_resolution_warning, mag IS NOT NULL AS magnetic_evidence_available,
      row_number() OVER (ORDER BY round(score, 12) DESC, candidate_id) AS gravity_first_rank FROM w""",
)
def gravity_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates").select(
        "candidate_id", "source_index", F.col("followup_score").alias("morphology"), F.col("gravity_bouguer_ring_score").alias("gravity"),
        F.col("magnetic_ring_score").alias("magnetic"), F.col("tid_artifact_risk").alias("risk"), "diameter_km",
    )
    out = L.gravity_first(rows).withColumn("_s", F.round("gravity_first_review_score", 12))
    out = R.number_rows(out.drop("gravity_first_rank"), "_s", ["candidate_id", "source_index"], "gravity_first_rank")
    flags = ["gravity_strong", "gravity_weak", "magnetic_supporting", "magnetic_discordant", "tid_risk_high", "large_scale_regime", "sub_10km_resolution_warning", "magnetic_evidence_available"]
    return rounded(out.select("candidate_id", F.col("gravity_first_review_score").alias("score"), F.col("gravity_morphology_agreement").alias("agreement"), *flags, "gravity_first_rank"))


@query(
    "preservation",
    duck("candidates")
    + _STRATA
    + """, st AS (
      SELECT candidate_id, domain, diameter_km AS km, gravity_bouguer_ring_score AS g,
        CASE WHEN diameter_km > 1000 THEN 'large_scale_regime_uncertain'
          WHEN domain = 'ocean' AND coalesce(sediment_thickness_km < 1, true) THEN 'oceanic_volcanic_or_margin_confounded'
          WHEN sediment_thickness_km >= 1 THEN 'buried_sedimentary'
          WHEN domain = 'land' AND diameter_km >= 20 THEN 'eroded_exposed' WHEN domain = 'land' THEN 'fresh_or_shallow'
          ELSE 'insufficient_context' END AS state FROM strata
    )
    SELECT candidate_id, state AS preservation_state, km >= 4 AND state <> 'large_scale_regime_uncertain' AS central_uplift_possible, km >= 10 AS annular_faulting_possible,
      state IN ('eroded_exposed', 'fresh_or_shallow') AS breccia_pseudotachylite_target,
      state IN ('eroded_exposed', 'fresh_or_shallow') AND domain = 'land' AS shocked_quartz_pdf_target,
      state IN ('eroded_exposed', 'fresh_or_shallow', 'buried_sedimentary') AS impact_melt_target,
      state IN ('fresh_or_shallow', 'buried_sedimentary') AS projectile_geochemistry_plausible, state = 'buried_sedimentary' AS drilling_required,
      state IN ('buried_sedimentary', 'large_scale_regime_uncertain') OR domain IN ('ocean', 'mixed') OR coalesce(g >= 0.75, false) AS gravity_seismic_modelling_priority,
      CASE WHEN state = 'large_scale_regime_uncertain' THEN 'separate scale-regime validation and lithospheric gravity/seismic modelling'
        WHEN state = 'buried_sedimentary' THEN 'seismic and gravity modelling, then archived core or targeted drilling'
        WHEN domain = 'ocean' THEN 'bathymetric, seismic, gravity, and volcanic-chain modelling before sampling'
        WHEN domain = 'land' AND km > 20 AND coalesce(g >= 0.75, false) THEN 'mapped structural transects plus archived sample and core search'
        WHEN domain = 'land' THEN 'field mapping, petrography, and targeted structural sampling'
        ELSE 'acquire geological, sediment, and crustal context before genetic interpretation' END AS recommended_follow_up FROM st""",
)
def preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates").withColumn("domain", S.domain("tid_land_fraction")).withColumn("gravity", F.col("gravity_bouguer_ring_score"))
    return L.preservation(rows)


@query(
    "ranking_summary",
    duck("candidates")
    + """, b AS (SELECT candidate_id FROM candidates ORDER BY followup_score DESC, candidate_id LIMIT 20),
      l AS (SELECT string_agg(candidate_id, ';' ORDER BY followup_score DESC, candidate_id) AS top_ids FROM candidates SEMI JOIN b USING (candidate_id)),
      q AS (SELECT count(*) AS n, quantile_cont(followup_score, [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS v FROM candidates)
      SELECT n AS n_candidates, round(v[1], 6) AS "min", round(v[2], 6) AS q25, round(v[3], 6) AS median, round(v[4], 6) AS q75, round(v[5], 6) AS q90,
        round(v[6], 6) AS q95, round(v[7], 6) AS q99, round(v[8], 6) AS "max", top_ids FROM q, l""",
)
def ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.ranking_summary(view(spark, sf_dir, "candidates"), "followup_score"))


@query(
    "priority_score",
    duck("candidates")
    + """ SELECT candidate_id, round((1 - tid_artifact_risk) * CASE WHEN magnetic_ring_score IS NULL THEN 0.78::DOUBLE * followup_score + 0.22::DOUBLE * geometry_angular_coverage
        ELSE 0.58::DOUBLE * followup_score + 0.22::DOUBLE * geometry_angular_coverage + 0.20::DOUBLE * magnetic_ring_score END, 6) AS priority_score,
        row_number() OVER (ORDER BY followup_score DESC, source_index) AS rank FROM candidates""",
)
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates")
    score = S.priority_score(1 - F.col("tid_artifact_risk"), "followup_score", "geometry_angular_coverage", "magnetic_ring_score")
    out = R.number_rows(rows.withColumn("priority_score", score), "followup_score", ["source_index"], "rank")
    return rounded(out.select("candidate_id", "priority_score", "rank"))
