"""The review shortlist: percentiles within strata, review tiers and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .checkpoints import cut
from .ranking import bins_right_closed, exact_quantiles, number_rows, percentiles_within, range_cuts

METRICS = ("gravity_bouguer_ring_score", "gravity_freeair_ring_score", "magnetic_ring_score")


def with_strata(candidates: DataFrame, bins: int = 10) -> DataFrame:
    """Add domain and diameter_decile (right-closed quantile bins of the logarithm)."""
    rows = candidates.withColumn("domain", S.domain("tid_land_fraction"))
    rows = rows.withColumn("_log", F.log10(F.greatest(S.known("diameter_km"), F.lit(1e-6))))
    edges = exact_quantiles(rows, "_log", [i / bins for i in range(bins + 1)])
    return rows.withColumn("diameter_decile", bins_right_closed(F.col("_log"), edges)).drop("_log")


def review_shortlist(candidates: DataFrame, then: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """Candidates with stratified percentiles, consensus, tier and review rank.

    Needs candidate_id, diameter_km, followup_score, tid_land_fraction, tid_artifact_risk
    and the three ring scores. Missing scores are left out of percentiles and never pass
    a threshold. Ranks go by tier, score, consensus and the columns of ``then``.
    """
    rows = with_strata(candidates)
    rows = percentiles_within(rows, "candidate_id", ["domain", "diameter_decile"], {m: f"{m}_stratified_percentile" for m in METRICS})
    b, f = (F.col(f"{m}_stratified_percentile") for m in METRICS[:2])
    n = b.isNotNull().cast("int") + f.isNotNull().cast("int")
    consensus = F.when(n > 0, (F.coalesce(b, F.lit(0.0)) + F.coalesce(f, F.lit(0.0))) / n)
    rows = rows.withColumn("gravity_consensus_percentile", consensus)
    rows = rows.withColumn("gravity_both_strong", F.coalesce(F.least(b, f) >= 0.75, F.lit(False)))
    rows = rows.withColumn("tid_low_artifact_risk", S.at_most("tid_artifact_risk", 0.25))
    tier = S.review_tier("followup_score", "gravity_consensus_percentile", F.col("gravity_both_strong"), "tid_artifact_risk")
    rows = rows.withColumn("review_tier", tier).withColumn("_order", S.tier_order("review_tier"))
    # one number that sorts by tier, score and consensus: each score is in [0, 1]
    rows = rows.withColumn("_minus", -F.coalesce(S.known("followup_score"), F.lit(-1.0)))
    rows = rows.withColumn("_minus2", -F.coalesce(F.col("gravity_consensus_percentile"), F.lit(-1.0)))
    rows = cut(rows.withColumn("_key", F.col("_order") * 4 + F.col("_minus")))  # ranked in two passes
    cuts = sorted({4 * t - c for t in range(len(S.TIERS)) for c in [*range_cuts(candidates, "followup_score", 8), 1.5]})
    ranked = number_rows(rows, "_key", ["_minus2", *then], "geophysical_review_rank", descending=False, cuts=cuts)
    return ranked.drop("_order", "_minus", "_minus2", "_key")


def counts_in_order(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(value, n) for each of ``values`` in order, zero where there is none."""
    order = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, nth int")
    found = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return order.join(found, "value", "left").select("nth", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gravity_first(candidates: DataFrame, strong: float = 0.75, weak: float = 0.25, risky: float = 0.25, large_km: float = 1000.0, small_km: float = 10.0) -> DataFrame:
    """Gravity-first scores, flags and ranks. Needs candidate_id, morphology, gravity, magnetic, risk, diameter_km.

    Missing values fail every flag; candidates without a score come last, ties by id.
    """
    g, m, r, d = (S.known(c) for c in ("gravity", "magnetic", "risk", "diameter_km"))
    no = F.lit(False)
    rows = candidates.withColumns(
        {
            "morphology_score_used": S.bounded("morphology"),
            "gravity_consensus_used": S.bounded("gravity"),
            "gravity_morphology_agreement": S.harmonic_available("morphology", "gravity"),
            "tid_cleanliness": 1 - S.bounded("risk"),
            "gravity_first_review_score": S.gravity_first_score("morphology", "gravity", "risk"),
            "gravity_strong": F.coalesce(g >= strong, no),
            "gravity_weak": F.coalesce(g <= weak, no),
            "magnetic_supporting": F.coalesce(m >= strong, no),
            "magnetic_discordant": F.coalesce(m <= weak, no),
            "tid_risk_high": F.coalesce(r > risky, no),
            "large_scale_regime": F.coalesce(d >= large_km, no),
            "sub_10km_resolution_warning": F.coalesce(d < small_km, no),
            "magnetic_evidence_available": m.isNotNull(),
        }
    )
    return number_rows(rows, "gravity_first_review_score", ["candidate_id"], "gravity_first_rank")


def preservation(candidates: DataFrame) -> DataFrame:
    """(candidate_id, preservation_state, targets, recommended_follow_up); needs domain, diameter_km, sediment_thickness_km, gravity."""
    state = S.preservation_state("domain", "diameter_km", "sediment_thickness_km")
    rows = candidates.withColumn("preservation_state", state)
    targets = S.preservation_targets(F.col("preservation_state"), "domain", "diameter_km", "gravity")
    return rows.select("candidate_id", "preservation_state", *[c.alias(n) for n, c in targets.items()])


def ranking_summary(df: DataFrame, score: str, top: int = 20) -> DataFrame:
    """One row: count, eight score quantiles and the best ids."""
    at = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    names = ["min", "q25", "median", "q75", "q90", "q95", "q99", "max"]
    q = exact_quantiles(df, score, at) or [None] * len(at)
    best = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), "candidate_id").limit(top)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("m"), "candidate_id"))).alias("a"))
    ids = F.concat_ws(";", F.transform("a", lambda x: x["candidate_id"]))
    counts = df.agg(F.count(F.lit(1)).alias("n_candidates"))
    return counts.crossJoin(listed.select(ids.alias("top_ids"))).select("n_candidates", *[F.lit(v).cast("double").alias(n) for n, v in zip(names, q, strict=True)], "top_ids")
