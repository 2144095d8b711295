"""Distribution and resampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import spatial as J
from ..operators import stats as T
from ..operators.ranking import equal_count_bins
from ..operators.shortlist import with_strata
from .registry import query, rounded
from .spatial_queries import km
from .views import duck, view

REPS, SEED = 40, 7


def _draw(seed: int, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


@query(
    "power_law_tail",
    duck("candidates")
    + """, c AS (SELECT diameter_km::DOUBLE AS v, count(*) AS k FROM candidates GROUP BY 1),
      t AS (SELECT v, k, sum(k) OVER (ORDER BY v DESC) AS n, sum(k * ln(v)) OVER (ORDER BY v DESC) AS s FROM c),
      x AS (SELECT v AS xmin, n, 1 + n / (s - n * ln(v)) AS alpha FROM t WHERE n >= 25 AND v < (SELECT max(v) FROM c)),
      f AS (SELECT xmin, alpha, x.n, max(greatest(abs((x.n - (t.n - t.k)) / x.n - (1 - pow(t.v / xmin, 1 - alpha))), abs((x.n - t.n + 1) / x.n - (1 - pow(t.v / xmin, 1 - alpha))))) AS ks
        FROM x JOIN t ON t.v >= xmin GROUP BY 1, 2, 3)
      SELECT round(xmin, 6) AS xmin, round(alpha, 6) AS alpha_pdf, n::BIGINT AS n, round(ks, 6) AS ks FROM f ORDER BY f.ks, f.xmin LIMIT 1""",
)
def power_law_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.power_law_tail(view(spark, sf_dir, "candidates"), "diameter_km"))


@query(
    "ks_two_sample",
    duck("candidates", "catalogue")
    + """, b AS (SELECT radius_km AS v, 1 AS x, 0 AS y FROM candidates UNION ALL SELECT radius_km, 0, 1 FROM catalogue),
      c AS (SELECT v, sum(sum(x)) OVER (ORDER BY v) / (SELECT sum(x) FROM b) AS f, sum(sum(y)) OVER (ORDER BY v) / (SELECT sum(y) FROM b) AS g FROM b GROUP BY v)
      SELECT round(max(abs(f - g)), 6) AS ks FROM c""",
)
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.ks_two_sample(view(spark, sf_dir, "candidates"), view(spark, sf_dir, "catalogue"), "radius_km"))


def _grid_round(n: int, half: float, mid: str) -> str:
    """One refinement of the shift: the 41 shifts about ``mid``, their distances, and the best of them."""
    return f""", g{n} AS (SELECT ({mid}) + {half} * (2 * i / 40 - 1) AS s FROM (SELECT unnest(range(0, 41)) AS i)),
      u{n} AS (SELECT s, v, sum(x) AS x, sum(y) AS y FROM (SELECT s, l AS v, 1 AS x, 0 AS y FROM lx, g{n} UNION ALL SELECT s, l + s, 0, 1 FROM ly, g{n}) b GROUP BY 1, 2),
      k{n} AS (SELECT s, max(abs(fx / nx - fy / ny)) AS ks FROM (SELECT s, sum(x) OVER w AS fx, sum(y) OVER w AS fy, sum(x) OVER p AS nx, sum(y) OVER p AS ny FROM u{n} WINDOW w AS (PARTITION BY s ORDER BY v), p AS (PARTITION BY s)) c GROUP BY 1),
      r{n} AS (SELECT s, ks FROM k{n} ORDER BY ks, s LIMIT 1)"""


@query(
    "ks_scaled",
    duck("candidates", "catalogue")
    + ", lx AS (SELECT ln(radius_km) AS l FROM candidates), ly AS (SELECT ln(radius_km) AS l FROM catalogue)"
    + _grid_round(1, 5.0, "(SELECT median(l) FROM lx) - (SELECT median(l) FROM ly)")
    + _grid_round(2, 0.25, "SELECT s FROM r1")
    + _grid_round(3, 0.0125, "SELECT s FROM r2")
    + " SELECT round(exp(s), 5) AS scale, round(ks, 5) AS ks FROM r3",
)
def ks_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.ks_scaled(view(spark, sf_dir, "candidates"), view(spark, sf_dir, "catalogue"), "radius_km"), 5)


@query("ks_permutation")
def ks_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("id"), "radius_km")
    y = view(spark, sf_dir, "catalogue").select(F.col("record_id").alias("id"), "radius_km")
    return rounded(T.null_summary(T.ks_permutation(x, y, "id", "radius_km", 10, SEED), "ks"))


@query(
    "survival",
    duck("candidates") + """ SELECT v, n::BIGINT AS n, round(sum(n) OVER (ORDER BY v DESC) / sum(n) OVER (), 6) AS survival FROM (SELECT radius_km AS v, count(*) AS n FROM candidates GROUP BY 1)""",
)
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.survival(view(spark, sf_dir, "candidates"), "radius_km"))


@query(
    "size_bins",
    duck("candidates")
    + """, b(nth, label, lo, hi) AS (VALUES (0, '10-50', 10, 50), (1, '50-100', 50, 100), (2, '100-300', 100, 300), (3, '300-1000', 300, 1000), (4, '1000-5000', 1000, 5000), (5, '>=5000', 5000, 1e30))
      SELECT nth::INTEGER AS nth, label, count(candidate_id) AS n, round(100 * count(candidate_id) / (SELECT count(*) FROM candidates WHERE diameter_km >= 10), 6) AS percent
      FROM b LEFT JOIN candidates ON diameter_km >= lo AND diameter_km < hi GROUP BY 1, 2""",
)
def size_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.labelled_bins(view(spark, sf_dir, "candidates"), "diameter_km", [10.0, 50.0, 100.0, 300.0, 1000.0, 5000.0]))


@query(
    "log_density",
    duck("candidates")
    + """, v AS (SELECT log10(diameter_km) AS x FROM candidates), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM v),
      b AS (SELECT least(31, floor((x - lo) / ((hi - lo) / 32)))::INTEGER AS bin, lo, hi, e.n AS al FROM v, e)
      SELECT bin, count(*) AS n, round(count(*) / (al * (hi - lo) / 32), 6) AS density FROM b GROUP BY bin, al, lo, hi""",
)
def log_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.density_bins(view(spark, sf_dir, "candidates").select(F.log10("diameter_km").alias("x")), "x"))


@query(
    "spearman",
    duck("candidates")
    + """, r AS (SELECT rank() OVER (ORDER BY followup_score) + (count(*) OVER (PARTITION BY followup_score) - 1) / 2 AS a,
        rank() OVER (ORDER BY magnetic_ring_score) + (count(*) OVER (PARTITION BY magnetic_ring_score) - 1) / 2 AS b FROM candidates WHERE magnetic_ring_score IS NOT NULL)
      SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.spearman(view(spark, sf_dir, "candidates"), "followup_score", "magnetic_ring_score", "candidate_id"))


_ROT = (
    duck("catalogue", "candidates")
    + f""", p AS (SELECT rep, record_id, lat, ((lon + CASE WHEN rep < 0 THEN 0 ELSE 360 * {_draw(SEED, "rep")} - 180 END + 180) % 360 + 360) % 360 - 180 AS lon
        FROM catalogue, (SELECT unnest(range(-1, {REPS})) AS rep) WHERE eid_match),
      n AS (SELECT rep, record_id, min({km("a", "b")}) AS km FROM p a, candidates b GROUP BY 1, 2),
      reps AS (SELECT rep::INTEGER AS rep, count(*) FILTER (WHERE km <= 100) AS count_within, median(km) AS median_km FROM n GROUP BY 1)"""
)


def _rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "catalogue").where("eid_match")
    return T.rotation_null(points, "record_id", view(spark, sf_dir, "candidates"), "candidate_id", REPS, SEED)


@query("rotation_null", _ROT + " SELECT rep, count_within, round(median_km, 5) AS median_km FROM reps")
def rotation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rotation(spark, sf_dir), 5)


@query(
    "rotation_summary",
    _ROT
    + """ SELECT round(o.count_within, 6)::DOUBLE AS observed, round(avg(r.count_within), 6) AS null_mean, round(quantile_cont(r.count_within, 0.025), 6) AS null_low,
      round(median(r.count_within), 6) AS null_median, round(quantile_cont(r.count_within, 0.975), 6) AS null_high,
      round((1 + count(*) FILTER (WHERE r.count_within >= o.count_within)) / (count(*) + 1), 6) AS p FROM reps r, (SELECT count_within FROM reps WHERE rep < 0) o WHERE r.rep >= 0 GROUP BY o.count_within""",
)
def rotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.null_summary(_rotation(spark, sf_dir), "count_within"))


@query(
    "label_null",
    duck("catalogue", "candidates")
    + f""", n AS (SELECT a.record_id, a.eid_match, min({km("a", "b")}) AS km FROM catalogue a, candidates b GROUP BY 1, 2),
      d AS (SELECT rep, km, row_number() OVER (PARTITION BY rep ORDER BY {_draw(SEED, "rep", "record_id")}, record_id) AS nth FROM n, (SELECT unnest(range(0, {REPS})) AS rep)),
      x AS (SELECT rep, km FROM d WHERE nth <= (SELECT count(*) FROM n WHERE eid_match) UNION ALL SELECT -1, km FROM n WHERE eid_match)
      SELECT rep::INTEGER AS rep, count(*) FILTER (WHERE km <= 100) AS count_within, round(median(km), 5) AS median_km FROM x GROUP BY 1""",
)
def label_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "catalogue")
    near = J.nearest_neighbour(points, "record_id", view(spark, sf_dir, "candidates"), "candidate_id")
    rows = near.join(points.select("record_id", "eid_match"), "record_id")
    return rounded(T.label_null(rows, "record_id", "eid_match", "distance_km", REPS, SEED), 5)


_NULLS = """, obs AS (SELECT candidate_id, magnetic_ring_score AS v FROM candidates),
  nulls AS (SELECT candidate_id, i AS null_index, CASE WHEN (source_index + i) % 11 = 0 THEN NULL ELSE (source_index * 37 + i * 101) % 1000 / 1000 END AS v
    FROM candidates, (SELECT unnest(range(0, 19)) AS i))"""


def _nulls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "candidates")
    obs = rows.select("candidate_id", F.col("magnetic_ring_score").alias("v"))
    nulls = rows.select("candidate_id", "source_index", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("null_index"))
    v = F.when((F.col("source_index") + F.col("null_index")) % 11 != 0, ((F.col("source_index") * 37 + F.col("null_index") * 101) % 1000) / 1000)
    return obs, nulls.select("candidate_id", "null_index", v.alias("v"))


@query(
    "candidate_p",
    duck("candidates")
    + _NULLS
    + """ SELECT o.candidate_id, CASE WHEN o.v IS NULL OR count(n.v) = 0 THEN NULL ELSE round((1 + count(*) FILTER (WHERE n.v >= o.v)) / (count(n.v) + 1), 6) END AS p, count(n.v) AS n_null
      FROM obs o LEFT JOIN nulls n ON n.candidate_id = o.candidate_id GROUP BY o.candidate_id, o.v""",
)
def candidate_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, nulls = _nulls(spark, sf_dir)
    return rounded(T.candidate_p(obs, nulls, "candidate_id", "v"))


@query(
    "global_null",
    duck("candidates")
    + _NULLS
    + f""", p AS (SELECT rep, o.candidate_id, floor({_draw(SEED, "rep", "o.candidate_id")} * 19)::INTEGER AS i FROM obs o, (SELECT unnest(range(0, {REPS})) AS rep) WHERE o.v IS NOT NULL),
      x AS (SELECT rep, n.v FROM p JOIN nulls n ON n.candidate_id = p.candidate_id AND n.null_index = p.i UNION ALL SELECT -1, v FROM obs WHERE v IS NOT NULL)
      SELECT rep::INTEGER AS rep, round(median(v), 6) AS median FROM x GROUP BY 1""",
)
def global_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, nulls = _nulls(spark, sf_dir)
    return rounded(T.global_null(obs, nulls, "candidate_id", "v", REPS, SEED))


@query(
    "stratified_null",
    duck("candidates")
    + f""", s AS (SELECT candidate_id, CASE WHEN tid_land_fraction >= 0.8 THEN 'land' WHEN tid_land_fraction <= 0.2 THEN 'ocean' ELSE 'mixed' END AS domain,
        rank() OVER (ORDER BY followup_score) + (count(*) OVER (PARTITION BY followup_score) - 1) / 2 AS rx,
        rank() OVER (ORDER BY magnetic_ring_score) + (count(*) OVER (PARTITION BY magnetic_ring_score) - 1) / 2 AS ry FROM candidates WHERE magnetic_ring_score IS NOT NULL),
      m AS (SELECT rep, domain, rx, ry, row_number() OVER (PARTITION BY rep, domain ORDER BY candidate_id) AS i,
        row_number() OVER (PARTITION BY rep, domain ORDER BY {_draw(SEED, "rep", "candidate_id")}, candidate_id) AS j FROM s, (SELECT unnest(range(0, {REPS})) AS rep)),
      x AS (SELECT a.rep, corr(a.rx, b.ry) AS rho FROM m a JOIN m b ON a.rep = b.rep AND a.domain = b.domain AND a.i = b.j GROUP BY a.rep UNION ALL SELECT -1, corr(rx, ry) FROM s)
      SELECT rep::INTEGER AS rep, round(rho, 6) AS rho FROM x""",
)
def stratified_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates").withColumn("domain", S.domain("tid_land_fraction"))
    return rounded(T.stratified_null(rows, "candidate_id", ["domain"], "followup_score", "magnetic_ring_score", REPS, SEED))


@query(
    "matched_null",
    duck("candidates")
    + f""", b AS (SELECT candidate_id, CASE WHEN tid_land_fraction >= 0.8 THEN 'land' WHEN tid_land_fraction <= 0.2 THEN 'ocean' ELSE 'mixed' END AS domain,
        greatest(0, ceil(5.0::DOUBLE * (row_number() OVER (ORDER BY radius_km, candidate_id) - 1) / (count(*) OVER () - 1)) - 1)::INTEGER AS rb,
        greatest(0, ceil(4.0::DOUBLE * (row_number() OVER (ORDER BY abs(lat), candidate_id) - 1) / (count(*) OVER () - 1)) - 1)::INTEGER AS lb,
        followup_score > 0.97 AS is_case, (source_index % 3 = 0)::INT AS hit, ln(1 + tid_artifact_risk) AS lr FROM candidates),
      ca AS (SELECT * FROM b WHERE is_case), co AS (SELECT * FROM b WHERE NOT is_case),
      n1 AS (SELECT domain, rb, lb, count(*) AS n FROM co GROUP BY ALL), n2 AS (SELECT domain, rb, count(*) AS n FROM co GROUP BY ALL), n3 AS (SELECT domain, count(*) AS n FROM co GROUP BY ALL),
      cs AS (SELECT ca.*, CASE WHEN coalesce(n1.n, 0) >= 3 THEN 1 WHEN coalesce(n2.n, 0) >= 3 THEN 2 ELSE 3 END AS lvl, CASE WHEN coalesce(n1.n, 0) >= 3 THEN n1.n WHEN coalesce(n2.n, 0) >= 3 THEN n2.n ELSE n3.n END AS sz
        FROM ca LEFT JOIN n1 USING (domain, rb, lb) LEFT JOIN n2 USING (domain, rb) LEFT JOIN n3 USING (domain)),
      k AS (SELECT rep, cs.*, floor({_draw(954, "rep", "candidate_id")} * sz)::INTEGER AS i FROM cs, (SELECT unnest(range(0, {REPS})) AS rep)),
      o AS (SELECT *, row_number() OVER (PARTITION BY domain, rb, lb ORDER BY candidate_id) - 1 AS i1, row_number() OVER (PARTITION BY domain, rb ORDER BY candidate_id) - 1 AS i2,
        row_number() OVER (PARTITION BY domain ORDER BY candidate_id) - 1 AS i3 FROM co),
      x AS (SELECT k.rep, o.hit, o.lr FROM k JOIN o ON k.domain = o.domain AND ((lvl = 1 AND k.rb = o.rb AND k.lb = o.lb AND i = i1) OR (lvl = 2 AND k.rb = o.rb AND i = i2) OR (lvl = 3 AND i = i3))
        UNION ALL SELECT -1, hit, lr FROM ca)
      SELECT rep::INTEGER AS rep, round(avg(hit), 6) AS fraction, round(median(lr), 6) AS median_log FROM x GROUP BY 1""",
)
def matched_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates").withColumn("domain", S.domain("tid_land_fraction")).withColumn("alat", F.abs("lat"))
    rows = equal_count_bins(equal_count_bins(rows, "radius_km", ["candidate_id"], 5, "rb"), "alat", ["candidate_id"], 4, "lb")
    rows = rows.withColumn("hit", (F.col("source_index") % 3 == 0).cast("int")).withColumn("lr", F.log1p("tid_artifact_risk"))
    cases, controls = rows.where("followup_score > 0.97"), rows.where("followup_score <= 0.97")
    levels = [["domain", "rb", "lb"], ["domain", "rb"], ["domain"]]
    return rounded(T.matched_null(cases, controls, "candidate_id", levels, {"fraction": "avg:hit", "median_log": "median:lr"}, REPS, 954))


@query(
    "strata",
    duck("candidates")
    + """, q AS (SELECT list_distinct(quantile_cont(log10(diameter_km), [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM candidates)
      SELECT candidate_id, greatest(0, len(list_filter(e, lambda x: x < log10(diameter_km))) - 1)::INTEGER AS quartile FROM candidates, q""",
)
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_strata(view(spark, sf_dir, "candidates"), 4).select("candidate_id", F.col("diameter_decile").alias("quartile"))
