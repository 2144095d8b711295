"""Distance joins, control matching, families and structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import scoring as S
from ..operators import cluster as C
from ..operators import spatial as J
from .registry import query, rounded
from .views import duck, view


def km(a: str, b: str) -> str:
    """SQL for the haversine distance of two rows."""
    return (
        f"(asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
        f" * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))) * 12742.0176::DOUBLE)"
    )


@query(
    "nearest_control",
    duck("candidates", "controls")
    + f""", d AS (SELECT a.candidate_id, b.negative_control_id, {km("a", "b")} AS km FROM candidates a, controls b),
      r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY km, negative_control_id) AS n FROM d)
      SELECT candidate_id, negative_control_id, round(km, 6) AS distance_km FROM r WHERE n = 1""",
)
def nearest_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.nearest_neighbour(view(spark, sf_dir, "candidates"), "candidate_id", view(spark, sf_dir, "controls"), "negative_control_id"))


@query(
    "duplicate_candidate",
    duck("catalogue", "candidates")
    + f""", d AS (SELECT a.record_id, b.candidate_id, {km("a", "b")} AS km, greatest(5, 0.25 * least(a.diameter_km, b.diameter_km)) AS lim FROM catalogue a, candidates b),
      r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY km, candidate_id) AS n FROM d WHERE km <= lim)
      SELECT c.record_id, r.candidate_id, round(r.km, 6) AS distance_km FROM catalogue c LEFT JOIN r ON r.record_id = c.record_id AND n = 1""",
)
def duplicate_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.nearest_within(view(spark, sf_dir, "catalogue"), "record_id", view(spark, sf_dir, "candidates"), "candidate_id"))


@query(
    "distance_pairs",
    duck("candidates")
    + f""" SELECT a.candidate_id AS a, b.candidate_id AS b, round({km("a", "b")}, 6) AS distance_km FROM candidates a, candidates b
      WHERE a.candidate_id < b.candidate_id AND {km("a", "b")} <= 500""",
)
def distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.distance_self_join(view(spark, sf_dir, "candidates"), "candidate_id", 500.0, digits=6)


@query(
    "overlap_pairs",
    duck("candidates")
    + f""" SELECT a.candidate_id AS a, b.candidate_id AS b, round({km("a", "b")}, 6) AS distance_km FROM candidates a, candidates b
      WHERE a.candidate_id < b.candidate_id AND {km("a", "b")} <= a.radius_km + b.radius_km""",
)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.overlapping_pairs(view(spark, sf_dir, "candidates"), "candidate_id", digits=6)


@query(
    "concentric_pairs",
    duck("clustered")
    + f""" SELECT a.candidate_id AS small, b.candidate_id AS large, round({km("a", "b")}, 6) AS distance_km, round(b.radius_km / a.radius_km, 6) AS ratio
      FROM clustered a, clustered b WHERE b.radius_km / a.radius_km >= 1.2 AND least(a.geometry_angular_coverage, b.geometry_angular_coverage) >= 0.35
      AND {km("a", "b")} <= 0.25 * a.radius_km""",
)
def concentric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "clustered").where("geometry_angular_coverage >= 0.35")
    return J.centered_pairs(rows, "candidate_id", 0.25, 1.2, None, digits=6).select("small", "large", "distance_km", "ratio")


@query(
    "compatible_pairs",
    duck("clustered")
    + f""" SELECT a.candidate_id AS small, b.candidate_id AS large, round({km("a", "b")}, 6) AS distance_km FROM clustered a, clustered b
      WHERE (a.radius_km < b.radius_km OR (a.radius_km = b.radius_km AND a.candidate_id < b.candidate_id)) AND b.radius_km / a.radius_km <= 1.5
      AND {km("a", "b")} <= 0.25 * a.radius_km""",
)
def compatible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.centered_pairs(view(spark, sf_dir, "clustered"), "candidate_id", 0.25, 1.0, 1.5, digits=6).select("small", "large", "distance_km")


@query(
    "control_match",
    duck("candidates", "controls")
    + f""", d AS (SELECT a.candidate_id, a.radius_km AS r, a.diameter_km AS dk, a.followup_score AS m, a.gravity_bouguer_ring_score AS g, b.*, {km("a", "b")} AS km FROM candidates a, controls b),
      n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY km, negative_control_id) AS nth FROM d),
      s AS (SELECT *, least(dk, diameter_km) / greatest(dk, diameter_km) AS s1,
          CASE WHEN greatest(m, morphology_score_used) > 0 THEN least(m, morphology_score_used) / greatest(m, morphology_score_used) END AS s2,
          CASE WHEN g IS NOT NULL AND gravity_consensus_used IS NOT NULL AND greatest(g, gravity_consensus_used) > 0 THEN least(g, gravity_consensus_used) / greatest(g, gravity_consensus_used) END AS s3,
          2 + (g IS NOT NULL AND gravity_consensus_used IS NOT NULL)::INT AS used FROM n WHERE nth = 1),
      t AS (SELECT *, (s1 + coalesce(s2, 0) + coalesce(s3, 0)) / (1 + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT) AS sim, km <= r + radius_km AS over,
          km <= greatest(250, 2 * (r + radius_km)) AS nearby FROM s)
      SELECT candidate_id, negative_control_id AS nearest_negative_control_id, negative_control_class AS nearest_negative_control_class, round(km, 6) AS nearest_negative_control_distance_km,
        over AS overlapping_negative_control, round(sim, 6) AS control_similarity_score, used::INTEGER AS control_similarity_channels_used, nearby AS control_similarity_nearby,
        over OR (nearby AND sim >= 0.75) AS control_similarity_warning FROM t""",
)
def control_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates").withColumns({"morphology_score_used": F.col("followup_score"), "gravity_consensus_used": F.col("gravity_bouguer_ring_score")})
    return rounded(J.match_controls(rows, view(spark, sf_dir, "controls")))


def _families(pairs: str, source: str) -> str:
    return f""", pairs AS ({pairs}), edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
      walk AS (SELECT source_index AS node, source_index AS root FROM {source} UNION SELECT e.a, w.root FROM walk w JOIN edges e ON e.b = w.node),
      comp AS (SELECT node, min(root) AS root FROM walk GROUP BY node)"""


@query(
    "regional_families",
    duck("candidates").replace("WITH ", "WITH RECURSIVE ", 1)
    + _families(f"SELECT a.source_index AS a, b.source_index AS b FROM candidates a, candidates b WHERE a.source_index < b.source_index AND {km('a', 'b')} <= 90", "candidates")
    + f""", ov AS (SELECT DISTINCT a.candidate_id FROM candidates a, candidates b WHERE a.candidate_id <> b.candidate_id AND {km("a", "b")} <= a.radius_km + b.radius_km),
      nums AS (SELECT root, 'regional_family_' || lpad(row_number() OVER (ORDER BY root)::VARCHAR, 4, '0') AS fam, n FROM (SELECT root, count(*) AS n FROM comp GROUP BY root) x)
      SELECT c.candidate_id, fam AS regional_family_id, n AS regional_family_member_count, ov.candidate_id IS NOT NULL AS overlapping_large_candidate,
        CASE WHEN n = 1 THEN 'geographically isolated at configured scale' ELSE 'geographic cluster; test shared tectonic/volcanic fabric and selection bias' END AS regional_context_flag,
        CASE WHEN c.source_index % 50 = 0 THEN 'case ' || c.candidate_id END AS special_regional_case
      FROM candidates c JOIN comp ON comp.node = c.source_index JOIN nums USING (root) LEFT JOIN ov ON ov.candidate_id = c.candidate_id""",
)
def regional_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates")
    cases = rows.where("source_index % 50 = 0").select("candidate_id", F.concat(F.lit("case "), "candidate_id").alias("special_regional_case"))
    return C.regional_families(rows, 90.0, cases)


def _cliques(n: str, rows: str, pairs: str) -> str:
    """CTEs that end with cl{n} (rk, step, lead): clusters formed row by row, the rows of independent components at the same step.

    rows: SELECT of rk and more from the view; pairs: SELECT of e, l (ranks, e before l) and w from rw{n} a, rw{n} b.
    """
    return f""", rw{n} AS ({rows}), prs{n} AS ({pairs}), edges{n} AS (SELECT e AS a, l AS b FROM prs{n} UNION ALL SELECT l, e FROM prs{n}),
      walk{n} AS (SELECT rk AS node, rk AS root FROM rw{n} UNION SELECT x.b, w.root FROM walk{n} w JOIN edges{n} x ON x.a = w.node),
      st{n} AS (SELECT node AS rk, row_number() OVER (PARTITION BY root ORDER BY node) AS step FROM (SELECT node, min(root) AS root FROM walk{n} GROUP BY node) c),
      cl{n}(rk, step, lead) USING KEY (rk) AS (
        SELECT rk, step, rk FROM st{n} WHERE step = 1
        UNION
        SELECT x.rk, x.step, coalesce(b.lead, x.rk) FROM (SELECT * FROM st{n} WHERE step = (SELECT max(step) + 1 FROM cl{n})) x
        LEFT JOIN (
          SELECT l, arg_min(lead, {{'w': w, 'lead': lead}}) AS lead FROM (
            SELECT q.* FROM (SELECT p.l, c.lead, count(*) AS k, min(p.w) FILTER (WHERE p.e = c.lead) AS w FROM prs{n} p JOIN recurring.cl{n} c ON c.rk = p.e GROUP BY p.l, c.lead) q
            JOIN (SELECT lead, count(*) AS size FROM recurring.cl{n} GROUP BY lead) s ON s.lead = q.lead AND q.k = s.size) f
          GROUP BY l) b ON b.l = x.rk)"""


_RANKED = "SELECT candidate_id, source_index, followup_score, radius_km AS r, lon, lat, row_number() OVER (ORDER BY followup_score DESC, candidate_id) AS rk FROM clustered"


def _consolidated(n: str, fraction: float, low: float, high: float) -> str:
    near = f"SELECT a.rk AS e, b.rk AS l, {km('a', 'b')} / least(a.r, b.r) AS w FROM rw{n} a, rw{n} b WHERE a.rk < b.rk AND b.r / a.r BETWEEN {low} AND {high} AND {km('a', 'b')} <= {fraction} * least(a.r, b.r)"
    return _cliques(n, _RANKED, near)


_CLUSTERED = duck("clustered").replace("WITH ", "WITH RECURSIVE ", 1)
_STRUCTURES = (
    _CLUSTERED
    + _consolidated("", *C.SETTINGS["default"])
    + """, m AS (SELECT rw.*, cl.lead FROM rw JOIN cl USING (rk)), named AS (SELECT lead, 'structure_' || lpad(row_number() OVER (ORDER BY lead)::VARCHAR, 4, '0') AS structure_id FROM (SELECT DISTINCT lead FROM cl) d)"""
)


@query(
    "structure_consolidation",
    _STRUCTURES + " SELECT m.candidate_id, structure_id, f.candidate_id AS representative_id FROM m JOIN named USING (lead) JOIN rw f ON f.rk = m.lead",
)
def structure_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consolidate(view(spark, sf_dir, "clustered"))


@query(
    "consolidation_sensitivity",
    _CLUSTERED
    + "".join(_consolidated(f"_{name}", *how) for name, how in C.SETTINGS.items())
    + " "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS setting, count(*) AS structure_count, count(*) FILTER (WHERE k > 1) AS multi_pick_structures, (sum(k) - count(*))::BIGINT AS candidates_consolidated FROM (SELECT lead, count(*) AS k FROM cl_{name} GROUP BY lead) g"
        for name in C.SETTINGS
    ),
)
def consolidation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consolidation_sensitivity(view(spark, sf_dir, "clustered"))


@query(
    "structure_ranking",
    _STRUCTURES
    + """, t AS (SELECT m.*, f.lon AS lon0, f.candidate_id AS representative_id, f.followup_score AS top, CASE WHEN f.source_index % 3 = 0 THEN 'land' ELSE 'ocean' END AS domain,
          greatest(m.followup_score, 0.001) AS w, CASE WHEN m.followup_score >= 0.9 THEN 'A_cross_layer' WHEN m.followup_score >= 0.75 THEN 'C_morphology' ELSE 'D_background' END AS tier FROM m JOIN rw f ON f.rk = m.lead)
      SELECT row_number() OVER (ORDER BY any_value(top) DESC, structure_id)::BIGINT AS structure_review_rank, structure_id, any_value(representative_id) AS representative_id,
        round(((sum(w * (lon + round((lon0 - lon) / 360) * 360)) / sum(w) + 180) % 360 + 360) % 360 - 180, 6) AS lon, round(sum(w * lat) / sum(w), 6) AS lat, round(median(r), 6) AS radius_km, round(2 * median(r), 6) AS diameter_km,
        count(*) AS member_count, string_agg(candidate_id, ';' ORDER BY candidate_id) AS member_candidate_ids, round(min(r), 6)::DOUBLE AS radius_min_km, round(max(r), 6)::DOUBLE AS radius_max_km, round(any_value(top), 6)::DOUBLE AS followup_score,
        min(tier) AS review_tier, any_value(domain) AS domain FROM t JOIN named USING (lead) GROUP BY structure_id""",
)
def structure_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "clustered").withColumns(
        {
            "review_tier": F.when(F.col("followup_score") >= 0.9, S.TIERS[0]).when(F.col("followup_score") >= 0.75, S.TIERS[2]).otherwise(S.TIERS[3]),
            "domain": F.when(F.col("source_index") % 3 == 0, "land").otherwise("ocean"),
        }
    )
    rows = rows.withColumn("candidate_id", F.struct("candidate_id", "source_index"))  # ids repeat from a million on
    return rounded(C.structures(rows, C.consolidate(rows), "candidate_id"))


@query(
    "ring_families",
    _CLUSTERED
    + _cliques(
        "",
        "SELECT candidate_id, source_index, radius_km AS r, lon, lat, row_number() OVER (ORDER BY radius_km, source_index) AS rk FROM clustered WHERE geometry_angular_coverage >= 0.35",
        f"SELECT a.rk AS e, b.rk AS l, 0.0::DOUBLE AS w, {km('a', 'b')} AS away FROM rw a, rw b WHERE b.r / a.r >= 1.2 AND {km('a', 'b')} <= 0.25 * a.r",
    )
    + """, m AS (SELECT rw.*, cl.lead FROM rw JOIN cl USING (rk)),
      o AS (SELECT x.lead, median(away) AS off FROM prs JOIN cl x ON x.rk = e JOIN cl y ON y.rk = l AND y.lead = x.lead GROUP BY 1),
      g AS (SELECT lead, count(*) AS k, min(source_index) AS first, list(r ORDER BY r) AS rs FROM m GROUP BY lead HAVING count(*) > 1),
      f AS (SELECT g.*, off, 'ring_family_' || lpad(row_number() OVER (ORDER BY first, lead)::VARCHAR, 4, '0') AS fam FROM g JOIN o USING (lead))
      SELECT fam AS ring_family_id, candidate_id, k AS member_count, round(off, 6) AS center_offset_km_median, array_to_string(list_transform(range(2, k + 1), lambda i: printf('%.4f', rs[i] / rs[i - 1])), ';') AS ratios,
        printf('%.3f-%.3f', 2 * rs[1], 2 * rs[-1]) AS diameter_range_km, round(least(1, 0.5 * least(1, k / 3) + 0.5 * (1 - least(1, off / greatest(rs[1], 1)))), 6) AS nested_geometry_score FROM m JOIN f USING (lead)""",
)
def ring_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.ring_families(view(spark, sf_dir, "clustered"))
    ratios = F.array_join(F.transform("radius_ratio_sequence", lambda x: F.format_string("%.4f", x)), ";")
    return rounded(out.withColumn("ratios", ratios).drop("radius_ratio_sequence"))


@query(
    "spherical_fit",
    duck("vertices")
    + """, v AS (SELECT candidate_id, lon, lat, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM vertices),
      c AS (SELECT candidate_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM v GROUP BY 1),
      u AS (SELECT candidate_id, n, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM c),
      d AS (SELECT v.candidate_id, u.n, degrees(atan2(u.y, u.x)) AS clon, degrees(asin(u.z)) AS clat, v.lon, v.lat,
          acos(greatest(-1, least(1, v.x * u.x + v.y * u.y + v.z * u.z))) * 6371.0088::DOUBLE AS km FROM v JOIN u USING (candidate_id)),
      m AS (SELECT candidate_id, clon, clat, n, median(km) AS radius FROM d GROUP BY ALL),
      s AS (SELECT candidate_id, least(1, count(DISTINCT floor(((atan2(radians(((lon - clon + 180) % 360 + 360) % 360 - 180) * cos(radians(clat)), radians(lat - clat))) % 6.283185307179586::DOUBLE + 6.283185307179586::DOUBLE) % 6.283185307179586::DOUBLE / 6.283185307179586::DOUBLE * 72)) / 72) AS cov FROM d GROUP BY 1)
      SELECT candidate_id, round(clon, 4) AS lon, round(clat, 4) AS lat, round(m.radius, 2) AS radius_km, n AS vertices,
        round(median(abs(d.km - m.radius)) / greatest(m.radius, 1e-9), 3) AS relative_radial_mad, round(any_value(cov), 3) AS angular_coverage FROM d JOIN m USING (candidate_id, clon, clat, n) JOIN s USING (candidate_id) GROUP BY candidate_id, clon, clat, m.radius, n""",
)
def spherical_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.arcs import spherical_fit as fit

    out = fit(view(spark, sf_dir, "vertices"))
    return out.select("candidate_id", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), F.round("radius_km", 2).alias("radius_km"), "vertices", F.round("relative_radial_mad", 3).alias("relative_radial_mad"), F.round("angular_coverage", 3).alias("angular_coverage"))


@query(
    "dateline_segments",
    duck("vertices")
    + """, s AS (SELECT *, abs(lon - lag(lon) OVER w) > 180 AS br, row_number() OVER w AS rn FROM (SELECT candidate_id, line_no, vertex_no, lat, ((lon * 3 + 180) % 360 + 360) % 360 - 180 AS lon FROM vertices) q
        WINDOW w AS (PARTITION BY candidate_id ORDER BY line_no, vertex_no, lon)),
      g AS (SELECT candidate_id, sum(coalesce(br, false)::INT) OVER (PARTITION BY candidate_id ORDER BY rn) AS seg FROM s)
      SELECT candidate_id, seg::BIGINT AS segment, count(*) AS vertices FROM g GROUP BY ALL""",
)
def dateline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.arcs import dateline_segments as cut_up

    rows = view(spark, sf_dir, "vertices").withColumn("lon", G.wrap_lon(F.col("lon") * 3))
    return cut_up(rows).groupBy("candidate_id", "segment").agg(F.count(F.lit(1)).alias("vertices"))


@query(
    "circle_vertices",
    duck("candidates")
    + """, s AS (SELECT candidate_id, radians(lat) AS p, radians(lon) AS l, diameter_km / 2 / 6371.0088::DOUBLE AS a, unnest(range(0, 9)) AS i FROM candidates),
      t AS (SELECT *, i * 6.283185307179586::DOUBLE / 8 AS b FROM s),
      q AS (SELECT *, asin(sin(p) * cos(a) + cos(p) * sin(a) * cos(b)) AS p2 FROM t)
      SELECT candidate_id, i::BIGINT AS i, round(((degrees(l + atan2(sin(b) * sin(a) * cos(p), cos(a) - sin(p) * sin(p2))) + 180) % 360 + 360) % 360 - 180, 5) AS lon, round(degrees(p2), 5) AS lat FROM q""",
)
def circle_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "candidates")
    ring = rows.select("candidate_id", F.posexplode(G.circle_vertices("lon", "lat", "diameter_km", 8, 9)).alias("i", "p"))
    return ring.select("candidate_id", F.col("i").cast("long").alias("i"), F.round("p.lon", 5).alias("lon"), F.round("p.lat", 5).alias("lat"))


@query(
    "priority_review_order",
    duck("clustered") + """ SELECT candidate_id, row_number() OVER (ORDER BY followup_score DESC, source_index) AS rank FROM clustered""",
)
def priority_review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import number_rows

    return number_rows(view(spark, sf_dir, "clustered"), "followup_score", ["source_index"], "rank").select("candidate_id", "rank")


