"""Views that give the given tables the shape of a screening study.

The tables hold no geometry, so positions, sizes and scores come from their keys by
exact integer arithmetic. Each text is SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = """({k} * 7919 % 36000) / 100 - 180 AS lon, ({k} * 104729 % 17000) / 100 - 85 AS lat,
    5 + ({k} * 31 % 1000) / 2 AS radius_km, 10 + ({k} * 31 % 1000) AS diameter_km"""

VIEWS: dict[str, str] = {
    "candidates": f"""SELECT p_partkey AS source_index, concat('arc_', lpad(cast(p_partkey AS string), 6, '0')) AS candidate_id,
    p_name AS name, {_PLACE.format(k="p_partkey")}, (p_partkey * 613 % 1000) / 1000 AS followup_score,
    (p_partkey * 17 % 11) / 10 AS tid_land_fraction, (p_partkey * 29 % 100) / 100 AS tid_artifact_risk,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey * 271 % 1000) / 1000 END AS gravity_bouguer_ring_score,
    CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE (p_partkey * 383 % 1000) / 1000 END AS gravity_freeair_ring_score,
    CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE (p_partkey * 499 % 1000) / 1000 END AS magnetic_ring_score,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey * 37 % 400) / 100 END AS sediment_thickness_km,
    (p_partkey * 41 % 100) / 100 AS geometry_angular_coverage
  FROM part""",
    "clustered": """SELECT p_partkey AS source_index, concat('arc_', lpad(cast(p_partkey AS string), 6, '0')) AS candidate_id,
    ((p_partkey % 200) * 7919 % 36000) / 100 - 180 + (p_partkey // 200 % 12) / 100 AS lon,
    ((p_partkey % 200) * 104729 % 16000) / 100 - 80 + (p_partkey // 200 % 7) / 100 AS lat,
    40 + 3 * (p_partkey // 200 % 15) + (p_partkey // 3000) / 2 AS radius_km,
    (p_partkey * 613 % 1000) / 1000 AS followup_score, 1 - (p_partkey % 13) / 20 AS geometry_angular_coverage
  FROM part""",
    "controls": f"""SELECT concat('control_', lpad(cast(s_suppkey AS string), 6, '0')) AS negative_control_id,
    CASE s_suppkey % 8 WHEN 0 THEN 'caldera' WHEN 1 THEN 'volcanic_seamount' WHEN 2 THEN 'ring_complex' WHEN 3 THEN 'diapir'
      WHEN 4 THEN 'sedimentary_basin' WHEN 5 THEN 'salt_structure' WHEN 6 THEN 'tectonic_arc' ELSE 'intrusive_complex' END AS negative_control_class,
    {_PLACE.format(k="(s_suppkey + 17)")}, (s_suppkey * 613 % 1000) / 1000 AS morphology_score_used,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey * 271 % 1000) / 1000 END AS gravity_consensus_used
  FROM supplier""",
    "catalogue": f"""SELECT concat('astro_', lpad(cast(c_custkey AS string), 6, '0')) AS record_id, c_name AS name,
    {_PLACE.format(k="(c_custkey + 31)")}, c_custkey % 3 = 0 AS eid_match, c_nationkey AS nation
  FROM customer""",
    "vertices": """SELECT concat('arc_', lpad(cast(l_orderkey AS string), 6, '0')) AS candidate_id,
    l_linenumber AS line_no, cast(l_partkey AS bigint) AS vertex_no,
    (l_orderkey * 7919 % 35000) / 100 - 175 + cos(l_linenumber * 0.7 + l_partkey % 5) * (1 + l_quantity / 100) AS lon,
    (l_orderkey * 104729 % 14000) / 100 - 70 + sin(l_linenumber * 0.7 + l_partkey % 5) * (1 + l_quantity / 100) AS lat
  FROM lineitem""",
    "fault_segments": """SELECT o_orderkey // 4 AS fault_id, o_orderkey % 4 AS segment_no, concat('fault_', cast(o_orderkey // 4 % 97 AS string)) AS name,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Normal' WHEN '2' THEN 'Reverse' WHEN '3' THEN 'Dextral' WHEN '4' THEN 'Sinistral' ELSE NULL END AS slip_type,
    (o_orderkey // 4 * 7919 % 35700) / 100 - 180 + o_orderkey % 4 * 0.5 AS lon1, (o_orderkey // 4 * 104729 % 16800) / 100 - 85 + o_orderkey % 4 * 0.25 AS lat1,
    (o_orderkey // 4 * 7919 % 35700) / 100 - 179.5 + o_orderkey % 4 * 0.5 AS lon2, (o_orderkey // 4 * 104729 % 16800) / 100 - 84.75 + o_orderkey % 4 * 0.25 AS lat2
  FROM orders""",
    "submissions": """SELECT k AS submission_id, text AS description, coalesce(c_name, '') AS source_title, coalesce(c_mktsegment, '') AS observed_feature,
    CASE k % 3 WHEN 0 THEN text WHEN 1 THEN lang ELSE NULL END AS endogenic_alternative,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'https://example.org/s' END AS source_uri,
    CASE WHEN k % 4 = 0 THEN NULL ELSE '30 m' END AS source_resolution,
    k % 2 = 0 AS original_trace_available, k % 9 <> 0 AS terms_confirmed,
    (k * 7919 % 37000) / 100 - 185 AS longitude, (k * 104729 % 17000) / 100 - 85 AS latitude,
    CAST((k * 31 % 6000) AS double) AS diameter_km, k % 6 AS n_evidence
  FROM (SELECT coalesce(c.c_custkey, d.doc_id) AS k, c.c_name, c.c_mktsegment, d.text, d.lang FROM customer c FULL JOIN documents d ON d.doc_id = c.c_custkey) merged""",
    "job_events": """SELECT event_id, user_id AS job_id, ts AS event_ts,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'heartbeat'
      WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS event,
    concat('worker_', cast(event_id % 5 AS string)) AS worker_id
  FROM events""",
    "patches": """SELECT candidate_id, source_index, iy, ix, x, y, sqrt(x * x + y * y) AS rho,
    CASE WHEN (source_index + iy * 13 + ix * 7) % 97 = 0 THEN 127 WHEN sqrt(x * x + y * y) < 0.98 THEN 11
         WHEN (iy + source_index) % 5 = 0 THEN 0 ELSE 40 END AS tid,
    300 * exp(-pow((sqrt(x * x + y * y) - 1) / 0.2, 2) / 2) + 20 * x + 10 * y AS value
  FROM (SELECT concat('arc_', lpad(cast(p_partkey AS string), 6, '0')) AS candidate_id, p_partkey AS source_index, gy AS iy, gx AS ix,
      (gx - 12) / 7 + (p_partkey % 3) / 100 AS x, (gy - 12) / 7 AS y
    FROM part, gx_axis, gy_axis) cells""",
}
_SPARK_AXES = {"gx_axis": "SELECT explode(sequence(0, 24)) AS gx", "gy_axis": "SELECT explode(sequence(0, 24)) AS gy"}
_DUCK_AXES = {"gx_axis": "SELECT unnest(range(0, 25)) AS gx", "gy_axis": "SELECT unnest(range(0, 25)) AS gy"}


def _for_spark(text: str) -> str:
    return text.replace(" // ", " div ")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables in ``sf_dir``."""
    text = _for_spark(VIEWS[name])
    frames = {}
    for t in ("part", "supplier", "customer", "lineitem", "orders", "events", "documents"):
        if f"FROM {t}" in text or f"JOIN {t}" in text:
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "patches":  # 625 cells a row: dealt before there are cells, so that no task makes them all and operators by candidate move none
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        frames["part"] = frames["part"].select("p_partkey").repartition(parts, F.expr("concat('arc_', lpad(cast(p_partkey AS string), 6, '0'))"))
    for axis, sql in _SPARK_AXES.items():
        if axis in text:
            frames[axis] = spark.sql(sql)
    for t in frames:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t},", f"FROM {{{t}}},")
        text = text.replace(f", {t}", f", {{{t}}}") if t.endswith("_axis") else text
        if text.endswith(f"FROM {t}"):
            text = text[: -len(t)] + f"{{{t}}}"
    return spark.sql(text, **frames)


def duck(*names: str) -> str:
    """The views as the start of a WITH clause."""
    axes = [f"{a} AS ({s})" for a, s in _DUCK_AXES.items() if any(a in VIEWS[n] for n in names)]
    return "WITH " + ", ".join(axes + [f"{n} AS ({VIEWS[n]})" for n in names])
