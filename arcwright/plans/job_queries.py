"""Queries over submissions, jobs, reviews and small relational rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from .registry import query
from .spatial_queries import km
from .views import duck, view


@query(
    "intake_score",
    duck("submissions", "candidates")
    + f""", p AS (SELECT *, longitude AS lon, latitude AS lat FROM submissions),
      d AS (SELECT a.submission_id, b.candidate_id, {km("a", "b")} AS d, greatest(5, 0.25 * least(a.diameter_km, b.diameter_km)) AS lim FROM p a, candidates b WHERE a.diameter_km > 0),
      n AS (SELECT submission_id, arg_min(candidate_id, d) AS dup FROM d WHERE d <= lim GROUP BY 1),
      c AS (SELECT s.submission_id, n.dup, longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AS loc, diameter_km BETWEEN 10 AND 5000 AS scale, length(trim(coalesce(description, ''))) >= 80 AS descr,
        length(trim(source_title)) >= 8 AS src, length(trim(observed_feature)) >= 8 AS feat, length(trim(coalesce(endogenic_alternative, ''))) >= 20 AS alt, terms_confirmed AS terms,
        source_uri, source_resolution, original_trace_available AS tr, n_evidence AS ev FROM submissions s LEFT JOIN n ON n.submission_id = s.submission_id),
      x AS (SELECT *, round(CASE WHEN src THEN 0.20 ELSE 0 END::DOUBLE + CASE WHEN descr THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN alt THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN feat THEN 0.10 ELSE 0 END::DOUBLE
        + CASE WHEN coalesce(source_uri, '') <> '' THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN coalesce(source_resolution, '') <> '' THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN tr THEN 0.10 ELSE 0 END::DOUBLE + least(0.10::DOUBLE, 0.025::DOUBLE * ev), 3) AS score FROM c)
      SELECT submission_id, dup AS duplicate_of, loc AS valid_location, scale AS reviewable_scale, descr AS description_complete, alt AS alternative_considered, score AS intake_score,
        loc AND scale AND descr AND src AND feat AND alt AND terms AND dup IS NULL AND score >= 0.55 AS passed FROM x""",
)
def intake_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "submissions").withColumn("independent_evidence", F.slice(F.array(*map(F.lit, J.EVIDENCE)), F.lit(1), F.col("n_evidence").cast("int")))
    out = J.score_submissions(rows.withColumn("has_geometry", F.lit(True)), view(spark, sf_dir, "candidates"))
    return out.select("submission_id", "duplicate_of", "valid_location", "reviewable_scale", "description_complete", "alternative_considered", "intake_score", "passed")


@query("job_states")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_states(view(spark, sf_dir, "job_events"))


@query(
    "supersede",
    duck("job_events")
    + """, r AS (SELECT event_id AS request_id, job_id % 500 AS candidate_id, event_ts, CASE WHEN event_id % 4 = 0 THEN 'succeeded' ELSE 'queued' END AS status FROM job_events WHERE event = 'queued')
      SELECT request_id, candidate_id, CASE WHEN lead(request_id) OVER (PARTITION BY candidate_id ORDER BY event_ts, request_id) IS NOT NULL AND status = 'queued' THEN 'cancelled' ELSE status END AS status FROM r""",
)
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "job_events").where("event = 'queued'").select(
        F.col("event_id").alias("request_id"), (F.col("job_id") % 500).alias("candidate_id"), F.col("event_ts").alias("requested_at"),
        F.when(F.col("event_id") % 4 == 0, "succeeded").otherwise("queued").alias("status"),
    )
    return J.superseded(rows).select("request_id", "candidate_id", "status")


@query(
    "review_log",
    duck("job_events")
    + """ SELECT event_id AS change_id, job_id AS item_id, event AS status, lag(event) OVER w AS from_status, lead(event_id) OVER w IS NULL AS is_current FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY event_ts, event_id)""",
)
def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "job_events").select(F.col("event_id").alias("change_id"), F.col("job_id").alias("item_id"), F.col("event_ts").alias("changed_at"), F.col("event").alias("status"))
    return J.review_log(rows).select("change_id", "item_id", "status", "from_status", "is_current")


@query(
    "latest_per_job",
    duck("job_events") + """ SELECT job_id, event_id, event FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_ts DESC, event_id DESC) AS n FROM job_events) q WHERE n = 1""",
)
def latest_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import latest_per_parent

    return latest_per_parent(view(spark, sf_dir, "job_events"), "job_id", [F.desc("event_ts"), F.desc("event_id")]).select("job_id", "event_id", "event")


@query(
    "status_dashboard",
    duck("job_events")
    + """ SELECT worker_id, count(*) FILTER (WHERE event = 'queued') AS n_queued, count(*) FILTER (WHERE event = 'claimed') AS n_claimed, count(*) FILTER (WHERE event = 'succeeded') AS n_succeeded,
      count(*) FILTER (WHERE event = 'failed') AS n_failed, count(*) AS n_all, round(100 * count(*) FILTER (WHERE event IN ('succeeded', 'failed', 'cancelled')) / count(*), 1) AS progress_percent FROM job_events GROUP BY 1""",
)
def status_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.status_dashboard(view(spark, sf_dir, "job_events"), "event", ("queued", "claimed", "succeeded", "failed"), "worker_id")


@query(
    "recent_per_owner",
    duck("job_events")
    + """, c AS (SELECT worker_id AS owner, job_id AS candidate_id, min(event_ts) AS created_at FROM job_events GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, candidate_id DESC) AS nth FROM c)
      SELECT owner, candidate_id, nth::INTEGER AS nth, j.event_id AS latest_job_id, j.event AS latest_job_status FROM r JOIN
        (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_ts DESC, event_id DESC) AS n FROM job_events) q WHERE n = 1) j ON j.job_id = r.candidate_id WHERE nth <= 6""",
)
def recent_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "job_events")
    candidates = e.groupBy(F.col("worker_id").alias("owner"), F.col("job_id").alias("candidate_id")).agg(F.min("event_ts").alias("created_at"))
    jobs = e.select(F.col("job_id").alias("candidate_id"), F.col("event_ts").alias("created_at"), F.col("event_id").alias("job_id"), F.col("event").alias("status"))
    return J.recent_of_owners(candidates, jobs).select("owner", "candidate_id", "nth", "latest_job_id", "latest_job_status")


@query(
    "artifacts",
    """SELECT c_custkey AS job_id, 0 AS nth, 'image/png' AS mime_type, sha256(c_name) AS sha256, strlen(c_name)::BIGINT AS size_bytes, NULL::VARCHAR AS error FROM customer
      UNION ALL SELECT c_custkey, 1, 'text/html', sha256(c_name), strlen(c_name)::BIGINT, 'mime_type' FROM customer""",
)
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    one = lambda mime, content: F.struct(F.lit("diagnostic").alias("kind"), F.lit("t").alias("title"), F.lit(mime).alias("mime_type"), content.alias("content_base64"), F.lit("").alias("url_or_path"))
    b64 = F.base64(F.col("c_name").cast("binary"))
    rows = c.select(F.col("c_custkey").alias("job_id"), F.array(one(" Image/PNG", b64), one("text/html", b64), one("image/png", F.lit(""))).alias("artifacts"))
    return J.decode_artifacts(rows).select("job_id", "nth", "mime_type", "sha256", "size_bytes", "error")


@query(
    "search_and_page",
    duck("candidates")
    + """ SELECT candidate_id, name, source_index FROM candidates WHERE (lower(name) LIKE '%re%' OR lower(candidate_id) LIKE '%77%') AND source_index >= 100 ORDER BY source_index LIMIT 50""",
)
def search_and_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import page, text_search

    return page(text_search(view(spark, sf_dir, "candidates"), ["name", "candidate_id"], [("name", "RE"), ("candidate_id", "77")]), "source_index", 100, 50).select("candidate_id", "name", "source_index")


_FIELDS = {
    "source_index": "integer", "candidate_id": "string", "name": "string", "lon": "number", "lat": "number", "radius_km": "number", "diameter_km": "integer", "followup_score": "number", "tid_land_fraction": "number",
    "tid_artifact_risk": "number", "gravity_bouguer_ring_score": "number", "gravity_freeair_ring_score": "number", "magnetic_ring_score": "number", "sediment_thickness_km": "number", "geometry_angular_coverage": "number",
}


@query(
    "field_dictionary",
    duck("candidates") + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, '{t}' AS type, count({c}) < count(*) AS nullable, count({c}) AS n FROM candidates" for c, t in _FIELDS.items()),
)
def field_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import field_dictionary as describe

    return describe(view(spark, sf_dir, "candidates"))


@query(
    "evidence_override",
    duck("candidates")
    + """ SELECT candidate_id, CASE WHEN source_index % 3 = 0 THEN 0.5::DOUBLE ELSE followup_score END AS followup_score, CASE WHEN source_index % 3 = 0 THEN 'new' END AS note FROM candidates""",
)
def evidence_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import override

    # ids have six digits and repeat from a million candidates on; the index does not
    base = view(spark, sf_dir, "candidates").select("source_index", "candidate_id", "followup_score")
    new = view(spark, sf_dir, "candidates").where("source_index % 3 = 0").select("source_index", F.lit(0.5).alias("followup_score"), F.lit("new").alias("note"))
    return override(base, new, "source_index").drop("source_index")


@query(
    "backfill_without_job",
    duck("candidates", "job_events")
    + """ SELECT candidate_id FROM candidates WHERE source_index % 5 <> 0 AND source_index NOT IN (SELECT job_id FROM job_events WHERE event IN ('queued', 'claimed'))""",
)
def backfill_without_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = view(spark, sf_dir, "candidates").withColumn("followup_status", F.when(F.col("source_index") % 5 == 0, "scored").otherwise("source_unavailable"))
    jobs = view(spark, sf_dir, "job_events").select(F.format_string("arc_%06d", "job_id").alias("candidate_id"), F.col("event").alias("status"))
    return J.jobs_to_backfill(candidates, jobs).select("candidate_id")


@query(
    "review_rules",
    duck("job_events")
    + """, c AS (SELECT event_id AS change_id, job_id AS item_id, event_ts AS ts, CASE WHEN event_id % 40 = 7 THEN 'delete' WHEN event = 'queued' THEN 'submit' WHEN event IN ('claimed', 'heartbeat') THEN 'edit' ELSE 'status' END AS action,
        worker_id AS actor, event_id % 3 = 0 AS passed, CASE event_id % 4 WHEN 0 THEN 'under_review' WHEN 1 THEN 'accepted' WHEN 2 THEN 'baseline_passed' ELSE 'other' END AS target, event_id % 5 < 2 AS may FROM job_events
        UNION ALL SELECT -event_id, i, event_ts, 'status', worker_id, NULL, 'rejected', TRUE FROM (SELECT *, unnest([job_id, job_id + 1]) AS i FROM job_events WHERE event = 'failed' AND event_id % 10 = 1) b),
      o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts, change_id) AS n FROM c),
      f AS (SELECT item_id, min(n) AS first_n, arg_min(actor, n) AS owner FROM o WHERE action = 'submit' GROUP BY 1),
      g AS (SELECT o.item_id, min(n) AS gone_n FROM o JOIN f USING (item_id) WHERE action = 'delete' AND may AND n > first_n GROUP BY 1),
      s AS (SELECT o.*, first_n, owner, coalesce(n > first_n, FALSE) AND (gone_n IS NULL OR n <= gone_n) AS open, coalesce(n = first_n, FALSE) AS first FROM o LEFT JOIN f USING (item_id) LEFT JOIN g USING (item_id)),
      t AS (SELECT *, CASE WHEN passed THEN 'baseline_passed' ELSE 'baseline_failed' END AS checked FROM s),
      k AS (SELECT *, CASE WHEN first THEN checked WHEN open AND action = 'status' AND may AND target <> 'other' THEN target END AS fixed FROM t),
      l AS (SELECT *, last_value(fixed IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) NOT IN ('baseline_passed', 'baseline_failed') AS locked FROM k),
      r AS (SELECT *, CASE WHEN action = 'submit' THEN CASE WHEN first THEN NULL ELSE 'exists' END WHEN NOT open THEN 'unknown' WHEN action = 'edit' THEN CASE WHEN NOT may AND actor <> owner THEN 'permission' WHEN NOT may AND locked THEN 'locked' END
        WHEN NOT may THEN 'permission' WHEN action = 'status' AND target = 'other' THEN 'target' END AS refused FROM l),
      v AS (SELECT *, CASE WHEN action = 'edit' AND refused IS NULL AND NOT locked THEN checked ELSE fixed END AS now FROM r)
      SELECT change_id, item_id, action, refused, CASE WHEN open THEN last_value(now IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS from_status,
        CASE WHEN (open OR first) AND NOT (action = 'delete' AND refused IS NULL) THEN last_value(now IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY n ROWS UNBOUNDED PRECEDING) END AS to_status FROM v""",
)
def review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "job_events")
    k = F.col("event_id")
    changes = e.select(
        k.alias("change_id"), F.col("job_id").alias("item_id"), F.col("event_ts").alias("changed_at"),
        F.when(k % 40 == 7, "delete").when(F.col("event") == "queued", "submit").when(F.col("event").isin("claimed", "heartbeat"), "edit").otherwise("status").alias("action"), F.col("worker_id").alias("actor"),
        (k % 3 == 0).alias("passed"), F.when(k % 4 == 0, "under_review").when(k % 4 == 1, "accepted").when(k % 4 == 2, "baseline_passed").otherwise("other").alias("target"), (k % 5 < 2).alias("may_review"),
    )
    bulk = e.where((F.col("event") == "failed") & (k % 10 == 1)).select(
        (-k).alias("change_id"), F.array("job_id", F.col("job_id") + 1).alias("item_ids"), F.col("event_ts").alias("changed_at"), F.lit("rejected").alias("target"), F.col("worker_id").alias("actor"), F.lit(True).alias("may_review")
    )
    return J.reviewed(J.per_item(changes, bulk)).select("change_id", "item_id", "action", "refused", "from_status", "to_status")


@query(
    "unpivot_sensitivity",
    duck("controls") + """ SELECT negative_control_id, 'morphology_score_used' AS measure, morphology_score_used AS value FROM controls UNION ALL SELECT negative_control_id, 'gravity_consensus_used', gravity_consensus_used FROM controls""",
)
def unpivot_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "controls").unpivot("negative_control_id", ["morphology_score_used", "gravity_consensus_used"], "measure", "value")


@query(
    "planetary_comparison",
    duck("candidates")
    + """ SELECT 'terrestrial_screening' AS source, candidate_id AS object, 'Earth' AS body, round(diameter_km, 3)::DOUBLE AS diameter_km FROM candidates
      UNION ALL SELECT 'seed', name, body, km::DOUBLE FROM (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Moon' ELSE 'Mars' END AS body, 100 + s_suppkey AS km FROM supplier) q""",
)
def planetary_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import compare_planetary

    seed = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.lit("seed").alias("source"), F.col("s_name").alias("object"), F.when(F.col("s_suppkey") % 2 == 0, "Moon").otherwise("Mars").alias("body"), (F.col("s_suppkey") + 100).cast("double").alias("diameter_km")
    )
    families = view(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("family_id"), F.format_string("10.000-%.3f", F.col("diameter_km").cast("double")).alias("diameter_range_km"))
    return compare_planetary(families, seed).select("source", "object", "body", "diameter_km")


@query(
    "adjacent_ratios",
    """SELECT vec_id, len(r)::INTEGER AS n, r[1] AS first, r[-1] AS last FROM (
      SELECT vec_id, list_transform(range(2, len(v) + 1), lambda i: v[i] / v[i - 1]) AS r FROM (SELECT vec_id, list_sort(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0)) AS v FROM embeddings) a) b WHERE len(r) > 0""",
)
def adjacent_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import ratios

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    r = e.select("vec_id", ratios(F.col("embedding").cast("array<double>")).alias("r")).where("size(r) > 0")
    return r.select("vec_id", F.size("r").alias("n"), F.get("r", F.lit(0)).alias("first"), F.element_at("r", -1).alias("last"))  # quotients of the same doubles are the same in every engine
