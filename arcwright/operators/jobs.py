"""Submissions, analysis jobs and reviews as batch tables; ``streaming.jobs`` has the same rules over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import latest_per_parent

# Evidence types that count, states of jobs, allowed image types, artifact limits.
EVIDENCE = ("gravity", "magnetic", "geology", "seismic", "field", "petrography", "geochemistry")
TERMINAL = ("succeeded", "failed", "cancelled")
ACTIVE = ("queued", "claimed", "running")
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp")
MOST_ARTIFACTS, MOST_BYTES = 25, 5 * 1024 * 1024
LEASE_SECONDS = 1800


def _long(text: str, least: int) -> Column:
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least


def intake_checks(least_score: float = 0.55, description: int = 80, alternative: int = 20, title: int = 8, feature: int = 8, smallest_km: float = 10, largest_km: float = 5000) -> dict[str, Column]:
    """The checks, the score and the verdict of a submission; needs its columns and duplicate_of (null: no duplicate)."""
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    lon, lat, km = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("longitude", "latitude", "diameter_km"))
    checks = {
        "valid_location": lon.between(-180, 180) & lat.between(-90, 90),
        "reviewable_scale": km.between(smallest_km, largest_km),
        "description_complete": _long("description", description),
        "source_identified": _long("source_title", title),
        "feature_identified": _long("observed_feature", feature),
        "alternative_considered": _long("endogenic_alternative", alternative),
        "terms_confirmed": yes("terms_confirmed"),
        "not_duplicate_of_study_candidate": F.col("duplicate_of").isNull(),
    }
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    evidence = F.size(F.array_intersect(F.coalesce("independent_evidence", F.array().cast("array<string>")), F.array(*map(F.lit, EVIDENCE))))
    score = F.round(
        part(checks["source_identified"], 0.20) + part(checks["description_complete"], 0.15) + part(checks["alternative_considered"], 0.15) + part(checks["feature_identified"], 0.10)
        + part(given("source_uri"), 0.10) + part(given("source_resolution"), 0.10) + part(yes("original_trace_available") & yes("has_geometry"), 0.10) + F.least(F.lit(0.10), 0.025 * evidence),
        3,
    )
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return {**checks, "intake_score": score, "passed": every & (score >= least_score)}


def score_submissions(submissions: DataFrame, study: DataFrame, **limits) -> DataFrame:
    """Submissions with duplicate_of (the nearest study candidate within reach), checks, score and verdict."""
    from .spatial import nearest_within

    places = submissions.select("submission_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("diameter_km").cast("double").alias("diameter_km"))
    near = nearest_within(places, "submission_id", study, "candidate_id").select("submission_id", F.col("candidate_id").alias("duplicate_of"), F.col("distance_km").alias("duplicate_km"))
    rows = submissions.join(near, "submission_id", "left")
    return rows.withColumns(intake_checks(**limits))


def _in_runs(events: DataFrame) -> DataFrame:
    """Events with ``segment``, which grows when their job is queued, and ``run``: heartbeats of one worker in a row share one, other events have their own."""
    order = Window.partitionBy("job_id").orderBy(F.col("event_ts").cast("timestamp"), "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    beat = F.coalesce(F.col("event") == "heartbeat", F.lit(False))
    again = beat & F.coalesce(F.lag("event").over(order) == "heartbeat", F.lit(False)) & F.col("worker_id").eqNullSafe(F.lag("worker_id").over(order))
    rows = events.withColumn("_new", (~again).cast("long"))
    return rows.withColumn("segment", F.sum((F.col("event") == "queued").cast("long")).over(upto)).withColumn("run", F.sum("_new").over(upto)).drop("_new")


def _folded(events: DataFrame, lease_seconds: int) -> DataFrame:
    """(job_id, segment, s): state after each stretch of a job's events that begins when it is queued; s: status, attempts, worker, lease, refused (runs and their numbers of events).

    Of a run of heartbeats all are taken or all refused, and the last one's time counts, so a run is one step however long.
    """
    runs = _in_runs(events).groupBy("job_id", "segment", "run").agg(F.max(F.col("event_ts").cast("timestamp")).alias("event_ts"), F.first("event").alias("event"), F.first("worker_id").alias("worker_id"), F.count(F.lit(1)).alias("n"))
    e = runs.groupBy("job_id", "segment").agg(F.array_sort(F.collect_list(F.struct("run", "event_ts", "event", "worker_id", "n"))).alias("es"))
    start = F.struct(
        F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("worker"),
        F.lit(None).cast("timestamp").alias("lease"), F.array().cast("array<struct<run: bigint, n: bigint>>").alias("refused"),
    )

    def step(s: Column, x: Column) -> Column:
        until = F.timestamp_seconds(F.unix_micros(x["event_ts"]) / 1_000_000 + lease_seconds)
        none = F.lit(None).cast("timestamp")
        active = s["status"].isin(*ACTIVE)
        claimable = F.coalesce((s["status"] == "queued") | (active & (s["lease"] < x["event_ts"])), F.lit(False))
        other = F.coalesce(s["worker"] != x["worker_id"], F.lit(False)) & F.coalesce(x["worker_id"] != "", F.lit(False))
        beats = F.coalesce(active, F.lit(False)) & ~other
        state = lambda status, attempts, worker, lease, refused: F.struct(
            status.alias("status"), attempts.alias("attempts"), worker.alias("worker"), lease.alias("lease"), refused.alias("refused")
        )
        open_ = F.coalesce(s["status"] != "cancelled", F.lit(True))
        return (
            F.when((x["event"] == "queued"), state(F.lit("queued"), s["attempts"], F.lit(None).cast("string"), none, s["refused"]))
            .when((x["event"] == "claimed") & claimable, state(F.lit("claimed"), s["attempts"] + 1, x["worker_id"], until, s["refused"]))
            .when((x["event"] == "heartbeat") & beats, state(F.lit("running"), s["attempts"], s["worker"], until, s["refused"]))
            .when(x["event"].isin("succeeded", "failed") & open_, state(x["event"], s["attempts"], s["worker"], none, s["refused"]))
            .when((x["event"] == "cancelled"), state(F.lit("cancelled"), s["attempts"], s["worker"], none, s["refused"]))
            .otherwise(state(s["status"], s["attempts"], s["worker"], s["lease"], F.array_append(s["refused"], F.struct(x["run"].alias("run"), x["n"].alias("n")))))
        )

    return e.select("job_id", "segment", F.aggregate("es", start, step).alias("s"))


def job_states(events: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """(job_id, status, attempt_count, worker_id, lease_expires_at, rejected) after all events, in order of event_ts, then event_id.

    queued makes a job claimable; claimed takes it if it is queued or its lease has run out (else rejected), for one more attempt;
    heartbeat makes a job that hasn't ended run and extends its lease, unless another worker holds it (else rejected);
    succeeded and failed end any job that isn't cancelled; cancelled ends it. Events are folded between one queued event and the
    next, which starts afresh, and heartbeats in a row count as one, so no row holds all events of a job that is queued again and again or sends nothing but heartbeats.
    """
    out = _folded(events, lease_seconds).groupBy("job_id").agg(
        F.max_by("s", "segment").alias("s"), F.sum("s.attempts").alias("attempt_count"), F.sum(F.aggregate("s.refused", F.lit(0).cast("long"), lambda a, r: a + r["n"])).alias("rejected")
    )
    return out.select("job_id", "s.status", "attempt_count", F.col("s.worker").alias("worker_id"), F.col("s.lease").alias("lease_expires_at"), "rejected")


def rejected_events(events: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """The events that their job's state refused, as they came: the side table of ``job_states``."""
    refused = _folded(events, lease_seconds).select("job_id", F.explode("s.refused").alias("r")).select("job_id", F.col("r.run").alias("run"))
    return _in_runs(events).join(refused, ["job_id", "run"], "left_semi").select(*events.columns)


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that a worker may take: queued, or claimed or running with a lease that ran out."""
    return jobs.where((F.col("status") == "queued") | (F.col("status").isin("claimed", "running") & (F.col("lease_expires_at") < now)))


def queue_page(jobs: DataFrame, limit: int, now: Column) -> DataFrame:
    """The first claimable jobs by priority, then age; the limit is held within 1 and 100."""
    return claimable(jobs, now).orderBy(F.desc("priority"), "created_at", "job_id").limit(min(max(limit, 1), 100))


def allowed_requests(requests: DataFrame) -> DataFrame:
    """Requests whose candidate passed the baseline check, and forced ones. Needs baseline_passed and forced (missing: no)."""
    return requests.where(F.coalesce("baseline_passed", F.lit(False)) | F.coalesce("forced", F.lit(False)))


def superseded(requests: DataFrame) -> DataFrame:
    """Enqueue requests with status: a later request for the same candidate cancels an active one. Needs candidate_id, requested_at, request_id, status."""
    later = F.lead("request_id").over(Window.partitionBy("candidate_id").orderBy("requested_at", "request_id"))
    return requests.withColumn("status", F.when(later.isNotNull() & F.col("status").isin(*ACTIVE), "cancelled").otherwise(F.col("status")))


def review_log(changes: DataFrame) -> DataFrame:
    """Status changes with from_status and whether they are current. Needs item_id, changed_at, change_id, status."""
    order = Window.partitionBy("item_id").orderBy("changed_at", "change_id")
    return changes.withColumn("from_status", F.lag("status").over(order)).withColumn("is_current", F.lead("change_id").over(order).isNull())


# States of a submission, those in which its owner may still edit it, and those that a reviewer may choose.
UNREVIEWED = ("baseline_failed", "baseline_passed")
REVIEW_STATES = (*UNREVIEWED, "under_review", "accepted", "rejected")


def per_item(changes: DataFrame, bulk: DataFrame) -> DataFrame:
    """Changes with those of bulk actions, one row for each item of ``item_ids``; bulk: change_id, item_ids, changed_at, target, actor, may_review, note. Items named twice count once."""
    each = bulk.withColumn("item_id", F.explode(F.array_distinct("item_ids"))).drop("item_ids").withColumn("action", F.lit("status"))
    return changes.unionByName(each, allowMissingColumns=True)


def reviewed(changes: DataFrame) -> DataFrame:
    """Every change with from_status, to_status and refused, by the rules of review; in order of changed_at, then change_id, item by item.

    Needs change_id, item_id, changed_at, action, actor, passed (the edit's or submission's baseline check), target (a status change's), may_review (whether
    the actor may review and delete). Actions: ``submit`` opens an item as baseline_passed or baseline_failed and makes its actor the owner; ``edit`` checks it anew while it is
    unreviewed, for its owner or a reviewer, and later leaves its status, for a reviewer only; ``status`` sets the target; ``delete`` ends the item for good. refused:
    ``unknown`` (no item, or a deleted one), ``exists``, ``permission``, ``locked`` (an owner's edit after review began), ``target``, ``action``, else null. A refused change leaves the status.
    """
    w = Window.partitionBy("item_id").orderBy("changed_at", "change_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    is_, target = lambda *a: F.coalesce(F.col("action").isin(*a), F.lit(False)), F.col("target").isin(*REVIEW_STATES)
    checked = F.when(yes("passed"), "baseline_passed").otherwise("baseline_failed")
    opened = F.coalesce(F.max(is_("submit").cast("int")).over(before) > 0, F.lit(False))
    gone = F.max((F.col("_open") & is_("delete") & yes("may_review")).cast("int")).over(before) > 0
    rows = changes.withColumn("_open", opened).withColumn("_open", F.col("_open") & ~F.coalesce(gone, F.lit(False)))
    # what decides whether an item is locked: its first submission and the changes of status that count; edits never do
    rows = rows.withColumn("_first", is_("submit") & (F.sum(is_("submit").cast("int")).over(upto) == 1))
    rows = rows.withColumn("_set", F.when(F.col("_first"), checked).when(F.col("_open") & is_("status") & yes("may_review") & target, F.col("target")))
    rows = rows.withColumn("_owner", F.last(F.when(F.col("_first"), F.col("actor")), True).over(upto)).withColumn("_locked", ~F.last("_set", True).over(before).isin(*UNREVIEWED))
    own = F.coalesce(F.col("actor") == F.col("_owner"), F.lit(False))
    refused = (
        F.when(~is_("submit", "edit", "status", "delete"), "action").when(is_("submit"), F.when(~F.col("_first"), "exists")).when(~F.col("_open"), "unknown")
        .when(is_("edit"), F.when(~own & ~yes("may_review"), "permission").when(F.col("_locked") & ~yes("may_review"), "locked")).when(~yes("may_review"), "permission")
        .when(is_("status") & ~F.coalesce(target, F.lit(False)), "target")
    )
    rows = rows.withColumn("refused", refused)
    edited = is_("edit") & F.col("refused").isNull() & ~F.col("_locked")
    rows = rows.withColumn("_now", F.when(edited, checked).otherwise(F.col("_set")))
    deleted = is_("delete") & F.col("refused").isNull()
    rows = rows.withColumn("from_status", F.when(F.col("_open"), F.last("_now", True).over(before))).withColumn("to_status", F.when(~deleted & (F.col("_open") | F.col("_first")), F.last("_now", True).over(upto)))
    return rows.drop("_open", "_first", "_set", "_owner", "_locked", "_now")


def review_states(changes: DataFrame) -> DataFrame:
    """(item_id, status, owner, moderated_by, moderated_at, changes, refused) of every item that was opened and not deleted; see ``reviewed``."""
    done = reviewed(changes)
    counts = F.col("refused").isNull()
    set_by = F.max(F.when(counts & (F.col("action") == "status"), F.struct("changed_at", "change_id", "actor")))
    out = done.groupBy("item_id").agg(
        F.max_by("to_status", F.struct("changed_at", "change_id")).alias("status"), F.max(F.when(counts & (F.col("action") == "submit"), F.col("actor"))).alias("owner"), set_by.alias("_m"),
        F.count_if(counts).alias("changes"), F.count_if(~counts).alias("refused"),
    )
    return out.where("status IS NOT NULL").select("item_id", "status", "owner", F.col("_m.actor").alias("moderated_by"), F.col("_m.changed_at").alias("moderated_at"), "changes", "refused")


# Texts of a result and how many characters of each are kept, and its states.
RESULT_TEXTS = {"review_tier": 80, "method_version": 120, "worker_id": 120, "worker_version": 120}
RESULT_STATES = ("succeeded", "failed", "source_unavailable")
RESULT_OBJECTS = ("metrics", "diagnostics", "source_fingerprints")
FIGURES = ("elevation_diagnostic", "diagnostic_png", "diagnostic_figure")
_ARTIFACTS = "array<struct<kind: string, title: string, mime_type: string, content_base64: string, url_or_path: string>>"


def parse_results(payloads: DataFrame) -> DataFrame:
    """(job_id, status, score, score_percentile, runtime_seconds, texts, objects, artifacts, error) of JSON results; needs job_id, received_at, payload.

    Texts are cut to their columns' widths. metrics, diagnostics and source_fingerprints that aren't objects become empty ones, artifacts
    that are no list an empty list. error: ``payload`` where the payload is no JSON object, ``status`` where its status isn't known.
    """
    v = payloads.withColumn("_v", F.try_parse_json("payload"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    get = lambda name, t: F.try_variant_get("_v", f"$.{name}", t)
    whole = F.coalesce(kind("$").startswith("OBJECT"), F.lit(False))
    status = F.trim(F.coalesce(get("status", "string"), F.lit("")))
    objects = [F.when(kind(f"$.{n}").startswith("OBJECT"), F.to_json(get(n, "variant"))).otherwise("{}").alias(n) for n in RESULT_OBJECTS]
    listed = F.when(kind("$.artifacts").startswith("ARRAY"), F.from_json(F.to_json(get("artifacts", "variant")), _ARTIFACTS))
    return v.select(
        "job_id", "received_at", status.alias("status"), *[get(n, "double").alias(n) for n in ("score", "score_percentile", "runtime_seconds")],
        *[F.substring(F.coalesce(get(n, "string"), F.lit("")), 1, width).alias(n) for n, width in RESULT_TEXTS.items()], *objects,
        F.coalesce(F.filter(listed, lambda a: a.isNotNull()), F.array().cast(_ARTIFACTS)).alias("artifacts"),
        F.when(~whole, "payload").when(~status.isin(*RESULT_STATES), "status").alias("error"),
    )


def apply_results(candidates: DataFrame, results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Candidates with followup_status, followup_score, method_version and diagnostic_figure_url of their latest valid result, as they were without one.

    candidates: candidate_id, job_id, job_status and these columns; results: see ``parse_results``; artifacts: see ``decode_artifacts``. Results of
    cancelled jobs and with an error count for nothing. A result that didn't succeed changes the status alone.
    """
    good = results.where("error IS NULL").groupBy("job_id").agg(F.max(F.struct("received_at", "status", "score", "method_version")).alias("_r"))
    figure = artifacts.where(F.col("kind").isin(*FIGURES) & F.col("error").isNull()).groupBy("job_id").agg(F.min_by("url", "nth").alias("_figure"))
    rows = candidates.join(good, "job_id", "left").join(figure, "job_id", "left")
    new = F.col("_r").isNotNull() & F.coalesce(F.col("job_status") != "cancelled", F.lit(True))
    done = new & F.coalesce(F.col("_r.status") == "succeeded", F.lit(False))
    said = F.when(F.col("_r.status") == "succeeded", "scored").otherwise(F.col("_r.status"))
    return rows.withColumns(
        {
            "followup_status": F.when(new, said).otherwise(F.col("followup_status")), "followup_score": F.when(done, F.col("_r.score")).otherwise(F.col("followup_score")),
            "method_version": F.when(done, F.col("_r.method_version")).otherwise(F.col("method_version")),
            "diagnostic_figure_url": F.when(done, F.coalesce("_figure", F.lit(""))).otherwise(F.col("diagnostic_figure_url")),
        }
    ).drop("_r", "_figure")


def job_feed(jobs: DataFrame, candidates: DataFrame, limit: int, now: Column) -> DataFrame:
    """The first claimable jobs with their candidate as a struct, by priority, then age. See ``queue_page``."""
    nested = candidates.select("candidate_id", F.struct(*[candidates[c] for c in candidates.columns]).alias("candidate"))
    page = queue_page(jobs, limit, now)
    return page.join(nested, "candidate_id", "left").orderBy(F.desc("priority"), "created_at", "job_id")


def jobs_to_backfill(candidates: DataFrame, jobs: DataFrame, status: str = "source_unavailable") -> DataFrame:
    """Candidates of a status that have no job which is queued, claimed or running."""
    live = jobs.where(F.col("status").isin(*ACTIVE)).select("candidate_id")
    return candidates.where(F.col("followup_status") == status).join(live, "candidate_id", "left_anti")


def recent_of_owners(candidates: DataFrame, jobs: DataFrame, keep: int = 6) -> DataFrame:
    """Each owner's latest candidates (created_at, then id downwards) with the latest job of each."""
    recent = latest_per_parent(candidates, "owner", [F.desc("created_at"), F.desc("candidate_id")], keep)
    last = jobs.groupBy("candidate_id").agg(F.max(F.struct("created_at", "job_id", "status")).alias("_j"))
    return recent.join(last, "candidate_id", "left").select(*recent.columns, F.col("_j.job_id").alias("latest_job_id"), F.col("_j.status").alias("latest_job_status"))


def decode_artifacts(results: DataFrame) -> DataFrame:
    """(job_id, nth, kind, mime_type, sha256, size_bytes, error, url) of each result's first 25 artifacts; needs artifacts: array of
    (kind, title, mime_type, content_base64, url_or_path). Artifacts without content and path are left out. url: the path, or
    ``artifact/`` and the hash of an embedded content."""
    a = results.select("job_id", F.posexplode(F.slice("artifacts", 1, MOST_ARTIFACTS)).alias("nth", "a"))
    has = F.coalesce(F.col("a.content_base64") != "", F.lit(False))
    content = F.expr("try_to_binary(a.content_base64, 'base64')")
    mime = F.lower(F.trim(F.coalesce("a.mime_type", F.lit(""))))
    a = a.withColumns({"_has": has, "_content": F.when(has, content), "_mime": mime}).where(F.col("_has") | F.coalesce(F.col("a.url_or_path") != "", F.lit(False)))
    error = (
        F.when(F.col("_has") & ~F.col("_mime").isin(*IMAGE_TYPES), "mime_type").when(F.col("_has") & F.col("_content").isNull(), "base64").when(F.octet_length("_content") > MOST_BYTES, "too large")
    )
    return a.select("job_id", "nth", F.substring("a.kind", 1, 80).alias("kind"), F.col("_mime").alias("mime_type"), F.sha2("_content", 256).alias("sha256"), F.octet_length("_content").cast("long").alias("size_bytes"), error.alias("error"),
        F.when(F.col("_has"), F.concat(F.lit("artifact/"), F.sha2("_content", 256))).otherwise(F.substring("a.url_or_path", 1, 1000)).alias("url"))


def status_dashboard(df: DataFrame, status: str, values: tuple[str, ...], *groups: str) -> DataFrame:
    """One row a group: the number of each status, all, and the percent that ended."""
    ended = F.count_if(F.col(status).isin(*TERMINAL))
    n = F.count(F.lit(1))
    cols = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values]
    return df.groupBy(*groups).agg(*cols, n.alias("n_all"), F.round(100 * ended / n, 1).alias("progress_percent"))
