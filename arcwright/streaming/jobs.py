"""The job lifecycle, intake scoring and dashboards over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import great_circle_km
from ..operators.jobs import ACTIVE, LEASE_SECONDS, TERMINAL, allowed_requests, intake_checks, parse_results
from ..operators.spatial import HALF_TURN_KM, cells, level_of
from .tables import KeyedTable, latest_by, summed

#: How long after its last event an ended job is remembered, so that late events are told from those of unknown jobs.
KEEP_ENDED_SECONDS = 7 * 24 * 3600

STATE = "status string, attempts long, worker string, lease double, rejected long"
OUT = "job_id long, status string, attempt_count long, worker_id string, lease_expires_at timestamp, rejected long, cause string, previous_status string, event_id long"


def _advance(state: tuple, event: str, worker: str, at: float) -> tuple:
    """One event on (status, attempts, worker, lease, rejected)."""
    status, attempts, owner, lease, rejected = state
    held = status in ("claimed", "running")
    if event == "queued":
        return "queued", attempts, None, None, rejected
    if event == "claimed" and (status == "queued" or (held and lease is not None and lease < at)):
        return "claimed", attempts + 1, worker, at + LEASE_SECONDS, rejected
    if event == "heartbeat" and status in ACTIVE and not (owner and worker and owner != worker):
        return "running", attempts, owner, at + LEASE_SECONDS, rejected
    if event in ("succeeded", "failed") and status != "cancelled":
        return event, attempts, owner, None, rejected
    if event == "cancelled":
        return "cancelled", attempts, owner, None, rejected
    return status, attempts, owner, lease, rejected + 1


def _keep(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (None, 0, None, None, 0)
    before, cause, refused = now[0], "event", []
    if state.hasTimedOut:
        if now[0] in TERMINAL:  # nothing about it is expected any more
            state.remove()
            return
        cause = "lease expired"  # claimable again, and its worker may still come back
    else:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["event_ts", "event_id"])
        for at, event, worker, event_id in zip(rows["event_ts"], rows["event"], rows["worker_id"], rows["event_id"], strict=True):
            then, now = now, _advance(now, event, worker, at.timestamp())
            if now[4] > then[4]:
                refused.append(event_id)
        last = max(0.0, float(rows["event_ts"].iloc[-1].timestamp()))
    state.update(now)
    due = 0
    if now[0] in TERMINAL and cause == "event":
        due = int((last + KEEP_ENDED_SECONDS) * 1000)
    elif now[3] is not None:
        due = int(now[3] * 1000)
    if due > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(due)
    lease = pd.Timestamp(now[3], unit="s") if now[3] is not None else pd.NaT
    out = pd.DataFrame({"job_id": [key[0]], "status": [now[0]], "attempt_count": [now[1]], "worker_id": [now[2]], "lease_expires_at": [lease], "rejected": [now[4]], "cause": [cause], "previous_status": [before], "event_id": [None]})
    if refused:
        tagged = pd.DataFrame({"job_id": key[0], "cause": "refused", "event_id": refused})
        out = pd.concat([out, tagged.reindex(columns=out.columns).astype({"lease_expires_at": out["lease_expires_at"].dtype})], ignore_index=True)
    yield out.astype({"attempt_count": "Int64", "rejected": "Int64", "event_id": "Int64"})


def track_jobs(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The state of each job whenever it changes and every event that a job refused, from a stream of (event_id, job_id, event_ts, event, worker_id).

    Repeated events within the delay count once. Events of one micro-batch are applied in order of time, by the rules of the batch
    twin ``operators.jobs.job_states``. Rows differ by ``cause``: ``event`` for a state after events, with the ``previous_status`` that it takes the place of (null: a
    new job); ``refused`` for one event_id that its job's state didn't allow, the side output that equals the twin's ``rejected_events``; ``lease expired`` when the
    watermark passes a lease: the job is claimable again. An ended job's state goes a week of event time after its last event; events behind the watermark
    are dropped by Spark and counted in the query's progress (``numRowsDroppedByWatermark``).
    """
    fresh = events.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return fresh.groupBy("job_id").applyInPandasWithState(_keep, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def states_of(tracked: DataFrame) -> DataFrame:
    """The rows of ``track_jobs`` that are states."""
    return tracked.where("cause <> 'refused'").drop("event_id")


def refused_of(tracked: DataFrame) -> DataFrame:
    """(job_id, event_id) of the events that were refused."""
    return tracked.where("cause = 'refused'").select("job_id", "event_id")


def score_intake(submissions: DataFrame, study: DataFrame, delay: str = "1 hour", **limits) -> DataFrame:
    """A stream of submissions with checks, score and verdict, joined to the static study candidates on tiles.

    Needs submission_id and submitted_at, the event time: a submission comes out once the watermark has passed it by ``delay``.

    A study row's duplicates lie within a quarter of its diameter or 5 km: it is put into the 27 cubes of that size around it, and a submission into its cube of
    each size (a dozen), so the join is an equi-join that streams, at the poles and the date line as elsewhere.
    """
    s = submissions.withWatermark("submitted_at", delay).withColumn("_level", F.explode(F.sequence(F.lit(0), level_of(F.lit(HALF_TURN_KM)))))
    s = cells(s, "longitude", "latitude", "_level", False)
    reach = F.greatest(F.lit(5.0), 0.25 * F.col("diameter_km"))
    t = cells(study.where("diameter_km IS NOT NULL").withColumn("_level", level_of(reach)), "lon", "lat", "_level", True)
    keys = ["_level", "_cx", "_cy", "_cz"]
    j = s.join(t.select(*keys, "candidate_id", "lon", "lat", F.col("diameter_km").alias("study_km")), keys, "left")
    away = great_circle_km("longitude", "latitude", "lon", "lat")
    hit = (F.col("diameter_km") > 0) & (away <= F.greatest(F.lit(5.0), 0.25 * F.least("diameter_km", "study_km")))
    best = F.min(F.when(hit, F.struct(away.alias("km"), "candidate_id")))
    kept = [c for c in submissions.columns if c != "submission_id"]
    one = j.groupBy("submission_id", "submitted_at").agg(*[F.first(c).alias(c) for c in kept if c != "submitted_at"], best.alias("_b"))
    return one.withColumn("duplicate_of", F.col("_b.candidate_id")).withColumns(intake_checks(**limits)).drop("_b")


DASHBOARD = "status string, jobs long"
REFUSED = "job_id long, event_id long"


def status_steps(states: DataFrame) -> DataFrame:
    """(status, jobs): what each change takes from its old status (-1) and gives to its new one (1)."""
    moved = states.where(~F.col("status").eqNullSafe(F.col("previous_status")))
    step = lambda c, n: F.struct(F.col(c).alias("status"), F.lit(n).cast("long").alias("jobs"))
    return moved.select(F.explode(F.array(step("previous_status", -1), step("status", 1))).alias("s")).select("s.*").where("status IS NOT NULL")


def queue_counts(counts: KeyedTable, refused: KeyedTable | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` for ``track_jobs``: keeps in ``counts`` (schema ``DASHBOARD``) how many jobs are in each status now, in ``refused`` (``REFUSED``) the refused events.

    Every change is a retraction and an addition, so the numbers are those of a grouping of the last states, however the events fell into batches.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two tables from one pass over the states
        steps = status_steps(states_of(batch)).groupBy("status").agg(F.sum("jobs").alias("jobs"))
        counts.fold(steps, batch_id, summed(["status"], ["jobs"]))
        if refused is not None:
            refused.fold(refused_of(batch), batch_id, lambda table, new: table.unionByName(new).distinct())
        batch.unpersist()

    return take


RESULTS = "job_id long, received_at timestamp, status string, score double, score_percentile double, review_tier string, method_version string, worker_id string, worker_version string, runtime_seconds double, metrics string, diagnostics string, source_fingerprints string"


def upsert_results(table: KeyedTable, refused: KeyedTable | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` for a stream of (job_id, received_at, payload): ``table`` (schema ``RESULTS``) holds each job's latest valid result.

    Payloads that are no JSON object or have an unknown status go to ``refused`` (job_id long, received_at timestamp, error string), one row a job and time. A batch that
    comes again changes nothing, and neither does a result that came before.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = parse_results(batch)
        table.fold(rows.where("error IS NULL"), batch_id, latest_by(["job_id"], ["received_at", "status", "score", "method_version"]))
        if refused is not None:
            refused.fold(rows.where("error IS NOT NULL"), batch_id, latest_by(["job_id", "received_at"], ["error"]))

    return take


def supersede_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The request that counts for each candidate whenever it changes, from a stream of (request_id, candidate_id, requested_at, baseline_passed, forced).

    Requests that passed no baseline check and aren't forced don't count. Update mode: (candidate_id, request_id, requested_at) of the latest request so
    far, which cancels the earlier ones.
    """
    latest = F.max(F.struct("requested_at", "request_id")).alias("_r")
    counted = allowed_requests(requests.withWatermark("requested_at", delay)).dropDuplicatesWithinWatermark(["request_id"])
    return counted.groupBy("candidate_id").agg(latest).select("candidate_id", "_r.request_id", "_r.requested_at")


def replay(events: DataFrame, spark_name: str, delay: str = "1 hour") -> DataFrame:
    """Run ``track_jobs`` over all of a stream's present input, and return what it put out as a table."""
    q = track_jobs(events, delay).writeStream.format("memory").queryName(spark_name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return events.sparkSession.table(spark_name)
