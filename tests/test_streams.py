"""Streams that keep tables: dashboards by retraction, side tables, upserts, and the functions over streams."""

import datetime as D
import json
import random

import pytest
from arcwright.operators import jobs as J
from arcwright.streaming import jobs as ST
from arcwright.streaming.tables import KeyedTable, latest_by, summed
from pyspark.sql import functions as F

EVENTS = "event_id long, job_id long, event_ts timestamp, event string, worker_id string"
AT = D.datetime(2026, 1, 1)


def at(s):
    return AT + D.timedelta(seconds=s)


def many_events(n=400, jobs=25):
    draw = random.Random(2)
    kinds = ["queued", "claimed", "heartbeat", "succeeded", "failed", "cancelled"]
    out = [(k, k, at(k), "queued", "w0") for k in range(jobs)]
    return out + [(i, draw.randrange(jobs), at(10 * i), draw.choices(kinds, (2, 4, 4, 2, 1, 1))[0], draw.choice("ab")) for i in range(jobs, n)]


def stream(spark, folder, schema, parts):
    """A stream that reads one part a micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{i}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return files.parquet(str(folder))


def test_dashboard_and_side_table_equal_the_batch(spark, tmp_path):
    rows = many_events()
    parts = [rows[:150], rows[150:160], rows[160:]]
    events = stream(spark, tmp_path / "in", EVENTS, parts)
    counts, refused = KeyedTable(spark, str(tmp_path / "counts"), ST.DASHBOARD), KeyedTable(spark, str(tmp_path / "refused"), ST.REFUSED)
    tracked = ST.track_jobs(events, "2 hours")
    q = tracked.writeStream.foreachBatch(ST.queue_counts(counts, refused)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.createDataFrame(rows, EVENTS)
    want = {r["status"]: r["n"] for r in J.job_states(batch).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["status"]: r["jobs"] for r in counts.read().collect()} == want and len(want) > 3
    late = {r["event_id"] for r in J.rejected_events(batch).collect()}
    assert {r["event_id"] for r in refused.read().collect()} == late and len(late) > 50
    assert refused.read().count() == len(late)


def test_a_batch_counts_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, n long")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert table.read().count() == 0
    assert table.fold(one, 0, summed(["k"], ["n"])) and not table.fold(one, 0, summed(["k"], ["n"]))
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 2)}
    assert table.fold(one, 0, summed(["k"], ["n"]), "other stream")
    for i in range(1, 5):
        table.fold(spark.createDataFrame([("a", -1)], "k string, n long"), i, summed(["k"], ["n"]))
    assert {tuple(r) for r in table.read().collect()} == {("a", -2), ("b", 4)}
    table.fold(spark.createDataFrame([("a", 2)], "k string, n long"), 5, summed(["k"], ["n"]))
    assert {tuple(r) for r in table.read().collect()} == {("b", 4)}

    def dies(old, new):
        return old.unionByName(new).withColumn("n", F.raise_error(F.lit("half way")).cast("long"))

    with pytest.raises(Exception, match="half way"):
        table.fold(one, 6, dies)
    assert {tuple(r) for r in table.read().collect()} == {("b", 4)}
    assert table.fold(one, 6, summed(["k"], ["n"])) and table.read().count() == 2


def test_results_are_upserted(spark, tmp_path):
    payload = lambda status, score: json.dumps({"status": status, "score": score, "method_version": "m"})
    parts = [
        [(1, at(10), payload("succeeded", 0.5)), (2, at(10), payload("failed", None)), (3, at(5), "no json")],
        [(1, at(30), payload("succeeded", 0.9)), (2, at(1), payload("succeeded", 0.1)), (1, at(20), payload("failed", None))],
    ]
    schema = "job_id long, received_at timestamp, payload string"
    table, bad = KeyedTable(spark, str(tmp_path / "t"), ST.RESULTS), KeyedTable(spark, str(tmp_path / "bad"), "job_id long, received_at timestamp, error string")
    take = ST.upsert_results(table, bad)
    stream(spark, tmp_path / "in", schema, parts).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    want = [(1, at(30), "succeeded", 0.9), (2, at(10), "failed", None)]
    got = lambda: sorted((r["job_id"], r["received_at"], r["status"], r["score"]) for r in table.read().collect())
    assert got() == want and [tuple(r) for r in bad.read().collect()] == [(3, at(5), "payload")]
    for _ in range(2):  # replayed
        take(spark.createDataFrame(parts[0], schema), 0)
    assert got() == want
    take(spark.createDataFrame(parts[0], schema), 7)  # the same results in a later batch
    assert got() == want and table.read().count() == 2
    ranked = latest_by(["job_id"], ["received_at"])(spark.createDataFrame([(1, 1, "x")], "job_id int, received_at int, s string"), spark.createDataFrame([(1, 2, "y")], "job_id int, received_at int, s string"))
    assert [tuple(r) for r in ranked.collect()] == [(1, 2, "y")]


def test_intake_in_a_stream_equals_the_batch(spark, tmp_path):
    draw = random.Random(4)
    study = [(f"c{i}", draw.uniform(-180, 180), draw.choice([draw.uniform(-90, 90), 89.9, -89.97]), draw.uniform(5, 900)) for i in range(200)]
    places = [(draw.choice(study)[1] + draw.uniform(-0.3, 0.3), max(-90.0, min(90.0, draw.choice(study)[2] + draw.uniform(-0.2, 0.2)))) for _ in range(150)]
    places += [(lon + draw.uniform(-0.05, 0.05), lat) for _, lon, lat, _ in study[:100]] + [(lon + 179.9, lat) for _, lon, lat, _ in study if abs(lat) > 89.5]
    schema = "submission_id string, description string, source_title string, observed_feature string, endogenic_alternative string, source_uri string, source_resolution string, independent_evidence array<string>, original_trace_available boolean, has_geometry boolean, terms_confirmed boolean, longitude double, latitude double, diameter_km double, submitted_at timestamp"
    rows = [(f"s{i}", "d" * 80, "A good title", "A rim there", "a volcanic caldera would", "u", "30 m", ["gravity"], True, True, True, lon, lat, draw.choice([0.0, 20.0, 300.0]), at(i)) for i, (lon, lat) in enumerate(places)]
    rows.append(("end", *rows[0][1:11], 0.0, 0.0, 5.0, at(10**6)))
    known = spark.createDataFrame(study, "candidate_id string, lon double, lat double, diameter_km double")
    src = stream(spark, tmp_path / "in", schema, [rows[:100], rows[100:-1], rows[-1:]])
    ST.score_intake(src, known).writeStream.format("memory").queryName("intake").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["submission_id"]: (r["duplicate_of"], r["intake_score"], r["passed"]) for r in spark.table("intake").collect()}
    batch = J.score_submissions(spark.createDataFrame(rows[:-1], schema), known)
    want = {r["submission_id"]: (r["duplicate_of"], r["intake_score"], r["passed"]) for r in batch.collect()}
    assert got == want and sum(d is not None for d, _, _ in want.values()) > 40


def test_requests_supersede_in_a_stream(spark, tmp_path):
    schema = "request_id long, candidate_id string, requested_at timestamp, baseline_passed boolean, forced boolean"
    rows = [(1, "a", at(0), True, False), (2, "a", at(60), False, False), (3, "b", at(5), None, True), (4, "a", at(30), True, None), (4, "a", at(30), True, None), (5, "c", at(1), False, None)]
    src = stream(spark, tmp_path / "in", schema, [rows[:2], rows[2:]])
    ST.supersede_stream(src).writeStream.format("memory").queryName("requests").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in spark.table("requests").orderBy("requested_at").collect():
        last[r["candidate_id"]] = r["request_id"]
    assert last == {"a": 4, "b": 3}
