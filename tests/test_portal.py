"""Catalogue repair, results of jobs, feeds and small relational rules on hand-made tables."""

import json

from arcwright.functions import geo as G
from arcwright.functions import text as X
from arcwright.operators import jobs as J
from arcwright.operators import relational as L
from arcwright.operators import wiki as K
from pyspark.sql import functions as F


def test_catalogue_repair(spark):
    text = "\n".join(
        ["{| class=x", "| before the first row", "| a", "| b", "| 1", "|-", "| [[Acraman crater|Acraman]]", "| South", "| Australia", "| {{sort|90|90 km}}", "| {{coord|32|1|S|135|27|E}}", "|-", "| short", "|}", "{|", "|-", "| Open", "| a", "| b", "| 5"]
    )
    pages = spark.createDataFrame([("p", text)], "page string, text string")
    rows = [(1, "Acraman", "s", 135.45, -32.0167, 9.0, "90", "", "Australia"), (2, "Elsewhere", "s", 135.45, -32.01, 5.0, "about 5", "", ""), (3, "Nowhere", "s", 0.0, 0.0, 7.0, None, "", "")]
    records = spark.createDataFrame(rows, "record_id long, name string, source_key string, lon double, lat double, diameter_km double, diameter_raw string, coordinate_title string, place string")
    out = K.repair_catalogue(records, pages, spark.createDataFrame([(3, 1, "twin")], "record_id long, duplicate_of long, note string"))
    got = {r["record_id"]: r for r in out["audit"].collect()}
    assert (got[1]["diameter_km"], got[1]["diameter_km_original"], got[1]["diameter_repair_status"]) == (90.0, 9.0, "verified_against_snapshot")
    assert [got[i]["coordinate_audit_status"] for i in (1, 2, 3)] == ["verified_within_5_km", "verified_by_coordinate_alias_within_5_km", "not_found_in_2026_snapshot"]
    s = out["summary"].first()
    assert (s["records"], s["unique_records"], s["diameters_changed"], s["coordinates_verified_by_alias"]) == (3, 2, 1, 1)


def test_results_of_jobs(spark):
    payload = {"status": "succeeded", "score": 0.7, "method_version": "v" * 200, "metrics": [1], "diagnostics": {"a": 1}, "artifacts": [{"kind": "diagnostic_png", "mime_type": "image/png", "content_base64": "aGk="}, None]}
    rows = [(1, 1, json.dumps(payload)), (2, 1, json.dumps({"status": "done"})), (3, 1, "[1]"), (4, 1, "no json"), (5, 1, json.dumps({"status": "failed"}))]
    results = J.parse_results(spark.createDataFrame(rows, "job_id long, received_at long, payload string"))
    got = {r["job_id"]: r for r in results.collect()}
    assert [got[i]["error"] for i in (1, 2, 3, 4, 5)] == [None, "status", "payload", "payload", None]
    assert got[1]["metrics"] == "{}" and json.loads(got[1]["diagnostics"]) == {"a": 1} and len(got[1]["method_version"]) == 120 and len(got[1]["artifacts"]) == 1
    candidates = spark.createDataFrame(
        [("a", 1, "claimed", "x", None, None, None), ("b", 5, "claimed", "x", 0.5, "m", "f"), ("c", 2, "claimed", "x", 0.1, "m", "f")],
        "candidate_id string, job_id long, job_status string, followup_status string, followup_score double, method_version string, diagnostic_figure_url string",
    )
    done = {r["candidate_id"]: r for r in J.apply_results(candidates, results, J.decode_artifacts(results)).collect()}
    assert (done["a"]["followup_status"], done["a"]["followup_score"]) == ("scored", 0.7) and done["a"]["diagnostic_figure_url"].startswith("artifact/")
    assert (done["b"]["followup_status"], done["b"]["followup_score"]) == ("failed", 0.5) and done["c"]["followup_status"] == "x"


def test_small_rules(spark):
    rows = spark.createDataFrame([("a", "me", "published"), ("b", "you", "published"), ("c", "me", "draft"), ("d", None, "draft")], "id string, owner string, status string")
    seen = lambda scope: {r["id"] for r in L.visible_to(rows, "me", ("published",), scope).collect()}
    assert seen("all") == {"a", "b", "c"} and seen("own") == {"a", "c"} and seen("others") == {"b"}
    figures = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "candidate_id string, figure_id long, figure_title string")
    with_one = {r["candidate_id"]: r for r in L.with_figures(rows.withColumnRenamed("id", "candidate_id"), figures).collect()}
    assert with_one["a"]["figure_title"] == "one" and not with_one["b"]["has_figure"]
    one = spark.range(1).select(X.clean_json(F.lit('{"a": [NaN, 1, "NaN"], "b": -Infinity}')).alias("j")).first()["j"]
    assert json.loads(one) == {"a": [None, 1, "NaN"], "b": None}
    rings = L.planetary_rings(spark.createDataFrame([([400.0, 100.0, 200.0],)], "ring_diameters_km array<double>")).first()
    assert rings["ring_ratios"] == [2.0, 2.0] and rings["number_of_nested_rings"] == 3
    G.register(spark)
    r = spark.sql("SELECT arc_km(0, 0, 1, 0) AS km, arc_wrap_lon(190) AS w, arc_name_key('Ångström 2') AS k, (SELECT count(*) FROM arc_circle(0, 0, 100, 8)) AS n, (SELECT count(*) FROM arc_tiles(-5, -5, 5, 5, 10)) AS t").first()
    assert abs(r["km"] - 111.195) < 0.01 and r["w"] == -170 and r["k"] == "angstrom2" and r["n"] == 9 and r["t"] == 4


def test_clean_json_takes_long_strings(spark):
    long = "x" * 10_000_000
    escaped = '\\"NaN\\\\' * 200_000
    rows = [(1, '{"a": "' + long + '", "b": NaN}'), (2, '{"a": "' + escaped + '", "b": [-Infinity, "\\\\", NaN]}'), (3, '{"a": "NaN'), (4, '{"a": "\u0001"}'), (6, None), (7, "[NaN,NaN]")]
    got = {r["k"]: r["j"] for r in spark.createDataFrame(rows, "k int, j string").select("k", X.clean_json("j").alias("j")).collect()}
    assert json.loads(got[1]) == {"a": long, "b": None}
    assert json.loads(got[2]) == {"a": '"NaN\\' * 200_000, "b": [None, "\\", None]}
    assert [got[k] for k in (3, 4, 6)] == [None] * 3 and got[7] == "[null,null]"


def test_review_rules(spark):
    schema = "change_id long, item_id long, changed_at long, action string, actor string, passed boolean, target string, may_review boolean"
    rows = [
        (1, 1, 0, "edit", "me", True, None, True), (2, 1, 1, "submit", "me", False, None, False), (3, 1, 2, "submit", "you", True, None, False), (4, 1, 3, "edit", "you", True, None, False), (5, 1, 4, "edit", "me", True, None, False),
        (6, 1, 5, "status", "me", None, "accepted", False), (7, 1, 6, "status", "r", None, "splendid", True), (8, 1, 7, "status", "r", None, "under_review", True), (9, 1, 8, "edit", "me", False, None, False), (10, 1, 9, "edit", "r", False, None, True),
        (11, 1, 10, "status", "r", None, "baseline_passed", True), (12, 1, 11, "edit", "me", False, None, False), (13, 1, 12, "wave", "r", None, None, True),
        (20, 2, 0, "submit", "me", True, None, False), (21, 2, 1, "delete", "me", None, None, False), (22, 2, 2, "delete", "r", None, None, True), (23, 2, 3, "edit", "me", True, None, True), (24, 2, 4, "submit", "me", True, None, False),
        (30, 3, 0, "submit", None, None, None, None), (31, 4, 0, "status", "r", None, "accepted", True),
    ]
    bulk = spark.createDataFrame([(40, [1, 3, 3, 9], 20, "rejected", "r", True, "all of them")], "change_id long, item_ids array<long>, changed_at long, target string, actor string, may_review boolean, note string")
    changes = J.per_item(spark.createDataFrame(rows, schema), bulk)
    got = {(r["change_id"], r["item_id"]): (r["from_status"], r["to_status"], r["refused"]) for r in J.reviewed(changes).collect()}
    p, f, u = "baseline_passed", "baseline_failed", "under_review"
    want = {1: (None, None, "unknown"), 2: (None, f, None), 3: (f, f, "exists"), 4: (f, f, "permission"), 5: (f, p, None), 6: (p, p, "permission"), 7: (p, p, "target"), 8: (p, u, None), 9: (u, u, "locked"), 10: (u, u, None), 11: (u, p, None), 12: (p, f, None), 13: (f, f, "action")}
    assert {k: got[k, 1] for k in want} == want
    assert [got[k, 2] for k in (20, 21, 22, 23, 24)] == [(None, p, None), (p, p, "permission"), (p, None, None), (None, None, "unknown"), (None, None, "exists")]
    assert got[30, 3] == (None, f, None) and got[31, 4] == (None, None, "unknown")
    assert got[40, 1] == (f, "rejected", None) and got[40, 3] == (f, "rejected", None) and got[40, 9] == (None, None, "unknown")
    states = {r["item_id"]: r for r in J.review_states(changes).collect()}
    assert set(states) == {1, 3} and (states[1]["status"], states[1]["owner"], states[1]["moderated_by"], states[1]["moderated_at"], states[1]["changes"], states[1]["refused"]) == ("rejected", "me", "r", 20, 7, 7)
    assert states[3]["owner"] is None


def test_sort_templates_and_references(spark):
    cells = {
        "{{sort|10|ten km}}": "ten km", "a {{ Sort |1| x | y }} b {{sort|2|z}}": "x | y", "{{sort|1|}} {{sort|2|b}}": "b", "{{other|1|c}}": "{{other|1|c}}", "{{sort|1|{d}}}": "{{sort|1|{d}}}", "{{sort|e}}": "{{sort|e}}",
        "plain": "plain", "{{sort|1|open": "{{sort|1|open", "": "", "{{x}}{{SORT\t|k|v}}": "v",
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r["c"]: r["v"] for r in df.select("c", X.rendered_value("c").alias("v")).collect()} == cells
    pages = {"<p>1 &lt; 2&nbsp;&amp;amp;</p>": "1 < 2 &amp;", "&eacute;&#233;&#xE9;&hellip;<br>x": "ééé… x", "a & b": "a & b", "no\n\n  sign": "no sign", "&notanentity;": "¬anentity;"}
    df = spark.createDataFrame([(c,) for c in [*pages, None]], "c string")
    got = {r["c"]: r["v"] for r in df.select("c", X.visible_text("c").alias("v")).collect()}
    assert got == pages | {None: None}


def test_heartbeats_in_a_row_are_one_step(spark):
    import datetime as D

    at = lambda i: D.datetime(2026, 1, 1) + D.timedelta(seconds=i)
    rows = [(1, 1, at(0), "queued", "w"), (2, 1, at(1), "claimed", "a")] + [(10 + i, 1, at(10 + i), "heartbeat", "b") for i in range(500)] + [(1000 + i, 1, at(1000 + i), "heartbeat", "a") for i in range(500)]
    rows += [(5000 + i, 2, at(i), "heartbeat", None) for i in range(300)] + [(6000, 1, at(2000), "claimed", "b"), (6001, 1, at(1499 + J.LEASE_SECONDS + 1), "claimed", "c")]
    events = spark.createDataFrame(rows, "event_id long, job_id long, event_ts timestamp, event string, worker_id string")
    got = {r["job_id"]: r for r in J.job_states(events).collect()}
    assert (got[1]["status"], got[1]["worker_id"], got[1]["attempt_count"], got[1]["rejected"]) == ("claimed", "c", 2, 501)
    assert (got[2]["status"], got[2]["rejected"]) == (None, 300)
    refused = {r["event_id"] for r in J.rejected_events(events).collect()}
    assert refused == {10 + i for i in range(500)} | {5000 + i for i in range(300)} | {6000}
    assert J._folded(events, J.LEASE_SECONDS).agg(F.max(F.size("s.refused"))).first()[0] == 2
