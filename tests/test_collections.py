import datetime as dt

from runledger.operators import collections as C

T0 = dt.datetime(2026, 1, 1)


def frames(spark, jobs_rows, members_rows, collections_rows):
    wf = spark.createDataFrame(
        [("wf", "v1", "retired", 2, T0), ("wf", "v2", "active", 2, T0)],
        "workflow_id string, version string, status string, max_retries int, created_at timestamp")
    jobs = spark.createDataFrame(
        jobs_rows, "sample_id string, workflow_id string, workflow_version string, status string, "
                   "completed_at timestamp")
    members = spark.createDataFrame(members_rows, "collection_id string, sample_id string")
    cols = spark.createDataFrame(collections_rows,
                                 "collection_id string, source string, label string, created_at timestamp")
    return wf, jobs, members, cols


def test_leaderboard_laggard_first(spark):
    jobs = [("a1", "wf", "v2", "completed", T0), ("a2", "wf", "v2", "completed", T0),
            ("a3", "wf", "v2", "completed", T0), ("a4", "wf", "v2", "running", None),
            ("b1", "wf", "v2", "failed", None), ("b2", "wf", "v1", "completed", T0),
            ("x9", "wf", "v2", "completed", T0)]   # outsider: no membership
    members = [("A", s) for s in ("a1", "a2", "a3", "a4")] + [("B", "b1"), ("B", "b2")]
    cols = [("A", "study", "A", T0), ("B", "study", "B", T0), ("E", "study", "E", T0)]
    wf, j, m, c = frames(spark, jobs, members, cols)
    rows = C.leaderboard(c, m, j, wf).collect()
    by = {r["collection_id"]: r for r in rows}
    assert by["A"]["completion_pct"] == 75.0 and by["A"]["samples_running"] == 1
    assert by["B"]["completion_pct"] == 0.0 and by["B"]["samples_failed"] == 1
    assert by["E"]["completion_pct"] == 0.0 and by["E"]["sample_count"] == 0
    # laggards first, then bigger collections: B (0 %, 2) before E (0 %, 0) before A
    assert [r["collection_id"] for r in rows] == ["B", "E", "A"]


def test_summary_active_scope_and_all_versions(spark):
    jobs = [("s1", "wf", "v2", "completed", T0), ("s2", "wf", "v2", "completed", T0),
            ("s3", "wf", "v2", "pending", None)] + \
           [(s, "wf", "v1", "completed", T0) for s in ("s1", "s2", "s3", "s4")]
    members = [("C", s) for s in ("s1", "s2", "s3", "s4")]
    wf, j, m, c = frames(spark, jobs, members, [("C", "study", "C", T0)])
    act = C.collection_summary(c, m, j, wf, collection_id="C").collect()[0]
    assert act["completion_pct"] == 50.0 and act["total_jobs"] == 3 and act["sample_count"] == 4
    allv = C.collection_summary(c, m, j, wf, collection_id="C", include_all=True).collect()[0]
    assert allv["total_jobs"] == 7 and allv["completed"] == 6
    assert allv["samples_completed"] == 4 and allv["completion_pct"] == 100.0


def test_failures_drilldown_and_share(spark):
    wf = spark.createDataFrame([("wf", "v2", "active", 2, T0)],
                               "workflow_id string, version string, status string, max_retries int, "
                               "created_at timestamp")
    tasks = spark.createDataFrame(
        [(1, "s1", "wf", "v2", "P", "FAILED", T0, "n", "ab/cd", "1", 1, "r1"),
         (2, "s1", "wf", "v2", "P", "ABORTED", T0, "n", "ab/ce", None, 2, "r1"),
         (3, "s2", "wf", "v2", "Q", "FAILED", T0, "n", "ab/cf", "1", 1, "r2"),
         (4, "s2", "wf", "v2", "Q", "COMPLETED", T0, "n", "ab/cg", "0", 1, "r2")],
        "telemetry_id long, sample_id string, workflow_id string, workflow_version string, process string, "
        "status string, utc_time timestamp, name string, task_hash string, exit_code string, attempt int, "
        "run_name string")
    members = spark.createDataFrame([("C", "s1"), ("C", "s2")], "collection_id string, sample_id string")
    fb = {r["process"]: r for r in C.failure_by_process(tasks, members, wf).collect()}
    assert fb["P"]["failed_count"] == 2 and fb["P"]["sample_count"] == 1
    assert round(fb["P"]["failure_share"] + fb["Q"]["failure_share"]) == 100
    rows = C.collection_failures(tasks, members, wf, collection_id="C", process="P").collect()
    assert sorted(r["telemetry_id"] for r in rows) == [1, 2]
