"""The job-level fold against an independent event-by-event simulation of the guarded
updates, plus the pinned retry-budget, TTL and watchdog behaviours."""
import datetime as dt
import random

from runledger.operators import lifecycle as L
from runledger.plans.domain import Domain
from tests.conftest import SF_SMALL

TERMINAL_JOB = ("completed", "failed")


def simulate(events, max_retries):
    """Apply events one by one in arrival order, like the guarded UPDATEs do."""
    runs, jobs, dlq = {}, {}, set()
    for e in sorted(events, key=lambda e: e["seq"]):
        r, ev = e["run_name"], e["event"]
        if ev == "claim":
            runs.setdefault(r, "claimed")
            k = (e["sample_id"], e["workflow_id"], e["workflow_version"])
            j = jobs.setdefault(k, {"status": "pending", "retry": 0, "run": None})
            if j["status"] == "pending":
                j.update(status="claimed", run=r)
        elif ev == "submitted":
            if runs.get(r) == "claimed":
                runs[r] = "submitted"
                for j in jobs.values():
                    if j["run"] == r and j["status"] == "claimed":
                        j["status"] = "submitted"
        elif ev == "started":                      # the jobs' update does not look at the run
            if runs.get(r) in ("claimed", "submitted"):
                runs[r] = "running"
            for j in jobs.values():
                if j["run"] == r and j["status"] in ("claimed", "submitted"):
                    j["status"] = "running"
        elif ev == "sentinel":
            for k, j in jobs.items():
                if k[0] == e["sample_id"] and j["run"] == r and j["status"] not in TERMINAL_JOB:
                    j["status"] = "completed"
        elif ev in ("completed", "failed"):
            if runs.get(r, "completed") not in ("completed", "failed", "expired"):
                runs[r] = ev
            for k, j in jobs.items():
                if j["run"] == r and j["status"] in ("claimed", "submitted", "running"):
                    old = j["retry"]
                    j["retry"] = old + 1
                    if old < max_retries[k[1]]:
                        j.update(status="pending", run=None)
                    else:
                        j["status"] = "failed"
                        dlq.add(k)
        elif ev == "expire":
            if runs.get(r) == "claimed":
                runs[r] = "expired"
                for j in jobs.values():
                    if j["run"] == r and j["status"] == "claimed":
                        j.update(status="pending", run=None)
    return runs, jobs, dlq


def test_fold_matches_simulation(spark):
    d = Domain(spark, SF_SMALL)
    ev = d.lifecycle_events
    events = [r.asDict() for r in ev.collect()]
    max_retries = {r["workflow_id"]: r["max_retries"] for r in d.workflows.collect()}
    runs, jobs, dlq = simulate(events, max_retries)
    run_state = L.fold_runs(ev)
    got_runs = {r["run_name"]: r["status"] for r in run_state.collect()}
    assert got_runs == runs
    got = {(r["sample_id"], r["workflow_id"], r["workflow_version"]): r
           for r in L.fold_jobs(ev, d.workflows).collect()}
    assert set(got) == set(jobs)
    for k, j in jobs.items():
        g = got[k]
        assert (g["status"], g["retry_count"], g["run_name"]) == (j["status"], j["retry"], j["run"]), k
    assert {k for k, g in got.items() if g["dead_letter"]} == dlq
    assert len(dlq) > 0 and any(g["status"] == "completed" for g in got.values())


def _state(spark, jobs, runs):
    wf = spark.createDataFrame([("wf", "v", "active", 1)],
                               "workflow_id string, version string, status string, max_retries int")
    j = spark.createDataFrame(jobs, "job_id long, sample_id string, workflow_id string, "
                                    "workflow_version string, status string, run_name string, retry_count int")
    r = spark.createDataFrame(runs, "run_name string, status string, claimed_at timestamp, "
                                    "started_at timestamp, last_heartbeat_at timestamp, completed_at timestamp")
    return wf, j, r


NOW = dt.datetime(2026, 1, 1, 12, 0)


def test_retry_budget_and_dead_letter(spark):
    wf, jobs, _ = _state(spark, [(1, "s1", "wf", "v", "running", "r1", 0),
                                 (2, "s2", "wf", "v", "running", "r1", 1),
                                 (3, "s3", "wf", "v", "completed", "r1", 0)], [])
    closed = spark.createDataFrame([("r1",)], "run_name string")
    out, dlq = L.sweep(jobs, closed, wf, NOW)
    by = {r["job_id"]: r for r in out.collect()}
    assert (by[1]["status"], by[1]["retry_count"], by[1]["run_name"]) == ("pending", 1, None)
    assert (by[2]["status"], by[2]["retry_count"], by[2]["run_name"]) == ("failed", 2, "r1")
    assert by[3]["status"] == "completed"
    assert [r["job_id"] for r in dlq.collect()] == [2]
    # a second sweep of the same run finds nothing in flight
    out2, dlq2 = L.sweep(out, closed, wf, NOW)
    assert dlq2.count() == 0 and {r["job_id"]: r["status"] for r in out2.collect()} == \
        {1: "pending", 2: "failed", 3: "completed"}


def test_watchdog_zombie_fresh_queued(spark):
    wf, jobs, runs = _state(
        spark,
        [(1, "s1", "wf", "v", "running", "zombie", 0), (2, "s2", "wf", "v", "running", "fresh", 0),
         (3, "s3", "wf", "v", "submitted", "queued", 0)],
        [("zombie", "running", NOW - dt.timedelta(hours=1), NOW - dt.timedelta(hours=1),
          NOW - dt.timedelta(minutes=30), None),
         ("fresh", "running", NOW - dt.timedelta(hours=1), NOW - dt.timedelta(hours=1),
          NOW - dt.timedelta(minutes=1), None),
         ("queued", "submitted", NOW - dt.timedelta(minutes=45), None, None, None)])
    new_runs, new_jobs, _ = L.heartbeat_watchdog(runs, jobs, wf, NOW)
    assert {r["run_name"]: r["status"] for r in new_runs.collect()} == \
        {"zombie": "failed", "fresh": "running", "queued": "submitted"}
    by = {r["job_id"]: r for r in new_jobs.collect()}
    assert (by[1]["status"], by[1]["run_name"]) == ("pending", None)
    assert by[2]["status"] == "running" and by[3]["status"] == "submitted"


def test_claim_ttl_no_penalty(spark):
    wf, jobs, runs = _state(
        spark, [(1, "s1", "wf", "v", "claimed", "old", 0), (2, "s2", "wf", "v", "claimed", "new", 0)],
        [("old", "claimed", NOW - dt.timedelta(minutes=6), None, None, None),
         ("new", "claimed", NOW - dt.timedelta(minutes=1), None, None, None)])
    new_runs, new_jobs = L.requeue_expired(runs, jobs, NOW)
    assert {r["run_name"]: r["status"] for r in new_runs.collect()} == {"old": "expired", "new": "claimed"}
    by = {r["job_id"]: r for r in new_jobs.collect()}
    assert (by[1]["status"], by[1]["retry_count"], by[1]["run_name"]) == ("pending", 0, None)
    assert by[2]["status"] == "claimed"


def test_run_events_summary(spark):
    ev = spark.createDataFrame(
        [("r1", 1, "pre_nextflow", 30, None, None, None, NOW),
         ("r1", 2, "slurm_state", None, None, "PENDING", "Priority", NOW),
         ("r1", 3, "slurm_state", None, None, "RUNNING", None, NOW + dt.timedelta(minutes=1)),
         ("r1", 4, "wrapper_exited", None, 1, None, None, NOW + dt.timedelta(minutes=2)),
         ("r1", 5, "heartbeat", None, None, None, None, NOW + dt.timedelta(minutes=1)),
         ("r1", 6, "pre_nextflow", None, None, None, None, NOW + dt.timedelta(minutes=3)),
         ("nobody", 7, "heartbeat", None, None, None, None, NOW)],
        "run_name string, seq long, type string, wait_seconds long, exit_code long, state string, "
        "reason string, received_at timestamp")
    known = spark.createDataFrame([("r1",)], "run_name string")
    [r] = L.apply_run_events(ev, known).collect()
    assert r["wait_seconds"] == 30 and r["wrapper_exit_code"] == 1
    assert r["slurm_state"] == "RUNNING" and r["slurm_reason"] is None   # reason cleared
    assert r["last_heartbeat_at"] == NOW + dt.timedelta(minutes=1)     # heartbeats only


def test_reset_and_requeue_dead_letter(spark):
    wf, jobs, _ = _state(spark, [(1, "s1", "wf", "v", "failed", "r1", 2),
                                 (2, "s2", "wf", "v", "running", "r2", 1),
                                 (3, "s3", "wf", "v", "completed", "r3", 0)], [])
    out = {r["job_id"]: r for r in L.reset_jobs(jobs, "wf").collect()}
    assert (out[1]["status"], out[1]["retry_count"], out[1]["run_name"]) == ("pending", 0, None)
    assert (out[2]["status"], out[2]["retry_count"]) == ("pending", 0)
    assert out[3]["status"] == "completed"
    dlq = spark.createDataFrame([(1, None)], "job_id long, resolved_at timestamp")
    new_jobs, new_dlq = L.requeue_dead_letter(dlq, jobs, NOW)
    assert {r["job_id"]: r["status"] for r in new_jobs.collect()}[1] == "pending"
    assert new_dlq.collect()[0]["resolved_at"] == NOW


def test_close_run_first_terminal_wins(spark):
    _, _, runs = _state(spark, [], [("a", "failed", NOW, NOW, NOW, NOW), ("b", "running", NOW, NOW, NOW, None)])
    names = spark.createDataFrame([("a",), ("b",)], "run_name string")
    got = {r["run_name"]: r["status"] for r in L.close_runs(runs, names, "completed", NOW).collect()}
    assert got == {"a": "failed", "b": "completed"}


def test_fold_edge_cases_match_simulation(spark):
    """A sentinel that arrives before its run's claim, a claim while the job is held by
    another run, a late sentinel after the run closed, and an expiry."""
    rows = [
        (1, "r1", "claim", "A", "wf", "v"), (2, "r2", "sentinel", "A", None, None),
        (3, "r1", "completed", None, None, None),            # A swept: retry 1, pending
        (4, "r2", "claim", "A", "wf", "v"), (5, "r2", "sentinel", "A", None, None),   # A completed
        (10, "r3", "claim", "B", "wf", "v"), (11, "r4", "claim", "B", "wf", "v"),     # r4 claim ineffective
        (12, "r4", "completed", None, None, None), (13, "r3", "failed", None, None, None),
        (14, "r3", "sentinel", "B", None, None),             # late: ignored
        (20, "r5", "claim", "C", "wf", "v"), (21, "r5", "expire", None, None, None),
        (22, "r6", "claim", "C", "wf", "v"), (23, "r6", "submitted", None, None, None),
        (30, "r7", "claim", "D", "wf", "v"), (31, "r7", "completed", None, None, None),
        (32, "r8", "claim", "D", "wf", "v"), (33, "r8", "completed", None, None, None),   # D exhausts budget 1
    ]
    ev = spark.createDataFrame(
        [(s, r, e, smp, w, v, None, dt.datetime(2026, 1, 1)) for s, r, e, smp, w, v in rows],
        "seq long, run_name string, event string, sample_id string, workflow_id string, "
        "workflow_version string, run_id string, utc_time timestamp")
    wf = spark.createDataFrame([("wf", "v", "active", 1)],
                               "workflow_id string, version string, status string, max_retries int")
    runs, jobs, dlq = simulate([r.asDict() for r in ev.collect()], {"wf": 1})
    run_state = L.fold_runs(ev)
    assert {r["run_name"]: r["status"] for r in run_state.collect()} == runs
    got = {r["sample_id"]: r for r in L.fold_jobs(ev, wf).collect()}
    for k, j in jobs.items():
        g = got[k[0]]
        assert (g["status"], g["retry_count"], g["run_name"]) == (j["status"], j["retry"], j["run"]), k
    assert {k for k, g in got.items() if g["dead_letter"]} == {k[0] for k in dlq}
    assert got["A"]["status"] == "completed" and got["B"]["retry_count"] == 1
    assert got["C"]["status"] == "submitted" and got["D"]["status"] == "failed"


def test_fold_of_unordered_logs_matches_simulation(spark):
    """Random logs: events before any claim, late claims, repeated starts and closes."""
    rng = random.Random(11)
    rows = []
    for g in range(60):                                   # independent groups of runs and samples
        for k in range(25):
            ev = rng.choice(["claim"] * 4 + ["submitted", "started", "sentinel", "sentinel", "completed", "failed", "expire"])
            named = ev in ("claim", "sentinel")
            rows.append((g * 100 + k, f"r{g}-{rng.randrange(4)}", ev, f"S{g}-{rng.randrange(3)}" if named else None,
                         "wf" if ev == "claim" else None, "v" if ev == "claim" else None, None, NOW))
    ev = spark.createDataFrame(rows, "seq long, run_name string, event string, sample_id string, workflow_id string, "
                                     "workflow_version string, run_id string, utc_time timestamp")
    wf = spark.createDataFrame([("wf", "v", "active", 1)], "workflow_id string, version string, status string, max_retries int")
    runs, jobs, dlq = simulate([r.asDict() for r in ev.collect()], {"wf": 1})
    assert {r["run_name"]: r["status"] for r in L.fold_runs(ev).collect()} == runs
    got = {(r["sample_id"], r["workflow_id"], r["workflow_version"]): r for r in L.fold_jobs(ev, wf).collect()}
    assert {k: (g["status"], g["retry_count"], g["run_name"]) for k, g in got.items()} == {
        k: (j["status"], j["retry"], j["run"]) for k, j in jobs.items()}
    assert {k for k, g in got.items() if g["dead_letter"]} == dlq and len(dlq) > 5
