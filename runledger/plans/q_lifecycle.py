"""Registered lifecycle folds (L1-L13) and state-table sweeps."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import parse_tag
from ..operators import lifecycle as L
from .q_collections import AS_OF
from .registry import register

BIG = 2 ** 62


@register("lifecycle_runs", ("lifecycle_events",), f"""
, g AS (SELECT run_name,
   min(seq) FILTER (WHERE event = 'claim') AS claim_seq,
   min(utc_time) FILTER (WHERE event = 'claim') AS claimed_at,
   min(seq) FILTER (WHERE event = 'submitted') AS submit_seq,
   min(seq) FILTER (WHERE event = 'started') AS start_any,
   min(seq) FILTER (WHERE event IN ('completed', 'failed')) AS close_seq,
   arg_min(event, seq) FILTER (WHERE event IN ('completed', 'failed')) AS close_kind,
   arg_min(utc_time, seq) FILTER (WHERE event IN ('completed', 'failed')) AS closed_at0,
   min(seq) FILTER (WHERE event = 'expire') AS expire_any
  FROM lifecycle_events GROUP BY run_name),
e AS (SELECT *, CASE WHEN expire_any < least(coalesce(submit_seq, {BIG}), coalesce(start_any, {BIG}),
                                           coalesce(close_seq, {BIG})) THEN expire_any END AS expire_seq FROM g),
e2 AS (SELECT *, coalesce(expire_seq, close_seq) AS end_seq FROM e),
s AS (SELECT l.run_name, arg_min(l.run_id, l.seq) AS run_id, min(l.seq) AS start_seq,
             arg_min(l.utc_time, l.seq) AS started_at
      FROM lifecycle_events l JOIN e2 ON l.run_name = e2.run_name
      WHERE l.event = 'started' AND l.seq < coalesce(e2.end_seq, {BIG}) GROUP BY l.run_name)
SELECT e2.run_name, s.run_id,
  CASE WHEN expire_seq IS NOT NULL THEN 'expired' WHEN close_kind IS NOT NULL THEN close_kind
       WHEN s.start_seq IS NOT NULL THEN 'running'
       WHEN submit_seq < coalesce(end_seq, {BIG}) THEN 'submitted' ELSE 'claimed' END AS status,
  claim_seq, end_seq, claimed_at, s.started_at,
  CASE WHEN expire_seq IS NULL THEN closed_at0 END AS closed_at, expire_seq IS NOT NULL AS expired
FROM e2 LEFT JOIN s ON s.run_name = e2.run_name
""")
def q_lifecycle_runs(d):
    """L1-L3, L5, L7, L13 run-level fold of the lifecycle event log."""
    return L.fold_runs(d.lifecycle_events)


# The job fold, event by event. A run exists from its first claim on; the first event of its
# own after that decides whether a submit or an expiry found it still claimed.
_JOBS_SQL = """
, claimed AS (SELECT run_name, min(seq) AS since FROM lifecycle_events WHERE event = 'claim' GROUP BY run_name),
opening AS (
  SELECT e.run_name, min(e.seq) AS seq FROM lifecycle_events e JOIN claimed c ON c.run_name = e.run_name AND e.seq > c.since
  WHERE e.event NOT IN ('claim', 'sentinel') GROUP BY e.run_name),
tickets AS (
  SELECT sample_id, workflow_id, workflow_version, run_name, min(seq) AS since
  FROM lifecycle_events WHERE event = 'claim' GROUP BY ALL),
steps AS (
  SELECT sample_id, workflow_id, workflow_version, seq, event, run_name FROM lifecycle_events WHERE event = 'claim'
  UNION ALL
  SELECT t.sample_id, t.workflow_id, t.workflow_version, e.seq, e.event, e.run_name
  FROM tickets t JOIN lifecycle_events e ON e.run_name = t.run_name AND e.seq > t.since
  LEFT JOIN opening o ON o.run_name = e.run_name AND o.seq = e.seq
  WHERE CASE e.event WHEN 'claim' THEN false WHEN 'sentinel' THEN e.sample_id = t.sample_id
        WHEN 'submitted' THEN o.seq IS NOT NULL WHEN 'expire' THEN o.seq IS NOT NULL ELSE true END),
ordered AS (
  SELECT s.*, coalesce(w.max_retries, 0) AS budget,
         row_number() OVER (PARTITION BY s.sample_id, s.workflow_id, s.workflow_version ORDER BY s.seq) AS k
  FROM steps s LEFT JOIN workflows w ON w.workflow_id = s.workflow_id AND w.version = s.workflow_version),
walk AS (
  SELECT DISTINCT sample_id, workflow_id, workflow_version, 0::BIGINT AS k, 'pending' AS status, 0::BIGINT AS retries,
         NULL::VARCHAR AS run, NULL::BIGINT AS done_seq FROM ordered
  UNION ALL
  SELECT p.sample_id, p.workflow_id, p.workflow_version, p.k + 1,
    CASE WHEN o.event = 'claim' THEN CASE p.status WHEN 'pending' THEN 'claimed' ELSE p.status END
         WHEN p.run IS DISTINCT FROM o.run_name OR p.status IN ('completed', 'failed') THEN p.status
         WHEN o.event = 'sentinel' THEN 'completed'
         WHEN o.event IN ('completed', 'failed') THEN CASE WHEN p.retries < o.budget THEN 'pending' ELSE 'failed' END
         WHEN o.event = 'started' THEN 'running'
         WHEN p.status <> 'claimed' THEN p.status
         WHEN o.event = 'submitted' THEN 'submitted' ELSE 'pending' END,
    p.retries + CASE WHEN p.run = o.run_name AND p.status NOT IN ('completed', 'failed')
                      AND o.event IN ('completed', 'failed') THEN 1 ELSE 0 END,
    CASE WHEN o.event = 'claim' THEN CASE p.status WHEN 'pending' THEN o.run_name ELSE p.run END
         WHEN p.run IS DISTINCT FROM o.run_name OR p.status IN ('completed', 'failed') THEN p.run
         WHEN o.event IN ('completed', 'failed') AND p.retries < o.budget THEN NULL
         WHEN o.event = 'expire' AND p.status = 'claimed' THEN NULL ELSE p.run END,
    CASE WHEN o.event = 'sentinel' AND p.run = o.run_name AND p.status NOT IN ('completed', 'failed') THEN o.seq
         ELSE p.done_seq END
  FROM walk p JOIN ordered o ON o.sample_id = p.sample_id AND o.workflow_id = p.workflow_id
    AND o.workflow_version = p.workflow_version AND o.k = p.k + 1),
state AS (
  SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY sample_id, workflow_id, workflow_version ORDER BY k DESC) = 1)
"""


@register("lifecycle_jobs", ("lifecycle_events", "workflows"), _JOBS_SQL + """
SELECT sample_id, workflow_id, workflow_version, status, retries AS retry_count, run AS run_name,
  status = 'failed' AS dead_letter, CASE WHEN status = 'failed' THEN run END AS dead_letter_run,
  done_seq AS completed_seq
FROM state
""")
def q_lifecycle_jobs(d):
    """L1-L4, L6, L7 job-level fold: final status, retries and dead-letter flag per job."""
    return L.fold_jobs(d.lifecycle_events, d.workflows)


@register("lifecycle_dead_letter", ("lifecycle_events", "workflows"), _JOBS_SQL + f"""
SELECT sample_id, workflow_id, workflow_version, run AS run_name, retries AS retry_count, '{L.SWEEP_REASON}' AS reason
FROM state WHERE status = 'failed'
""")
def q_lifecycle_dead_letter(d):
    """Dead-letter rows produced by the fold (one per failed job)."""
    return L.dead_letters(L.fold_jobs(d.lifecycle_events, d.workflows))


@register("lifecycle_events_from_log", ("weblog", "run_events", "jobs"), """
SELECT id AS seq, run_name, event, NULL AS sample_id, NULL AS workflow_id, NULL AS workflow_version, run_id, utc_time
FROM weblog WHERE event IN ('started', 'completed')
UNION ALL
SELECT id, run_name, 'sentinel', split_part(trace ->> '$.tag', ':', 1), NULL, NULL, run_id, utc_time
FROM weblog WHERE event = 'process_completed' AND trace ->> '$.process' LIKE '%MARK_COMPLETE' AND trace ->> '$.status' = 'COMPLETED'
  AND split_part(trace ->> '$.tag', ':', 1) <> ''
UNION ALL
SELECT seq, run_name, 'submitted', NULL, NULL, NULL, NULL, received_at FROM run_events WHERE type = 'wrapper_started'
UNION ALL
SELECT job_id, run_name, 'claim', sample_id, workflow_id, workflow_version, NULL, claimed_at FROM jobs WHERE run_name IS NOT NULL
""")
def q_lifecycle_events_from_log(d):
    """The lifecycle log derived from weblog events, wrapper events and dispatch records."""
    telemetry = d.weblog.select(F.col("id").alias("seq"), "run_name", "event", "trace", "run_id", "utc_time",
                                parse_tag(F.get_json_object("trace", "$['tag']")).alias("sample_id"))
    wrapper = d.run_events.withColumnRenamed("received_at", "utc_time")
    claims = d.jobs.filter("run_name is not null").select(
        F.col("job_id").alias("seq"), "run_name", "sample_id", "workflow_id", "workflow_version",
        F.col("claimed_at").alias("utc_time"))
    return L.lifecycle_log(telemetry, wrapper, claims)


_WD_CUT = "TIMESTAMP '2001-07-31 23:50:30'"


@register("heartbeat_watchdog", ("workflow_runs", "jobs", "workflows"), f"""
, stale AS (SELECT run_name FROM workflow_runs WHERE status = 'running'
            AND coalesce(last_heartbeat_at, started_at) < {_WD_CUT}),
j AS (SELECT j.*, w.max_retries,
        j.run_name IN (SELECT run_name FROM stale) AND j.status IN ('claimed', 'submitted', 'running') AS hit
      FROM jobs j LEFT JOIN workflows w ON w.workflow_id = j.workflow_id AND w.version = j.workflow_version)
SELECT job_id,
  CASE WHEN hit AND retry_count < coalesce(max_retries, 0) THEN 'pending' WHEN hit THEN 'failed' ELSE status END AS status,
  CASE WHEN hit THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN hit AND retry_count < coalesce(max_retries, 0) THEN NULL ELSE run_name END AS run_name
FROM j
""")
def q_heartbeat_watchdog(d):
    """L11 + L6: jobs after failing stale running runs and sweeping their jobs."""
    _, jobs, _ = L.heartbeat_watchdog(d.workflow_runs, d.jobs, d.workflows, AS_OF)
    return jobs.select("job_id", "status", "retry_count", "run_name")


@register("watchdog_runs", ("workflow_runs",), f"""
SELECT run_name, CASE WHEN status = 'running' AND coalesce(last_heartbeat_at, started_at) < {_WD_CUT}
                      THEN 'failed' ELSE status END AS status
FROM workflow_runs
""")
def q_watchdog_runs(d):
    """Run statuses after the heartbeat watchdog (submitted runs untouched)."""
    runs, _, _ = L.heartbeat_watchdog(d.workflow_runs, d.jobs, d.workflows, AS_OF)
    return runs.select("run_name", "status")


@register("watchdog_report", ("workflow_runs", "jobs"), f"""
SELECT r.run_name, coalesce(r.last_heartbeat_at, r.started_at) AS last_signal_at,
  (SELECT count(*) FROM jobs j WHERE j.run_name = r.run_name AND j.status IN ('claimed', 'submitted', 'running')) AS jobs_swept
FROM workflow_runs r WHERE r.status = 'running' AND coalesce(r.last_heartbeat_at, r.started_at) < {_WD_CUT}
""")
def q_watchdog_report(d):
    """The runs that the watchdog fails, with their last signal and swept jobs."""
    return L.watchdog_report(d.workflow_runs, d.jobs, AS_OF)


_NOW = "TIMESTAMP '2001-08-01 00:05:30'"


@register("sweep_jobs", ("workflow_runs", "jobs", "workflows"), f"""
SELECT j.job_id,
  CASE WHEN NOT hit THEN j.status WHEN j.retry_count < coalesce(w.max_retries, 0) THEN 'pending' ELSE 'failed' END AS status,
  j.retry_count + CASE WHEN hit THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN hit AND j.retry_count < coalesce(w.max_retries, 0) THEN NULL ELSE j.run_name END AS run_name,
  CASE WHEN hit AND j.retry_count >= coalesce(w.max_retries, 0) THEN {_NOW} END AS failed_at,
  CASE WHEN hit AND j.retry_count >= coalesce(w.max_retries, 0) THEN '{L.SWEEP_REASON}' END AS failure_reason
FROM (SELECT j.*, j.status IN ('claimed', 'submitted', 'running') AND j.run_name IN (
        SELECT run_name FROM workflow_runs WHERE status IN ('completed', 'failed')) AS hit FROM jobs j) j
LEFT JOIN workflows w ON w.workflow_id = j.workflow_id AND w.version = j.workflow_version
""")
def q_sweep_jobs(d):
    """Jobs after sweeping all closed runs, with failure time and reason."""
    closed = d.workflow_runs.filter(F.col("status").isin("completed", "failed"))
    jobs, _ = L.sweep(d.jobs, closed, d.workflows, AS_OF)
    return jobs.select("job_id", "status", "retry_count", "run_name", "failed_at", "failure_reason")


@register("sweep_dead_letters", ("workflow_runs", "jobs", "workflows", "dead_letter"), f"""
SELECT j.job_id, j.run_name, j.sample_id, j.workflow_id, j.workflow_version
FROM jobs j JOIN workflow_runs r ON r.run_name = j.run_name AND r.status IN ('completed', 'failed')
LEFT JOIN workflows w ON w.workflow_id = j.workflow_id AND w.version = j.workflow_version
WHERE j.status IN ('claimed', 'submitted', 'running') AND j.retry_count >= coalesce(w.max_retries, 0)
  AND j.job_id NOT IN (SELECT job_id FROM dead_letter)
""")
def q_sweep_dead_letters(d):
    """Dead-letter rows that the sweep inserts; jobs that have one get no second."""
    closed = d.workflow_runs.filter(F.col("status").isin("completed", "failed"))
    _, found = L.sweep(d.jobs, closed, d.workflows, AS_OF)
    return L.new_dead_letters(found, d.dead_letter).select("job_id", "run_name", "sample_id", "workflow_id", "workflow_version")


@register("requeue_dead_letter", ("jobs", "dead_letter"), """
SELECT job_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN hit THEN NULL ELSE run_name END AS run_name
FROM (SELECT *, job_id IN (SELECT job_id FROM dead_letter WHERE resolved_at IS NULL) AS hit FROM jobs)
""")
def q_requeue_dead_letter(d):
    """Jobs after the unresolved dead letters were put back."""
    jobs, _ = L.requeue_dead_letter(d.dead_letter, d.jobs, AS_OF)
    return jobs.select("job_id", "status", "retry_count", "run_name")


@register("reset_jobs", ("jobs",), """
SELECT job_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN hit THEN NULL ELSE run_name END AS run_name
FROM (SELECT *, workflow_id = 'shotgun' AND status IN ('running', 'failed') AS hit FROM jobs)
""")
def q_reset_jobs(d):
    """Running and failed jobs of one workflow back to pending."""
    return L.reset_jobs(d.jobs, "shotgun").select("job_id", "status", "retry_count", "run_name")


@register("expire_stale_runs", ("workflow_runs",), f"""
SELECT run_name, CASE WHEN status IN ('running', 'submitted') AND claimed_at < TIMESTAMP '2001-07-31 22:05:30'
                      THEN 'completed' ELSE status END AS status
FROM workflow_runs
""")
def q_expire_stale_runs(d):
    """Runs claimed more than two hours ago and still open are closed."""
    runs, _, _ = L.expire_stale_runs(d.workflow_runs, d.jobs, d.workflows, AS_OF)
    return runs.select("run_name", "status")


@register("claim_ttl", ("workflow_runs", "jobs"), """
, gone AS (SELECT run_name FROM workflow_runs WHERE status = 'claimed' AND claimed_at < TIMESTAMP '2001-08-01 00:00:30')
SELECT job_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE run_name END AS run_name
FROM (SELECT *, status = 'claimed' AND run_name IN (SELECT run_name FROM gone) AS hit FROM jobs)
""")
def q_claim_ttl(d):
    """Jobs after expired claims were detached without a retry penalty."""
    _, jobs = L.requeue_expired(d.workflow_runs, d.jobs, AS_OF)
    return jobs.select("job_id", "status", "run_name")


@register("run_event_summary", ("run_events", "workflow_runs"), """
SELECT run_name,
  arg_max(wait_seconds, seq) FILTER (WHERE wait_seconds IS NOT NULL) AS wait_seconds,
  arg_max(exit_code, seq) FILTER (WHERE type = 'wrapper_exited' AND exit_code IS NOT NULL) AS wrapper_exit_code,
  max(received_at) FILTER (WHERE type = 'heartbeat') AS last_heartbeat_at,
  (arg_max({'s': state, 'r': reason}, seq) FILTER (WHERE type = 'slurm_state')).s AS slurm_state,
  (arg_max({'s': state, 'r': reason}, seq) FILTER (WHERE type = 'slurm_state')).r AS slurm_reason,
  bool_or(type = 'wrapper_started') AS started_by_wrapper
FROM run_events WHERE run_name IN (SELECT run_name FROM workflow_runs) GROUP BY run_name
""")
def q_run_event_summary(d):
    """Per-run summary columns from wrapper/scheduler events in arrival order (last
    non-NULL wait, last exit code, latest heartbeat, latest scheduler state and reason),
    for the runs of the registry."""
    return L.apply_run_events(d.run_events, d.workflow_runs)


@register("etl_status", ("jobs", "etl_ingested"), """
SELECT (SELECT count(*) FROM etl_ingested WHERE workflow_id = 'shotgun' AND workflow_version = '1-URGENT') AS ingested,
       (SELECT count(*) FROM jobs j WHERE j.status = 'completed' AND j.workflow_id = 'shotgun'
          AND j.workflow_version = '1-URGENT'
          AND NOT EXISTS (SELECT 1 FROM etl_ingested w WHERE w.sample_id = j.sample_id
                          AND w.workflow_id = j.workflow_id AND w.workflow_version = j.workflow_version)) AS backlog
""")
def q_etl_status(d):
    """Samples ingested and the backlog of the active shotgun version."""
    from ..operators import etl as E
    return E.etl_status(d.jobs, d.etl_ingested, "shotgun", "1-URGENT")
