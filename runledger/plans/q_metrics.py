"""Registered metric queries (A1-A13, A32, O1, F1) with their oracle SQL."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import rollup
from ..operators.filters import MetricFilter
from ..sources.events import enrich_events, to_task_executions
from ..operators.paging import cursor_of
from ..session import scratch_path
from .registry import pct, r2, register

ALL = MetricFilter(all_time=True)
WINDOW = MetricFilter(since=dt.datetime(2000, 1, 1), until=dt.datetime(2001, 12, 31, 23, 59, 59))
FAILED = "status IN ('FAILED', 'ABORTED')"
TE = ("task_executions",)


def telemetry(d):
    """The event log as the ingest writes it: weblog rows + sample id + workflow lookup."""
    return enrich_events(d.weblog, d.workflow_runs)


# One tally of all facts; every figure is a sum over it, and the mode is the head of the
# process's own list of failed values, most frequent first.
_FAILURES_SQL = """
, tally AS (
  SELECT process, exit_code AS code, error_action AS action, status, count(*) AS k
  FROM task_executions {where} GROUP BY ALL),
bad AS (SELECT * FROM tally WHERE status IN ('FAILED', 'ABORTED')),
codes AS (
  SELECT process, list(code ORDER BY k DESC, code NULLS LAST) AS ranked
  FROM (SELECT process, code, sum(k) AS k FROM bad GROUP BY ALL) GROUP BY process),
actions AS (
  SELECT process, list(action ORDER BY k DESC, action) AS ranked
  FROM (SELECT process, action, sum(k) AS k FROM bad WHERE action IS NOT NULL GROUP BY ALL) GROUP BY process),
sums AS (
  SELECT process, CAST(sum(k) AS BIGINT) AS total_completed,
    CAST(sum(if(status = 'COMPLETED', k, 0)) AS BIGINT) AS success,
    CAST(sum(if(status = 'FAILED' OR status = 'ABORTED', k, 0)) AS BIGINT) AS failed
  FROM tally GROUP BY process)
SELECT sums.*, {pct} AS failure_pct,
  (SELECT ranked[1] FROM codes WHERE codes.process = sums.process) AS modal_failure_exit_code,
  (SELECT ranked[1] FROM actions WHERE actions.process = sums.process) AS modal_error_action
FROM sums WHERE total_completed > 4
ORDER BY failed DESC, failure_pct DESC, total_completed DESC, process NULLS LAST LIMIT 50
"""


@register("failures", TE, _FAILURES_SQL.format(where="", pct=pct("failed", "total_completed")))
def q_failures(d):
    """A10 over all task facts: per-process totals, modal exit code and error action."""
    return M.failures(d.keep("task_executions", "process", "status", "exit_code", "error_action"), ALL)


@register("failures_window", TE, _FAILURES_SQL.format(
    where="WHERE utc_time >= TIMESTAMP '2000-01-01 00:00:00' AND utc_time <= TIMESTAMP '2001-12-31 23:59:59'",
    pct=pct("failed", "total_completed")))
def q_failures_window(d):
    """A10 with a since/until window (P1), pushed into the lineitem scan."""
    return M.failures(d.task_executions, WINDOW)


@register("summary_cards", TE, f"""
SELECT count(*) AS process_completed_rows,
  count(DISTINCT run_id) AS distinct_runs,
  count(DISTINCT process) FILTER (WHERE process NOT LIKE '%MARK_COMPLETE' AND process NOT LIKE '%FINISHED') AS distinct_processes,
  count(*) FILTER (WHERE status = 'COMPLETED') AS success_rows,
  count(*) FILTER (WHERE {FAILED}) AS failure_rows,
  coalesce({pct(f"count(*) FILTER (WHERE {FAILED})", "count(*)")}, 0) AS failure_pct,
  count(*) FILTER (WHERE attempt > 1) AS retried_rows,
  coalesce({pct("count(*) FILTER (WHERE attempt > 1)", "count(*)")}, 0) AS retry_pct,
  coalesce({pct("count(*) FILTER (WHERE attempt > 1 AND status = 'COMPLETED')", "count(*) FILTER (WHERE attempt > 1)")}, 0) AS retry_success_pct,
  coalesce({r2("100.0 * avg(peak_rss / nullif(requested_memory_bytes, 0)) FILTER (WHERE peak_rss IS NOT NULL AND requested_memory_bytes IS NOT NULL AND requested_memory_bytes > 0)")}, 0) AS memory_efficiency_pct,
  max(utc_time) AS latest_process_completed_utc
FROM task_executions
""")
def q_summary_cards(d):
    """A1 headline cards over all task facts."""
    return M.summary_cards(d.task_executions, ALL)


@register("top_failures", TE, f"""
SELECT process, count(*) AS total_completed,
  count(*) FILTER (WHERE {FAILED}) AS failed,
  {pct(f"count(*) FILTER (WHERE {FAILED})", "count(*)")} AS failure_pct
FROM task_executions GROUP BY process HAVING count(*) >= 5
ORDER BY failed DESC, failure_pct DESC, total_completed DESC, process ASC NULLS LAST LIMIT 10
""")
def q_top_failures(d):
    """A2."""
    return M.top_failures(d.task_executions, ALL)


_RETRY_SQL = """
SELECT process, count(*) AS total_completed,
  count(*) FILTER (WHERE attempt > 1) AS retried,
  {pct} AS retried_pct,
  count(*) FILTER (WHERE attempt > 1 AND status = 'COMPLETED') AS retried_success,
  count(*) FILTER (WHERE attempt > 1 AND status IN ('FAILED', 'ABORTED')) AS retried_failed{extra}
FROM task_executions GROUP BY process HAVING count(*) >= 5
ORDER BY retried DESC, retried_pct DESC, total_completed DESC, process ASC NULLS LAST LIMIT {limit}
"""


@register("top_retries", TE, _RETRY_SQL.format(
    pct=pct("count(*) FILTER (WHERE attempt > 1)", "count(*)"), extra="", limit=10))
def q_top_retries(d):
    """A3."""
    return M.top_retries(d.task_executions, ALL)


@register("retries_by_process", TE, _RETRY_SQL.format(
    pct=pct("count(*) FILTER (WHERE attempt > 1)", "count(*)"),
    extra=",\n  max(attempt) AS max_attempt", limit=50))
def q_retries_by_process(d):
    """A7."""
    return M.retries_by_process(d.task_executions, ALL)


@register("top_exit_codes", TE, f"""
SELECT coalesce(exit_code, '<null>') AS exit_code, count(*) AS failures
FROM task_executions WHERE {FAILED}
GROUP BY task_executions.exit_code
ORDER BY failures DESC, 1 ASC LIMIT 10
""")
def q_top_exit_codes(d):
    """A4."""
    return M.top_exit_codes(d.task_executions, ALL)


@register("event_mix", ("weblog",), """
SELECT event, count(*) AS rows FROM weblog GROUP BY event ORDER BY rows DESC, event
""")
def q_event_mix(d):
    """A5 over the raw event log."""
    return M.event_mix(d.weblog, ALL)


@register("retries_summary", TE, f"""
SELECT count(*) AS process_completed_rows,
  count(*) FILTER (WHERE attempt > 1) AS retried_rows,
  coalesce({pct("count(*) FILTER (WHERE attempt > 1)", "count(*)")}, 0) AS retried_pct,
  count(*) FILTER (WHERE attempt > 1 AND status = 'COMPLETED') AS retry_success_rows,
  count(*) FILTER (WHERE attempt > 1 AND {FAILED}) AS retry_failure_rows,
  coalesce({pct("count(*) FILTER (WHERE attempt > 1 AND status = 'COMPLETED')", "count(*) FILTER (WHERE attempt > 1)")}, 0) AS retry_success_pct
FROM task_executions
""")
def q_retries_summary(d):
    """A6."""
    return M.retries_summary(d.task_executions, ALL)


@register("retries_by_attempt", TE, f"""
SELECT attempt, count(*) AS rows, count(*) FILTER (WHERE status = 'COMPLETED') AS success,
  count(*) FILTER (WHERE {FAILED}) AS failed
FROM task_executions GROUP BY attempt ORDER BY attempt
""")
def q_retries_by_attempt(d):
    """A8."""
    return M.retries_by_attempt(d.task_executions, ALL)


def _mean(expr: str, scale: str = "") -> str:
    return r2(f"sum({expr}) / count({expr}){scale}")


# The 0.95 quantile by its definition: sort the present values, interpolate between the two
# that surround position 0.95 * (n - 1).
def _q95(column: str, scale: str = "") -> str:
    at = f"0.95 * (len({column}) - 1)"
    low, high = f"{column}[CAST(floor({at}) AS INT) + 1]", f"{column}[CAST(ceil({at}) AS INT) + 1]"
    return r2(f"({low} + ({high} - {low}) * ({at} - floor({at}))){scale}")


_GIB = " / 1073741824.0"


@register("resources_by_attempt", TE, f"""
, used AS (
  SELECT process, attempt, status, requested_cpus AS cpus, requested_memory_bytes AS memory, requested_time_ms AS time_ms,
    pct_cpu, pct_mem, peak_rss, read_bytes, write_bytes,
    if(requested_cpus <> 0, pct_cpu / (100 * requested_cpus), NULL) AS cpu_use,
    if(requested_memory_bytes <> 0, peak_rss / requested_memory_bytes, NULL) AS memory_use
  FROM task_executions WHERE process IS NOT NULL),
per AS (
  SELECT process, attempt, count(*) AS rows,
    sum(if(status = 'COMPLETED', 1, 0))::BIGINT AS success, sum(if({FAILED}, 1, 0))::BIGINT AS failed,
    {_mean("cpus")} AS avg_requested_cpus, {_mean("memory", _GIB)} AS avg_requested_memory_gb,
    {_mean("time_ms", " / 60000.0")} AS avg_requested_time_min, {_mean("pct_cpu")} AS avg_pct_cpu,
    {_mean("cpu_use", " * 100")} AS avg_cpu_efficiency_pct, {_mean("pct_mem")} AS avg_pct_mem,
    {_mean("memory_use", " * 100")} AS avg_memory_efficiency_pct, {_mean("peak_rss", _GIB)} AS avg_peak_rss_gb,
    {_mean("read_bytes", _GIB)} AS avg_read_gb, {_mean("write_bytes", _GIB)} AS avg_write_gb,
    list(pct_cpu ORDER BY pct_cpu) FILTER (pct_cpu IS NOT NULL) AS cpu_list,
    list(pct_mem ORDER BY pct_mem) FILTER (pct_mem IS NOT NULL) AS mem_list,
    list(peak_rss ORDER BY peak_rss) FILTER (peak_rss IS NOT NULL) AS rss_list
  FROM used GROUP BY process, attempt)
SELECT * EXCLUDE (cpu_list, mem_list, rss_list), {_q95("cpu_list")} AS p95_pct_cpu, {_q95("mem_list")} AS p95_pct_mem,
  {_q95("rss_list", _GIB)} AS p95_peak_rss_gb
FROM per WHERE rows > 4 ORDER BY rows DESC, process, attempt LIMIT 100
""")
def q_resources_by_attempt(d):
    """A9 with exact p95 (banded exact quantile, no whole-group gather)."""
    facts = d.keep("task_executions", "process", "attempt", "status", "utc_time", "requested_cpus", "requested_memory_bytes",
                   "requested_time_ms", "pct_cpu", "pct_mem", "peak_rss", "read_bytes", "write_bytes")
    return M.resources_by_attempt(facts, ALL)


# The days that the rollup report covers.
ROLLUP_DAYS = (dt.date(2000, 3, 1), dt.date(2001, 10, 31))


@register("rollup_window", TE, f"""
SELECT process, attempt, count(*) AS rows, count(*) FILTER (status = 'COMPLETED') AS success,
  count(*) FILTER ({FAILED}) AS failed, {_mean("pct_cpu")} AS avg_pct_cpu, {_mean("pct_mem")} AS avg_pct_mem,
  {_mean("peak_rss")} AS avg_peak_rss, true AS p95_in_range
FROM task_executions
WHERE process IS NOT NULL AND CAST(utc_time AS DATE) BETWEEN DATE '{ROLLUP_DAYS[0]}' AND DATE '{ROLLUP_DAYS[1]}'
GROUP BY process, attempt
""")
def q_rollup_window(d):
    """A1/A8/A9 over a span of days from daily states that three batches of facts wrote (the second
    one twice, as after a failure). ``p95_in_range``: the facts at or below the sketched p95 of CPU
    use are 95 % of the group, within 1 % and one row."""
    spark = d.spark
    facts = d.keep("task_executions", "process", "attempt", "status", "utc_time", *rollup.MEASURES)
    path = scratch_path(spark, f"rollup-{uuid.uuid4().hex}")
    for batch in (0, 1, 2, 1):
        rollup.write_batch(facts.filter(F.pmod(F.xxhash64("process", "utc_time"), F.lit(3)) == batch), path, batch)
    report = rollup.window_report(rollup.read_states(spark, path), *ROLLUP_DAYS)
    day = F.to_date("utc_time")
    same = facts["process"].eqNullSafe(F.col("p")) & facts["attempt"].eqNullSafe(F.col("a"))
    ranks = (facts.filter(day.between(*[F.lit(x) for x in ROLLUP_DAYS]) & F.col("pct_cpu").isNotNull())
             .join(report.select(F.col("process").alias("p"), F.col("attempt").alias("a"), F.col("q_pct_cpu").alias("q")), same)
             .groupBy("p", "a").agg(F.count("*").alias("n"), F.count_if(F.col("pct_cpu") < F.col("q")).alias("below"),
                                    F.count_if(F.col("pct_cpu") <= F.col("q")).alias("upto")))
    slack = F.lit(0.01) * F.col("n") + 1
    held = (F.col("below") - slack <= 0.95 * F.col("n")) & (F.col("upto") + slack >= 0.95 * F.col("n"))
    on = F.col("process").eqNullSafe(F.col("p")) & F.col("attempt").eqNullSafe(F.col("a"))
    return report.join(ranks, on, "left").select(
        "process", "attempt", "rows", "success", "failed", "avg_pct_cpu", "avg_pct_mem", "avg_peak_rss",
        F.coalesce(held, F.col("q_pct_cpu").isNull()).alias("p95_in_range"))


@register("failure_signatures", TE, f"""
SELECT process, coalesce(exit_code, '<null>') AS exit_code, error_action, count(*) AS failures
FROM task_executions WHERE {FAILED}
GROUP BY process, task_executions.exit_code, error_action
ORDER BY failures DESC, process ASC NULLS LAST, 2 ASC, error_action ASC NULLS LAST LIMIT 100
""")
def q_failure_signatures(d):
    """A11."""
    return M.failure_signatures(d.task_executions, ALL)


@register("signature_heatmap", TE, f"""
, g AS (SELECT process, exit_code, error_action, count(*) AS failures
        FROM task_executions WHERE {FAILED} GROUP BY process, exit_code, error_action),
m AS (SELECT *, sum(failures) OVER (PARTITION BY process) AS row_total,
             CAST(failures AS DOUBLE) / greatest(max(failures) OVER (), 1) AS share FROM g)
SELECT process, coalesce(exit_code, '<null>') || ' / ' || coalesce(error_action, '<null>') AS signature,
  failures, CAST(row_total AS BIGINT) AS row_total,
  CASE WHEN share > 0.6 THEN 'high' WHEN share > 0.3 THEN 'mid' WHEN share > 0.1 THEN 'low' ELSE 'none' END AS heat
FROM m
""")
def q_signature_heatmap(d):
    """A32 + F32: failure signature matrix (long form) with row totals and heat level."""
    return M.signature_heatmap(d.task_executions, ALL)


_TIMELINE_SQL = """
SELECT date_trunc('{bucket}', utc_time) AS bucket_start, count(*) AS total,
  count(*) FILTER (WHERE status = 'COMPLETED') AS success,
  count(*) FILTER (WHERE status IN ('FAILED', 'ABORTED')) AS failed,
  coalesce({pct}, 0) AS failure_pct
FROM task_executions GROUP BY 1 ORDER BY 1
"""


@register("timeline_day", TE, _TIMELINE_SQL.format(
    bucket="day", pct=pct("count(*) FILTER (WHERE status IN ('FAILED', 'ABORTED'))", "count(*)")))
def q_timeline_day(d):
    """A12, daily buckets."""
    return M.timeline(d.task_executions, "day", ALL)


@register("timeline_week", TE, _TIMELINE_SQL.format(
    bucket="week", pct=pct("count(*) FILTER (WHERE status IN ('FAILED', 'ABORTED'))", "count(*)")))
def q_timeline_week(d):
    """A12, weekly buckets starting Monday."""
    return M.timeline(d.task_executions, "week", ALL)


# One row per task with a 0/1 mark for each kind of event seen.
TASK_MARKS = """
SELECT run_name, trace ->> '$.task_id' AS task, coalesce(trace ->> '$.process', '<null>') AS process,
  max(if(event = 'process_submitted', 1, 0)) AS sent, max(if(event = 'process_started', 1, 0)) AS begun,
  max(if(event = 'process_completed', 1, 0)) AS ended
FROM weblog WHERE event LIKE 'process%' AND trace IS NOT NULL GROUP BY ALL
"""
_LIVE = "run_name IN (FROM workflow_runs SELECT run_name WHERE status = 'running')"


@register("running", ("weblog", "workflow_runs"), f"""
, marks AS ({TASK_MARKS})
SELECT process, sum(begun * (1 - ended))::BIGINT AS running, sum(sent * (1 - begun))::BIGINT AS queued
FROM marks WHERE {_LIVE} GROUP BY process HAVING running + queued > 0 ORDER BY running DESC, queued DESC, process
""")
def q_running(d):
    """In-flight and queued tasks per process over running runs."""
    return M.running(d.weblog, d.workflow_runs)


@register("running_totals", ("weblog", "workflow_runs"), f"""
, marks AS ({TASK_MARKS})
SELECT (FROM workflow_runs SELECT count(*) WHERE status = 'running') AS active_runs,
  coalesce(sum(begun * (1 - ended)), 0)::BIGINT AS total_running, coalesce(sum(sent * (1 - begun)), 0)::BIGINT AS total_queued
FROM marks WHERE {_LIVE}
""")
def q_running_totals(d):
    """A13 envelope: active runs, total running and queued tasks."""
    return M.running_totals(d.weblog, d.workflow_runs)


@register("tasks_page", TE, """
SELECT telemetry_id, run_name, run_id, sample_id, workflow_id, workflow_version, utc_time,
  process, name, status, attempt, task_hash, exit_code, error_action, realtime_ms,
  requested_cpus, requested_memory_bytes / 1073741824.0 AS requested_memory_gb, pct_cpu, pct_mem,
  peak_rss / 1073741824.0 AS peak_rss_gb, rchar / 1073741824.0 AS read_gb,
  wchar / 1073741824.0 AS write_gb
FROM task_executions WHERE status = 'FAILED'
ORDER BY utc_time DESC, telemetry_id DESC LIMIT 50 OFFSET 100
""")
def q_tasks_page(d):
    """O1: third page (offset 100, 50 rows) of failed tasks, newest first."""
    return M.tasks_page(d.task_executions, ALL, status="FAILED", limit=50, offset=100)


@register("tasks_next_page", TE, """
SELECT telemetry_id, utc_time, process, peak_rss / 1073741824.0 AS peak_rss_gb
FROM task_executions WHERE status = 'FAILED'
ORDER BY utc_time DESC, telemetry_id DESC LIMIT 50 OFFSET 100
""")
def q_tasks_next_page(d):
    """O1 by cursor: the page after the hundredth failed task."""
    last = M.tasks_page(d.task_executions, ALL, status="FAILED", limit=100).collect()[-1]
    page = M.tasks_page(d.task_executions, ALL, status="FAILED", limit=50, cursor=cursor_of(last, M.TASK_ORDER))
    return page.select("telemetry_id", "utc_time", "process", "peak_rss_gb")


@register("tasks_total", TE, """
SELECT count(*) AS total FROM task_executions WHERE status = 'FAILED'
""")
def q_tasks_total(d):
    """Total rows behind the task browser."""
    return M.tasks_total(d.task_executions, ALL, status="FAILED")


@register("flatten_events", ("weblog", "workflow_runs"), """
SELECT w.id AS telemetry_id, w.run_name, w.run_id,
  split_part(nullif(json_extract_string(w.trace, '$.tag'), ''), ':', 1) AS sample_id,
  r.workflow_id, r.workflow_version, w.utc_time,
  coalesce(json_extract_string(w.trace, '$.task_id'), '') AS task_id,
  nullif(json_extract_string(w.trace, '$.hash'), '') AS task_hash,
  nullif(json_extract_string(w.trace, '$.process'), '') AS process,
  nullif(json_extract_string(w.trace, '$.name'), '') AS name,
  nullif(json_extract_string(w.trace, '$.status'), '') AS status,
  coalesce(TRY_CAST(json_extract_string(w.trace, '$.attempt') AS INTEGER), 1) AS attempt,
  nullif(json_extract_string(w.trace, '$.exit'), '') AS exit_code,
  nullif(json_extract_string(w.trace, '$.error_action'), '') AS error_action,
  TRY_CAST(json_extract_string(w.trace, '$.realtime') AS DOUBLE) AS realtime_ms,
  TRY_CAST(json_extract_string(w.trace, '$.cpus') AS DOUBLE) AS requested_cpus,
  TRY_CAST(json_extract_string(w.trace, '$.memory') AS DOUBLE) AS requested_memory_bytes,
  TRY_CAST(json_extract_string(w.trace, '$.time') AS DOUBLE) AS requested_time_ms,
  TRY_CAST(json_extract_string(w.trace, '$."%cpu"') AS DOUBLE) AS pct_cpu,
  TRY_CAST(json_extract_string(w.trace, '$."%mem"') AS DOUBLE) AS pct_mem,
  TRY_CAST(json_extract_string(w.trace, '$.peak_rss') AS DOUBLE) AS peak_rss,
  TRY_CAST(json_extract_string(w.trace, '$.read_bytes') AS DOUBLE) AS read_bytes,
  TRY_CAST(json_extract_string(w.trace, '$.write_bytes') AS DOUBLE) AS write_bytes,
  TRY_CAST(json_extract_string(w.trace, '$.rchar') AS DOUBLE) AS rchar,
  TRY_CAST(json_extract_string(w.trace, '$.wchar') AS DOUBLE) AS wchar
FROM weblog w LEFT JOIN workflow_runs r ON w.run_name = r.run_name
WHERE w.event = 'process_completed' AND w.trace IS NOT NULL
  AND nullif(json_extract_string(w.trace, '$.process'), '') IS NOT NULL
""")
def q_flatten_events(d):
    """F1-F5 + J18: the ingest's flattening of completed-task events into typed facts."""
    return to_task_executions(telemetry(d))
