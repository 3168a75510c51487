"""Registered streaming queries: the driver tables are landed as files in the shared
checkpoint folder and replayed through the streaming operators (``availableNow``); the
final table is compared with the batch SQL of the same report."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs as J
from ..streaming import streams as S
from .q_lifecycle import _JOBS_SQL as JOBS_SQL
from .q_metrics import TASK_MARKS
from .registry import pct, register


def _land_weblog(d, path: str, where=None) -> None:
    """Add the weblog rows (those of ``where``) as landed JSON lines, payloads as JSON objects."""
    def q(c):
        return F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.to_json(F.array(F.col(c)))
                                                                  .substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2))
    line = F.concat(
        F.lit('{"runId": '), q("run_id"), F.lit(', "runName": '), q("run_name"),
        F.lit(', "event": '), q("event"),
        F.lit(', "utcTime": "'), F.date_format("utc_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'),
        F.lit(', "metadata": '), F.coalesce("metadata", F.lit("null")),
        F.lit(', "trace": '), F.coalesce("trace", F.lit("null")), F.lit("}"))
    rows = d.weblog if where is None else d.weblog.filter(where)
    rows.select(line.alias("value")).write.mode("append").text(path)


def _scratch(d, name):
    return scratch_path(d.spark, f"{name}-{uuid.uuid4().hex}")


@register("stream_event_mix", ("weblog",), """
SELECT event, count(*) AS rows FROM weblog GROUP BY event
""")
def q_stream_event_mix(d):
    """T9 + S1: event counts of the landed weblog, as a complete-mode streaming aggregate."""
    root = _scratch(d, "stream-event-mix")
    _land_weblog(d, f"{root}/landing")
    name = "event_mix_" + uuid.uuid4().hex[:8]
    S.run_to_table(S.event_mix_stream(S.read_weblog_stream(d.spark, f"{root}/landing")),
                   name, "complete", f"{root}/ckpt")
    return d.spark.table(name)


@register("stream_timeline_day", ("task_executions",), f"""
SELECT date_trunc('day', utc_time) AS bucket_start, count(*) AS total,
  count(*) FILTER (WHERE status = 'COMPLETED') AS success,
  count(*) FILTER (WHERE status IN ('FAILED', 'ABORTED')) AS failed,
  coalesce({pct("count(*) FILTER (WHERE status IN ('FAILED', 'ABORTED'))", "count(*)")}, 0) AS failure_pct
FROM task_executions GROUP BY 1
""")
def q_stream_timeline_day(d):
    """Daily tumbling-window totals over the task facts replayed as a file stream."""
    root = _scratch(d, "stream-timeline")
    d.task_executions.select("utc_time", "status").write.mode("overwrite").parquet(f"{root}/facts")
    src = (d.spark.readStream.schema("utc_time timestamp_ntz, status string")
           .option("maxFilesPerTrigger", 4).parquet(f"{root}/facts"))
    name = "timeline_" + uuid.uuid4().hex[:8]
    S.run_to_table(S.timeline_stream(src, "day", late="3650 days"), name, "complete", f"{root}/ckpt")
    return d.spark.table(name).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@register("stream_ingest_facts", ("weblog", "workflow_runs"), """
SELECT w.run_name, w.run_id,
  split_part(nullif(json_extract_string(w.trace, '$.tag'), ''), ':', 1) AS sample_id,
  r.workflow_id, r.workflow_version, w.utc_time,
  json_extract_string(w.trace, '$.task_id') AS task_id,
  nullif(json_extract_string(w.trace, '$.process'), '') AS process,
  nullif(json_extract_string(w.trace, '$.status'), '') AS status,
  coalesce(TRY_CAST(json_extract_string(w.trace, '$.attempt') AS INTEGER), 1) AS attempt,
  nullif(json_extract_string(w.trace, '$.exit'), '') AS exit_code,
  TRY_CAST(json_extract_string(w.trace, '$."%cpu"') AS DOUBLE) AS pct_cpu,
  TRY_CAST(json_extract_string(w.trace, '$.memory') AS DOUBLE) AS requested_memory_bytes
FROM weblog w LEFT JOIN workflow_runs r ON w.run_name = r.run_name
WHERE w.event = 'process_completed' AND w.trace IS NOT NULL
  AND nullif(json_extract_string(w.trace, '$.process'), '') IS NOT NULL
""")
def q_stream_ingest_facts(d):
    """Landed weblog -> stream-static run enrichment -> foreachBatch writes of the event
    log and task facts (one directory per batch id); the facts read back."""
    root = _scratch(d, "stream-ingest")
    _land_weblog(d, f"{root}/landing")
    d.workflow_runs.write.mode("overwrite").parquet(f"{root}/runs")
    q = S.ingest_stream(d.spark, f"{root}/landing", f"{root}/runs", f"{root}/out", f"{root}/ckpt")
    q.processAllAvailable()
    q.stop()
    facts = d.spark.read.parquet(f"{root}/out/task_executions")
    return facts.select("run_name", "run_id", "sample_id", "workflow_id", "workflow_version",
                        "utc_time", "task_id", "process", "status", "attempt", "exit_code",
                        "pct_cpu", "requested_memory_bytes")


@register("stream_running", ("weblog", "workflow_runs"), f"""
, marks AS ({TASK_MARKS})
SELECT process, sum(begun * (1 - ended))::BIGINT AS running, sum(sent * (1 - begun))::BIGINT AS queued
FROM marks SEMI JOIN (FROM workflow_runs WHERE status = 'running') live USING (run_name)
GROUP BY process HAVING running + queued > 0
""")
def q_stream_running(d):
    """Stateful per-task flags maintained over four micro-batches (events out of order,
    some repeated), then in-flight counts per process over the running runs."""
    root = _scratch(d, "stream-running")
    for k in (2, 0, 3, 1):
        _land_weblog(d, f"{root}/landing", (F.col("id") % 4 == k) | (F.col("id") % 28 == k + 4))
        S.run_to_parts(S.running_state(S.read_weblog_stream(d.spark, f"{root}/landing")),
                       "update", f"{root}/state", f"{root}/ckpt")
    state = S.latest_state(d.spark, f"{root}/state", ["run_name", "task_id", "process"])
    return S.running_by_process(state, d.workflow_runs)


@register("stream_run_state", ("lifecycle_events",), """
, g AS (SELECT run_name,
   min(seq) FILTER (WHERE event = 'submitted') AS submit_seq,
   min(seq) FILTER (WHERE event = 'started') AS start_any,
   min(seq) FILTER (WHERE event IN ('completed', 'failed')) AS close_seq,
   arg_min(event, seq) FILTER (WHERE event IN ('completed', 'failed')) AS close_kind,
   min(seq) FILTER (WHERE event = 'expire') AS expire_any
  FROM lifecycle_events GROUP BY run_name),
e AS (SELECT *, CASE WHEN expire_any < least(coalesce(submit_seq, 4611686018427387904),
                     coalesce(start_any, 4611686018427387904), coalesce(close_seq, 4611686018427387904))
                THEN expire_any END AS expire_seq FROM g),
e2 AS (SELECT *, coalesce(expire_seq, close_seq, 4611686018427387904) AS end_seq FROM e)
SELECT run_name,
  CASE WHEN expire_seq IS NOT NULL THEN 'expired' WHEN close_kind IS NOT NULL THEN close_kind
       WHEN start_any < end_seq THEN 'running'
       WHEN submit_seq < end_seq THEN 'submitted' ELSE 'claimed' END AS status
FROM e2
""")
def q_stream_run_state(d):
    """The keyed run state machine (applyInPandasWithState) over the lifecycle log,
    replayed in order of arrival over five micro-batches (the stream is started anew for
    each); the last one repeats starts and closes, which change nothing. One row per run."""
    root = _scratch(d, "stream-run-state")
    for slice_ in [*_arrivals(d.lifecycle_events), F.col("event").isin("started", "completed")]:
        S.run_to_parts(S.run_state_stream(_landed(d, slice_, root), timeouts=False), "update", f"{root}/state", f"{root}/ckpt")
    return S.latest_state(d.spark, f"{root}/state", ["run_name"]).select("run_name", "status")


def _arrivals(events) -> list:
    """Four slices of the log in order of arrival."""
    a, b, c = events.select(F.percentile_approx("seq", [0.25, 0.5, 0.75]).alias("q")).first()["q"]
    seq = F.col("seq")
    return [seq <= a, seq.between(a + 1, b), seq.between(b + 1, c), seq > c]


def _landed(d, slice_, root: str):
    """Land a slice of the lifecycle log, as many files as it has partitions, and read the landing
    folder as a stream. Started again on its checkpoint, a stream takes the new files as one
    micro-batch."""
    ev = d.lifecycle_events
    ev.filter(slice_).write.mode("append").parquet(f"{root}/events")
    return d.spark.readStream.schema(ev.schema).parquet(f"{root}/events")


@register("stream_jobs", ("lifecycle_events", "workflows"), JOBS_SQL + """
SELECT sample_id, workflow_id, workflow_version, status, retries AS retry_count, run AS run_name,
  status = 'failed' AS dead_letter, CASE WHEN status = 'failed' THEN run END AS dead_letter_run,
  done_seq AS completed_seq
FROM state
""")
def q_stream_jobs(d):
    """Job rows (dead letters among them) kept by the stream (run and job state machines, RocksDB state) over
    four micro-batches, the stream stopped and started again between them."""
    root = _scratch(d, "stream-jobs")
    for slice_ in _arrivals(d.lifecycle_events):
        S.run_to_parts(J.job_stream(_landed(d, slice_, root), d.workflows), "append", f"{root}/jobs", f"{root}/ckpt")
    return J.current_jobs(d.spark, f"{root}/jobs")


@register("stream_unique_events", ("weblog",), """
SELECT run_name, event, utc_time, trace, 1 AS copies FROM (SELECT DISTINCT run_name, event, utc_time, trace FROM weblog)
""")
def q_stream_unique_events(d):
    """T1 with repeats dropped: the weblog landed in three overlapping parts, each event kept once."""
    root = _scratch(d, "stream-unique")
    d.workflow_runs.write.mode("overwrite").parquet(f"{root}/runs")
    for k in range(3):
        _land_weblog(d, f"{root}/landing", F.col("id") % 4 >= k)
        q = S.ingest_stream(d.spark, f"{root}/landing", f"{root}/runs", f"{root}/out", f"{root}/ckpt",
                            unique_by=["run_name", "event", "utc_time", "trace"], within="3650 days")
        q.processAllAvailable()
        q.stop()
    log = d.spark.read.parquet(f"{root}/out/telemetry")
    return log.groupBy("run_name", "event", "utc_time", "trace").agg(F.count("*").cast("int").alias("copies"))
