"""Structured Streaming forms of the ingest and the live reports.

* T1 ``ingest_stream``: landed weblog JSON -> enrichment by run name (stream-static join,
  the run registry is re-read every micro-batch) -> ``foreachBatch`` writes the event log
  and the flattened task facts. Each micro-batch writes under its own ``batch_id``
  directory in overwrite mode, so a replayed batch replaces its earlier output
  (exactly-once by batch id, not by content: duplicate events are kept, as the log does).
* T2 ``running_state`` + ``running_by_process``: per (run, task, process) flags in a
  stateful aggregation; the per-process counts are the second level, computed on a
  snapshot of that state table.
* T6 ``timeline_stream``: tumbling event-time windows with a watermark; weeks start on
  Monday (``startTime`` offset from the Thursday epoch).
* T9 ``event_mix_stream``: running count per event type.
* T3-T5, T7 ``run_state_stream``: a state machine per run (``applyInPandasWithState`` by buckets of
  runs) with the guarded transitions and a processing-time timeout that fails a running run whose
  heartbeats stopped (T4) or expires a claim past its TTL (T5).
* T8 ``etl_tick``: one scheduled tick - decide by backlog/age, then ingest the next batch.
"""
from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.display import is_failed, null_label, ratio_pct
from .jobs import in_order
from ..sources.events import WEBLOG_SCHEMA, enrich_events, to_task_executions, weblog_envelope

WEEK_START_OFFSET = "4 days"   # 1970-01-01 was a Thursday; Monday-aligned weeks


def read_weblog_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """S1 as a stream of landed JSON files."""
    r = spark.readStream.schema(WEBLOG_SCHEMA).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return weblog_envelope(r.json(landing))


def _event_id(batch_id: int):
    """K8: unique and growing id of a log row: batch, partition, row in the partition."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (F.when(row < (1 << 24), F.lit(batch_id << 40) + F.shiftleft(F.spark_partition_id().cast("long"), 24) + row)
            .otherwise(F.raise_error(F.lit("more than 2^24 rows in one partition of a micro-batch")).cast("long")))


def ingest_stream(spark: SparkSession, landing: str, runs_path: str, out: str, checkpoint: str,
                  available_now: bool = True, unique_by: list[str] | None = None, within: str = "1 day"):
    """Event log + task facts, enriched by run name, one directory per micro-batch.

    The log keeps repeated events; ``unique_by`` names columns by which repeats that arrive
    ``within`` that span of event time are dropped (``drop_repeats``)."""
    events = read_weblog_stream(spark, landing).filter("valid").drop("valid")
    if unique_by:
        events = drop_repeats(events, unique_by, within)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        runs = spark.read.parquet(runs_path)            # static side, re-read per batch
        log = (enrich_events(batch, runs)
               .withColumn("id", _event_id(batch_id)))
        log = log.withColumn("event_date", F.to_date("utc_time")).persist()
        try:
            (log.write.mode("overwrite").partitionBy("event_date")
             .parquet(f"{out}/telemetry/batch_id={batch_id}"))
            facts = to_task_executions(log.drop("event_date")).withColumn("event_date", F.to_date("utc_time"))
            (facts.write.mode("overwrite").partitionBy("event_date")
             .parquet(f"{out}/task_executions/batch_id={batch_id}"))
        finally:
            log.unpersist()

    w = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def drop_repeats(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    """T1, T7 as an option: the first event of each key; repeats are known for the span ``within``
    of event time, then forgotten, so the state stays bounded. Events without a time have no
    place in that span: they all stay, as do all columns' types."""
    kind = events.schema["utc_time"].dataType
    timed = (events.filter("utc_time is not null").withColumn("utc_time", F.col("utc_time").cast("timestamp"))
             .withWatermark("utc_time", within).dropDuplicatesWithinWatermark(keys)
             .withColumn("utc_time", F.col("utc_time").cast(kind)))
    return timed.unionByName(events.filter("utc_time is null"))


def event_mix_stream(events: DataFrame) -> DataFrame:
    """Rows per event type (complete-mode aggregation)."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("rows"))


def timeline_stream(tasks: DataFrame, bucket: str = "day", late: str = "1 day") -> DataFrame:
    """Totals per tumbling event-time bucket; rows later than ``late`` are dropped."""
    size = {"hour": "1 hour", "day": "1 day", "week": "7 days"}[bucket]
    start = WEEK_START_OFFSET if bucket == "week" else None
    win = F.window("utc_time", size, size, start) if start else F.window("utc_time", size)
    n = F.count(F.lit(1))
    failed = F.count_if(is_failed())
    # event-time watermarks need TIMESTAMP; naive UTC values convert 1:1 (session zone UTC)
    tasks = tasks.withColumn("utc_time", F.col("utc_time").cast("timestamp"))
    return (tasks.withWatermark("utc_time", late)
            .groupBy(win.alias("w"))
            .agg(n.alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("success"),
                 failed.alias("failed"), ratio_pct(failed, n, zero_if_null=True).alias("failure_pct"))
            .select(F.col("w.start").alias("bucket_start"), "total", "success", "failed", "failure_pct"))


def running_state(telemetry: DataFrame) -> DataFrame:
    """T2 first level: per (run, task, process) which task events were seen."""
    ev = (telemetry.filter(F.col("event").isin("process_submitted", "process_started", "process_completed")
                           & F.col("trace").isNotNull())
          .select("run_name", F.get_json_object("trace", "$['task_id']").alias("task_id"),
                  null_label(F.get_json_object("trace", "$['process']")).alias("process"), "event"))
    return (ev.groupBy("run_name", "task_id", "process")
            .agg(F.bool_or(F.col("event") == "process_submitted").alias("is_submitted"),
                 F.bool_or(F.col("event") == "process_started").alias("is_started"),
                 F.bool_or(F.col("event") == "process_completed").alias("is_completed")))


def running_by_process(state: DataFrame, runs: DataFrame) -> DataFrame:
    """T2 second level on a state snapshot: in-flight / queued per process over running runs."""
    active = runs.filter(F.col("status") == "running").select("run_name")
    st = state.join(active, "run_name", "left_semi")
    r = F.count_if(F.col("is_started") & ~F.col("is_completed"))
    q = F.count_if(F.col("is_submitted") & ~F.col("is_started"))
    return (st.groupBy("process").agg(r.alias("running"), q.alias("queued"))
            .filter((F.col("running") > 0) | (F.col("queued") > 0)))


def run_to_parts(df: DataFrame, mode: str, out: str, checkpoint: str) -> None:
    """Drive a streaming frame to completion into Parquet, one directory per micro-batch.

    A replayed batch overwrites its own directory; the rows never pass the driver."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    q = (df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.processAllAvailable()
    q.stop()


def latest_state(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last row written per key by ``run_to_parts`` (of an update-mode stream)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    rows = spark.read.parquet(out)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch_id")


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Drive a streaming frame to completion into an in-memory table on the driver. Only for
    results that stay small (tests, counts per event type or day)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    # processAllAvailable + stop: a stateful query with pending timeouts keeps running
    # no-data batches and would not end by itself
    q.processAllAvailable()
    q.stop()
    return q


# ---------------------------------------------------------------------------- T3-T5, T7

RUN_STATE_OUT = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("last_event_at", T.TimestampType()),
    T.StructField("reason", T.StringType()),
])
# The runs of one bucket, an entry each; times in microseconds, ``ends`` when the run's status runs out.
RUN_STATES = T.StructType([
    T.StructField("run_name", T.ArrayType(T.StringType())),
    T.StructField("status", T.ArrayType(T.StringType())),
    T.StructField("run_id", T.ArrayType(T.StringType())),
    T.StructField("last_event_at", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
])
TERMINAL = ("completed", "failed", "expired")
NO_TIME = np.iinfo(np.int64).min          # a null time as numpy stores it
RUN_BUCKETS = 2048                        # groups of runs that share a call of the state machine


def _moved(status: str | None, run_id: str | None, event: str, event_run: str | None) -> tuple[str | None, str | None]:
    """A run's status and id after an event (T7: the first end is final)."""
    if event == "claim" and status is None:
        return "claimed", run_id
    if event == "submitted" and status == "claimed":
        return "submitted", run_id
    if event == "started" and status in ("claimed", "submitted"):
        return "running", run_id or event_run
    if event in ("completed", "failed") and status is not None:
        return event, run_id
    if event == "expire" and status == "claimed":
        return "expired", run_id
    return status, run_id


def _run_state_fn(heartbeat_ms: int, claim_ttl_ms: int, timeouts: bool = True,
                  retention_ms: int = 24 * 3600 * 1000):
    waits = {"running": heartbeat_ms, "claimed": claim_ttl_ms, **dict.fromkeys(TERMINAL, retention_ms)}

    def fn(key, pdfs, state):
        runs = {k: rest for k, *rest in zip(*state.get)} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if timeouts else 0
        out = []

        def ends(status):                     # a submitted run may wait in the queue for long
            return now + waits[status] if timeouts and status in waits else None

        # rows of a bucket arrive in no particular order within a micro-batch
        touched = {}
        if not state.hasTimedOut:
            for run_name, ev, rid, at in in_order(_in_micros(pdfs), ["run_name", "event", "run_id", "utc_time"], ["seq"]):
                if run_name not in touched:
                    touched[run_name] = runs.get(run_name, (None, None, None))[:3]
                status, run_id, last = touched[run_name]
                if at != NO_TIME and (last is None or at > last):
                    last = int(at)
                if status not in TERMINAL:    # T7: late events never roll back
                    status, run_id = _moved(status, run_id, ev, rid)
                touched[run_name] = status, run_id, last
            for run_name, (status, run_id, last) in touched.items():
                if status is not None:        # else events of an unknown run: nothing to keep
                    runs[run_name] = status, run_id, last, ends(status)
                    out.append((run_name, status, run_id, last, None))
        for run_name, (status, run_id, last, limit) in list(runs.items()):
            if limit is None or limit > now or run_name in touched:
                continue
            if status in TERMINAL:            # retention over: forget the finished run
                del runs[run_name]
                continue
            status, reason = ("failed", "heartbeat timeout") if status == "running" else ("expired", "claim ttl")
            runs[run_name] = status, run_id, last, ends(status)
            out.append((run_name, status, run_id, last, reason))
        if runs:
            state.update(tuple(map(list, zip(*((k, *rest) for k, rest in runs.items())))))
            limits = [r[3] for r in runs.values() if r[3] is not None]
            if limits:
                state.setTimeoutDuration(max(1, min(limits) - now))
        elif state.exists:
            state.remove()
        if out:
            names, statuses, ids, times, reasons = zip(*out)
            times = np.array([NO_TIME if t is None else t for t in times], "int64").view("datetime64[us]")
            yield pd.DataFrame({"run_name": names, "status": statuses, "run_id": ids,
                                "last_event_at": times.astype("datetime64[ns]"), "reason": reasons})
    return fn


def _in_micros(frames):
    """Frames with ``utc_time`` as whole microseconds (NO_TIME: null)."""
    for frame in frames:
        yield frame.assign(utc_time=frame["utc_time"].to_numpy().astype("datetime64[us]").astype("int64"))


def run_state_stream(events: DataFrame, heartbeat_minutes: float = 15,
                     claim_ttl_minutes: float = 5, timeouts: bool = True, buckets: int = RUN_BUCKETS) -> DataFrame:
    """Per-run guarded state with processing-time timeouts (receipt time is what
    the heartbeat rule measures). Output: the run's state after each micro-batch.

    The machine is called once for each bucket of runs (a hash of the name) that a micro-batch
    touches, as a call costs far more than a run's events; every run has its own state and time
    limit within it. ``timeouts=False`` replays a log deterministically (no wall-clock transitions)."""
    fn = _run_state_fn(int(heartbeat_minutes * 60_000), int(claim_ttl_minutes * 60_000), timeouts)
    mode = GroupStateTimeout.ProcessingTimeTimeout if timeouts else GroupStateTimeout.NoTimeout
    return (events.select("run_name", "seq", "event", "run_id", F.col("utc_time").cast("timestamp"),
                          F.pmod(F.xxhash64("run_name"), F.lit(buckets)).alias("bucket"))
            .groupBy("bucket")
            .applyInPandasWithState(fn, RUN_STATE_OUT, RUN_STATES, "update", mode))


def etl_tick(spark: SparkSession, jobs: DataFrame, watermark: DataFrame, base: str, lake_base: str,
             workflow_id: str, version: str, as_of: dt.datetime, labels: DataFrame | None = None,
             **tick) -> dict | None:
    """One scheduled tick - ingest the next batch when the backlog rule says so."""
    from ..operators import etl as E
    decision = E.tick_decision(E.backlog(jobs, watermark, workflow_id, version, as_of), **tick).first()
    if not decision["ingest"]:
        return None
    keys = E.pending_queue(jobs, watermark, workflow_id, version, decision["batch_size"]).select(
        "sample_id", "workflow_id", "workflow_version")
    return E.ingest(spark, keys, base, lake_base, workflow_id, version, labels, as_of)
