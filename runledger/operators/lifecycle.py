"""Job / run lifecycle as folds over an arrival-ordered event log.

The event log has one row per lifecycle event with its arrival sequence ``seq``:
``claim`` (one row per job claimed into a run), ``submitted``, ``started``, ``sentinel``
(a sample's MARK_COMPLETE task finished), ``completed`` / ``failed`` (the run closed) and
``expire`` (the claim outlived its TTL). ``lifecycle_log`` derives that log from telemetry.

Two levels:

* **Run level** (key ``run_name``) is a plain aggregation: the first effective event of each
  kind decides the run's state. Guards make late or repeated events harmless: ``started``
  counts only while the run is claimed/submitted, the first terminal write wins, an expiry
  counts only while the run is still merely claimed.
* **Job level** (key ``(sample, workflow, version)``) depends on which earlier claims took
  effect (a job can only be claimed while pending), so it is a sequential fold per job. Every
  claim is joined with the events of its run, rows are hash-partitioned by job, sorted by
  arrival and streamed through ``mapInPandas``; the state of one job is a few values, so a
  job may have any number of events. Each event applies a guarded update: it acts only on
  jobs that are attached to that run and in a state the update accepts. A sweep adds one
  retry; a job fails - and is dead-lettered - when its retry count passes ``max_retries``; an
  expiry detaches without penalty.

State-table operators (watchdog, TTL, resets, dead-letter requeue) apply the same rules to
the current tables.
"""
from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import first_per_key

TERMINAL_RUN = ("completed", "failed", "expired")
IN_FLIGHT_JOB = ("claimed", "submitted", "running")
CLAIM_TTL_MINUTES = 5
SWEEP_REASON = "run ended without completing this sample"
SENTINEL_PROCESS = "MARK_COMPLETE"

_BIG_SEQ = 2 ** 62


def _big():
    return F.lit(_BIG_SEQ)


def lifecycle_log(telemetry: DataFrame, run_events: DataFrame, claims: DataFrame) -> DataFrame:
    """The lifecycle log from what the producers send.

    ``telemetry``: weblog events (run_name, event, trace, run_id, sample_id, utc_time, seq);
    ``run_events``: wrapper events (run_name, type, utc_time, seq); ``claims``: dispatch
    records (run_name, sample_id, workflow_id, workflow_version, utc_time, seq). A weblog
    ``started`` starts the run, ``completed`` closes it, and a completed task whose process
    ends in the sentinel name completes its sample; a ``wrapper_started`` submits the run."""
    none = F.lit(None).cast("string")
    process, status = (F.get_json_object("trace", f"$['{k}']") for k in ("process", "status"))
    sentinel = ((F.col("event") == "process_completed") & process.endswith(SENTINEL_PROCESS)
                & (status == "COMPLETED") & (F.coalesce(F.col("sample_id"), F.lit("")) != ""))
    kind = (F.when(F.col("event").isin("started", "completed"), F.col("event")).when(sentinel, F.lit("sentinel")))
    log = telemetry.select("seq", "run_name", kind.alias("event"), F.when(sentinel, F.col("sample_id")).alias("sample_id"),
                           none.alias("workflow_id"), none.alias("workflow_version"), "run_id", "utc_time")
    wrapper = (run_events.filter(F.col("type") == "wrapper_started")
               .select("seq", "run_name", F.lit("submitted").alias("event"), none.alias("sample_id"),
                       none.alias("workflow_id"), none.alias("workflow_version"), none.alias("run_id"), "utc_time"))
    claimed = claims.select("seq", "run_name", F.lit("claim").alias("event"), "sample_id", "workflow_id",
                            "workflow_version", none.alias("run_id"), "utc_time")
    return log.filter("event is not null").unionByName(wrapper).unionByName(claimed)


def fold_runs(events: DataFrame, guards: bool = False) -> DataFrame:
    """L1-L3, L5, L7, L13 at run level: one row per run with its effective state.

    ``guards`` adds the arrivals of the submit and the expiry that took effect."""
    ev = F.col("event")
    seq = F.col("seq")
    # a run exists from its first claim on; what arrives before finds no run
    claim = F.min(F.when(ev == "claim", seq)).over(Window.partitionBy("run_name"))
    events = events.withColumn("_claim", claim).filter(seq >= F.col("_claim")).drop("_claim")

    def first(kind):
        return F.min(F.when(ev.isin(*kind) if isinstance(kind, tuple) else ev == kind, seq))

    # The first close is found as min(seq * 2 + is_failed): fixed-width aggregation buffers
    # only, so the whole fold stays a hash aggregate with map-side partial aggregation.
    close_code = F.when(ev.isin("completed", "failed"),
                        seq * 2 + (ev == "failed").cast("long"))
    g = events.groupBy("run_name").agg(
        first("claim").alias("claim_seq"),
        F.min(F.when(ev == "claim", F.col("utc_time"))).alias("claimed_at"),
        first("submitted").alias("submit_seq"),
        first("started").alias("start_seq_any"),
        F.min(close_code).alias("_close_code"),
        first("expire").alias("expire_seq"),
        F.min_by(F.when(ev.isin("completed", "failed"), F.col("utc_time")),
                 F.when(ev.isin("completed", "failed"), seq)).alias("closed_at"),
    )
    g = (g.withColumn("close_seq", F.floor(F.col("_close_code") / 2).cast("long"))
         .withColumn("close_kind", F.when(F.col("_close_code").isNotNull(),
                                          F.when(F.col("_close_code") % 2 == 1, F.lit("failed"))
                                          .otherwise(F.lit("completed"))))
         .drop("_close_code"))
    # An expiry is effective only while the run is merely claimed.
    busy = F.least(F.coalesce("submit_seq", _big()), F.coalesce("start_seq_any", _big()),
                   F.coalesce("close_seq", _big()))
    g = g.withColumn("expire_seq", F.when(F.col("expire_seq") < busy, F.col("expire_seq")))
    # The run stops changing at its first terminal event (expiry or close).
    g = g.withColumn("end_seq", F.coalesce("expire_seq", "close_seq"))
    g = g.withColumn("close_kind", F.when(F.col("expire_seq").isNull(), F.col("close_kind")))
    g = g.withColumn("closed_at", F.when(F.col("expire_seq").isNull(), F.col("closed_at")))
    # First 'started' before the end wins; run_id and started_at are never rewritten.
    starts = (events.filter(ev == "started").select("run_name", "seq", "run_id", "utc_time")
              .join(g.select("run_name", "end_seq"), "run_name")
              .filter(seq < F.coalesce(F.col("end_seq"), _big()))
              .groupBy("run_name")
              .agg(F.min("seq").alias("start_seq"),
                   F.min_by("run_id", "seq").alias("run_id"),
                   F.min_by("utc_time", "seq").alias("started_at")))
    g = g.join(starts, "run_name", "left")
    submit_eff = F.col("submit_seq") < F.coalesce(F.col("end_seq"), _big())
    status = (F.when(F.col("expire_seq").isNotNull(), F.lit("expired"))
              .when(F.col("close_kind").isNotNull(), F.col("close_kind"))
              .when(F.col("start_seq").isNotNull(), F.lit("running"))
              .when(submit_eff, F.lit("submitted"))
              .otherwise(F.lit("claimed")))
    # the submit that found the run still claimed
    submit = F.when(F.col("submit_seq") < F.least(F.coalesce("start_seq_any", _big()), F.coalesce("end_seq", _big())),
                    F.col("submit_seq"))
    out = g.select("run_name", "run_id", status.alias("status"), "claim_seq", "end_seq",
                   "claimed_at", "started_at", "closed_at",
                   F.col("expire_seq").isNotNull().alias("expired"), submit.alias("submit_seq"),
                   "expire_seq")
    return out if guards else out.drop("submit_seq", "expire_seq")


_JOB_OUT = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("workflow_id", T.StringType()),
    T.StructField("workflow_version", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("retry_count", T.LongType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("dead_letter", T.BooleanType()),
    T.StructField("dead_letter_run", T.StringType()),
    T.StructField("completed_seq", T.LongType()),
])


_KEYS = ["sample_id", "workflow_id", "workflow_version"]


class _JobState:
    """One job and its guarded updates, applied in order of arrival."""

    def __init__(self, max_retries):
        self.budget = 0 if max_retries is None or max_retries != max_retries else int(max_retries)
        self.status, self.retries, self.run, self.dead, self.done_seq = "pending", 0, None, False, None

    def apply(self, seq: int, event: str, run: str) -> None:
        if event == "claim":
            if self.status == "pending":
                self.status, self.run = "claimed", run
        elif self.run != run or self.status in ("completed", "failed"):
            return
        elif event == "submitted":
            if self.status == "claimed":
                self.status = "submitted"
        elif event == "started":
            if self.status in ("claimed", "submitted"):
                self.status = "running"
        elif event == "sentinel":
            self.status, self.done_seq = "completed", seq
        elif event == "expire":
            if self.status == "claimed":
                self.status, self.run = "pending", None
        else:                                  # the run closed: one more retry, or fail
            self.retries += 1
            if self.retries > self.budget:
                self.status, self.dead = "failed", True
            else:
                self.status, self.run = "pending", None

    def row(self, key) -> tuple:
        return (*key, self.status, self.retries, self.run, self.dead, self.run if self.dead else None, self.done_seq)


def _fold_stream(batches):
    """mapInPandas body: rows arrive sorted by job and arrival; only the open job is held."""
    columns = [f.name for f in _JOB_OUT.fields]
    key, state = None, None
    for pdf in batches:
        out = []
        for *k, seq, event, run, budget in zip(*(pdf[c].tolist() for c in (*_KEYS, "seq", "event", "run_name", "max_retries"))):
            if k != key:
                if state is not None:
                    out.append(state.row(key))
                key, state = k, _JobState(budget)
            state.apply(int(seq), event, run)
        if out:
            yield pd.DataFrame.from_records(out, columns=columns)
    if state is not None:
        yield pd.DataFrame.from_records([state.row(key)], columns=columns)


def fold_jobs(events: DataFrame, workflows: DataFrame) -> DataFrame:
    """L1-L4, L6, L7, L13 at job level: the final state of every claimed job.

    Each claim meets the events of its run that arrived after it: every start and close, the
    submit and the expiry that found the run still claimed, and the sentinels of its sample."""
    claims = (events.filter(F.col("event") == "claim")
              .groupBy(*_KEYS, "run_name").agg(F.min("seq").alias("claim_seq")))
    repeats = events.filter(F.col("event") == "claim").select(*_KEYS, "seq", "event", "run_name")
    guards = fold_runs(events, guards=True).select("run_name", "submit_seq", "expire_seq")
    of_run = (events.filter(F.col("event").isin("submitted", "started", "completed", "failed", "expire"))
              .select("run_name", "seq", "event").join(guards, "run_name")
              .filter(F.col("event").isin("started", "completed", "failed")
                      | ((F.col("event") == "submitted") & (F.col("seq") == F.col("submit_seq")))
                      | ((F.col("event") == "expire") & (F.col("seq") == F.col("expire_seq"))))
              .select("run_name", "seq", "event"))
    of_sample = (events.filter(F.col("event") == "sentinel")
                 .select("run_name", "sample_id", "seq", "event"))
    steps = (repeats
             .unionByName(claims.join(of_run, "run_name").filter("seq > claim_seq").drop("claim_seq"))
             .unionByName(claims.join(of_sample, ["run_name", "sample_id"]).filter("seq > claim_seq").drop("claim_seq")))
    wf = workflows.select("workflow_id", F.col("version").alias("workflow_version"), "max_retries")
    return (steps.join(wf, ["workflow_id", "workflow_version"], "left")
            .select(*_KEYS, "seq", "event", "run_name", "max_retries")
            .repartition(*_KEYS).sortWithinPartitions(*_KEYS, "seq").mapInPandas(_fold_stream, _JOB_OUT))


def dead_letters(job_state: DataFrame) -> DataFrame:
    """One dead-letter row per failed job."""
    return (job_state.filter("dead_letter")
            .select("sample_id", "workflow_id", "workflow_version",
                    F.col("dead_letter_run").alias("run_name"), "retry_count",
                    F.lit(SWEEP_REASON).alias("reason")))


def _set_failure(jobs: DataFrame, hit, at, reason) -> DataFrame:
    """Write ``failed_at`` and ``failure_reason`` of the rows ``hit`` (added when absent)."""
    for name, value, kind in (("failed_at", at, "timestamp_ntz"), ("failure_reason", reason, "string")):
        old = F.col(name) if name in jobs.columns else F.lit(None)
        jobs = jobs.withColumn(name, F.when(hit, value.cast(kind)).otherwise(old.cast(kind)))
    return jobs


def new_dead_letters(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Dead-letter rows to insert; a job that has a row keeps it (one per ``job_id``)."""
    return (found.join(existing.select("job_id").distinct(), "job_id", "left_anti")
            .transform(first_per_key, ["job_id"]))


def watchdog_report(runs: DataFrame, jobs: DataFrame, as_of: dt.datetime, stale_minutes: int = 15) -> DataFrame:
    """One row per run that the watchdog fails: its last signal and the jobs it sweeps."""
    cutoff = F.lit(as_of - dt.timedelta(minutes=stale_minutes)).cast("timestamp_ntz")
    last = F.coalesce(F.col("last_heartbeat_at"), F.col("started_at"))
    stale = (runs.filter((F.col("status") == "running") & last.isNotNull() & (last < cutoff))
             .select("run_name", last.alias("last_signal_at")))
    swept = (jobs.filter(F.col("status").isin(*IN_FLIGHT_JOB)).groupBy("run_name")
             .agg(F.count("*").alias("jobs_swept")))
    return (stale.join(swept, "run_name", "left")
            .select("run_name", "last_signal_at", F.coalesce("jobs_swept", F.lit(0)).alias("jobs_swept")))


def sweep(jobs: DataFrame, closed_runs: DataFrame, workflows: DataFrame,
          now: dt.datetime, reason: str = SWEEP_REASON) -> tuple[DataFrame, DataFrame]:
    """L6 on state tables: in-flight jobs of the closed runs get one more retry; within the
    budget (old count < max_retries) they return to pending, detached; otherwise they fail
    and get a dead-letter row. Returns (jobs, new dead-letter rows)."""
    wf = workflows.select("workflow_id", F.col("version").alias("workflow_version"), "max_retries")
    closed = closed_runs.select("run_name").distinct().withColumn("_closed", F.lit(True))
    j = (jobs.join(closed, "run_name", "left").join(wf, ["workflow_id", "workflow_version"], "left"))
    hit = F.coalesce(F.col("_closed"), F.lit(False)) & F.col("status").isin(*IN_FLIGHT_JOB)
    within = F.col("retry_count") < F.coalesce(F.col("max_retries"), F.lit(0))
    # flags first: the updates below must all see the pre-sweep values
    out = (j.withColumn("_hit", hit).withColumn("_within", within)
           .withColumn("_fail", F.col("_hit") & ~F.col("_within"))
           .withColumn("retry_count", F.when(F.col("_hit"), F.col("retry_count") + 1)
                       .otherwise(F.col("retry_count")))
           .withColumn("status", F.when(F.col("_hit") & F.col("_within"), F.lit("pending"))
                       .when(F.col("_hit"), F.lit("failed")).otherwise(F.col("status")))
           .withColumn("run_name", F.when(F.col("_hit") & F.col("_within"), F.lit(None).cast("string"))
                       .otherwise(F.col("run_name"))))
    out = _set_failure(out, F.col("_fail"), F.lit(now).cast("timestamp_ntz"), F.lit(reason))
    dlq = (out.filter("_fail").select("job_id", "run_name", "sample_id", "workflow_id",
                                      "workflow_version", F.lit(reason).alias("reason"),
                                      F.lit(now).cast("timestamp_ntz").alias("created_at")))
    return out.drop("_closed", "max_retries", "_hit", "_within", "_fail"), dlq


def heartbeat_watchdog(runs: DataFrame, jobs: DataFrame, workflows: DataFrame,
                       as_of: dt.datetime, stale_minutes: int = 15
                       ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Running runs whose last heartbeat (or start) is older than ``stale_minutes`` are
    failed and their jobs swept; submitted runs are never touched.
    Returns (runs, jobs, new dead-letter rows)."""
    cutoff = F.lit(as_of - dt.timedelta(minutes=stale_minutes)).cast("timestamp_ntz")
    last = F.coalesce(F.col("last_heartbeat_at"), F.col("started_at"))
    stale = (F.col("status") == "running") & last.isNotNull() & (last < cutoff)
    flagged = runs.withColumn("_stale", stale)
    new_runs = (flagged.withColumn("status", F.when(F.col("_stale"), F.lit("failed"))
                                   .otherwise(F.col("status")))
                .withColumn("completed_at", F.when(F.col("_stale"), F.lit(as_of).cast("timestamp_ntz"))
                            .otherwise(F.col("completed_at")))
                .drop("_stale"))
    new_jobs, dlq = sweep(jobs, flagged.filter("_stale"), workflows, as_of,
                          "heartbeat watchdog: run stale")
    return new_runs, new_jobs, dlq


def close_runs(runs: DataFrame, names: DataFrame, terminal: str, now: dt.datetime) -> DataFrame:
    """Terminal write once - runs already terminal keep their status."""
    hit = names.select("run_name").distinct().withColumn("_hit", F.lit(True))
    r = runs.join(hit, "run_name", "left")
    r = r.withColumn("_do", F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("status").isin(*TERMINAL_RUN))
    do = F.col("_do")
    return (r.withColumn("status", F.when(do, F.lit(terminal)).otherwise(F.col("status")))
            .withColumn("completed_at", F.when(do, F.lit(now).cast("timestamp_ntz"))
                        .otherwise(F.col("completed_at")))
            .drop("_hit", "_do"))


def expire_stale_runs(runs: DataFrame, jobs: DataFrame, workflows: DataFrame, as_of: dt.datetime,
                      older_than_hours: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """running/submitted runs claimed more than N hours ago are closed 'completed'
    and their jobs swept."""
    cutoff = F.lit(as_of - dt.timedelta(hours=older_than_hours)).cast("timestamp_ntz")
    stale = runs.filter(F.col("status").isin("running", "submitted") & (F.col("claimed_at") < cutoff))
    new_runs = close_runs(runs, stale, "completed", as_of)
    new_jobs, dlq = sweep(jobs, stale, workflows, as_of)
    return new_runs, new_jobs, dlq


def requeue_expired(runs: DataFrame, jobs: DataFrame, as_of: dt.datetime,
                    ttl_minutes: int = CLAIM_TTL_MINUTES) -> tuple[DataFrame, DataFrame]:
    """Claimed runs older than the TTL expire; their claimed jobs return to pending and
    are detached without a retry penalty."""
    cutoff = F.lit(as_of - dt.timedelta(minutes=ttl_minutes)).cast("timestamp_ntz")
    exp = runs.filter((F.col("status") == "claimed") & (F.col("claimed_at") < cutoff)).select("run_name")
    new_runs = (runs.join(exp.withColumn("_e", F.lit(True)), "run_name", "left")
                .withColumn("status", F.when(F.col("_e"), F.lit("expired")).otherwise(F.col("status")))
                .drop("_e"))
    j = jobs.join(exp.withColumn("_e", F.lit(True)), "run_name", "left")
    j = j.withColumn("_hit", F.coalesce(F.col("_e"), F.lit(False)) & (F.col("status") == "claimed"))
    hit = F.col("_hit")
    new_jobs = (j.withColumn("status", F.when(hit, F.lit("pending")).otherwise(F.col("status")))
                .withColumn("run_name", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("run_name")))
                .drop("_e", "_hit"))
    return new_runs, new_jobs


def requeue_dead_letter(dead_letter: DataFrame, jobs: DataFrame, now: dt.datetime
                        ) -> tuple[DataFrame, DataFrame]:
    """Every unresolved dead-letter job back to pending with counters cleared; the
    dead-letter rows are marked resolved."""
    todo = dead_letter.filter(F.col("resolved_at").isNull()).select("job_id").withColumn("_r", F.lit(True))
    j = jobs.join(todo, "job_id", "left")
    hit = F.coalesce(F.col("_r"), F.lit(False))
    new_jobs = (j.withColumn("status", F.when(hit, F.lit("pending")).otherwise(F.col("status")))
                .withColumn("retry_count", F.when(hit, F.lit(0)).otherwise(F.col("retry_count")))
                .withColumn("run_name", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("run_name"))))
    new_jobs = _set_failure(new_jobs, hit, F.lit(None), F.lit(None)).drop("_r")
    new_dlq = dead_letter.withColumn(
        "resolved_at", F.coalesce(F.col("resolved_at"), F.lit(now).cast("timestamp_ntz")))
    return new_jobs, new_dlq


def reset_jobs(jobs: DataFrame, workflow_id: str) -> DataFrame:
    """running/failed jobs of a workflow back to pending, counters cleared."""
    j = jobs.withColumn("_hit", (F.col("workflow_id") == workflow_id)
                        & F.col("status").isin("running", "failed"))
    hit = F.col("_hit")
    j = (j.withColumn("status", F.when(hit, F.lit("pending")).otherwise(F.col("status")))
         .withColumn("retry_count", F.when(hit, F.lit(0)).otherwise(F.col("retry_count")))
         .withColumn("run_name", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("run_name"))))
    return _set_failure(j, hit, F.lit(None), F.lit(None)).drop("_hit")


def apply_run_events(run_events: DataFrame, runs: DataFrame) -> DataFrame:
    """Per-run summary columns from wrapper events in arrival order, for known runs.

    wait_seconds: last non-NULL value; wrapper_exit_code: last exit; last_heartbeat_at:
    latest *receipt* time of a heartbeat; scheduler state and reason from the latest
    scheduler event (a state event without a reason clears it); started_by_wrapper when a
    wrapper_started arrived (L2)."""
    t = F.col("type")
    seq = F.col("seq")
    known = runs.select("run_name").distinct()
    return run_events.join(known, "run_name", "left_semi").groupBy("run_name").agg(
        F.max_by(F.col("wait_seconds"), F.when(F.col("wait_seconds").isNotNull(), seq)).alias("wait_seconds"),
        F.max_by(F.col("exit_code"), F.when((t == "wrapper_exited") & F.col("exit_code").isNotNull(), seq)
                 ).alias("wrapper_exit_code"),
        F.max(F.when(t == "heartbeat", F.col("received_at"))).alias("last_heartbeat_at"),
        F.max_by(F.struct(F.col("state").alias("slurm_state"), F.col("reason").alias("slurm_reason")),
                 F.when(t == "slurm_state", seq)).alias("_slurm"),
        F.max(t == "wrapper_started").alias("started_by_wrapper"),
    ).select("run_name", "wait_seconds", "wrapper_exit_code", "last_heartbeat_at",
             "_slurm.slurm_state", "_slurm.slurm_reason", "started_by_wrapper")
