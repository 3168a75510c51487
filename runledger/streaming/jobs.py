"""Live job state from the lifecycle stream (T3-T5, T7; L1-L7 as events arrive).

Two keyed state machines (``transformWithStateInPandas``, RocksDB state) in one stream:

* **Runs**: a run has its status and last signal and the jobs claimed into it. An event of a run
  becomes one step for each of its jobs that it can concern; events before the run's first claim
  find no run, and a submit or an expiry counts only while the run is merely claimed. Timers fail a running run whose signals
  stopped (T4) and expire a claim past its time (T5).
* **Jobs** (sample, workflow, version): a job has its status, retries, run and completion, and each
  step applies the same guarded update as the batch fold (``lifecycle.fold_jobs``), so both give the same rows. A job's retries survive its runs.

A machine is called once for each bucket of runs or jobs (a hash of the key) that a micro-batch
touches, as a call and its state requests cost far more than a key's rows; the bucket's value state
holds an entry for each of its keys.

Output is one row per job that a micro-batch touched; the last one of a job is its state, and
those with ``dead_letter`` are its dead letters.

Rows of a bucket come in no order within a micro-batch; both machines put them in order of
``seq``. Micro-batches must follow the order of arrival (the landed log does). What a timer
does comes after the rows of its micro-batch. Clocks: ``none`` replays a log without timers,
``event`` reads the watermark (a replay gives the same timeouts), ``receipt`` the wall clock.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import SWEEP_REASON, _JobState

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTROL = ("submitted", "started", "completed", "failed", "expire")
CLOCKS = {"none": "None", "event": "EventTime", "receipt": "ProcessingTime"}
HEARTBEAT_MINUTES, CLAIM_TTL_MINUTES = 15, 5
RETENTION_MINUTES = 24 * 60

JOB_KEYS = ["sample_id", "workflow_id", "workflow_version"]
STEPS = ("sample_id string, workflow_id string, workflow_version string, seq long, event string, run_name string, "
         "timer boolean, at timestamp")
JOBS = ("sample_id string, workflow_id string, workflow_version string, status string, retry_count long, run_name string, "
        "dead_letter boolean, dead_letter_run string, completed_seq long")
_STEP_COLUMNS = ["sample_id", "workflow_id", "workflow_version", "seq", "event", "run_name", "timer", "at"]
_JOB_COLUMNS = [c.split()[0] for c in JOBS.split(", ")]


def in_order(frames: Iterator[pd.DataFrame], columns: list[str], by: list[str]) -> Iterator[tuple]:
    """The rows of one group of a micro-batch by ``by``. Columns are gathered as arrays, in which
    strings that repeat are shared."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in dict.fromkeys([*columns, *by])}
    for frame in frames:
        for c in parts:
            parts[c].append(frame[c].to_numpy())
    data = {c: np.concatenate(v) for c, v in parts.items()}
    for k in np.lexsort([data[c] for c in reversed(by)]):
        yield tuple(data[c][k] for c in columns)


def _missing(value) -> bool:
    return value is None or value != value


ENDED = ("completed", "failed", "expired")


def _moved(status: str, event: str) -> str:
    """A run's status after a control event; the first end is final."""
    if status in ENDED:
        return status
    if event == "started":
        return "running"
    if event in ("completed", "failed"):
        return event
    if status == "claimed":
        return "submitted" if event == "submitted" else "expired"
    return status


BUCKET = "entries string"  # the keys of one bucket with their states: columns as JSON (a value state holds no arrays)
BUCKETS = 1024            # groups of runs, and of jobs, that share a call of their machine
FRAME_ROWS = 10_000


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as columns of objects: whole numbers beside nulls stay whole."""
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*rows))})


def _load(state) -> list[list]:
    """The columns of a bucket's entries; none, if it has none yet."""
    stored = state.get()
    return json.loads(stored[0]) if stored else []


def _save(state, rows: list[tuple]) -> None:
    state.update((json.dumps([*zip(*rows)]),))


class _Run:
    """One run: its status, last signal, last row, time limit and the jobs claimed into it, by sample."""
    __slots__ = ("status", "signal", "last_seq", "ends", "jobs")

    def __init__(self, status=None, signal=0, last_seq=0, ends=None):
        self.status, self.signal, self.last_seq, self.ends, self.jobs = status, signal, last_seq, ends, {}

    def claimed(self) -> list[tuple]:
        return [job for jobs in self.jobs.values() for job in jobs]

    def step(self, seq: int, event: str, sample, workflow, version, at) -> list[tuple]:
        """The jobs that an event concerns."""
        if event != "claim" and self.status is None:
            return []                                  # no such run yet
        self.last_seq = max(self.last_seq, seq)
        if event == "claim":
            job = (sample, workflow, version)
            self.status = self.status or "claimed"
            mine = self.jobs.setdefault(sample, [])
            if job not in mine:
                mine.append(job)
            hit = [job]
        elif event == "sentinel":
            hit = list(self.jobs.get(sample, ()))
        elif event in CONTROL:
            # a submit or an expiry counts only as the run's first event
            hit = [] if event in ("submitted", "expire") and self.status != "claimed" else self.claimed()
            self.status = _moved(self.status, event)
        else:
            hit = []                                   # a heartbeat only renews the signal
        if at is not None and at == at:
            self.signal = max(self.signal, int(at.value // 1_000_000))
        return hit


class RunSteps(StatefulProcessor):
    """Events of the runs of a bucket -> steps of their jobs."""

    def __init__(self, clock: str, heartbeat_ms: int, ttl_ms: int, retention_ms: int):
        self.clock, self.waits = clock, {"running": heartbeat_ms, "claimed": ttl_ms}
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", BUCKET)

    def _load(self) -> dict[str, _Run]:
        runs = {}
        for name, status, signal, last_seq, ends, jobs in zip(*_load(self.runs)):
            run = runs[name] = _Run(status, signal, last_seq, ends)
            for job in jobs:
                run.jobs.setdefault(job[0], []).append(tuple(job))
        return runs

    def _save(self, runs: dict[str, _Run]) -> None:
        if not runs:
            self.runs.clear()
            return
        _save(self.runs, [(n, r.status, r.signal, r.last_seq, r.ends, r.claimed()) for n, r in runs.items()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = self._load()
        touched, steps = {}, []
        for run_name, seq, event, sample, workflow, version, at in in_order(
                rows, ["run_name", "seq", "event", *JOB_KEYS, "utc_time"], ["seq"]):
            seq, at = int(seq), None if at is None else pd.Timestamp(at)
            run = touched[run_name] = runs.get(run_name) or touched.get(run_name) or _Run()
            steps.extend((*job, seq, event, run_name, False, at)
                         for job in run.step(seq, event, sample, workflow, version, at))
            if len(steps) >= FRAME_ROWS:
                yield _frame(steps, _STEP_COLUMNS)
                steps = []
        known = {n: r for n, r in touched.items() if r.status is not None}
        runs.update(known)
        if known:
            if self.clock == "receipt":
                now = timerValues.getCurrentProcessingTimeInMs()
                for run in known.values():
                    run.signal = now
            self._arm(runs, known)
            self._save(runs)
        if steps:
            yield _frame(steps, _STEP_COLUMNS)

    def _arm(self, runs: dict[str, _Run], touched: dict[str, _Run]) -> None:
        """A timer at each time when the status of a touched run runs out; runs of the bucket share it. Finished
        runs are kept for a while, so that late events find them."""
        if self.clock == "none":
            return
        before = {r.ends for r in touched.values()} - {None}
        for run in touched.values():
            wait = self.waits.get(run.status, self.retention_ms if run.status in ENDED else None)
            run.ends = None if wait is None else run.signal + wait
        for old in before - {r.ends for r in runs.values()}:
            self.handle.deleteTimer(old)
        for new in {r.ends for r in touched.values()} - before - {None}:
            self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        time, runs, steps = expiredTimerInfo.getExpiryTimeInMs(), self._load(), []
        due = [n for n, r in runs.items() if r.ends is not None and r.ends <= time]
        for run_name in due:
            run = runs[run_name]
            if run.status not in self.waits:
                del runs[run_name]                     # retention over
                continue
            at = run.ends
            event, run.status = ("failed", "failed") if run.status == "running" else ("expire", "expired")
            run.ends = at + self.retention_ms
            self.handle.registerTimer(run.ends)
            steps.extend((*job, run.last_seq, event, run_name, True, pd.Timestamp(at, unit="ms")) for job in run.claimed())
        if due:
            self._save(runs)
        for start in range(0, len(steps), FRAME_ROWS):
            yield _frame(steps[start:start + FRAME_ROWS], _STEP_COLUMNS)

    def close(self) -> None:
        pass


class JobFold(StatefulProcessor):
    """Steps of the jobs of a bucket -> their states."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getValueState("jobs", BUCKET)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {tuple(entry[:3]): entry[3:] for entry in zip(*_load(self.jobs))}
        touched: dict[tuple, _JobState] = {}
        for *job, timer, seq, event, run, budget in in_order(
                rows, [*JOB_KEYS, "timer", "seq", "event", "run_name", "max_retries"], ["timer", "seq"]):
            job = tuple(job)
            state = touched.get(job)
            if state is None:
                state = touched[job] = _JobState(None if _missing(budget) else budget)
                if job in known:
                    state.status, state.retries, state.run, state.dead, state.done_seq = known[job]
            state.apply(int(seq), event, run)
        known.update((job, (s.status, s.retries, s.run, s.dead, s.done_seq)) for job, s in touched.items())
        if known:
            _save(self.jobs, [(*job, *rest) for job, rest in known.items()])
        out = [state.row(job) for job, state in touched.items()]
        for start in range(0, len(out), FRAME_ROWS):
            yield _frame(out[start:start + FRAME_ROWS], _JOB_COLUMNS)

    def close(self) -> None:
        pass


def _bucket(buckets: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).alias("bucket")


def run_steps(events: DataFrame, clock: str = "none", heartbeat_minutes: float = HEARTBEAT_MINUTES,
              claim_ttl_minutes: float = CLAIM_TTL_MINUTES, retention_minutes: float = RETENTION_MINUTES,
              late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """The first machine: a stream of lifecycle events (``lifecycle.lifecycle_log``) -> steps of jobs."""
    rows = events.select("run_name", "seq", "event", *JOB_KEYS, F.col("utc_time").cast("timestamp").alias("utc_time"),
                         _bucket(buckets, "run_name"))
    if clock == "event":
        rows = rows.withWatermark("utc_time", late)
    machine = RunSteps(clock, *(int(m * 60_000) for m in (heartbeat_minutes, claim_ttl_minutes, retention_minutes)))
    return rows.groupBy("bucket").transformWithStateInPandas(machine, STEPS, "append", CLOCKS[clock])


def fold_steps(steps: DataFrame, workflows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The second machine: a stream of steps -> job rows. ``workflows`` is static, for the retry
    budgets."""
    budgets = workflows.select("workflow_id", F.col("version").alias("workflow_version"), "max_retries")
    return (steps.join(budgets, ["workflow_id", "workflow_version"], "left")
            .select(*JOB_KEYS, "seq", "event", "run_name", "timer", "max_retries", _bucket(buckets, *JOB_KEYS))
            .groupBy("bucket")
            .transformWithStateInPandas(JobFold(), JOBS, "append", "None"))


def job_stream(events: DataFrame, workflows: DataFrame, buckets: int = BUCKETS, **clock) -> DataFrame:
    """Lifecycle events -> job rows, both machines in one stream. See ``run_steps`` for ``clock``. The number of
    ``buckets`` is part of a checkpoint: it must stay as it was when the stream began."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return fold_steps(run_steps(events, buckets=buckets, **clock), workflows, buckets)


def current_jobs(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each job from the parts that ``streams.run_to_parts`` wrote. The batch is a
    column of the parts' path, and the maximum is combined before the shuffle."""
    rows = spark.read.parquet(out)
    columns = [c for c in _JOB_COLUMNS if c not in JOB_KEYS]
    return (rows.groupBy(*JOB_KEYS).agg(F.max_by(F.struct(*columns), "batch_id").alias("j")).select(*JOB_KEYS, "j.*"))


def dead_letters(jobs: DataFrame) -> DataFrame:
    """One row for each job that used up its retries."""
    return jobs.filter("dead_letter").select(*JOB_KEYS, F.col("dead_letter_run").alias("run_name"), "retry_count",
                                             F.lit(SWEEP_REASON).alias("reason"))
