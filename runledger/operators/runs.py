"""Run, job, agent and dispatch reports: A20-A23, A33, A40, O2, O6, O8, O10, J17.

Large inputs (task facts, jobs) are reduced per run / per workflow version with partial
aggregation before they meet the run registry; no report gathers a run's rows in one task.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import classify_run, driver_death, is_active_agent
from . import paging
from .collections import JOB_STATUSES

NEXTFLOW_LOG_TYPE = "nextflow_log"
WRAPPER_LOG_TYPE = "wrapper_output_log"
ATTENTION = ("wrapper-failed", "ended-no-log", "stalled")


def _status_counts(df: DataFrame, key: list[str], statuses=JOB_STATUSES) -> list:
    return [F.count_if(F.col("status") == s).alias(s) for s in statuses]


def job_summary(workflows: DataFrame, jobs: DataFrame, dead_letter: DataFrame) -> DataFrame:
    """Per workflow version: six job-status counts, dead-letter rows (resolved
    included), total and completion over job rows."""
    keys = ["workflow_id", "workflow_version"]
    counts = jobs.groupBy(*keys).agg(*_status_counts(jobs, keys))
    dlq = (dead_letter.select("job_id")
           .join(jobs.select("job_id", *keys), "job_id")
           .groupBy(*keys).agg(F.count(F.lit(1)).alias("dead_letter")))
    wf = workflows.select("workflow_id", F.col("version").alias("workflow_version"))
    out = (wf.join(counts, keys, "left").join(dlq, keys, "left")
           .select(*keys, *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in JOB_STATUSES],
                   F.coalesce("dead_letter", F.lit(0)).cast("long").alias("dead_letter")))
    total = sum((F.col(s) for s in JOB_STATUSES[1:]), F.col(JOB_STATUSES[0]))
    out = out.withColumn("total", total)
    pct = F.when(F.col("total") > 0, F.col("completed") * 100.0 / F.col("total")).otherwise(0.0)
    return out.withColumn("completion_pct", F.bround(pct, 2))


def admin_stats(samples: DataFrame, workflows: DataFrame, jobs: DataFrame, runs: DataFrame,
                dead_letter: DataFrame) -> DataFrame:
    """Catalog overview as (metric, key, n) rows."""
    def total(df, metric):
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("key"), "n")

    def by_status(df, metric):
        return df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(metric).alias("metric"), F.col("status").alias("key"), "n")

    active = workflows.filter(F.col("status") == "active").select(
        "workflow_id", F.col("version").alias("workflow_version"))
    active_jobs = jobs.join(active, ["workflow_id", "workflow_version"], "left_semi")
    return (total(samples, "samples")
            .unionByName(total(workflows, "workflows"))
            .unionByName(by_status(jobs, "jobs_by_status"))
            .unionByName(by_status(active_jobs, "jobs_by_status_active"))
            .unionByName(by_status(runs, "runs_by_status"))
            .unionByName(total(dead_letter.filter(F.col("resolved_at").isNull()),
                               "dead_letter_unresolved")))


def _active_agents(agents: DataFrame, as_of: dt.datetime) -> DataFrame:
    filt = F.filter(F.transform(F.split(F.coalesce(F.trim("workflow_filter"), F.lit("")), ","),
                                lambda x: F.trim(x)), lambda x: x != F.lit(""))
    return agents.filter(is_active_agent(as_of)).withColumn("filters", filt)


def dispatchability(jobs: DataFrame, workflows: DataFrame, agents: DataFrame,
                    as_of: dt.datetime) -> DataFrame:
    """A22 + J17: pending jobs per active workflow version that no active agent claims.

    An agent claims a workflow when its filter list is empty (claims any) or lists the
    workflow id. The list-containment join is rewritten as an equi anti-join on the
    exploded filter lists plus a scalar 'is there a claim-any agent' test."""
    active_wf = workflows.filter(F.col("status") == "active").select(
        "workflow_id", F.col("version").alias("workflow_version"))
    pending = (jobs.filter(F.col("status") == "pending")
               .join(active_wf, ["workflow_id", "workflow_version"], "left_semi")
               .groupBy("workflow_id", "workflow_version").agg(F.count(F.lit(1)).alias("pending")))
    live = _active_agents(agents, as_of)
    claimed = live.select(F.explode("filters").alias("workflow_id")).distinct()
    claim_any = live.filter(F.size("filters") == 0).agg(F.count(F.lit(1))).scalar()
    return (pending.join(claimed, "workflow_id", "left_anti")
            .filter(claim_any == 0)
            .withColumn("reason", F.lit(NO_DAEMON_REASON))
            .orderBy("workflow_id", "workflow_version"))


# Fixed value: wording of the report.
NO_DAEMON_REASON = "no active daemon claims this workflow"


def dispatch_totals(jobs: DataFrame, workflows: DataFrame, agents: DataFrame,
                    as_of: dt.datetime) -> DataFrame:
    """A22 envelope: active agents and total stuck pending jobs (one row)."""
    stuck = dispatchability(jobs, workflows, agents, as_of)
    n_live = _active_agents(agents, as_of).agg(F.count(F.lit(1))).scalar()
    return stuck.agg(F.coalesce(F.sum("pending"), F.lit(0)).cast("long").alias("stuck_pending_total"),
                     F.count(F.lit(1)).alias("stuck_workflows")) \
        .select(n_live.alias("active_daemons"), "stuck_pending_total", "stuck_workflows")


def classified_runs(runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Runs with their F28 classification."""
    return runs.withColumn("classification", classify_run(as_of))


RUN_ORDER = [("claimed_at", "desc"), ("run_name", "asc")]


def runs_page(runs: DataFrame, as_of: dt.datetime, status: str | None = None,
              workflow_id: str | None = None, limit: int = 50, offset: int = 0,
              cursor: dict | None = None) -> DataFrame:
    """O2 + P13: runs by claim time (newest first, never-claimed last), classified. ``cursor``: the
    last run seen, in place of an offset (``paging.cursor_of(row, RUN_ORDER)``)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    if offset < 0 or offset and cursor is not None:
        raise ValueError("offset must be >= 0, and none is taken beside a cursor")
    r = runs
    if status is not None:
        r = r.filter(F.col("status") == status)
    if workflow_id is not None:
        r = r.filter(F.col("workflow_id") == workflow_id)
    if cursor is not None:
        return classified_runs(paging.page(r, RUN_ORDER, limit, cursor), as_of)
    page = r.orderBy(F.desc_nulls_last("claimed_at"), F.asc("run_name"))
    page = page.limit(offset + limit).offset(offset) if offset else page.limit(limit)
    return classified_runs(page, as_of)


def attention_count(runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Runs per classification, flagged when the class needs attention."""
    return (classified_runs(runs, as_of).groupBy("classification")
            .agg(F.count(F.lit(1)).alias("runs"))
            .withColumn("needs_attention", F.col("classification").isin(*ATTENTION)))


def run_detail(runs: DataFrame, tasks: DataFrame, jobs: DataFrame, logs: DataFrame,
               as_of: dt.datetime, run_name: str | None = None) -> DataFrame:
    """A23 (+F31): per run (or one run): classification, task-status counts, job-status
    counts, run-log availability and the driver-death signature."""
    r = runs if run_name is None else runs.filter(F.col("run_name") == run_name)
    t = tasks if run_name is None else tasks.filter(F.col("run_name") == run_name)
    j = jobs if run_name is None else jobs.filter(F.col("run_name") == run_name)
    task_c = (t.groupBy("run_name")
              .agg(F.count_if(F.col("status") == "COMPLETED").alias("tasks_completed"),
                   F.count_if(F.col("status") == "FAILED").alias("tasks_failed"),
                   F.count_if(F.col("status") == "ABORTED").alias("tasks_aborted"),
                   F.count_if(~F.col("status").isin("COMPLETED", "FAILED", "ABORTED")
                              | F.col("status").isNull()).alias("tasks_other")))
    job_c = (j.filter(F.col("run_name").isNotNull()).groupBy("run_name")
             .agg(*[F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in JOB_STATUSES]))
    log_f = (logs.filter(F.col("log_type").isin(NEXTFLOW_LOG_TYPE, WRAPPER_LOG_TYPE))
             .groupBy("run_name")
             .agg(F.bool_or(F.col("log_type") == NEXTFLOW_LOG_TYPE).alias("nextflow_log_available"),
                  F.bool_or(F.col("log_type") == WRAPPER_LOG_TYPE).alias("wrapper_output_log_available")))
    count_cols = (["tasks_completed", "tasks_failed", "tasks_aborted", "tasks_other"]
                  + [f"jobs_{s}" for s in JOB_STATUSES])
    out = (classified_runs(r, as_of).select("run_name", "status", "classification")
           .join(task_c, "run_name", "left").join(job_c, "run_name", "left")
           .join(log_f, "run_name", "left"))
    return out.select(
        "run_name", "status", "classification",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in count_cols],
        F.coalesce("nextflow_log_available", F.lit(False)).alias("nextflow_log_available"),
        F.coalesce("wrapper_output_log_available", F.lit(False)).alias("wrapper_output_log_available"),
    ).withColumn("driver_death", driver_death("tasks_aborted", "tasks_failed"))


def failed_tasks(tasks: DataFrame, run_name: str | None = None) -> DataFrame:
    """The failed and aborted tasks of every run (or one), newest first within a run."""
    t = tasks if run_name is None else tasks.filter(F.col("run_name") == run_name)
    return (t.filter(F.col("status").isin("FAILED", "ABORTED"))
            .select("run_name", "utc_time", "process", "sample_id", "exit_code", "task_hash", "attempt", "error_action")
            .orderBy("run_name", F.desc("utc_time"), "task_hash"))


def agents_list(agents: DataFrame, as_of: dt.datetime, active_only: bool = False) -> DataFrame:
    """O6 + F29: agents newest heartbeat first, with liveness."""
    a = agents.withColumn("is_active", is_active_agent(as_of))
    if active_only:
        a = a.filter("is_active")
    return a.orderBy(F.desc_nulls_last("last_seen_at"), F.asc("agent_id"))


def fleet_counts(agents: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Active vs stale agents."""
    act = is_active_agent(as_of)
    return agents.agg(F.count_if(act).alias("active"), F.count_if(~act).alias("stale"))


def next_batch(jobs: DataFrame, workflows: DataFrame, samples: DataFrame, limit: int = 100,
               workflow_ids: list[str] | None = None,
               workflow_version: str | None = None) -> DataFrame:
    """O8 (read-only): the first (workflow, version) with pending jobs under an active version
    (by workflow id, version, creation time), then its oldest ``limit`` jobs with the
    sample's accession and metadata. No claim is written."""
    active = workflows.filter(F.col("status") == "active").select(
        "workflow_id", F.col("version").alias("workflow_version"))
    p = jobs.filter(F.col("status") == "pending").join(active, ["workflow_id", "workflow_version"],
                                                      "left_semi")
    if workflow_ids:
        p = p.filter(F.col("workflow_id").isin(*workflow_ids))
    if workflow_version:
        p = p.filter(F.col("workflow_version") == workflow_version)
    first = p.agg(F.min(F.struct("workflow_id", "workflow_version", "created_at")).alias("k"))
    pick = first.scalar()
    batch = (p.filter((F.col("workflow_id") == pick.getField("workflow_id"))
                      & (F.col("workflow_version") == pick.getField("workflow_version")))
             .orderBy(F.asc_nulls_last("created_at"), F.asc("job_id")).limit(limit))
    return (batch.select("job_id", "sample_id", "workflow_id", "workflow_version", "created_at")
            .join(samples.select("sample_id", "ncbi_accession", "metadata"), "sample_id", "left"))


def eligible_samples(samples: DataFrame, jobs: DataFrame, workflow_id: str, version: str,
                     limit: int) -> DataFrame:
    """Samples without a job of the version, or whose job is terminal; never-run first."""
    j = (jobs.filter((F.col("workflow_id") == workflow_id) & (F.col("workflow_version") == version))
         .select("sample_id", F.col("status").alias("job_status")))
    return (samples.select("sample_id").join(j, "sample_id", "left")
            .filter(F.col("job_status").isNull() | F.col("job_status").isin("completed", "failed"))
            .orderBy(F.col("job_status").isNull().desc(), F.asc("sample_id"))
            .limit(limit))
