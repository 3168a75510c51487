"""Task-level metric reports (A1-A13, A32, O1) over the ``task_executions`` fact table.

Every report is ``DataFrame -> DataFrame``: filter (pushed into the scan), one aggregate with
map-side partial aggregation, then a small sort/limit (TakeOrderedAndProject). Reports that
need several views of the same rows (A10) aggregate once to a compact
``(process, status, exit_code, error_action)`` rollup and derive the views from it; Spark
reuses the shuffle of that rollup for each branch (ReusedExchange).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import (GIB, bytes_to_gb, heat_level, is_failed, is_sentinel,
                                 null_label, ratio_pct, time_bucket)
from . import paging
from .filters import MetricFilter
from .quantiles import group_quantile

def _completed() -> Column:
    return F.col("status") == "COMPLETED"


def _retried() -> Column:
    return F.col("attempt") > 1


def _check(min_samples: int | None = None, limit: int | None = None) -> None:
    if min_samples is not None and min_samples < 1:
        raise ValueError("min_samples must be >= 1")
    if limit is not None and limit < 1:
        raise ValueError("limit must be >= 1")


def _base(tasks: DataFrame, flt: MetricFilter | None) -> DataFrame:
    return (flt or MetricFilter()).apply(tasks)


def summary_cards(tasks: DataFrame, flt: MetricFilter | None = None) -> DataFrame:
    """A1: one row of headline counts and percentages (zeros, not NULL, on empty input)."""
    x = _base(tasks, flt)
    valid_mem = (F.col("peak_rss").isNotNull() & F.col("requested_memory_bytes").isNotNull()
                 & (F.col("requested_memory_bytes") > 0))
    n = F.count(F.lit(1))
    failed = F.count_if(is_failed())
    retried = F.count_if(_retried())
    mem_ratio = F.avg(F.when(valid_mem, F.col("peak_rss") / F.col("requested_memory_bytes")))
    return x.agg(
        n.alias("process_completed_rows"),
        F.count_distinct("run_id").alias("distinct_runs"),
        F.count_distinct(F.when(~is_sentinel(), F.col("process"))).alias("distinct_processes"),
        F.count_if(_completed()).alias("success_rows"),
        failed.alias("failure_rows"),
        ratio_pct(failed, n, zero_if_null=True).alias("failure_pct"),
        retried.alias("retried_rows"),
        ratio_pct(retried, n, zero_if_null=True).alias("retry_pct"),
        ratio_pct(F.count_if(_retried() & _completed()), retried, zero_if_null=True).alias("retry_success_pct"),
        F.coalesce(F.round(mem_ratio * 100.0, 2), F.lit(0.0)).alias("memory_efficiency_pct"),
        F.max("utc_time").alias("latest_process_completed_utc"),
    )


def top_failures(tasks: DataFrame, flt: MetricFilter | None = None, min_samples: int = 5,
                 limit: int = 10) -> DataFrame:
    """A2: processes with the most failed tasks."""
    _check(min_samples, limit)
    g = (_base(tasks, flt).groupBy("process")
         .agg(F.count(F.lit(1)).alias("total_completed"), F.count_if(is_failed()).alias("failed"))
         .filter(F.col("total_completed") >= min_samples)
         .withColumn("failure_pct", ratio_pct("failed", "total_completed")))
    return (g.select("process", "total_completed", "failed", "failure_pct")
            .orderBy(F.desc("failed"), F.desc_nulls_first("failure_pct"), F.desc("total_completed"),
                     F.asc_nulls_last("process"))
            .limit(limit))


def _retry_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_completed"),
            F.count_if(_retried()).alias("retried"),
            F.count_if(_retried() & _completed()).alias("retried_success"),
            F.count_if(_retried() & is_failed()).alias("retried_failed")]


def top_retries(tasks: DataFrame, flt: MetricFilter | None = None, min_samples: int = 5,
                limit: int = 10, with_max_attempt: bool = False) -> DataFrame:
    """A3 (and A7 with ``with_max_attempt``): processes with the most retried tasks."""
    _check(min_samples, limit)
    aggs = _retry_aggs() + ([F.max("attempt").alias("max_attempt")] if with_max_attempt else [])
    g = (_base(tasks, flt).groupBy("process").agg(*aggs)
         .filter(F.col("total_completed") >= min_samples)
         .withColumn("retried_pct", ratio_pct("retried", "total_completed")))
    cols = ["process", "total_completed", "retried", "retried_pct", "retried_success",
            "retried_failed"] + (["max_attempt"] if with_max_attempt else [])
    return (g.select(*cols)
            .orderBy(F.desc("retried"), F.desc_nulls_first("retried_pct"), F.desc("total_completed"),
                     F.asc_nulls_last("process"))
            .limit(limit))


def retries_by_process(tasks: DataFrame, flt: MetricFilter | None = None, min_samples: int = 5,
                       limit: int = 50) -> DataFrame:
    """A7."""
    return top_retries(tasks, flt, min_samples, limit, with_max_attempt=True)


def top_exit_codes(tasks: DataFrame, flt: MetricFilter | None = None, limit: int = 10) -> DataFrame:
    """A4: failed tasks by exit code; NULL is its own group, labelled '<null>'."""
    _check(limit=limit)
    g = (failed_rows(_base(tasks, flt)).groupBy("exit_code").agg(F.count(F.lit(1)).alias("failures"))
         .select(null_label("exit_code").alias("exit_code"), "failures"))
    return g.orderBy(F.desc("failures"), F.asc("exit_code")).limit(limit)


def failed_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_failed())


def event_mix(telemetry: DataFrame, flt: MetricFilter | None = None) -> DataFrame:
    """A5: rows per event type of the event log."""
    return (_base(telemetry, flt).groupBy("event").agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc_nulls_last("event")))


def retries_summary(tasks: DataFrame, flt: MetricFilter | None = None) -> DataFrame:
    """Global retry counts."""
    n = F.count(F.lit(1))
    retried = F.count_if(_retried())
    ok = F.count_if(_retried() & _completed())
    return _base(tasks, flt).agg(
        n.alias("process_completed_rows"),
        retried.alias("retried_rows"),
        ratio_pct(retried, n, zero_if_null=True).alias("retried_pct"),
        ok.alias("retry_success_rows"),
        F.count_if(_retried() & is_failed()).alias("retry_failure_rows"),
        ratio_pct(ok, retried, zero_if_null=True).alias("retry_success_pct"),
    )


def retries_by_attempt(tasks: DataFrame, flt: MetricFilter | None = None) -> DataFrame:
    """Rows, successes and failures per attempt number."""
    return (_base(tasks, flt).groupBy("attempt")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(_completed()).alias("success"),
                 F.count_if(is_failed()).alias("failed"))
            .orderBy(F.asc_nulls_last("attempt")))


def resources_by_attempt(tasks: DataFrame, flt: MetricFilter | None = None, min_samples: int = 5,
                         limit: int = 100, p95: str = "exact") -> DataFrame:
    """Requested vs used resources per (process, attempt), with p95 of usage.

    ``p95="exact"`` interpolates like ``percentile_cont(0.95)`` without holding a whole
    group in one task (see ``quantiles.group_quantile``); ``p95="approx"`` uses the
    mergeable ``percentile_approx`` sketch in a single pass.
    """
    _check(min_samples, limit)
    keys = ["process", "attempt"]
    x = _base(tasks, flt).filter(F.col("process").isNotNull())
    eff_cpu = F.col("pct_cpu") / F.nullif(F.col("requested_cpus") * 100.0, F.lit(0.0))
    eff_mem = F.col("peak_rss") / F.nullif(F.col("requested_memory_bytes"), F.lit(0.0))
    g = (x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_completed()).alias("success"),
        F.count_if(is_failed()).alias("failed"),
        F.round(F.avg("requested_cpus"), 2).alias("avg_requested_cpus"),
        F.round(F.avg("requested_memory_bytes") / GIB, 2).alias("avg_requested_memory_gb"),
        F.round(F.avg("requested_time_ms") / 60000.0, 2).alias("avg_requested_time_min"),
        F.round(F.avg("pct_cpu"), 2).alias("avg_pct_cpu"),
        F.round(F.avg(eff_cpu) * 100.0, 2).alias("avg_cpu_efficiency_pct"),
        F.round(F.avg("pct_mem"), 2).alias("avg_pct_mem"),
        F.round(F.avg(eff_mem) * 100.0, 2).alias("avg_memory_efficiency_pct"),
        F.round(F.avg("peak_rss") / GIB, 2).alias("avg_peak_rss_gb"),
        F.round(F.avg("read_bytes") / GIB, 2).alias("avg_read_gb"),
        F.round(F.avg("write_bytes") / GIB, 2).alias("avg_write_gb"),
    ).filter(F.col("rows") >= min_samples))
    q = group_quantile(x, keys, ["pct_cpu", "pct_mem", "peak_rss"], 0.95, method=p95)
    out = (g.join(q, keys, "left")
           .withColumn("p95_pct_cpu", F.round("q_pct_cpu", 2))
           .withColumn("p95_pct_mem", F.round("q_pct_mem", 2))
           .withColumn("p95_peak_rss_gb", F.round(F.col("q_peak_rss") / GIB, 2)))
    cols = ["process", "attempt", "rows", "success", "failed", "avg_requested_cpus",
            "avg_requested_memory_gb", "avg_requested_time_min", "avg_pct_cpu", "p95_pct_cpu",
            "avg_cpu_efficiency_pct", "avg_pct_mem", "p95_pct_mem", "avg_memory_efficiency_pct",
            "avg_peak_rss_gb", "p95_peak_rss_gb", "avg_read_gb", "avg_write_gb"]
    return (out.select(*cols)
            .orderBy(F.desc("rows"), F.asc_nulls_last("process"), F.asc_nulls_last("attempt"))
            .limit(limit))


def failure_rollup(tasks: DataFrame, flt: MetricFilter | None = None) -> DataFrame:
    """Compact per-(process, status, exit_code, error_action) counts; exactly re-aggregable.

    ``process`` is NOT NULL in the fact table (the flattening quarantines blank ones); the
    explicit predicate keeps every branch built on this rollup identical, because Catalyst
    infers the same predicate for the branches that are join sides."""
    return (_base(tasks, flt).filter(F.col("process").isNotNull())
            .groupBy("process", "status", "exit_code", "error_action")
            .agg(F.count(F.lit(1)).alias("n")))


def _modal(rollup: DataFrame, column: str, out: str, keep_null: bool) -> DataFrame:
    """Most frequent value per process among failed rows; ties -> smallest value,
    NULL last. NULL is a candidate only when ``keep_null``.

    The failed/NULL conditions are inside the sum, and only the aggregated count is
    filtered: a filter on a grouping column would be pushed below the shared rollup and
    give each branch its own scan instead of one reused exchange."""
    cond = is_failed() if keep_null else is_failed() & F.col(column).isNotNull()
    per = (rollup.groupBy("process", column)
           .agg(F.sum(F.when(cond, F.col("n")).otherwise(0)).alias("cnt"))
           .filter(F.col("cnt") > 0))
    w = Window.partitionBy("process").orderBy(F.desc("cnt"), F.asc_nulls_last(column))
    return (per.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
            .select("process", F.col(column).alias(out)))


def failures(tasks: DataFrame, flt: MetricFilter | None = None, min_samples: int = 5,
             limit: int = 50) -> DataFrame:
    """A10: per process totals with the modal failure exit code and modal error action.

    NULL exit codes compete for the mode (NULL loses ties); NULL actions are excluded.
    A NULL process never matches the modal frames (equality join), as in SQL. One scan:
    the three views are derived from one (process, status, exit_code, error_action)
    rollup whose exchange is reused."""
    _check(min_samples, limit)
    r = failure_rollup(tasks, flt)
    grouped = (r.groupBy("process")
               .agg(F.sum("n").alias("total_completed"),
                    F.sum(F.when(F.col("status") == "COMPLETED", F.col("n")).otherwise(0)).alias("success"),
                    F.sum(F.when(is_failed(), F.col("n")).otherwise(0)).alias("failed"))
               .filter(F.col("total_completed") >= min_samples))
    exit_mode = _modal(r, "exit_code", "modal_failure_exit_code", keep_null=True)
    action_mode = _modal(r, "error_action", "modal_error_action", keep_null=False)
    joined = (grouped.join(exit_mode, "process", "left").join(action_mode, "process", "left")
              .withColumn("failure_pct", ratio_pct("failed", "total_completed")))
    return (joined.select("process", F.col("total_completed").cast("long").alias("total_completed"),
                          F.col("success").cast("long").alias("success"),
                          F.col("failed").cast("long").alias("failed"), "failure_pct",
                          "modal_failure_exit_code", "modal_error_action")
            .orderBy(F.desc("failed"), F.desc_nulls_first("failure_pct"), F.desc("total_completed"),
                     F.asc_nulls_last("process"))
            .limit(limit))


def failure_signatures(tasks: DataFrame, flt: MetricFilter | None = None,
                       limit: int = 100) -> DataFrame:
    """Failed tasks per (process, exit code, error action)."""
    _check(limit=limit)
    g = (failed_rows(_base(tasks, flt)).groupBy("process", "exit_code", "error_action")
         .agg(F.count(F.lit(1)).alias("failures"))
         .select("process", null_label("exit_code").alias("exit_code"), "error_action", "failures"))
    return (g.orderBy(F.desc("failures"), F.asc_nulls_last("process"), F.asc("exit_code"),
                      F.asc_nulls_last("error_action"))
            .limit(limit))


def signature_heatmap(tasks: DataFrame, flt: MetricFilter | None = None) -> DataFrame:
    """A32 + F32: process x (exit code, action) failure matrix in long form, with row totals
    and a heat level relative to the largest cell. Runs on the aggregated matrix only."""
    g = (failed_rows(_base(tasks, flt)).groupBy("process", "exit_code", "error_action")
         .agg(F.count(F.lit(1)).alias("failures")))
    sig = F.concat(null_label("exit_code"), F.lit(" / "), F.coalesce("error_action", F.lit("<null>")))
    top = g.agg(F.max("failures")).scalar()          # largest cell, as a scalar subquery
    totals = g.groupBy("process").agg(F.sum("failures").alias("row_total"))
    return (g.select("process", sig.alias("signature"), "failures")
            .join(totals, "process")
            .withColumn("heat", heat_level("failures", top)))


def timeline(tasks: DataFrame, bucket: str = "hour", flt: MetricFilter | None = None,
             process: str | None = None) -> DataFrame:
    """Totals per time bucket; empty buckets are not filled."""
    x = (flt or MetricFilter()).apply(tasks, keys=("workflow_id", "workflow_version"))
    if process is not None:
        x = x.filter(F.col("process") == process)
    n = F.count(F.lit(1))
    failed = F.count_if(is_failed())
    return (x.groupBy(time_bucket(bucket, "utc_time").alias("bucket_start"))
            .agg(n.alias("total"), F.count_if(_completed()).alias("success"), failed.alias("failed"),
                 ratio_pct(failed, n, zero_if_null=True).alias("failure_pct"))
            .orderBy("bucket_start"))


TASK_EVENTS = ("process_submitted", "process_started", "process_completed")


def task_states(telemetry: DataFrame, runs: DataFrame) -> DataFrame:
    """Per (run, task, process) flags of the three task events, over running runs."""
    active = runs.filter(F.col("status") == "running").select("run_name")
    ev = (telemetry.filter(F.col("event").isin(*TASK_EVENTS) & F.col("trace").isNotNull())
          .join(active, "run_name", "left_semi")
          .select("run_name",
                  F.get_json_object("trace", "$['task_id']").alias("task_id"),
                  null_label(F.get_json_object("trace", "$['process']")).alias("process"),
                  "event"))
    return (ev.groupBy("run_name", "task_id", "process")
            .agg(F.bool_or(F.col("event") == "process_submitted").alias("is_submitted"),
                 F.bool_or(F.col("event") == "process_started").alias("is_started"),
                 F.bool_or(F.col("event") == "process_completed").alias("is_completed")))


def running(telemetry: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks in flight and queued per process over the currently running runs."""
    st = task_states(telemetry, runs)
    run_c = F.count_if(F.col("is_started") & ~F.col("is_completed"))
    queue_c = F.count_if(F.col("is_submitted") & ~F.col("is_started"))
    return (st.groupBy("process").agg(run_c.alias("running"), queue_c.alias("queued"))
            .filter((F.col("running") > 0) | (F.col("queued") > 0))
            .orderBy(F.desc("running"), F.desc("queued"), F.asc("process")))


def running_totals(telemetry: DataFrame, runs: DataFrame) -> DataFrame:
    """A13 envelope: active run count and total running / queued tasks (one row)."""
    st = task_states(telemetry, runs)
    totals = st.agg(F.count_if(F.col("is_started") & ~F.col("is_completed")).alias("total_running"),
                    F.count_if(F.col("is_submitted") & ~F.col("is_started")).alias("total_queued"))
    n_runs = runs.filter(F.col("status") == "running").agg(F.count(F.lit(1)))
    return totals.select(n_runs.scalar().alias("active_runs"), "total_running", "total_queued")


def tasks_page(tasks: DataFrame, flt: MetricFilter | None = None, process: str | None = None,
               status: str | None = None, limit: int = 50, offset: int = 0, cursor: dict | None = None) -> DataFrame:
    """O1: task browser page, newest first (telemetry_id breaks ties), with GB columns.

    ``cursor``: the ``utc_time`` and ``telemetry_id`` of the last row seen, in place of an offset
    (``paging.cursor_of(row, TASK_ORDER)``).
    The page total is a separate aggregate (``tasks_total``), not a global window."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    if offset < 0 or offset and cursor is not None:
        raise ValueError("offset must be >= 0, and none is taken beside a cursor")
    x = _base(tasks, flt)
    if process is not None:
        x = x.filter(F.col("process") == process)
    if status is not None:
        x = x.filter(F.col("status") == status)
    # the top-k runs over stored columns; derived ones are computed for the page alone
    rows = x.select(*_TASK_ROW)
    if cursor is not None:
        return _task_row(paging.page(rows, TASK_ORDER, limit, cursor))
    ordered = rows.orderBy(*paging.ordering(TASK_ORDER))
    return _task_row(ordered.limit(offset + limit).offset(offset) if offset else ordered.limit(limit))


TASK_ORDER = [("utc_time", "desc"), ("telemetry_id", "desc")]
_TASK_ROW = ["telemetry_id", "run_name", "run_id", "sample_id", "workflow_id", "workflow_version", "utc_time", "process", "name",
             "status", "attempt", "task_hash", "exit_code", "error_action", "realtime_ms", "requested_cpus",
             "requested_memory_bytes", "pct_cpu", "pct_mem", "peak_rss", "rchar", "wchar"]


def _task_row(rows: DataFrame) -> DataFrame:
    gb = {"requested_memory_bytes": "requested_memory_gb", "peak_rss": "peak_rss_gb", "rchar": "read_gb", "wchar": "write_gb"}
    return rows.select(*[bytes_to_gb(c).alias(gb[c]) if c in gb else c for c in _TASK_ROW])


def tasks_total(tasks: DataFrame, flt: MetricFilter | None = None, process: str | None = None,
                status: str | None = None) -> DataFrame:
    """Number of rows matching the task browser filters."""
    x = _base(tasks, flt)
    if process is not None:
        x = x.filter(F.col("process") == process)
    if status is not None:
        x = x.filter(F.col("status") == status)
    return x.agg(F.count(F.lit(1)).alias("total"))


def summary(tasks: DataFrame, telemetry: DataFrame, flt: MetricFilter | None = None,
            min_samples: int = 5, limit: int = 10) -> dict[str, DataFrame]:
    """The summary report: cards, event mix, top failures/retries/exit codes."""
    return {"cards": summary_cards(tasks, flt),
            "event_mix": event_mix(telemetry, flt),
            "top_failures": top_failures(tasks, flt, min_samples, limit),
            "top_retries": top_retries(tasks, flt, min_samples, limit),
            "top_failure_exit_codes": top_exit_codes(tasks, flt, limit)}
