"""Collection (study / group) reports: A14-A19, A34, F30, F36, O3, O9.

Membership is many-to-many: a sample in N collections counts in each. Every report first
reduces the large side to one row per sample (or per sample x process), then joins the
de-duplicated membership bridge, then aggregates per collection. The per-collection
aggregates are sums/counts/max, so a collection holding a third of all samples is
combined map-side and never gathered in one task.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import is_failed, is_stalled_collection
from .filters import workflow_scope

JOB_STATUSES = ("pending", "claimed", "submitted", "running", "completed", "failed")


def _members(members: DataFrame) -> DataFrame:
    return members.select("collection_id", "sample_id").dropDuplicates(["collection_id", "sample_id"])


def list_collections(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Collections with their member count, newest first."""
    counts = _members(members).groupBy("collection_id").agg(F.count(F.lit(1)).alias("sample_count"))
    return (collections.join(counts, "collection_id", "left")
            .select("collection_id", "source", "label", "created_at",
                    F.coalesce("sample_count", F.lit(0)).alias("sample_count"))
            .orderBy(F.desc_nulls_first("created_at"), F.asc("collection_id")))


def _sample_job_flags(jobs: DataFrame) -> DataFrame:
    """One row per sample: whether any in-scope job is completed / failed / running, and
    the last completion time."""
    st = F.col("status")
    return (jobs.groupBy("sample_id")
            .agg(F.max((st == "completed").cast("int")).alias("c"),
                 F.max((st == "failed").cast("int")).alias("f"),
                 F.max((st == "running").cast("int")).alias("r"),
                 F.max(F.when(st == "completed", F.col("completed_at"))).alias("last_completed_at")))


def leaderboard(collections: DataFrame, members: DataFrame, jobs: DataFrame,
                workflows: DataFrame) -> DataFrame:
    """Every collection with active-version completion, laggards first.

    completion = distinct samples with a completed job under an active version / samples.
    """
    flags = _sample_job_flags(workflow_scope(jobs, workflows))
    per = (_members(members).join(flags, "sample_id", "left")
           .groupBy("collection_id")
           .agg(F.count(F.lit(1)).alias("sample_count"),
                F.sum(F.coalesce("c", F.lit(0))).cast("long").alias("samples_completed"),
                F.sum(F.coalesce("f", F.lit(0))).cast("long").alias("samples_failed"),
                F.sum(F.coalesce("r", F.lit(0))).cast("long").alias("samples_running"),
                F.max("last_completed_at").alias("last_completed_at")))
    out = collections.join(per, "collection_id", "left").select(
        "collection_id", "source", "label",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
          for c in ("sample_count", "samples_completed", "samples_failed", "samples_running")],
        "last_completed_at")
    ratio = F.when(F.col("sample_count") == 0, F.lit(0.0)).otherwise(
        F.col("samples_completed") / F.col("sample_count"))
    return (out.withColumn("samples_remaining", F.col("sample_count") - F.col("samples_completed"))
            .withColumn("completion_pct", F.bround(ratio * 100.0, 2))
            .withColumn("_ratio", ratio)
            .orderBy(F.asc("_ratio"), F.desc("sample_count"), F.asc("collection_id"))
            .drop("_ratio"))


def stalled_collections(board: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """F30 over a leaderboard."""
    return board.withColumn("is_stalled", is_stalled_collection(as_of, days))


def collection_summary(collections: DataFrame, members: DataFrame, jobs: DataFrame,
                       workflows: DataFrame, collection_id: str | None = None,
                       workflow_id: str | None = None, workflow_version: str | None = None,
                       include_all: bool = False) -> DataFrame:
    """Per collection (or one, when ``collection_id`` is given): member count, the six
    job-status counts (zero-filled, other statuses ignored), distinct completed samples and
    completion over *samples*. Job rows are counted once per membership."""
    m = _members(members)
    cols = collections
    if collection_id is not None:
        m = m.filter(F.col("collection_id") == collection_id)
        cols = cols.filter(F.col("collection_id") == collection_id)
    scoped = workflow_scope(jobs, workflows, workflow_id, workflow_version, include_all)
    per_sample = (scoped.filter(F.col("status").isin(*JOB_STATUSES))
                  .groupBy("sample_id")
                  .agg(*[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES]))
    sizes = m.groupBy("collection_id").agg(F.count(F.lit(1)).alias("sample_count"))
    per = (m.join(per_sample, "sample_id", "inner").groupBy("collection_id")
           .agg(*[F.sum(s).alias(s) for s in JOB_STATUSES],
                F.count_if(F.col("completed") > 0).alias("samples_completed")))
    out = (cols.join(sizes, "collection_id", "left").join(per, "collection_id", "left")
           .select("collection_id", "source", "label",
                   F.coalesce("sample_count", F.lit(0)).cast("long").alias("sample_count"),
                   F.coalesce("samples_completed", F.lit(0)).cast("long").alias("samples_completed"),
                   *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in JOB_STATUSES]))
    total = sum((F.col(s) for s in JOB_STATUSES[1:]), F.col(JOB_STATUSES[0]))
    pct = F.when(F.col("sample_count") > 0,
                 F.col("samples_completed") / F.col("sample_count") * 100.0).otherwise(F.lit(0.0))
    return (out.withColumn("total_jobs", total)
            .withColumn("completion_pct", F.bround(pct, 2)))


def failure_by_process(tasks: DataFrame, members: DataFrame, workflows: DataFrame,
                       collection_id: str | None = None, workflow_id: str | None = None,
                       workflow_version: str | None = None, include_all: bool = False) -> DataFrame:
    """A17 + A34: failed tasks and distinct failed samples per (collection, process), with
    each process's share of the collection's failures."""
    f = workflow_scope(tasks.filter(is_failed() & F.col("process").isNotNull()),
                       workflows, workflow_id, workflow_version, include_all)
    per_sample = f.groupBy("sample_id", "process").agg(F.count(F.lit(1)).alias("n"))
    m = _members(members)
    if collection_id is not None:
        m = m.filter(F.col("collection_id") == collection_id)
    g = (m.join(per_sample, "sample_id").groupBy("collection_id", "process")
         .agg(F.sum("n").cast("long").alias("failed_count"),
              F.count(F.lit(1)).alias("sample_count")))
    share = F.col("failed_count") / F.sum("failed_count").over(Window.partitionBy("collection_id"))
    return (g.withColumn("failure_share", F.round(share * 100.0, 2))
            .orderBy("collection_id", F.desc("failed_count"), F.asc("process")))


def collection_failures(tasks: DataFrame, members: DataFrame, workflows: DataFrame,
                        collection_id: str | None = None, process: str | None = None,
                        limit: int = 200, workflow_id: str | None = None,
                        workflow_version: str | None = None,
                        include_all: bool = False) -> DataFrame:
    """Newest failed task occurrences per (collection, process), ``limit`` each.

    ``row_number() <= limit`` is planned as a window group limit: each map task keeps only
    its newest ``limit`` rows per group before the shuffle, so a hot group ships
    ``limit`` rows per partition, not all of its rows."""
    f = workflow_scope(tasks.filter(is_failed()), workflows, workflow_id, workflow_version,
                       include_all)
    if process is not None:
        f = f.filter(F.col("process") == process)
    m = _members(members)
    if collection_id is not None:
        m = m.filter(F.col("collection_id") == collection_id)
    rows = f.join(m, "sample_id").select(
        "collection_id", "process", "telemetry_id", "sample_id", "run_name", "utc_time",
        F.col("name").alias("task_name"), "task_hash", "status", "exit_code", "attempt")
    w = Window.partitionBy("collection_id", "process").orderBy(F.desc("utc_time"),
                                                               F.desc("telemetry_id"))
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def collection_facets(samples: DataFrame, members: DataFrame) -> DataFrame:
    """Member count per collection (overlap allowed) next to the catalog total."""
    total = samples.agg(F.count(F.lit(1)))
    return (_members(members).groupBy(F.col("collection_id").alias("collection"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("collection", "count", total.scalar().alias("total_samples"))
            .orderBy(F.desc("count"), F.asc("collection")))


def stack_shares(board: DataFrame) -> DataFrame:
    """completed / running / failed share of a collection's samples (clamped 0-100)."""
    from ..functions.display import clamp_pct
    return board.select(
        "collection_id",
        clamp_pct("samples_completed", "sample_count").alias("completed_share"),
        clamp_pct("samples_running", "sample_count").alias("running_share"),
        clamp_pct("samples_failed", "sample_count").alias("failed_share"))


def samples_page(samples: DataFrame, members: DataFrame, search: str | None = None,
                 collection: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """O3: samples newest first with their memberships; the page is cut before the
    membership lookup, so only page rows are enriched."""
    s = samples
    if search:
        s = s.filter(F.col("sample_id").ilike(f"%{search}%"))
    if collection:
        s = s.join(members.filter(F.col("collection_id") == collection).select("sample_id"),
                   "sample_id", "left_semi")
    page = s.orderBy(F.desc_nulls_first("created_at"), F.asc("sample_id"))
    page = page.limit(offset + limit).offset(offset) if offset else page.limit(limit)
    mem = (members.join(page.select("sample_id"), "sample_id", "left_semi")
           .groupBy("sample_id")
           .agg(F.array_sort(F.collect_set("collection_id")).alias("collections")))
    return (page.join(mem, "sample_id", "left")
            .withColumn("collections", F.coalesce("collections", F.array().cast("array<string>"))))


def sort_by_column(board: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """User-chosen sort key over a (small) report frame, key column as tie-break."""
    c = F.col(column)
    return board.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(),
                         F.asc(board.columns[0]))
