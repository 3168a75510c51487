"""Row filters and workflow scopes.

``MetricFilter`` is the conjunction every metric report applies to the task facts. Its
predicates are plain comparisons against literals of the column's own type, so Catalyst
pushes them into the Parquet scan (row-group min/max skipping on ``utc_time``) and, when the
table is partitioned by ``event_date``, a derived date predicate prunes whole partitions.
"""
from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import FAILED_STATUSES, SENTINEL_SUFFIXES

DEFAULT_WINDOW_DAYS = 7


def _lit_like(df: DataFrame, column: str, value) -> Column:
    """A literal cast to the column's own type (keeps the comparison pushable)."""
    return F.lit(value).cast(df.schema[column].dataType)


@dataclasses.dataclass(frozen=True)
class MetricFilter:
    """Time window and key filters of the metric reports.

    Relative windows (days/hours/minutes) are anchored at ``as_of``; there is no implicit
    now(). With no time field at all the default 7-day window applies unless ``all_time``.
    """
    window_days: int | None = None
    window_hours: int | None = None
    window_minutes: int | None = None
    since: dt.datetime | None = None
    until: dt.datetime | None = None
    workflow_id: str | None = None
    workflow_version: str | None = None
    run_name: str | None = None
    sample_id: str | None = None
    all_time: bool = False
    as_of: dt.datetime | None = None

    def effective(self) -> "MetricFilter":
        windows = [w for w in (self.window_days, self.window_hours, self.window_minutes)
                   if w is not None]
        if len(windows) > 1:
            raise ValueError("Provide only one of window_days, window_hours or window_minutes.")
        for name in ("window_days", "window_hours", "window_minutes"):
            v = getattr(self, name)
            if v is not None and v < 1:
                raise ValueError(f"{name} must be >= 1")
        if (not self.all_time and not windows and self.since is None and self.until is None):
            return dataclasses.replace(self, window_days=DEFAULT_WINDOW_DAYS)
        return self

    def lower_bound(self) -> dt.datetime | None:
        f = self.effective()
        delta = None
        if f.window_days is not None:
            delta = dt.timedelta(days=f.window_days)
        elif f.window_hours is not None:
            delta = dt.timedelta(hours=f.window_hours)
        elif f.window_minutes is not None:
            delta = dt.timedelta(minutes=f.window_minutes)
        bounds = []
        if delta is not None:
            if f.as_of is None:
                raise ValueError("a relative window needs as_of")
            bounds.append(f.as_of - delta)
        if f.since is not None:
            bounds.append(f.since)
        return max(bounds) if bounds else None

    def apply(self, df: DataFrame, time_col: str = "utc_time",
              keys: tuple[str, ...] = ("workflow_id", "workflow_version", "run_name", "sample_id")
              ) -> DataFrame:
        f = self.effective()
        conds: list[Column] = []
        lo = f.lower_bound()
        if lo is not None:
            conds.append(F.col(time_col) >= _lit_like(df, time_col, lo))
        if f.until is not None:
            conds.append(F.col(time_col) <= _lit_like(df, time_col, f.until))
        # Partition pruning: Catalyst cannot derive a date-partition predicate from a
        # timestamp range, so it is added explicitly.
        if "event_date" in df.columns:
            if lo is not None:
                conds.append(F.col("event_date") >= F.lit(lo.date()))
            if f.until is not None:
                conds.append(F.col("event_date") <= F.lit(f.until.date()))
        for k in keys:
            v = getattr(f, k)
            if v is not None:
                conds.append(F.col(k) == F.lit(v))
        for c in conds:
            df = df.filter(c)
        return df


def failed_only(df: DataFrame, status: str = "status") -> DataFrame:
    """P8."""
    return df.filter(F.col(status).isin(*FAILED_STATUSES))


def not_sentinel(df: DataFrame, process: str = "process") -> DataFrame:
    """Drop MARK_COMPLETE / FINISHED bookkeeping processes."""
    p = F.col(process)
    return df.filter(~p.like("%" + SENTINEL_SUFFIXES[0]) & ~p.like("%" + SENTINEL_SUFFIXES[1]))


def process_eq(df: DataFrame, process: str | None = None, status: str | None = None) -> DataFrame:
    """P3."""
    if process is not None:
        df = df.filter(F.col("process") == process)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df


def workflow_scope(df: DataFrame, workflows: DataFrame, workflow_id: str | None = None,
                   workflow_version: str | None = None, include_all: bool = False,
                   id_col: str = "workflow_id", version_col: str = "workflow_version") -> DataFrame:
    """Explicit id/version, everything, or (default) only currently active versions.

    The active scope is a semi-join, so the row count of ``df`` is never multiplied. The
    registry holds one row per (workflow, version); AQE broadcasts it from its measured
    runtime size.
    """
    if workflow_id or workflow_version:
        if workflow_id:
            df = df.filter(F.col(id_col) == workflow_id)
        if workflow_version:
            df = df.filter(F.col(version_col) == workflow_version)
        return df
    if include_all:
        return df
    active = (workflows.filter(F.col("status") == "active")
              .select(F.col("workflow_id").alias("_wf"), F.col("version").alias("_ver")))
    return df.join(active,
                   (F.col(id_col) == F.col("_wf")) & (F.col(version_col) == F.col("_ver")),
                   "left_semi")


def search_ilike(df: DataFrame, column: str, text: str) -> DataFrame:
    """P5: case-insensitive substring; '%' and '_' in the text act as wildcards, as in SQL."""
    return df.filter(F.col(column).ilike(f"%{text}%"))


def contains_accession(df: DataFrame, accession: str, match: str = "exact",
                       column: str = "ncbi_accession") -> DataFrame:
    """Samples listing a run accession; exact token match by default."""
    from ..functions.identity import parse_srrs
    if match == "substring":
        return df.filter(F.col(column).contains(accession))
    return df.filter(F.array_contains(parse_srrs(column), accession.strip()))


def in_collection(samples: DataFrame, members: DataFrame, collection_id: str) -> DataFrame:
    """Samples that belong to a collection (semi-join)."""
    m = members.filter(F.col("collection_id") == collection_id).select("sample_id")
    return samples.join(m, "sample_id", "left_semi")


def unresolved(df: DataFrame) -> DataFrame:
    """P10."""
    return df.filter(F.col("resolved_at").isNull())


def orphans(samples: DataFrame) -> DataFrame:
    """P11."""
    from ..functions.identity import is_orphan
    return samples.filter(is_orphan("ncbi_accession"))


def run_filters(runs: DataFrame, status: str | None = None,
                workflow_id: str | None = None) -> DataFrame:
    """P13."""
    if status is not None:
        runs = runs.filter(F.col("status") == status)
    if workflow_id is not None:
        runs = runs.filter(F.col("workflow_id") == workflow_id)
    return runs


def workflow_list(workflows: DataFrame, status: str | None = None) -> DataFrame:
    """P14."""
    if status is not None:
        workflows = workflows.filter(F.col("status") == status)
    return workflows.orderBy("workflow_id", "version")


def logs_by_key(logs: DataFrame, run_name: str, task_hash: str) -> DataFrame:
    """P15."""
    return (logs.filter((F.col("run_name") == run_name) & (F.col("task_hash") == task_hash))
            .orderBy("log_type"))


def lookup(df: DataFrame, **eq) -> DataFrame:
    """Point lookup by equality on the given columns."""
    for k, v in eq.items():
        df = df.filter(F.col(k) == v)
    return df


def exists(df: DataFrame, **eq) -> bool:
    """Does any row match (stops at the first match)."""
    return not lookup(df, **eq).isEmpty()


def active_version(workflows: DataFrame, workflow_id: str) -> DataFrame:
    """The active version row of a workflow (empty when none is active)."""
    return workflows.filter((F.col("workflow_id") == workflow_id) & (F.col("status") == "active"))
