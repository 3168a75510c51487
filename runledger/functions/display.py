"""Derived display columns of the reports (F22-F44) as Column expressions."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1073741824.0
STALE_RUN_MINUTES = 15          # run heartbeat stale limit
AGENT_LIVENESS_MINUTES = 2      # agent counts as active when seen within this
FAILED_STATUSES = ("FAILED", "ABORTED")
SENTINEL_SUFFIXES = ("MARK_COMPLETE", "FINISHED")
NON_TERMINAL_RUN = ("claimed", "submitted", "running")

# Meaning of common exit codes shown next to the modal exit code.
EXIT_LABELS = {
    "137": "OOM kill (SIGKILL)",
    "1": "Generic error",
    "2": "Misuse / config",
    "134": "Abort (SIGABRT)",
    "<null>": "Signal / unknown",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_task_hash(c) -> Column:
    """'ab/cdef1234...' -> 'ab/cdef12'."""
    return F.regexp_replace(_col(c), r"^([^/]+)/(.{6}).+$", "$1/$2")


def bytes_to_gb(c) -> Column:
    """F23."""
    return _col(c) / F.lit(GIB)


def ms_to_min(c) -> Column:
    """F23."""
    return _col(c) / F.lit(60000.0)


def round_half_up(c, digits: int = 2) -> Column:
    """Decimal half-up rounding of a double, as PostgreSQL numeric rounding does."""
    return F.round(_col(c), digits)


def ratio_pct(num, den, zero_if_null: bool = False) -> Column:
    """round(100 * num / nullif(den, 0), 2), optionally 0 instead of NULL."""
    v = F.round(F.try_divide(_col(num).cast("double") * F.lit(100.0), _col(den).cast("double")), 2)
    return F.coalesce(v, F.lit(0.0)) if zero_if_null else v


def null_label(c) -> Column:
    """NULL -> '<null>'."""
    return F.coalesce(_col(c), F.lit("<null>"))


def time_bucket(bucket: str, c) -> Column:
    """date_trunc by hour, day or week (weeks start Monday)."""
    if bucket not in ("hour", "day", "week"):
        raise ValueError("bucket must be 'hour', 'day', or 'week'")
    return F.date_trunc(bucket, _col(c))


def run_id_or_sentinel(run_id, run_name) -> Column:
    """the run's id, or 'pre-weblog:' + run name before the engine reported one."""
    return F.coalesce(_col(run_id), F.concat(F.lit("pre-weblog:"), _col(run_name)))


def is_failed(status="status") -> Column:
    """P8."""
    return _col(status).isin(*FAILED_STATUSES)


def is_sentinel(process="process") -> Column:
    """F41 / P9 complement."""
    p = _col(process)
    return p.endswith(SENTINEL_SUFFIXES[0]) | p.endswith(SENTINEL_SUFFIXES[1])


def classify_run(as_of: dt.datetime, stale_minutes: int = STALE_RUN_MINUTES) -> Column:
    """run death classification, first match wins.

    non-zero wrapper exit -> wrapper-failed; non-terminal -> stalled when the last sign of
    life is older than ``stale_minutes`` before ``as_of``, else (or with no sign) active; terminal without a
    log -> ended-no-log; completed; otherwise the status (or 'unknown').
    """
    last = F.coalesce(F.col("last_heartbeat_at"), F.col("submitted_at"), F.col("claimed_at"))
    cutoff = F.lit(as_of - dt.timedelta(minutes=stale_minutes)).cast("timestamp_ntz")
    status = F.col("status")
    return (F.when(F.col("wrapper_exit_code").isNotNull() & (F.col("wrapper_exit_code") != 0),
                   F.lit("wrapper-failed"))
            .when(status.isin(*NON_TERMINAL_RUN),
                  F.when(last.isNotNull() & (last < cutoff), F.lit("stalled")).otherwise(F.lit("active")))
            .when(F.col("log_uploaded_at").isNull(), F.lit("ended-no-log"))
            .when(status == "completed", F.lit("completed"))
            .otherwise(F.coalesce(status, F.lit("unknown"))))


def is_active_agent(as_of: dt.datetime, last_seen="last_seen_at",
                    minutes: int = AGENT_LIVENESS_MINUTES) -> Column:
    """seen strictly within the liveness window."""
    cutoff = F.lit(as_of - dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    return F.coalesce(_col(last_seen) > cutoff, F.lit(False))


def is_stalled_collection(as_of: dt.datetime, days: int = 7) -> Column:
    """remaining > 0, nothing running, and never completed or last completion > days ago."""
    cutoff = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    return ((F.col("samples_remaining") > 0) & (F.col("samples_running") == 0)
            & (F.col("last_completed_at").isNull() | (F.col("last_completed_at") < cutoff)))


def driver_death(aborted="aborted", failed="failed") -> Column:
    """aborted tasks but no failed ones."""
    return (_col(aborted) > 0) & (_col(failed) == 0)


def heat_level(failures="failures", max_failures: Column | None = None) -> Column:
    """F32: share of the largest cell: >0.6 high, >0.3 mid, >0.1 low, else none.

    ``max_failures`` is the largest cell, passed as a scalar (e.g. a scalar subquery), so
    no single-partition window is needed."""
    top = max_failures if max_failures is not None else F.lit(1)
    share = _col(failures) / F.greatest(top, F.lit(1))
    return (F.when(share > 0.6, "high").when(share > 0.3, "mid").when(share > 0.1, "low")
            .otherwise("none"))


def severity(failure_pct="failure_pct", overview: bool = False) -> Column:
    """failure-rate severity; the overview uses a 4 % middle threshold."""
    mid = 4.0 if overview else 3.0
    p = _col(failure_pct)
    return F.when(p > 6.0, "high").when(p > mid, "elevated").otherwise("normal")


def fmt_duration(ms) -> Column:
    """123ms / 4.5s / 3m 4s / 2h 5m."""
    m = _col(ms)
    secs = m / 1000.0
    return (F.when(m.isNull(), F.lit(None).cast("string"))
            .when(m < 1000, F.format_string("%dms", F.round(m).cast("long")))
            .when(secs < 60, F.format_string("%.1fs", secs))
            .when(secs < 3600, F.format_string("%dm %ds", F.floor(secs / 60).cast("long"),
                                               F.floor(secs % 60).cast("long")))
            .otherwise(F.format_string("%dh %dm", F.floor(secs / 3600).cast("long"),
                                       F.floor((secs % 3600) / 60).cast("long"))))


def success_pct(failure_pct="failure_pct") -> Column:
    """F35."""
    return F.lit(100.0) - _col(failure_pct)


def clamp_pct(part, total) -> Column:
    """share of a total in percent, clamped to 0..100, total at least 1."""
    v = _col(part).cast("double") * 100.0 / F.greatest(_col(total), F.lit(1))
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0))


def queue_wait(submit, start) -> Column:
    """start - submit in seconds from text timestamps; NULL if missing, junk or negative."""
    s = F.try_to_timestamp(_col(submit))
    e = F.try_to_timestamp(_col(start))
    d = F.unix_timestamp(e) - F.unix_timestamp(s)
    return F.when(d >= 0, d)


def tail_text(c, n_bytes: int) -> Column:
    """keep the last ``n_bytes`` bytes of a text (decoded with replacement)."""
    b = F.encode(_col(c), "UTF-8")
    ln = F.octet_length(b)
    cut = F.when(ln > n_bytes, F.substring(b, ln - n_bytes + 1, n_bytes)).otherwise(b)
    return F.decode(cut, "UTF-8")


def publish_prefix(base: str, workflow, version, sample) -> Column:
    """<base>/<workflow>/<version>/<sample>."""
    return F.concat_ws("/", F.lit(base.rstrip("/")), _col(workflow), _col(version), _col(sample))


def exit_label(c) -> Column:
    """meaning of an exit code label; an unknown code has an empty text."""
    pairs = []
    for k, v in EXIT_LABELS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), null_label(c)), F.lit(""))


def bar_share(failures="failures", max_failures: Column | None = None) -> Column:
    """failures / max(failures) with the maximum given as a scalar, at least 1."""
    top = max_failures if max_failures is not None else F.lit(1)
    return _col(failures) / F.greatest(top, F.lit(1))
