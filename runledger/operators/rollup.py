"""Mergeable daily rollups of task facts (A1, A8, A9, A12 over any span of days).

One state row holds a (day, process, attempt): counts, sums and a KLL sketch of each measured
column. States merge by addition and by ``kll_merge_agg_double``, so a report over years reads
some rows a day instead of the facts, and facts that arrive later only add rows. Counts and
sums equal the direct report; a p95 from the sketch is a value whose rank is off by a bounded
share of the group (``K`` = 800: about 0.4 %). Exact p95 stays with ``metrics.resources_by_attempt``.

Partial aggregation is map-side, so a process with a third of all rows is a few state rows a
task before the shuffle. A batch owns its folder: writing it again replaces it.
"""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import is_failed

KEYS = ["process", "attempt"]
MEASURES = ["pct_cpu", "pct_mem", "peak_rss"]
K = 800                   # size parameter of the sketches


def daily_state(tasks: DataFrame) -> DataFrame:
    """``(event_date, process, attempt, rows, success, failed, n_*, sum_*, kll_*)``; facts without a
    process or a time are left to the quarantine, as in the direct reports. Null measures count in
    ``rows`` alone."""
    measured = []
    for m in MEASURES:
        v = F.col(m).cast("double")
        measured += [F.count(v).alias(f"n_{m}"), F.sum(v).alias(f"sum_{m}"), F.kll_sketch_agg_double(v, K).alias(f"kll_{m}")]
    return (tasks.filter(F.col("process").isNotNull() & F.col("utc_time").isNotNull())
            .groupBy(F.to_date("utc_time").alias("event_date"), *KEYS)
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "COMPLETED").alias("success"),
                 F.count_if(is_failed()).alias("failed"), *measured))


def write_batch(tasks: DataFrame, path: str, batch: int) -> None:
    """The state of one batch of facts; a replay of the batch replaces it."""
    daily_state(tasks).write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def window_report(states: DataFrame, first: date | None = None, last: date | None = None,
                  quantile: float = 0.95) -> DataFrame:
    """States of the days ``first`` to ``last`` merged to one row a (process, attempt): counts, means
    and the sketched quantile of each measure (null where a group measured nothing)."""
    if first is not None:
        states = states.filter(F.col("event_date") >= F.lit(first))
    if last is not None:
        states = states.filter(F.col("event_date") <= F.lit(last))
    merged = states.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("rows", "success", "failed", *[f"{p}_{m}" for m in MEASURES for p in ("n", "sum")])],
        *[F.kll_merge_agg_double(F.when(F.col(f"n_{m}") > 0, F.col(f"kll_{m}")), K).alias(f"kll_{m}") for m in MEASURES])
    return merged.select(
        *KEYS, "rows", "success", "failed",
        *[F.round(F.col(f"sum_{m}") / F.nullif(F.col(f"n_{m}"), F.lit(0)), 2).alias(f"avg_{m}") for m in MEASURES],
        *[F.when(F.col(f"n_{m}") > 0, F.kll_sketch_get_quantile_double(f"kll_{m}", F.lit(quantile))).alias(f"q_{m}")
          for m in MEASURES])


def daily_timeline(states: DataFrame) -> DataFrame:
    """A12 by day from the states: rows, successes and failures."""
    return states.groupBy("event_date").agg(*[F.sum(c).alias(c) for c in ("rows", "success", "failed")])
