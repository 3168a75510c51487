"""Per-group quantiles with ``percentile_cont`` semantics that scale with hot groups.

Spark's exact ``percentile`` keeps a value->count map per group and merges it in one task,
which is unbounded when one group holds a large share of the rows. The exact method here
never gathers a whole group. The same steps serve groups of every size:

1. one aggregation gives, per group and value column, the count, the extremes and
   ``percentile_approx`` bands around the target quantile (the sketch merges map-side; its
   rank error is at most n/accuracy). Bands reach 3/accuracy, 1 % or 10 % of the group to
   either side; a group takes the narrowest that exceeds the sketch's error by two ranks, and
   a group of some 20 values its whole range;
2. a second pass over the rows counts, map-side, the rows below the band and each distinct
   value inside it. What is shuffled is one row a task for each distinct value in the band, so
   ties, however many, are one row;
3. the distinct values in the band (about 6n/accuracy of n distinct ones; at most
   accuracy/50 in a group of fewer than ``accuracy`` values) are put in order within their
   group and their counts added up; the two ranks around ``q * (n - 1)`` give the interpolated
   exact value. A band that missed them, which the sketch's error bound rules out, would end
   the job rather than give a wrong value.

``method="approx"`` stops after the sketch.
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

DEFAULT_ACCURACY = 10000


def group_quantile(df: DataFrame, keys: list[str], values: list[str], q: float,
                   method: str = "exact", accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Return ``keys + [q_<value> ...]``: the q-quantile of each value column per group
    (NULLs ignored; NULL when a group has no value)."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be within [0, 1]")
    if method not in ("exact", "approx"):
        raise ValueError("method must be 'exact' or 'approx'")
    # bands of several widths; a group takes the narrowest that surely holds its ranks
    margins = [m for m in (3.0 / accuracy, 0.01, 0.1) if 3.0 / accuracy <= m < 1]
    at = q if method == "approx" else [p for m in margins for p in (max(0.0, q - m), min(1.0, q + m))] or [0.0, 1.0]
    wide = df.groupBy(*keys).agg(*[agg for v in values for agg in (
        F.count(v).alias(f"n_{v}"), F.min(v).alias(f"lo_{v}"), F.max(v).alias(f"hi_{v}"),
        F.percentile_approx(v, at, accuracy).alias(f"b_{v}"))])
    if method == "approx":
        return wide.select(*keys, *[F.col(f"b_{v}").alias(f"q_{v}") for v in values])

    # one row a group, stored: its size then decides whether it is broadcast to the rows, so that
    # these are not shuffled by a hot group, and both uses below read it
    path = scratch_path(df.sparkSession, f"quantile-bands-{uuid.uuid4().hex}")
    wide.write.parquet(path)
    wide = df.sparkSession.read.schema(wide.schema).parquet(path)

    def end(v, side):
        """An end of the band of a column: 2 ranks beyond the sketch's error, or the extreme."""
        n, out = F.col(f"n_{v}"), F.col(f"{('lo', 'hi')[side]}_{v}")
        for k, m in reversed(list(enumerate(margins))):
            out = F.when(F.lit(m) * n >= n / F.lit(float(accuracy)) + 2, F.col(f"b_{v}")[2 * k + side]).otherwise(out)
        return out.cast("double")

    bands = wide.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for v in values for c in (
        end(v, 0).alias(f"_lo_{v}"), end(v, 1).alias(f"_hi_{v}"))])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    # one entry a row and column: null for a value below the band, none above it
    entries = [F.when(F.col(v) <= F.col(f"_hi_{v}"), F.struct(
        F.lit(v).alias("metric"), F.when(F.col(v) >= F.col(f"_lo_{v}"), F.col(v).cast("double")).alias("v"))) for v in values]
    counted = (df.select(*keys, *values).join(bands, same)
               .select(*keys, F.explode(F.array(*entries)).alias("e")).filter("e is not null")
               .groupBy(*keys, "e.metric", "e.v").agg(F.count("*").alias("c")))
    gk = [*keys, "metric"]
    position = F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(f"n_{v}") for v in values]))
    sizes = wide.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.explode(position).alias("_m", "n"))
    w = Window.partitionBy(*gk).orderBy(F.asc_nulls_first("v"))
    ranked = (counted.withColumn("upto", F.sum("c").over(w))
              .join(sizes, same & (F.col("metric") == F.col("_m")))
              .withColumn("pos", (F.col("n") - 1).cast("double") * F.lit(q))
              .withColumn("r_lo", F.floor("pos").cast("long")).withColumn("r_hi", F.ceil("pos").cast("long")))

    def holds(rank):
        return (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("c") <= F.col(rank))

    picked = (ranked.filter(holds("r_lo") | holds("r_hi")).groupBy(*gk, "pos", "r_lo", "r_hi")
              .agg(F.max(F.when(holds("r_lo"), F.col("v"))).alias("v_lo"), F.max(F.when(holds("r_hi"), F.col("v"))).alias("v_hi")))
    missed = F.raise_error(F.lit("a quantile lies outside its band")).cast("double")
    value = (F.when(F.col("v_lo").isNull() | F.col("v_hi").isNull(), missed)
             .when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo"))
             .otherwise((F.col("r_hi") - F.col("pos")) * F.col("v_lo")
                        + (F.col("pos") - F.col("r_lo")) * F.col("v_hi")))
    return _widen(picked.select(*gk, value.alias("qv")), keys, values)


def _widen(res: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long (keys, metric, qv) -> wide (keys, q_<metric>...) with a fixed column list."""
    aggs = [F.max(F.when(F.col("metric") == v, F.col("qv"))).alias(f"q_{v}") for v in values]
    return res.groupBy(*keys).agg(*aggs)
