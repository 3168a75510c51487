"""The outputs ETL as a stream over landed completion records.

Producers land one record for each completed job. Each tick starts the stream with
``availableNow``: its micro-batches add the new records to the backlog table (one directory a
batch, so a replayed batch replaces itself), then the rule A28 looks at all completions without
a watermark row and, if enough wait or one waits too long, the oldest are ingested. A tick
without new records still looks at the backlog. A tick that crashed is simply run again: a
sample counts as ingested only by its watermark row, which is written last.
"""
from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import etl as E
from ..sources import lake

COMPLETIONS = "sample_id string, workflow_id string, workflow_version string, completed_at timestamp_ntz"


def completions(spark: SparkSession, backlog: str) -> DataFrame:
    """All completion records taken in so far as completed jobs; the first record of a job counts."""
    try:
        rows = spark.read.schema(COMPLETIONS + ", batch_id long").parquet(backlog)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], COMPLETIONS)
    return (rows.groupBy(*E.KEYS).agg(F.min("completed_at").alias("completed_at"))
            .withColumn("status", F.lit("completed")))


def tick(spark: SparkSession, landing: str, state: str, base: str, lake_base: str, workflow: str, version: str,
         as_of: dt.datetime, labels: DataFrame | None = None, specs=None, wave: int = E.WAVE, stage=None, **rule) -> dict:
    """One tick: take in the completion records that landed since the last one, then ingest the
    next batch if the rule (``etl.tick_decision``) says so.

    ``landing``: folder of Parquet records; ``state``: folder of the stream's checkpoint and the
    backlog. ``wave`` and ``stage`` are those of ``etl.ingest_waves``. Returns the decision row and, after an
    ingest, its result."""
    def take_in(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/backlog/batch_id={batch_id}")

    query = (spark.readStream.schema(COMPLETIONS).parquet(landing).writeStream.foreachBatch(take_in)
             .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    lake.ensure_schema(spark, lake_base)
    jobs = completions(spark, f"{state}/backlog")
    done = lake.watermark_keys(lake.read_watermark(spark, lake_base))
    decision = E.tick_decision(E.backlog(jobs, done, workflow, version, as_of), **rule).first()
    out = {"decision": decision}
    if decision["ingest"]:
        if decision["batch_size"] < decision["backlog"]:
            keys = E.pending_queue(jobs, done, workflow, version, decision["batch_size"])
        else:                                         # all of it: no order needed
            keys = E.not_ingested(jobs, done, workflow, version)
        out |= E.ingest_waves(spark, keys.select(*E.KEYS), base, lake_base, workflow, version, labels, as_of, specs=specs,
                              wave=wave, stage=stage)
    return out
