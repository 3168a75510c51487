"""The published-outputs ETL as Spark jobs.

One ingest handles a whole batch of samples: keys -> paths (no listing) -> one distributed
fetch -> publish gate by semi-join -> per-spec parse plans -> one append per table -> the
watermark last. Parallelism is the number of files, not one sample at a time.
"""
from __future__ import annotations

import contextlib
import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import lake
from ..sources.outputs import fetch_outputs, output_paths, parse_tables, published, specs_for

DEFAULT_THRESHOLD = 500
DEFAULT_MAX_AGE_HOURS = 24
DEFAULT_BATCH = 1000
WAVE = 200_000              # samples of a batch that are ingested at a time
KEYS = ["sample_id", "workflow_id", "workflow_version"]


def completed_jobs(jobs: DataFrame, workflow_id: str, version: str) -> DataFrame:
    return jobs.filter((F.col("status") == "completed") & (F.col("workflow_id") == workflow_id)
                       & (F.col("workflow_version") == version))


def not_ingested(jobs: DataFrame, watermark: DataFrame, workflow_id: str, version: str) -> DataFrame:
    """Completed jobs of a version with no watermark row."""
    wm = watermark.select(*KEYS)
    return completed_jobs(jobs, workflow_id, version).join(wm, KEYS, "left_anti")


def backlog(jobs: DataFrame, watermark: DataFrame, workflow_id: str, version: str,
            as_of: dt.datetime) -> DataFrame:
    """Completed-not-ingested count and the age in hours of the oldest completion."""
    pend = not_ingested(jobs, watermark, workflow_id, version)
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz").cast("timestamp"))
           - F.unix_timestamp(F.min("completed_at").cast("timestamp"))) / 3600.0
    return pend.agg(F.count(F.lit(1)).alias("backlog"), F.min("completed_at").alias("oldest_completed_at"),
                    age.alias("oldest_age_hours"))


def tick_decision(backlog_df: DataFrame, threshold: int = DEFAULT_THRESHOLD,
                  max_age_hours: float = DEFAULT_MAX_AGE_HOURS, batch: int | None = DEFAULT_BATCH) -> DataFrame:
    """Ingest iff backlog >= threshold, or backlog > 0 and the oldest waited long enough.
    ``batch=None`` takes the whole backlog, so that it cannot grow from tick to tick."""
    go = (F.col("backlog") >= threshold) | ((F.col("backlog") > 0) & (F.col("oldest_age_hours") >= max_age_hours))
    reason = (F.when(F.col("backlog") >= threshold, F.lit("threshold"))
              .when(go, F.lit("age")).otherwise(F.lit("wait")))
    return backlog_df.select("*", go.alias("ingest"), reason.alias("reason"),
                             F.when(go, F.col("backlog") if batch is None else F.least(F.col("backlog"), F.lit(batch))).otherwise(0).alias("batch_size"))


def pending_queue(jobs: DataFrame, watermark: DataFrame, workflow_id: str, version: str,
                  limit: int = DEFAULT_BATCH) -> DataFrame:
    """The oldest ``limit`` completed-not-ingested samples (the next batch)."""
    return (not_ingested(jobs, watermark, workflow_id, version)
            .orderBy(F.asc_nulls_last("completed_at"), F.asc("sample_id")).limit(limit)
            .select(*KEYS, "completed_at"))


def study_labels(collections: DataFrame, members: DataFrame) -> DataFrame:
    """J19 + W3: one study label per sample - a 'study' collection first, then by id."""
    j = members.join(collections.select("collection_id", "type"), "collection_id")
    w = Window.partitionBy("sample_id").orderBy(F.desc_nulls_last(F.col("type") == "study"),
                                                F.asc("collection_id"))
    return (j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("sample_id", F.col("collection_id").alias("study_name")))


def parse_batch(spark: SparkSession, keys: DataFrame, base: str, workflow: str, version: str,
                labels: DataFrame | None = None, include_deferred: bool = False, specs=None
                ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Parse one batch without writing (A30 dry run): (rows per table, unpublished keys).

    Common columns (G3): sample, study label, run ids from the sample's qc manifest,
    workflow, version and the branch as data_type."""
    specs = specs or specs_for(workflow, version)
    ready, skipped = published(keys, base)
    # fetched once: every table's parse plan reads the same file rows
    files = fetch_outputs(output_paths(ready, base, specs, include_deferred)).checkpoint()
    # a sample with a file that could not be read, or a torn manifest, is left for the next tick, not marked ingested
    torn = F.col("path").endswith("/manifest.json") & F.col("text").isNotNull() & F.get_json_object("text", "$").isNull()
    failed = files.filter(F.col("status").startswith("error") | torn).select(*KEYS).distinct()
    files = files.join(failed, KEYS, "left_anti")
    skipped = skipped.unionByName(ready.join(failed, KEYS, "left_semi"))
    tables = parse_tables(files, [s for s in specs if include_deferred or not s.defer])
    run_ids = tables["qc_metrics"].select(*KEYS, "run_ids") if "qc_metrics" in tables else None
    out = {}
    for name, rows in tables.items():
        r = rows.withColumnRenamed("branch", "data_type")
        if run_ids is not None and name != "qc_metrics":
            r = r.join(run_ids, KEYS, "left")
        if labels is not None:
            r = r.join(labels, "sample_id", "left")
        out[name] = (r.withColumnRenamed("workflow_id", "workflow")
                     .withColumnRenamed("workflow_version", "version"))
    return out, skipped


def ingest_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per (table, sample)."""
    frames = [rows.groupBy("sample_id", "workflow", "version").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("table", F.lit(name)) for name, rows in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ingest(spark: SparkSession, keys: DataFrame, base: str, lake_base: str, workflow: str,
           version: str, labels: DataFrame | None = None, as_of: dt.datetime | None = None,
           include_deferred: bool = False, specs=None) -> dict:
    """K2-K4 + A29: parse a batch, append every table under one ingest id, then append the
    watermark. Parsed tables are materialised once (checkpointed into the shared checkpoint
    folder) so the watermark and the report agree without re-reading the sources.

    ``written`` holds the rows of each table as the writes themselves observed them; the
    watermark is only written if its counts agree with them."""
    ingest_id = uuid.uuid4().hex
    tables, skipped = parse_batch(spark, keys, base, workflow, version, labels, include_deferred, specs)
    tables = {k: v.checkpoint() for k, v in tables.items()}
    written = lake.write_tables(tables, lake_base, ingest_id)
    counts = ingest_counts(tables).checkpoint()
    total = {r["table"]: r["n"] for r in counts.groupBy("table").agg(F.sum("n").alias("n")).collect()}
    if any(total.get(t, 0) != n for t, n in written.items()):
        raise RuntimeError(f"rows written {written} differ from rows counted {total}")
    wm = lake.mark_ingested(counts, lake_base, ingest_id, as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    return {"counts": counts, "skipped_unpublished": skipped, "watermark": wm, "written": written}


def ingest_waves(spark: SparkSession, keys: DataFrame, base: str, lake_base: str, workflow: str, version: str,
                 labels: DataFrame | None = None, as_of: dt.datetime | None = None, include_deferred: bool = False,
                 specs=None, wave: int = WAVE, stage=None) -> dict:
    """``ingest`` of a batch of any length, about ``wave`` samples (by a hash of their id) after the other, each
    wave with an ingest id and watermark rows of its own. The result is that of the whole batch.

    ``stage(keys)`` is a context in which the published files of these samples lie under ``base``, for sources
    that are brought near for an ingest and let go after it."""
    keys = keys.checkpoint()                          # the queue as it is before the first wave is marked
    waves = -(-keys.count() // wave) or 1
    out: dict = {}
    for k in range(waves):
        mine = keys.filter(F.pmod(F.xxhash64("sample_id"), F.lit(waves)) == k)
        with stage(mine) if stage else contextlib.nullcontext():
            part = ingest(spark, mine, base, lake_base, workflow, version, labels, as_of, include_deferred, specs)
            part["skipped_unpublished"] = part["skipped_unpublished"].checkpoint()
        for name, new in part.items():
            if name == "written":
                out[name] = {t: n + out.get(name, {}).get(t, 0) for t, n in new.items()}
            else:
                out[name] = out[name].unionByName(new) if name in out else new
    return out


def etl_status(jobs: DataFrame, watermark: DataFrame, workflow_id: str, version: str) -> DataFrame:
    """Samples ingested and backlog for a version."""
    done = watermark.filter((F.col("workflow_id") == workflow_id) & (F.col("workflow_version") == version))
    pend = not_ingested(jobs, watermark, workflow_id, version)
    return (done.agg(F.count(F.lit(1)).alias("ingested"))
            .select("ingested", pend.agg(F.count(F.lit(1))).scalar().alias("backlog")))


def artifact_state(notifications: DataFrame) -> DataFrame:
    """Object-store notifications -> current artifact rows.

    The latest create per key gives size/etag/created_at; a delete after it sets
    ``archived_at``; a create after a delete revives the artifact. Out-of-order delivery
    is resolved by event time, then delivery sequence."""
    ev = F.col("event")
    order = F.struct("event_time", "seq")
    g = notifications.groupBy("key").agg(
        F.max_by(F.struct("size", "etag", "event_time"), F.when(ev == "create", order)).alias("c"),
        F.max(F.when(ev == "create", order)).alias("last_create"),
        F.max(F.when(ev == "delete", order)).alias("last_delete"))
    archived = F.col("last_delete").isNotNull() & (
        F.col("last_create").isNull() | (F.col("last_delete") > F.col("last_create")))
    return g.select("key", F.col("c.size").alias("size"), F.col("c.etag").alias("etag"),
                    F.col("c.event_time").alias("created_at"),
                    F.when(archived, F.col("last_delete.event_time")).alias("archived_at"))


def published_manifest(jobs: DataFrame, samples: DataFrame, workflows: DataFrame, base: str,
                       workflow_id: str | None = None, version: str | None = None,
                       since=None, labels: DataFrame | None = None) -> DataFrame:
    """Completed jobs x samples x workflows -> the published-sample manifest with its
    publish prefix; ``since`` keeps completions at or after it. The next cursor is
    ``max(completed_at)`` of the result (``next_since``)."""
    j = jobs.filter(F.col("status") == "completed")
    if workflow_id:
        j = j.filter(F.col("workflow_id") == workflow_id)
    if version:
        j = j.filter(F.col("workflow_version") == version)
    if since is not None:
        j = j.filter(F.col("completed_at") >= F.lit(since).cast("timestamp_ntz"))
    wf = workflows.select("workflow_id", F.col("version").alias("workflow_version"))
    out = (j.join(wf, ["workflow_id", "workflow_version"], "left_semi")
           .join(samples.select("sample_id", F.col("ncbi_accession").alias("run_ids")), "sample_id", "left"))
    if labels is not None:
        out = out.join(labels, "sample_id", "left")
    from ..functions.display import publish_prefix
    return out.select("sample_id", "run_ids", *(["study_name"] if labels is not None else []),
                      "workflow_id", "workflow_version",
                      publish_prefix(base, "workflow_id", "workflow_version", "sample_id").alias("publish_prefix"),
                      "completed_at")
