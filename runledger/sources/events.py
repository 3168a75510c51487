"""Event sources (S1-S3) and the ingest projections.

Landed events are JSON lines. The envelope is read with a fixed schema; the free-form
payloads (``trace``, ``metadata``) are kept as raw JSON text and read with
``get_json_object``, so a value that is sometimes a number and sometimes a string parses
the same way.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import parse_tag, task_fact_columns, trace_members, variant_text

WEBLOG_EVENTS = ("started", "process_submitted", "process_started", "process_completed",
                 "error", "completed")

# Landed weblog envelope. camelCase names as sent by the workflow engine.
WEBLOG_SCHEMA = T.StructType([
    T.StructField("runId", T.StringType()),
    T.StructField("runName", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("utcTime", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("trace", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# Run-lifecycle events: one superset struct for the eight variants (fixed values).
RUN_EVENT_TYPES = ("wrapper_started", "pre_nextflow", "wrapper_exited", "heartbeat",
                   "slurm_state", "workflow_oncomplete", "workflow_onerror", "wrapper_log")
RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("utc_time", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("slurm_job_id", T.StringType()),
    T.StructField("wait_seconds", T.LongType()),
    T.StructField("exit_code", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("state", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("exit_status", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("stream", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def _to_utc(c):
    """Timestamps may arrive with or without a zone; zone-less values are UTC, junk is NULL."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def read_weblog(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed weblog JSON -> (run_id, run_name, event, utc_time, metadata, trace).

    Payload objects are read into string columns, which keeps them as JSON text.
    Rows that are not JSON, lack runName/event, or have a time that is none, go to
    ``valid = false``."""
    reader = spark.readStream if stream else spark.read
    raw = (reader.schema(WEBLOG_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return weblog_envelope(raw)


def weblog_envelope(raw: DataFrame) -> DataFrame:
    valid = (F.col("_corrupt_record").isNull() & F.col("runName").isNotNull()
             & F.col("event").isNotNull()
             & (F.col("utcTime").isNull() | _to_utc(F.col("utcTime")).isNotNull()))
    return raw.select(
        F.col("runId").alias("run_id"), F.col("runName").alias("run_name"), "event",
        _to_utc(F.col("utcTime")).alias("utc_time"),
        strip_blobs(F.col("metadata")).alias("metadata"), F.col("trace"),
        valid.alias("valid"))


def strip_blobs(metadata):
    """Drop workflow.start/complete.offset.availableZoneIds from run metadata text.

    The blob is a long list of zone names. It is cut from the JSON text with one of the
    commas beside it, so the rest of the document stays byte-identical; documents without it
    at that place are left alone. The pattern reads strings whole, so brackets in them do
    not end the list."""
    blob = r'"availableZoneIds"\s*:\s*\[(?:[^\]"]|"(?:\\.|[^"\\])*")*\]'
    there = F.coalesce(*[F.get_json_object(metadata, f"$.workflow.{k}.offset.availableZoneIds") for k in ("start", "complete")])
    cut = F.regexp_replace(F.regexp_replace(metadata, blob + r"\s*,\s*", ""), r",?\s*" + blob, "")
    return F.when(there.isNotNull(), cut).otherwise(metadata)


def read_run_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """S3: run-lifecycle events with per-variant validation.

    Returns all rows with ``valid`` and ``reject_reason``; split with
    ``split_valid``. Required fields: wrapper_exited.exit_code, slurm_state.state,
    workflow_oncomplete.success, wrapper_log.stream + text."""
    reader = spark.readStream if stream else spark.read
    raw = (reader.schema(RUN_EVENT_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return validate_run_events(raw)


def validate_run_events(raw: DataFrame) -> DataFrame:
    t = F.col("type")
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed"))
              .when(~t.isin(*RUN_EVENT_TYPES) | t.isNull(), F.lit("unknown type"))
              .when(F.col("utc_time").isNull(), F.lit("missing utc_time"))
              .when(_to_utc(F.col("utc_time")).isNull(), F.lit("bad utc_time"))
              .when((t == "wrapper_exited") & F.col("exit_code").isNull(), F.lit("missing exit_code"))
              .when((t == "slurm_state") & F.col("state").isNull(), F.lit("missing state"))
              .when((t == "workflow_oncomplete") & F.col("success").isNull(), F.lit("missing success"))
              .when((t == "wrapper_log") & (F.col("stream").isNull() | F.col("text").isNull()
                                            | ~F.col("stream").isin("stdout", "stderr")),
                    F.lit("missing stream/text")))
    return (raw.withColumn("reject_reason", reason)
            .withColumn("utc_time", _to_utc(F.col("utc_time")))
            .withColumn("valid", F.col("reject_reason").isNull()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine frame."""
    return df.filter(F.col("valid")), df.filter(~F.col("valid"))


def enrich_events(events: DataFrame, runs: DataFrame) -> DataFrame:
    """J18 + F2: event log rows with sample id from the trace tag and workflow id/version
    looked up by run name (NULL for an unknown run).

    The run registry is far smaller than the event log; AQE broadcasts it when its runtime
    size is under the broadcast threshold and sort-merges otherwise."""
    wf = runs.select("run_name", "workflow_id", "workflow_version")
    return (events
            .withColumn("sample_id", parse_tag(F.get_json_object("trace", "$['tag']")))
            .join(wf, "run_name", "left"))


def to_task_executions(telemetry: DataFrame, strict: bool = False) -> DataFrame:
    """F1 (U17 with ``strict``): flatten ``process_completed`` events into the typed task
    fact table.

    Rows whose process is missing or blank are not valid facts (process is NOT NULL);
    use ``quarantined_tasks`` to keep them instead of failing the batch."""
    done = telemetry.filter((F.col("event") == "process_completed") & F.col("trace").isNotNull())
    envelope = ["id", "run_name", "run_id", "sample_id", "workflow_id", "workflow_version", "utc_time"]
    # the trace is parsed once for a row, in a projection of its own
    done = done.select(*envelope, trace_members("trace").alias("trace"))
    return _task_facts(done, Column.getField, strict)


def _task_facts(done: DataFrame, read, strict: bool = False) -> DataFrame:
    flat = done.select(
        F.col("id").alias("telemetry_id"), "run_name", "run_id", "sample_id", "workflow_id",
        "workflow_version", "utc_time", *task_fact_columns("trace", strict, read))
    return flat.filter(F.col("process").isNotNull())


PAYLOADS = ("metadata", "trace")


def to_variant_log(telemetry: DataFrame) -> DataFrame:
    """The event log with its payloads as VARIANT, parsed once when it is written: readers take
    typed members by path (``try_variant_get``) without parsing JSON text again. A payload that
    is no JSON, or an object that repeats a key, stays as text in ``<payload>_text``."""
    out = telemetry
    for c in PAYLOADS:
        v = F.try_parse_json(c)
        out = out.withColumn(f"{c}_text", F.when(v.isNull(), F.col(c))).withColumn(c, F.try_parse_json(c))
    return out


def variant_task_executions(log: DataFrame) -> DataFrame:
    """F1 from a log of ``to_variant_log``; its traces that stayed text are flattened as text."""
    done = log.filter(F.col("event") == "process_completed")
    text = done.filter(F.col("trace_text").isNotNull()).withColumn("trace", F.col("trace_text"))
    return _task_facts(done.filter(F.col("trace").isNotNull()), variant_text).unionByName(to_task_executions(text))


def quarantined_tasks(telemetry: DataFrame) -> DataFrame:
    done = telemetry.filter((F.col("event") == "process_completed") & F.col("trace").isNotNull())
    proc = F.nullif(F.get_json_object("trace", "$['process']"), F.lit(""))
    return done.filter(proc.isNull())


def run_events_to_log(run_events: DataFrame) -> DataFrame:
    """Run events in the shape of the weblog log (event = 'run_' + type, payload in
    metadata), so both producers append to one event log with ``unionByName``."""
    payload_cols = [c for c in run_events.columns
                    if c not in ("run_name", "type", "utc_time", "valid", "reject_reason",
                                 "_corrupt_record")]
    return run_events.select(
        F.lit(None).cast("string").alias("run_id"), "run_name",
        F.concat(F.lit("run_"), F.col("type")).alias("event"), "utc_time",
        F.to_json(F.struct(*payload_cols)).alias("metadata"),
        F.lit(None).cast("string").alias("trace"))
