"""Registered queries for state tables, predicates, display columns and landed files, each
with oracle SQL written from the rule it checks."""
from __future__ import annotations

import contextlib
import datetime as dt
import gzip
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import display as D
from ..functions import parse as P
from ..functions.identity import is_run_name
from ..operators import collections as C
from ..operators import filters as FL
from ..operators import registry as G
from ..operators import state as ST
from ..operators.filters import MetricFilter
from ..operators.keyed import KeyedTable
from ..sources import events as EV
from ..sources import files as FS
from ..sources import lake
from ..sources import outputs as O
from ..sources.logsource import task_logs
from ..session import default_root, scratch_path
from .registry import r2, register

NOW = dt.datetime(2026, 1, 1)


def _scratch(d, name: str) -> str:
    return scratch_path(d.spark, f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------- display and parsing

@register("display_tasks", ("task_executions",), """
SELECT telemetry_id, split_part(task_hash, '/', 1) || '/' || left(split_part(task_hash, '/', 2), 6) AS short_hash,
  CASE WHEN realtime_ms < 1000 THEN round(realtime_ms)::BIGINT || 'ms'
       WHEN realtime_ms < 60000 THEN printf('%.1fs', realtime_ms / 1000)
       WHEN realtime_ms < 3600000 THEN floor(realtime_ms / 60000)::BIGINT || 'm ' || floor((realtime_ms % 60000) / 1000)::BIGINT || 's'
       ELSE floor(realtime_ms / 3600000)::BIGINT || 'h ' || floor((realtime_ms % 3600000) / 60000)::BIGINT || 'm' END AS duration,
  CASE coalesce(exit_code, 'null') WHEN '137' THEN 'OOM kill (SIGKILL)' WHEN '1' THEN 'Generic error'
       WHEN '2' THEN 'Misuse / config' WHEN '134' THEN 'Abort (SIGABRT)' WHEN 'null' THEN 'Signal / unknown' ELSE '' END AS exit_text
FROM task_executions
""")
def q_display_tasks(d):
    """F22, F34, F43 over all task facts."""
    return d.task_executions.select("telemetry_id", D.short_task_hash("task_hash").alias("short_hash"),
                                    D.fmt_duration("realtime_ms").alias("duration"), D.exit_label("exit_code").alias("exit_text"))


@register("severity_by_process", ("task_executions",), f"""
, f AS (SELECT process, count(*) AS n, count(*) FILTER (WHERE status IN ('FAILED', 'ABORTED')) AS bad FROM task_executions GROUP BY 1),
p AS (SELECT process, bad, {r2("100.0 * bad / n")} AS pct FROM f)
SELECT process, CASE WHEN pct > 6 THEN 'high' WHEN pct > 3 THEN 'elevated' ELSE 'normal' END AS severity,
  CASE WHEN pct > 6 THEN 'high' WHEN pct > 4 THEN 'elevated' ELSE 'normal' END AS overview, 100 - pct AS success_pct,
  bad / greatest((SELECT max(bad) FROM p), 1) AS bar
FROM p
""")
def q_severity_by_process(d):
    """severity, success share and bar length per process."""
    n, bad = F.count("*"), F.count_if(D.is_failed())
    p = d.task_executions.groupBy("process").agg(bad.alias("failures"), D.ratio_pct(bad, n).alias("failure_pct"))
    top = p.agg(F.max("failures")).scalar()
    return p.select("process", D.severity().alias("severity"), D.severity(overview=True).alias("overview"),
                    D.success_pct().alias("success_pct"), D.bar_share(max_failures=top).alias("bar"))


@register("run_display", ("workflow_runs",), """
SELECT run_name, coalesce(if(length(run_id) % 2 = 0, run_id, NULL), 'pre-weblog:' || run_name) AS shown_id,
  if(started_at >= submitted_at, epoch(started_at - submitted_at)::BIGINT, NULL) AS wait_s,
  regexp_full_match('r' || substr(md5(run_name), 1, 8) || '-0000-4000-8000-' || substr(md5(run_name), 9, 12),
    'r[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS named, false AS short_named
FROM workflow_runs
""")
def q_run_display(d):
    """shown run id, queue wait from text timestamps, wrapper run names."""
    h = F.md5("run_name")
    name = F.concat(F.lit("r"), F.substring(h, 1, 8), F.lit("-0000-4000-8000-"), F.substring(h, 9, 12))
    return d.workflow_runs.select(
        "run_name", D.run_id_or_sentinel(F.when(F.length("run_id") % 2 == 0, F.col("run_id")), "run_name").alias("shown_id"),
        D.queue_wait(F.col("submitted_at").cast("string"), F.col("started_at").cast("string")).alias("wait_s"),
        is_run_name(name).alias("named"), is_run_name("run_name").alias("short_named"))


@register("log_tails", ("task_logs",), """
SELECT run_name, task_hash, log_type, right(regexp_replace(content, '[^ -~]', '', 'g'), 200) AS tail FROM task_logs
""")
def q_log_tails(d):
    """the last 200 bytes of every task log (ASCII part)."""
    ascii_text = F.regexp_replace("content", "[^ -~]", "")
    return d.task_logs.select("run_name", "task_hash", "log_type", D.tail_text(ascii_text, 200).alias("tail"))


@register("metadata_keys", ("samples",), """
SELECT sample_id, json_exists(metadata, '$.cohort') AS has_cohort, json_exists(metadata, '$.none') AS has_none,
  '{"subject":"' || (metadata ->> '$.subject') || '","segment":"' || (metadata ->> '$.segment') || '"}' AS without_cohort,
  '{"sample_id":"' || sample_id || '","biosample_id":"' || biosample_id || '"}' AS row_json
FROM samples
""")
def q_metadata_keys(d):
    """JSON member test and removal; a row as JSON without one column."""
    row = P.row_to_json_except(["sample_id", "ncbi_accession", "biosample_id"], "ncbi_accession")
    return d.samples.select("sample_id", P.json_has_key("metadata", "cohort").alias("has_cohort"),
                            P.json_has_key("metadata", "none").alias("has_none"),
                            P.json_drop_key("metadata", "cohort").alias("without_cohort"), row.alias("row_json"))


def _typed_metadata(d):
    """Samples whose metadata holds numbers, nested values, nulls and booleans."""
    return d.samples.select("sample_id", F.concat(
        F.lit('{"n": '), F.length("sample_id"), F.lit(', "cohort": "'), F.substring("sample_id", -1, 1),
        F.lit('", "o": {"k": [1, "x", null], "id": "'), "sample_id", F.lit('"}, "z": null, "b": true, "f": 0.25}')).alias("metadata"))


@register("typed_metadata", ("samples",), """
SELECT sample_id, '{"n":' || length(sample_id) || ',"o":{"id":"' || sample_id || '","k":[1,"x",null]},"z":null,"b":true,"f":0.25}' AS metadata,
  right(sample_id, 1) AS collection_id, true AS has_z
FROM samples
""")
def q_typed_metadata(d):
    """The cohort moves from the metadata to memberships; numbers, nested values and nulls
    stay what they are."""
    typed = _typed_metadata(d)
    back = G.backfill_collections(typed)
    return back["samples"].join(back["members"], "sample_id").select(
        "sample_id", "metadata", "collection_id", P.json_has_key("metadata", "z").alias("has_z"))


@register("variant_log", ("weblog",), """
SELECT id, run_name, trace ->> '$.process' AS process, TRY_CAST(trace ->> '$.attempt' AS INTEGER) AS attempt,
  TRY_CAST(trace ->> '$.memory' AS BIGINT) AS memory, metadata ->> '$.workflow.revision' AS revision
FROM weblog
""")
def q_variant_log(d):
    """the weblog stored with VARIANT payloads in Parquet and read back by typed paths."""
    path = _scratch(d, "variant-log")
    EV.to_variant_log(d.weblog).write.parquet(path)
    get = lambda c, key, kind: F.try_variant_get(c, f"$.{key}", kind)
    return d.spark.read.parquet(path).select(
        "id", "run_name", get("trace", "process", "string").alias("process"), get("trace", "attempt", "int").alias("attempt"),
        get("trace", "memory", "bigint").alias("memory"), get("metadata", "workflow.revision", "string").alias("revision"))


# ------------------------------------------------------------------------------ predicates

@register("filtered_tasks", ("task_executions",), """
SELECT telemetry_id FROM task_executions
WHERE workflow_id = 'shotgun' AND workflow_version = '1-URGENT' AND run_name = 'r7'
""")
def q_filtered_tasks(d):
    """Key filters of the metric reports."""
    flt = MetricFilter(all_time=True, workflow_id="shotgun", workflow_version="1-URGENT", run_name="r7")
    return flt.apply(d.task_executions).select("telemetry_id")


@register("samples_with_accession", ("samples",), """
SELECT sample_id, 'exact' AS match FROM samples
WHERE list_contains(list_transform(string_split(ncbi_accession, ';'), lambda x: trim(x)), 'SRR1000020')
UNION ALL SELECT sample_id, 'substring' FROM samples WHERE contains(ncbi_accession, 'SRR10000')
""")
def q_samples_with_accession(d):
    """Exact token match and substring match."""
    exact = FL.contains_accession(d.samples, " SRR1000020 ").select("sample_id", F.lit("exact").alias("match"))
    part = FL.contains_accession(d.samples, "SRR10000", match="substring").select("sample_id", F.lit("substring").alias("match"))
    return exact.unionByName(part)


@register("registry_lookups", ("workflow_runs", "workflows", "task_logs", "jobs"), """
SELECT 'runs' AS what, run_name AS found FROM workflow_runs WHERE status = 'failed' AND workflow_id = 'shotgun'
UNION ALL SELECT 'versions', workflow_id || '/' || version FROM workflows WHERE status = 'paused'
UNION ALL SELECT 'logs', log_type FROM task_logs WHERE run_name = 'r7' AND task_hash = 'run/0'
UNION ALL SELECT 'job', CAST(job_id AS VARCHAR) FROM jobs WHERE sample_id = 'S7' AND workflow_id = 'shotgun'
UNION ALL SELECT 'active', version FROM workflows WHERE workflow_id = 'shotgun' AND status = 'active'
""")
def q_registry_lookups(d):
    """Run, version, log and point lookups."""
    found = [("runs", FL.run_filters(d.workflow_runs, "failed", "shotgun"), F.col("run_name")),
             ("versions", FL.workflow_list(d.workflows, "paused"), F.concat_ws("/", "workflow_id", "version")),
             ("logs", FL.logs_by_key(d.task_logs, "r7", "run/0"), F.col("log_type")),
             ("job", FL.lookup(d.jobs, sample_id="S7", workflow_id="shotgun"), F.col("job_id").cast("string")),
             ("active", FL.active_version(d.workflows, "shotgun"), F.col("version"))]
    out = None
    for what, df, c in found:
        part = df.select(F.lit(what).alias("what"), c.alias("found"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------- state tables

def _incoming_samples(d):
    return d.samples.filter("sample_id like '%3'").select(
        F.concat(F.lit("N"), "sample_id").alias("sample_id"), F.lit("").alias("ncbi_accession"), "biosample_id",
        F.lit('{"new": 1}').alias("metadata")).unionByName(d.samples.filter("sample_id like '%7'").select(
            "sample_id", F.lit(" ").alias("ncbi_accession"), F.lit("SAMX").alias("biosample_id"), F.lit('{"upd": 1}').alias("metadata")))


@register("register_samples", ("samples",), """
SELECT sample_id, ncbi_accession, if(sample_id LIKE '%7', 'SAMX', biosample_id) AS biosample_id,
  if(sample_id LIKE '%7', '{"upd": 1}', metadata) AS metadata FROM samples
UNION ALL SELECT 'N' || sample_id, NULL, biosample_id, '{"new": 1}' FROM samples WHERE sample_id LIKE '%3'
""")
def q_register_samples(d):
    """Sample upsert - metadata replaced, blank accessions keep the stored ones."""
    return G.register_samples(d.samples.drop("created_at"), _incoming_samples(d))


@register("bucketed_registration", ("samples", "collection_samples"), """
, incoming AS (
  SELECT 'N' || sample_id AS sample_id, '{"new": 1}' AS metadata, biosample_id, 'fresh' AS collection_id
  FROM samples WHERE sample_id LIKE '%3'
  UNION ALL SELECT sample_id, '{"upd": 1}', 'SAMX', NULL FROM samples WHERE sample_id LIKE '%77'),
members AS (SELECT collection_id, sample_id FROM collection_samples
  UNION SELECT collection_id, sample_id FROM incoming WHERE collection_id IS NOT NULL),
stored AS (
  SELECT s.sample_id, s.ncbi_accession, coalesce(i.biosample_id, s.biosample_id) AS biosample_id,
         coalesce(i.metadata, s.metadata) AS metadata, i.sample_id IS NOT NULL AS registered
  FROM samples s LEFT JOIN incoming i ON i.sample_id = s.sample_id
  UNION ALL SELECT sample_id, NULL, biosample_id, metadata, true FROM incoming WHERE sample_id LIKE 'N%')
SELECT s.*, CASE WHEN registered THEN coalesce((SELECT string_agg(collection_id, ',' ORDER BY collection_id) FROM members m
                                               WHERE m.sample_id = s.sample_id), '') END AS collections
FROM stored s
""")
def q_bucketed_registration(d):
    """Samples registered into bucketed tables, twice (the second time changes nothing); the
    whole table, and the memberships that the registration returned."""
    root = _scratch(d, "bucketed")
    samples = KeyedTable(f"{root}/samples", ("sample_id",), 64)
    members = KeyedTable(f"{root}/members", ("collection_id", "sample_id"), 64, by=("sample_id",))
    samples.create(d.samples.drop("created_at"))
    members.create(d.collection_samples.select("collection_id", "sample_id").distinct())
    fresh = d.samples.filter("sample_id like '%3'").select(
        F.concat(F.lit("N"), "sample_id").alias("sample_id"), F.lit("").alias("ncbi_accession"), "biosample_id",
        F.lit('{"new": 1}').alias("metadata"), F.lit("fresh").alias("collection_id"))
    known = d.samples.filter("sample_id like '%77'").select(
        "sample_id", F.lit(None).cast("string").alias("ncbi_accession"), F.lit(" SAMX").alias("biosample_id"),
        F.lit('{"upd": 1}').alias("metadata"), F.lit(None).cast("string").alias("collection_id"))
    for _ in range(2):
        done = G.register_into(samples, members, fresh.unionByName(known))
    done = done.select("sample_id", F.array_join("collections", ",").alias("collections"))
    return (samples.read(d.spark).join(done, "sample_id", "left")
            .withColumn("registered", F.col("collections").isNotNull()))


@register("insert_ignore_samples", ("samples",), """
SELECT sample_id, metadata FROM samples UNION ALL SELECT 'N' || sample_id, '{"new": 1}' FROM samples WHERE sample_id LIKE '%3'
""")
def q_insert_ignore_samples(d):
    """Rows with unseen keys are added, the others left alone."""
    return ST.insert_ignore(d.samples.select("sample_id", "metadata"), _incoming_samples(d).select("sample_id", "metadata"), ["sample_id"])


@register("latest_job_per_sample", ("jobs",), """
SELECT sample_id, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY created_at DESC, job_id DESC) = 1
""")
def q_latest_job_per_sample(d):
    """The last row of each key."""
    return ST.latest_per_key(d.jobs, ["sample_id"], ["created_at", "job_id"]).select("sample_id", "job_id", "status")


@register("add_to_collection", ("collections", "collection_samples"), """
SELECT collection_id, sample_id FROM collection_samples
UNION SELECT upper(collection_id) || '-new', sample_id FROM collection_samples WHERE sample_id LIKE '%5'
""")
def q_add_to_collection(d):
    """U4: memberships after declaring new collections; repeats are no-ops."""
    new = d.collection_samples.filter("sample_id like '%5'").select(
        F.concat(F.upper("collection_id"), F.lit("-new")).alias("collection_id"), "sample_id")
    new = new.unionByName(new).unionByName(d.collection_samples.limit(0)).select(
        "collection_id", F.lit("manual").alias("source"), F.lit("group").alias("type"), F.lit(" ").alias("label"), "sample_id")
    _, members = G.add_to_collection(d.collections, d.collection_samples.distinct(), new, NOW)
    return members.select("collection_id", "sample_id")


@register("register_workflow", ("workflows",), """
SELECT workflow_id, version, if(status = 'active' AND workflow_id = 'shotgun', 'retired', status) AS status FROM workflows
UNION ALL VALUES ('shotgun', '9-A', 'retired'), ('shotgun', '9-B', 'active')
""")
def q_register_workflow(d):
    """Two new versions of one workflow - the newer is active, all others are not."""
    new = d.spark.createDataFrame([("shotgun", "9-A", 2, NOW), ("shotgun", "9-B", 2, NOW + dt.timedelta(days=1))],
                                  "workflow_id string, version string, max_retries int, created_at timestamp_ntz")
    out, _ = G.register_workflow(d.workflows, d.jobs, new)
    return out.select("workflow_id", "version", "status")


@register("one_active_version", ("workflows",), """
SELECT workflow_id, version, if(version = (SELECT max(version) FROM workflows), 'active', 'retired') AS status FROM workflows
""")
def q_one_active_version(d):
    """Of several active versions the newest stays."""
    return G.enforce_one_active(d.workflows.withColumn("status", F.lit("active"))).select("workflow_id", "version", "status")


@register("strict_backfill", ("weblog", "workflow_runs"), """
SELECT w.id AS telemetry_id, w.run_name, r.workflow_id, nullif(w.trace ->> '$.process', '') AS process,
  CAST(coalesce(nullif(w.trace ->> '$.attempt', ''), '1') AS INT) AS attempt, CAST(nullif(w.trace ->> '$.memory', '') AS DOUBLE) AS memory
FROM weblog w LEFT JOIN workflow_runs r USING (run_name) WHERE w.event = 'process_completed' AND w.trace IS NOT NULL
""")
def q_strict_backfill(d):
    """Facts rebuilt from the stored log with strict casts."""
    facts = EV.to_task_executions(EV.enrich_events(d.weblog, d.workflow_runs), strict=True)
    return facts.select("telemetry_id", "run_name", "workflow_id", "process", "attempt", F.col("requested_memory_bytes").alias("memory"))


@register("backfill_type", ("collections",), """
SELECT collection_id, CASE source WHEN 'country' THEN 'study' WHEN 'region' THEN 'project' ELSE type END AS type FROM collections
""")
def q_backfill_type(d):
    """Collection types from their sources."""
    known = d.collections.withColumn("source", F.when(F.col("source") == "country", "sra_study")
                                     .when(F.col("source") == "region", "bioproject").otherwise(F.col("source")))
    return G.backfill_type(known).select("collection_id", "type")


@register("submission_audit", ("run_reports",), """
, s AS (SELECT DISTINCT trim(source_accession) AS accession FROM run_reports)
SELECT accession, 'succeeded' AS status, 'me' AS submitted_by, TIMESTAMP '2026-01-01' AS submitted_at FROM s
""")
def q_submission_audit(d):
    """One audit row per submitted accession."""
    empty = d.spark.createDataFrame([], "collection_id string, source string, type string, label string, created_at timestamp_ntz")
    members = d.spark.createDataFrame([], "collection_id string, sample_id string")
    samples = d.spark.createDataFrame([], "sample_id string, ncbi_accession string, biosample_id string, metadata string")
    got = G.register_accessions(d.run_reports, samples, empty, members, "me", NOW)
    return got["submissions"].select("accession", "status", "submitted_by", "submitted_at")


@register("board_by_column", ("collections", "collection_samples"), """
SELECT collection_id, (SELECT count(DISTINCT sample_id) FROM collection_samples s WHERE s.collection_id = c.collection_id) AS sample_count
FROM collections c
""")
def q_board_by_column(d):
    """Collections sorted by a chosen column."""
    board = C.list_collections(d.collections, d.collection_samples).select("collection_id", "sample_count")
    return C.sort_by_column(board, "sample_count", ascending=False)


@register("annotation_pages", ("curation_rows",), """
, a AS (SELECT DISTINCT study_name, md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(
    string_split(ncbi_accession, ';'), lambda x: trim(x)), lambda x: x <> ''))), ';')) AS sample_id
  FROM curation_rows WHERE ncbi_accession <> '')
SELECT 'page' AS what, sample_id, study_name FROM (SELECT * FROM a WHERE study_name = 'study_7' ORDER BY sample_id LIMIT 20 OFFSET 5)
UNION ALL SELECT 'study', NULL, study_name FROM (SELECT DISTINCT study_name FROM a)
""")
def q_annotation_pages(d):
    """A page of one study's annotations, and all studies."""
    empty = d.spark.createDataFrame([], "sample_id string, study_name string, ncbi_accession string, metadata string")
    table = G.import_curation(d.curation_rows, empty)["annotations"]
    page = G.study_samples_page(table, "study_7", 20, 5).select(F.lit("page").alias("what"), "sample_id", "study_name")
    names = G.studies(table.select("study_name").distinct()).select(F.lit("study").alias("what"), F.lit(None).cast("string").alias("sample_id"), "study_name")
    return page.unionByName(names)


@register("upsert_logs", ("task_logs",), """
, k AS (SELECT run_name, task_hash, log_type, max(content) AS content FROM task_logs GROUP BY ALL)
SELECT run_name, task_hash, log_type, md5(if(run_name = 'r3', 'replaced', content)) AS content_md5 FROM k
""")
def q_upsert_logs(d):
    """K9: log contents replaced by key; of repeated keys one row stays."""
    empty = d.task_logs.limit(0)
    stored = FS.upsert_task_logs(empty, d.task_logs, max_bytes=None)
    new = stored.filter("run_name = 'r3'").withColumn("content", F.lit("replaced"))
    return FS.upsert_task_logs(stored, new).select("run_name", "task_hash", "log_type", F.md5("content").alias("content_md5"))


@register("run_logs", ("task_logs", "workflow_runs"), """
, x AS (SELECT run_name, max(content) AS content FROM task_logs GROUP BY run_name)
SELECT run_name, md5(content) AS content_md5, 'kept' AS outcome FROM x
WHERE run_name IN (SELECT run_name FROM workflow_runs) AND octet_length(encode(content)) <= 4000
UNION ALL SELECT run_name, NULL, 'over size' FROM x WHERE octet_length(encode(content)) > 4000
""")
def q_run_logs(d):
    """Engine logs of exited runs, stored up to a limit; longer ones are reported."""
    events = d.task_logs.groupBy("run_name").agg(F.max("content").alias("nextflow_log")).withColumns(
        {"type": F.lit("wrapper_exited"), "utc_time": F.lit(NOW).cast("timestamp_ntz")})
    limits = {"nextflow_log": 4000}
    stored, _ = FS.attach_run_logs(d.task_logs.limit(0), d.workflow_runs, events, limits)
    gone = FS.rejected_run_logs(events, limits)
    return stored.select("run_name", F.md5("content").alias("content_md5"), F.lit("kept").alias("outcome")).unionByName(
        gone.select("run_name", F.lit(None).cast("string").alias("content_md5"), F.lit("over size").alias("outcome")))


# ---------------------------------------------------------------------------- landed files

@register("sheet_rows", ("curation_rows",), """
SELECT ncbi_accession, subject_id, if(row_index % 2 = 0, disease, NULL) AS disease FROM curation_rows
""")
def q_sheet_rows(d):
    """Sheets with different headers and column orders, matched by name."""
    root = _scratch(d, "sheets")
    cols = {0: ["NCBI_Accession", "subject_id", "disease"], 1: ["subject_id", "ncbi_accession"]}
    for k, names in cols.items():
        (d.curation_rows.filter(F.col("row_index") % 2 == k).select(*[F.col(n.lower()).alias(n) for n in names])
         .write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(f"{root}/{k}"))
    rows = FS.read_sheet(d.spark, f"{root}/*/*.csv")
    return rows.select("ncbi_accession", "subject_id", "disease")


@register("landed_reports", ("run_reports",), """
SELECT run_accession, secondary_sample_accession, library_strategy FROM run_reports
""")
def q_landed_reports(d):
    """Run reports read back from landed JSON lines."""
    root = _scratch(d, "reports")
    d.run_reports.select(*FS.REPORT_FIELDS).write.json(root)
    return FS.read_run_reports(d.spark, root).select("run_accession", "secondary_sample_accession", "library_strategy")


@register("weblog_quarantine", ("weblog",), """
SELECT count(*) AS rows, count(*) FILTER (WHERE id % 10 <> 3 AND id % 10 <> 4) AS good,
  count(*) FILTER (WHERE id % 10 = 5) AS stripped FROM weblog
""")
def q_weblog_quarantine(d):
    """Landed events with junk times, broken lines and zone lists; nothing aborts."""
    root = _scratch(d, "junk-weblog")
    i = F.col("id") % 10
    time = F.when(i == 3, F.lit("yesterday")).otherwise(F.date_format("utc_time", "yyyy-MM-dd'T'HH:mm:ss"))
    meta = F.when(i == 5, F.lit('{"workflow": {"start": {"offset": {"availableZoneIds": ["A]", "B"], "id": "Z"}}}}')).otherwise(F.lit("null"))
    line = F.concat(F.lit('{"runName": "'), F.col("run_name"), F.lit('", "event": "'), F.col("event"), F.lit('", "utcTime": "'), time,
                    F.lit('", "metadata": '), meta, F.lit("}"))
    d.weblog.select(F.when(i == 4, F.lit("{broken")).otherwise(line).alias("value")).write.text(root)
    ev = EV.read_weblog(d.spark, root)
    kept = F.get_json_object("metadata", "$.workflow.start.offset.id") == "Z"
    return ev.agg(F.count("*").alias("rows"), F.count_if("valid").alias("good"),
                  F.count_if(kept & ~F.col("metadata").contains("availableZoneIds")).alias("stripped"))


@register("run_event_quarantine", ("run_events",), """
SELECT CASE WHEN seq % 20 = 2 THEN 'bad utc_time' WHEN type = 'wrapper_exited' AND seq % 20 = 3 THEN 'missing exit_code' END AS reject_reason,
  count(*) AS n FROM run_events GROUP BY 1
""")
def q_run_event_quarantine(d):
    """S3: wrapper events validated per kind, rejected with a reason."""
    root = _scratch(d, "run-events")
    k = F.col("seq") % 20
    d.run_events.select("run_name", "type", "state", "reason", "wait_seconds",
                        F.when(k == 2, F.lit("never")).otherwise(F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("utc_time"),
                        F.when(k != 3, F.col("exit_code")).alias("exit_code")).write.json(root)
    return EV.read_run_events(d.spark, root).groupBy("reject_reason").agg(F.count("*").alias("n"))


@register("one_event_log", ("weblog", "run_events"), """
SELECT event, count(*) AS n FROM (SELECT event FROM weblog UNION ALL SELECT 'run_' || type FROM run_events) GROUP BY event
""")
def q_one_event_log(d):
    """Weblog and wrapper events in one log."""
    wrapper = EV.run_events_to_log(d.run_events.withColumnRenamed("received_at", "utc_time"))
    return (d.weblog.select("run_name", "event", "utc_time").unionByName(wrapper.select("run_name", "event", "utc_time"))
            .groupBy("event").agg(F.count("*").alias("n")))


def _write_files(rows, root: str, zipped: bool = False):
    """Write (path, text) rows as files under ``root`` on the executors; a keyed table of them.
    ``zipped``: names in ``.gz`` hold gzip, not plain text."""
    root = root if "://" in root else default_root(rows.sparkSession) + root

    def write(batches):
        import pyarrow.fs as pafs
        fs, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            made = set()
            for p, t in zip(pdf["path"], pdf["text"]):
                folder = f"{base}/{p}".rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{base}/{p}", compression=None) as f:
                    f.write(gzip.compress(t.encode()) if zipped and p.endswith(".gz") else t.encode())
            yield pdf[["path"]]
    rows.select("path", "text").mapInPandas(write, "path string").count()


@register("task_log_walk", ("task_logs",), """
, f AS (SELECT task_hash, log_type, max(content) AS content FROM task_logs WHERE log_type IN ('out', 'err', 'sh') GROUP BY ALL)
SELECT left(task_hash, 9) AS task_hash, log_type, md5(max(content)) AS content_md5 FROM f GROUP BY left(task_hash, 9), log_type
""")
def q_task_log_walk(d):
    """Task logs written as work folders and found again by the walk."""
    root = _scratch(d, "work")
    logs = (d.task_logs.filter("log_type in ('out', 'err', 'sh')").groupBy("task_hash", "log_type").agg(F.max("content").alias("text"))
            .withColumn("path", F.concat("task_hash", F.lit("/.command."), "log_type")))
    _write_files(logs, root)
    found, _ = FS.read_task_logs(d.spark, root, max_bytes=None)
    return found.groupBy("task_hash", "log_type").agg(F.md5(F.max("content")).alias("content_md5"))


@register("task_log_source", ("task_logs",), """
, f AS (SELECT task_hash, log_type, max(content) AS content FROM task_logs WHERE log_type IN ('out', 'err', 'sh') GROUP BY ALL)
SELECT left(task_hash, 9) AS task_hash, log_type, md5(max(content)) AS content_md5 FROM f GROUP BY left(task_hash, 9), log_type
""")
def q_task_log_source(d):
    """The same files read through the data source, one input partition a prefix folder."""
    root = _scratch(d, "work")
    logs = (d.task_logs.filter("log_type in ('out', 'err', 'sh')").groupBy("task_hash", "log_type").agg(F.max("content").alias("text"))
            .withColumn("path", F.concat("task_hash", F.lit("/.command."), "log_type")))
    _write_files(logs, root)
    found = task_logs(d.spark, root).filter("reason is null")
    return found.groupBy("task_hash", "log_type").agg(F.md5(F.max("content")).alias("content_md5"))


def _to_publish(d):
    """Keys of one version's manifests, and its files (sample_id, path, text): profiles, manifests and
    completion marks."""
    base = F.concat_ws("/", "workflow_id", "workflow_version", "sample_id")
    manifests = d.qc_manifests.filter("workflow_version = '1-URGENT'")
    profiles = d.profile_files.filter("workflow_version = '1-URGENT'").withColumn(
        "path", F.concat_ws("/", base, "branch", F.lit("metaphlan_markers/marker_rel_ab_w_read_stats.tsv.gz")))
    files = (profiles.select("sample_id", "path", "text")
             .unionByName(manifests.select("sample_id", F.concat_ws("/", base, F.lit("manifest.json")).alias("path"), "text"))
             .unionByName(manifests.filter("sample_id not like '%9'").select(
                 "sample_id", F.concat_ws("/", base, F.lit("MARK_COMPLETE")).alias("path"), F.lit("").alias("text"))))
    return manifests.select("sample_id", "workflow_id", "workflow_version"), files


def _staging(d, files, root: str, zipped: bool = False):
    """A ``stage`` of ``etl.ingest_waves``: the files of some samples, published for as long as they are ingested."""
    spread = d.spark.sparkContext.defaultParallelism * 2

    @contextlib.contextmanager
    def stage(keys):
        keys = keys.filter("sample_id is not null")
        _write_files(files.join(keys.select("sample_id").distinct(), "sample_id", "left_semi").repartition(spread), root, zipped)
        yield
        _withdraw(keys, root)
    return stage


WAVE = 200_000             # samples whose published files exist at a time


def _by_waves(d, name: str, read, zipped: bool = False, wave: int | None = None):
    """``read(keys, root)`` over the samples' published files, some samples after the other: each
    wave is published, read into the result and withdrawn. A sample is some small files and folders,
    each a block on disk, so that all of them at once take many times their texts. ``read`` must not
    look beyond a sample."""
    root = _scratch(d, name)
    keys, files = _to_publish(d)
    waves = -(-keys.count() // (wave or WAVE)) or 1
    part = F.pmod(F.xxhash64("sample_id"), F.lit(waves)).alias("wave")
    spread = d.spark.sparkContext.defaultParallelism * 2
    for what, rows in (("keys", keys), ("files", files)):
        rows.select("*", part).write.partitionBy("wave").parquet(f"{root}/{what}")
    for k in range(waves):
        at = f"{root}/published-{k}"
        mine, texts = (d.spark.read.schema(T.StructType([*rows.schema, T.StructField("wave", T.IntegerType())]))
                       .parquet(f"{root}/{what}").filter(F.col("wave") == k).drop("wave")
                       for what, rows in (("keys", keys), ("files", files)))
        _write_files(texts.repartition(spread), at, zipped)
        read(mine, at).write.parquet(f"{root}/read/wave={k}")
        _withdraw(mine, at)
        _delete_rest(d.spark, at)
    return d.spark.read.parquet(f"{root}/read").drop("wave")


def _delete_rest(spark, root: str):
    """Delete what a wave leaves when its samples are withdrawn: their parent folder, files without a sample id."""
    import pyarrow.fs as pafs
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else default_root(spark) + root)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)


WITHDRAW_THREADS = 8       # folders that a task deletes at a time


def _withdraw(keys, root: str):
    """Delete the published folders of samples, on the executors. A file system answers a deletion
    slowly but many at once, so each of a fixed number of tasks deletes some folders at a time: keys
    are so few bytes that AQE would bring those of a plain ``distinct`` into one task."""
    root = root if "://" in root else default_root(keys.sparkSession) + root
    prefix = F.concat_ws("/", "workflow_id", "workflow_version", "sample_id").alias("path")
    spread = keys.sparkSession.sparkContext.defaultParallelism * 4

    def delete(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow.fs as pafs
        fs, base = pafs.FileSystem.from_uri(root)

        def one(p):
            if fs.get_file_info(f"{base}/{p}").type == pafs.FileType.Directory:
                fs.delete_dir(f"{base}/{p}")
        with ThreadPoolExecutor(WITHDRAW_THREADS) as pool:
            for pdf in batches:
                list(pool.map(one, pdf["path"]))
                yield pdf
    # without an id, the path is the folder of all samples
    (keys.filter("sample_id is not null").select(prefix).repartition(spread, "path").distinct()
     .mapInPandas(delete, "path string").count())


@register("fetch_outputs", ("profile_files", "qc_manifests"), """
SELECT q.sample_id, b.branch, if(p.text IS NULL, 'missing', 'ok') AS status, md5(p.text) AS text_md5
FROM qc_manifests q CROSS JOIN (VALUES ('full_data'), ('rarefied_data')) b(branch)
LEFT JOIN profile_files p ON p.sample_id = q.sample_id AND p.branch = b.branch AND p.workflow_version = '1-URGENT'
WHERE q.workflow_version = '1-URGENT'
""")
def q_fetch_outputs(d):
    """Published profiles by path, one row per file with its status."""
    spec = [s for s in O.specs_for("cmgd_nextflow", "2.2.1") if s.table == "taxonomic_profile_metaphlan"]

    def read(keys, root):
        files = O.fetch_outputs(O.output_paths(keys, root, spec))
        return files.select("sample_id", "branch", "status", F.md5("text").alias("text_md5"))
    return _by_waves(d, "published", read)


@register("unpublished_samples", ("qc_manifests", "profile_files"), """
SELECT sample_id FROM qc_manifests WHERE workflow_version = '1-URGENT' AND sample_id LIKE '%9'
""")
def q_unpublished_samples(d):
    """Samples whose completion mark is missing are not ready."""
    return _by_waves(d, "published", lambda keys, root: O.published(keys, root)[1].select("sample_id"))


# -------------------------------------------------------------------------------------- lake

def _lake(d, root: str):
    """Profiles ingested, then the samples ending in 3 again with halved abundances."""
    from ..sources.outputs import parse_metaphlan
    table = "taxonomic_profile_metaphlan"
    files = d.keep("profile_files").select(
        "sample_id", F.col("workflow_id").alias("workflow"), F.col("workflow_version").alias("version"),
        F.col("branch").alias("data_type"), "text")
    lake.ensure_schema(d.spark, root)

    def halved(files):
        return parse_metaphlan(files).withColumn("relative_abundance", F.col("relative_abundance") / 2)
    for part, parse, ident, at in ((files, parse_metaphlan, "first", NOW),
                                   (files.filter("sample_id like '%3'"), halved, "second", NOW + dt.timedelta(days=1))):
        lake.write_tables({table: part}, root, ident, parsers={table: parse})
        counts = parse(part).groupBy("sample_id", "workflow", "version").agg(F.count("*").alias("n")).withColumn("table", F.lit(table))
        lake.mark_ingested(counts, root, ident, at)


_LAKE_SQL = r"""
, l AS (SELECT sample_id, workflow_version AS version, branch AS data_type, string_split(line, chr(9)) AS f FROM profile_lines
        WHERE NOT starts_with(line, '#')),
v AS (SELECT sample_id, version, data_type, TRY_CAST(f[3] AS DOUBLE) / if(sample_id LIKE '%3', 2, 1) AS abundance FROM l WHERE TRY_CAST(f[3] AS DOUBLE) IS NOT NULL)
"""


@register("lake_round_trip", ("profile_lines",), _LAKE_SQL + """
SELECT sample_id, version, data_type, count(*) AS n, sum(CAST(round(abundance * 10000) AS BIGINT))::BIGINT AS total FROM v GROUP BY ALL
""")
def q_lake_round_trip(d):
    """Write, re-ingest and scan - the latest ingest of a sample replaces its rows."""
    root = _scratch(d, "lake")
    _lake(d, root)
    rows = lake.scan_lake(d.spark, root, "taxonomic_profile_metaphlan")
    return rows.groupBy("sample_id", "version", "data_type").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("relative_abundance") * 10000).cast("long")).alias("total"))


@register("freeze_manifest", ("profile_lines",), _LAKE_SQL + """
, n AS (SELECT count(*) AS live, count(*) FILTER (WHERE sample_id LIKE '%3') AS twice FROM v)
SELECT 'taxonomic_profile_metaphlan' AS "table", live AS live_rows, true AS under_base FROM n
UNION ALL SELECT 'etl_ingested', (SELECT count(DISTINCT (sample_id, version)) + count(DISTINCT (sample_id, version)) FILTER (WHERE sample_id LIKE '%3') FROM v), true
""")
def q_freeze_manifest(d):
    """K6: live rows per table in the frozen manifest of data and watermark files."""
    root = _scratch(d, "lake")
    _lake(d, root)
    m = lake.freeze_snapshot(d.spark, root, "https://data.example.org/v1")
    return m.groupBy("table").agg(F.sum("live_rows").alias("live_rows"),
                                  F.bool_and(F.col("url").startswith("https://data.example.org/v1/")).alias("under_base"))


@register("batch_metadata", ("jobs", "samples"), """
SELECT DISTINCT j.sample_id, coalesce(nullif(trim(s.ncbi_accession), ''), '') AS "NCBI_accession" FROM jobs j LEFT JOIN samples s USING (sample_id)
""")
def q_batch_metadata(d):
    """K7: the sample sheet of a batch, written and read back."""
    root = _scratch(d, "metadata")
    lake.write_metadata_tsv(d.jobs, d.samples, root, files=None)
    back = d.spark.read.option("sep", "\t").option("header", True).csv(root)
    return back.select("sample_id", F.coalesce("NCBI_accession", F.lit("")).alias("NCBI_accession"))


# ------------------------------------------------------------------- runs, studies, versions

@register("run_failed_tasks", ("task_executions",), """
SELECT run_name, utc_time, process, sample_id, exit_code, task_hash, attempt, error_action
FROM task_executions WHERE status <> 'COMPLETED'
""")
def q_run_failed_tasks(d):
    """Failed tasks of every run, newest first."""
    from ..operators import runs as RU
    return RU.failed_tasks(d.task_executions)


@register("curated_studies", ("curation_rows",), """
, s AS (SELECT DISTINCT study_name FROM curation_rows)
SELECT study_name, if(right(study_name, 1) IN ('1', '2', '3'), 'second.tsv', 'first.tsv') AS source_file,
  CASE WHEN study_name LIKE '%1' THEN '{"doi": 2}' WHEN study_name NOT LIKE '%9' THEN '{"doi": 1}' END AS metadata,
  if(right(study_name, 1) IN ('1', '2', '3'), TIMESTAMP '2026-01-02', TIMESTAMP '2026-01-01') AS loaded_at
FROM s
""")
def q_curated_studies(d):
    """U8: study records imported twice; metadata is overwritten only when given."""
    names = d.curation_rows.select("study_name").distinct()
    none = d.spark.createDataFrame([], "study_name string, source_file string, metadata string, loaded_at timestamp_ntz")
    first = names.select("study_name", F.lit("first.tsv").alias("source_file"),
                         F.when(~F.col("study_name").like("%9"), F.lit('{"doi": 1}')).alias("metadata"))
    last = F.substring("study_name", -1, 1)
    second = names.filter(last.isin("1", "2", "3")).select(
        "study_name", F.lit("second.tsv").alias("source_file"), F.when(last == "1", F.lit('{"doi": 2}')).otherwise(F.lit("{}")).alias("metadata"))
    table = G.upsert_studies(none, first, NOW)
    return G.upsert_studies(table, second, NOW + dt.timedelta(days=1))


@register("versioned_state", ("jobs",), """
SELECT job_id, CASE WHEN workflow_id = 'shotgun' AND status IN ('running', 'failed') THEN 'pending' ELSE status END AS status FROM jobs
""")
def q_versioned_state(d):
    """A state table persisted, changed and read back through its version pointer."""
    from ..operators import lifecycle as L
    root = _scratch(d, "jobs-table")
    ST.write_versioned(d.jobs, root)
    ST.write_versioned(L.reset_jobs(ST.read_current(d.spark, root), "shotgun"), root)
    return ST.read_current(d.spark, root).select("job_id", "status")


@register("etl_tick_all", ("jobs", "etl_ingested"), """
, p AS (SELECT count(*) AS n FROM jobs j WHERE status = 'completed' AND workflow_id = 'shotgun' AND workflow_version = '1-URGENT'
  AND NOT EXISTS (FROM etl_ingested e WHERE e.sample_id = j.sample_id AND e.workflow_id = j.workflow_id AND e.workflow_version = j.workflow_version))
SELECT n AS backlog, n > 0 AS ingest, n AS batch_size FROM p
""")
def q_etl_tick_all(d):
    """A tick that takes the whole backlog."""
    from ..operators import etl as E
    b = E.backlog(d.jobs, d.etl_ingested, "shotgun", "1-URGENT", dt.datetime(2030, 1, 1))
    return E.tick_decision(b, batch=None).select("backlog", "ingest", "batch_size")


# Published outputs of one version: the profile, tagged, and the manifest.
_TAGGED = [O.OutputSpec("metaphlan_markers/marker_rel_ab_w_read_stats.tsv.gz", "taxonomic_profile_metaphlan",
                        O.parse_metaphlan, tags=(("profiler", "metaphlan"),)),
           O.OutputSpec(O.MANIFEST, "qc_metrics", O.parse_qc, branched=False)]

_READY_SQL = r"""
, ready AS (SELECT sample_id, text FROM qc_manifests WHERE workflow_version = '1-URGENT' AND sample_id NOT LIKE '%9'),
pl AS (SELECT sample_id, branch, unnest(string_split(text, chr(10))) AS line FROM profile_files
       WHERE workflow_version = '1-URGENT' AND sample_id IN (SELECT sample_id FROM ready)),
v AS (SELECT *, string_split(line, chr(9)) AS f FROM pl WHERE NOT starts_with(line, '#') AND NOT regexp_matches(line, '^\s*$')),
p AS (SELECT * FROM v WHERE len(f) >= 3 AND TRY_CAST(f[3] AS DOUBLE) IS NOT NULL)
"""


@register("ingest_counts", ("profile_lines", "profile_files", "qc_manifests"), _READY_SQL + """
SELECT 'taxonomic_profile_metaphlan' AS "table", sample_id, branch AS data_type, 'metaphlan' AS profiler, count(*) AS n,
  coalesce((SELECT array_to_string(CAST(json_extract(r.text, '$.provenance.input_ids') AS VARCHAR[]), ';') FROM ready r
            WHERE r.sample_id = p.sample_id), '') AS run_ids
FROM p GROUP BY sample_id, branch
""")
def q_ingest_counts(d):
    """A30 (dry run), G2, G3, S16: rows that an ingest would write, from gzip files, with the spec's
    tag and the common columns."""
    from ..operators import etl as E

    def read(keys, root):
        tables, _ = E.parse_batch(d.spark, keys, root, "shotgun", "1-URGENT", specs=_TAGGED)
        return (tables["taxonomic_profile_metaphlan"].groupBy("sample_id", "data_type", "profiler", "run_ids")
                .agg(F.count("*").alias("n")).withColumn("table", F.lit("taxonomic_profile_metaphlan")))
    return _by_waves(d, "dry-run", read, zipped=True)


@register("backlog_stream", ("profile_lines", "profile_files", "qc_manifests"), _READY_SQL + """
, n AS (SELECT 'taxonomic_profile_metaphlan' AS "table", sample_id FROM p UNION ALL SELECT 'qc_metrics', sample_id FROM ready)
SELECT "table", count(*) AS rows, count(*) AS observed, count(DISTINCT sample_id) AS samples,
  (SELECT count(*) FROM qc_manifests WHERE workflow_version = '1-URGENT' AND sample_id LIKE '%9') AS skipped,
  'wait,age,threshold' AS ticks
FROM n GROUP BY "table"
""")
def q_backlog_stream(d):
    """Three ticks over landed completion records. The first has too few, the second
    takes them for their age, the third the rest; the lake, its watermark and the observed counts. A tick's
    samples are published while their wave is ingested."""
    from ..streaming.backlog import tick
    root = _scratch(d, "backlog")
    keys, files = _to_publish(d)
    files.write.parquet(f"{root}/files")
    stage = _staging(d, d.spark.read.schema(files.schema).parquet(f"{root}/files"), f"{root}/published", zipped=True)
    record = keys.withColumn("completed_at", F.lit(NOW).cast("timestamp_ntz"))
    early = F.pmod(F.xxhash64("sample_id"), F.lit(10)) == 0
    few = record.filter(early).count()
    ticks = []
    for hours, slice_ in ((1, early), (30, F.lit(False)), (31, ~early)):
        record.filter(slice_).write.mode("append").parquet(f"{root}/landing")
        ticks.append(tick(d.spark, f"{root}/landing", f"{root}/state", f"{root}/published", f"{root}/lake", "shotgun",
                          "1-URGENT", NOW + dt.timedelta(hours=hours), specs=_TAGGED, stage=stage, threshold=few + 1, batch=None))
    reasons = ",".join(t["decision"]["reason"] for t in ticks)
    observed = {k: sum(t["written"][k] for t in ticks if "written" in t) for k in ticks[-1]["written"]}
    skipped = ticks[-1]["skipped_unpublished"].count()      # those of earlier ticks are tried again
    marked = lake.read_watermark(d.spark, f"{root}/lake").select("sample_id", F.explode("row_counts").alias("table", "n"))
    samples = marked.groupBy("table").agg(F.count("*").alias("samples"))
    out = None
    for name, n in observed.items():
        rows = (lake.scan_lake(d.spark, f"{root}/lake", name).agg(F.count("*").alias("rows"))
                .withColumn("table", F.lit(name)).withColumn("observed", F.lit(n).cast("long")))
        out = rows if out is None else out.unionByName(rows)
    return out.join(samples, "table").withColumn("skipped", F.lit(skipped).cast("long")).withColumn("ticks", F.lit(reasons))
