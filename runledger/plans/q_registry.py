"""Registered identity / registration / catalog-maintenance queries with oracle SQL."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import registry as G
from ..operators.registry import curation_rows
from .registry import register

_TOKS = "list_filter(list_transform(string_split(coalesce({c}, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"


def _norm(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct({_TOKS.format(c=c)})), ';')"


@register("sample_identity", ("samples",), rf"""
SELECT sample_id, ncbi_accession,
  {_norm("ncbi_accession")} AS normalized_accession,
  CASE WHEN len({_TOKS.format(c="ncbi_accession")}) > 0 THEN md5({_norm("ncbi_accession")}) END AS content_id,
  CASE WHEN regexp_matches(ncbi_accession, '\b[SED]RR\d+\b') THEN md5({_norm("ncbi_accession")}) END AS derived_id,
  len({_TOKS.format(c="ncbi_accession")}) > 0 AS has_accession,
  coalesce(length(regexp_replace(ncbi_accession, '[\s;]', '', 'g')) = 0, true) AS is_orphan
FROM samples
""")
def q_sample_identity(d):
    """F9-F13 + P11: content-derived ids of the catalog's accession lists."""
    return G.sample_identity(d.samples)


_GROUPED = """
, r AS (SELECT *, trim(run_accession) AS srr, trim(secondary_sample_accession) AS srs FROM run_reports
        WHERE coalesce(trim(run_accession), '') <> '' AND coalesce(trim(secondary_sample_accession), '') <> ''),
g AS (SELECT source_accession AS collection_id, srs AS sra_sample,
             list_sort(list_distinct(list(srr))) AS runs,
             arg_min(nullif(trim(sample_accession), ''), pos) AS biosample_id,
             arg_min(nullif(trim(secondary_study_accession), ''), pos) AS sra_study,
             arg_min(nullif(trim(study_accession), ''), pos) AS bioproject
      FROM r GROUP BY source_accession, srs),
grouped AS (SELECT collection_id, sra_sample, md5(array_to_string(runs, ';')) AS sample_id,
             array_to_string(runs, ';') AS ncbi_accession, biosample_id, sra_study, bioproject,
             CAST(len(runs) AS INTEGER) AS n_runs FROM g)
"""


@register("group_runs", ("run_reports",), _GROUPED + "SELECT * FROM grouped")
def q_group_runs(d):
    """Archive run rows grouped into content-identified samples per study."""
    return G.group_runs(d.run_reports)


@register("library_composition", ("run_reports",), """
, l AS (SELECT source_accession, pos, 'library_strategy' AS field, library_strategy AS raw FROM run_reports
        UNION ALL SELECT source_accession, pos, 'library_selection', library_selection FROM run_reports
        UNION ALL SELECT source_accession, pos, 'library_source', library_source FROM run_reports
        UNION ALL SELECT source_accession, pos, 'instrument_platform', instrument_platform FROM run_reports),
g AS (SELECT source_accession, field, coalesce(nullif(trim(raw), ''), 'unknown') AS value,
             count(*) AS n, min(pos) AS first_pos FROM l GROUP BY 1, 2, 3)
SELECT source_accession, field, value, n,
       row_number() OVER (PARTITION BY source_accession, field ORDER BY n DESC, first_pos) AS rank
FROM g
""")
def q_library_composition(d):
    """Library tallies per study (count desc, first-seen order on ties)."""
    return G.library_composition(d.run_reports).withColumn("rank", F.col("rank").cast("long"))


@register("amplicon_warnings", ("run_reports",), """
, g AS (SELECT source_accession,
          count(*) FILTER (WHERE upper(trim(library_strategy)) = 'AMPLICON') AS n_amplicon,
          count(*) FILTER (WHERE upper(trim(library_selection)) = 'PCR') AS n_pcr,
          count(*) AS n_runs FROM run_reports GROUP BY source_accession)
SELECT *, greatest(n_amplicon, n_pcr) AS flagged,
  printf('%d of %d run(s) look like amplicon/16S (library_strategy=AMPLICON or library_selection=PCR), not shotgun metagenomics',
         greatest(n_amplicon, n_pcr), n_runs) AS warning
FROM g WHERE greatest(n_amplicon, n_pcr) > 0
""")
def q_amplicon_warnings(d):
    """Amplicon warning per study."""
    return G.amplicon_warnings(d.run_reports)


_CURATED = f"""
, cv AS (SELECT study_name, row_index, subject_id, trim(ncbi_accession) AS acc,
                len({_TOKS.format(c="trim(ncbi_accession)")}) > 0 AS ok FROM curation_rows),
curated AS (SELECT md5({_norm("acc")}) AS sample_id, study_name FROM cv WHERE ok)
"""


@register("count_new", ("run_reports", "curation_rows"), _GROUPED + _CURATED + """
, ids AS (SELECT DISTINCT collection_id, sample_id FROM grouped),
known AS (SELECT DISTINCT sample_id FROM curated)
SELECT i.collection_id, count(*) AS samples_found,
       count(*) FILTER (WHERE k.sample_id IS NULL) AS samples_added,
       count(*) FILTER (WHERE k.sample_id IS NOT NULL) AS samples_existing
FROM ids i LEFT JOIN known k ON i.sample_id = k.sample_id GROUP BY i.collection_id
""")
def q_count_new(d):
    """Per study, samples found / new / already known to the curated catalog."""
    catalog, _ = curation_rows(d.curation_rows)
    return G.count_new(G.group_runs(d.run_reports), catalog)


_ANN = T.StructType([T.StructField("sample_id", T.StringType()),
                     T.StructField("study_name", T.StringType()),
                     T.StructField("ncbi_accession", T.StringType()),
                     T.StructField("metadata", T.StringType())])


@register("curation_reimport", ("curation_rows",), _CURATED + """
, loaded AS (SELECT study_name, count(*) AS n FROM curated GROUP BY study_name),
dropped AS (SELECT study_name, count(*) AS n FROM cv WHERE NOT ok GROUP BY study_name)
SELECT coalesce(l.study_name, x.study_name) AS study_name, coalesce(l.n, 0) AS rows_loaded,
       coalesce(l.n, 0) AS rows_updated, coalesce(x.n, 0) AS rows_dropped
FROM loaded l FULL OUTER JOIN dropped x ON l.study_name = x.study_name
""")
def q_curation_reimport(d):
    """U8 twice: import the sheet, then import it again; the second run's per-study summary
    (every loaded row is an update, nothing new)."""
    empty = d.spark.createDataFrame([], _ANN)
    first = G.import_curation(d.curation_rows, empty)
    return G.import_curation(d.curation_rows, first["annotations"])["summary"]


@register("curation_dropped", ("curation_rows",), _CURATED + """
SELECT study_name, row_index, subject_id FROM cv WHERE NOT ok
""")
def q_curation_dropped(d):
    """U8: rows dropped for a missing accession, with index and subject."""
    empty = d.spark.createDataFrame([], _ANN)
    return G.import_curation(d.curation_rows, empty)["dropped"]


@register("reconcile_jobs", ("samples", "workflows", "jobs"), """
SELECT s.sample_id, w.workflow_id, w.version AS workflow_version, 'pending' AS status
FROM samples s JOIN workflows w ON w.status = 'active'
WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.sample_id = s.sample_id
                  AND j.workflow_id = w.workflow_id AND j.workflow_version = w.version)
""")
def q_reconcile_jobs(d):
    """Pending jobs to create for every sample x active workflow version."""
    return G.reconcile_jobs(d.samples, d.workflows, d.jobs)


_ORPHAN = r"coalesce(length(regexp_replace(ncbi_accession, '[\s;]', '', 'g')) = 0, true)"


@register("orphan_cleanup", ("samples", "jobs", "collection_samples", "task_executions", "dead_letter"), rf"""
, o AS (SELECT sample_id FROM samples WHERE {_ORPHAN})
SELECT 'samples' AS "table", count(*) AS n FROM o
UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE sample_id IN (SELECT sample_id FROM o)
UNION ALL SELECT 'collection_samples', count(*) FROM collection_samples WHERE sample_id IN (SELECT sample_id FROM o)
UNION ALL SELECT 'task_executions', count(*) FROM task_executions WHERE sample_id IN (SELECT sample_id FROM o)
UNION ALL SELECT 'dead_letter', count(*) FROM dead_letter WHERE sample_id IN (SELECT sample_id FROM o)
""")
def q_orphan_cleanup(d):
    """U13 dry run: rows per table that removing orphan samples would delete."""
    return G.orphan_cleanup(d.samples, {"jobs": d.jobs, "collection_samples": d.collection_samples,
                                        "task_executions": d.task_executions,
                                        "dead_letter": d.dead_letter})


@register("remapped_jobs", ("samples", "jobs"), f"""
, m AS (SELECT sample_id AS old_id, md5({_norm("ncbi_accession")}) AS new_id FROM samples
        WHERE len({_TOKS.format(c="ncbi_accession")}) > 0)
SELECT j.job_id, coalesce(m.new_id, j.sample_id) AS sample_id, j.workflow_id, j.workflow_version, j.status
FROM jobs j LEFT JOIN m ON j.sample_id = m.old_id AND m.old_id <> m.new_id
""")
def q_remapped_jobs(d):
    """Jobs re-keyed to content-derived sample ids."""
    jobs = d.jobs.select("job_id", "sample_id", "workflow_id", "workflow_version", "status")
    return G.remap_sample_ids(jobs, G.id_map(d.samples))


@register("backfill_members", ("samples",), """
SELECT json_extract_string(metadata, '$.cohort') AS collection_id, sample_id FROM samples
WHERE json_extract_string(metadata, '$.cohort') IS NOT NULL
""")
def q_backfill_members(d):
    """Memberships backfilled from the metadata cohort key."""
    return G.backfill_collections(d.samples)["members"]


@register("retire_purge", ("jobs", "workflows"), """
, w AS (SELECT workflow_id, version,
          CASE WHEN workflow_id = 'shotgun' AND version = '1-URGENT' THEN 'retired' ELSE status END AS status
        FROM workflows),
kept AS (SELECT j.* FROM jobs j WHERE NOT (j.status = 'pending' AND EXISTS (
           SELECT 1 FROM w WHERE w.workflow_id = j.workflow_id AND w.version = j.workflow_version
           AND w.status = 'retired')))
SELECT workflow_id, workflow_version, status, count(*) AS n FROM kept GROUP BY 1, 2, 3
""")
def q_retire_purge(d):
    """U6 + purge: retire the active shotgun version, drop pending jobs of retired versions (paused ones keep theirs);
    remaining jobs per version and status."""
    wf = G.set_workflow_status(d.workflows, "shotgun", "1-URGENT", "retired")
    kept = G.purge_pending(d.jobs, wf)
    return kept.groupBy("workflow_id", "workflow_version", "status").agg(F.count(F.lit(1)).alias("n"))


@register("accession_receipts", ("run_reports", "curation_rows"), _GROUPED + _CURATED + """
, subs AS (SELECT DISTINCT trim(source_accession) AS accession FROM run_reports),
ids AS (SELECT DISTINCT upper(collection_id) AS collection_id, sample_id FROM grouped),
known AS (SELECT DISTINCT sample_id FROM curated),
c AS (SELECT i.collection_id, count(*) AS samples_found,
             count(*) FILTER (WHERE k.sample_id IS NULL) AS samples_added,
             count(*) FILTER (WHERE k.sample_id IS NOT NULL) AS samples_existing
      FROM ids i LEFT JOIN known k ON i.sample_id = k.sample_id GROUP BY i.collection_id),
rc AS (SELECT s.accession, upper(s.accession) AS collection_id,
        CASE WHEN starts_with(upper(trim(s.accession)), 'PRJ') THEN 'bioproject'
             WHEN substr(upper(trim(s.accession)), 1, 3) IN ('SRP', 'ERP', 'DRP') THEN 'sra_study' END AS source,
        coalesce(c.samples_found, 0) AS samples_found, coalesce(c.samples_added, 0) AS samples_added,
        coalesce(c.samples_existing, 0) AS samples_existing
      FROM subs s LEFT JOIN c ON c.collection_id = upper(s.accession))
SELECT *, CASE WHEN source IS NULL THEN 'not a study/BioProject accession'
               WHEN samples_found = 0 THEN 'no runs found' END AS error,
       CASE WHEN source IS NULL OR samples_found = 0 THEN 'failed' ELSE 'dry_run' END AS status,
       'project' AS type
FROM rc
""")
def q_accession_receipts(d):
    """U9 dry run: per submitted accession, source, samples found / new / already known to
    the curated catalog, and the status; nothing is written."""
    catalog, _ = curation_rows(d.curation_rows)
    empty_c = d.spark.createDataFrame([], "collection_id string, source string, type string, "
                                          "label string, created_at timestamp")
    empty_m = d.spark.createDataFrame([], "collection_id string, sample_id string")
    return G.register_accessions(d.run_reports, catalog.select("sample_id").distinct(), empty_c,
                                 empty_m, "bench", dt.datetime(2026, 1, 1), dry_run=True)["receipts"]


@register("bulk_sample_counters", ("curation_rows",), r"""
, v AS (SELECT row_index, regexp_matches(trim(ncbi_accession), '\b[SED]RR\d+\b') AS ok,
               nullif(trim(study_name), '') AS coll FROM curation_rows),
SELECT count(*) FILTER (WHERE ok) AS registered, count(*) FILTER (WHERE NOT ok) AS skipped,
       count(*) FILTER (WHERE ok AND coll IS NULL) AS unattached
FROM v
""")
def q_bulk_sample_counters(d):
    """Bulk registration of all sheet rows."""
    return G.ingest_sample_rows(d.curation_rows)["counters"]


@register("agent_heartbeats", ("agents",), """
, hb AS (SELECT agent_id, 'host-new' || hostname AS hostname, workflow_filter,
                started_at + INTERVAL 1 DAY AS started_at, last_seen_at + INTERVAL 10 MINUTE AS last_seen_at
         FROM agents WHERE length(agent_id) % 2 = 0),
allrows AS (SELECT * FROM agents UNION ALL SELECT * FROM hb)
SELECT agent_id, min(started_at) AS started_at,
       arg_max({'h': hostname, 'w': workflow_filter, 'l': last_seen_at}, last_seen_at).h AS hostname,
       arg_max({'h': hostname, 'w': workflow_filter, 'l': last_seen_at}, last_seen_at).w AS workflow_filter,
       max(last_seen_at) AS last_seen_at
FROM allrows GROUP BY agent_id
""")
def q_agent_heartbeats(d):
    """A heartbeat batch upserted into the agent registry - the first start time is
    kept, every other value comes from the latest heartbeat."""
    a = d.agents
    hb = (a.filter(F.length("agent_id") % 2 == 0)
          .select("agent_id", F.concat(F.lit("host-new"), F.col("hostname")).alias("hostname"),
                  "workflow_filter", (F.col("started_at") + F.expr("INTERVAL 1 DAY")).alias("started_at"),
                  (F.col("last_seen_at") + F.expr("INTERVAL 10 MINUTES")).alias("last_seen_at")))
    return G.latest_agents(a, hb).select("agent_id", "started_at", "hostname", "workflow_filter",
                                         "last_seen_at")
