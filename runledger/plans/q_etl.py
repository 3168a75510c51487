"""Registered outputs-ETL queries: parsing, lake analyses, backlog and tick (S10, S15,
A27, A28, A35-A38, O7, J19/W3)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import etl as E
from ..operators import taxa as X
from ..sources import outputs as O
from ..sources.outputs import parse_metaphlan, parse_qc
from .registry import r2, register

AS_OF = dt.datetime(2001, 8, 2)
_RANKS = ("CASE substr(p[-1], 1, 1) WHEN 'd' THEN 'domain' WHEN 'k' THEN 'kingdom' WHEN 'p' THEN 'phylum' "
          "WHEN 'c' THEN 'class' WHEN 'o' THEN 'order' WHEN 'f' THEN 'family' WHEN 'g' THEN 'genus' "
          "WHEN 's' THEN 'species' WHEN 't' THEN 'strain' END")

_PARSED = rf"""
, pl AS (SELECT sample_id, workflow_id, workflow_version, branch, string_split(text, chr(10)) AS arr
         FROM profile_files),
l AS (SELECT sample_id, workflow_id, workflow_version, branch, unnest(arr) AS line,
             unnest(range(len(arr))) AS line_no FROM pl),
v AS (SELECT *, string_split(line, chr(9)) AS f FROM l
      WHERE NOT regexp_matches(line, '^\s*$') AND NOT starts_with(line, '#')),
w AS (SELECT *, TRY_CAST(f[3] AS DOUBLE) AS rel, string_split(f[1], '|') AS p,
             trim(string_split(f[2], '|')[-1]) AS tx FROM v WHERE len(f) >= 3),
parsed AS (
  SELECT sample_id, workflow_id, workflow_version, branch, CAST(line_no AS INTEGER) AS line_no,
    f[1] AS clade_name,
    CASE WHEN length(p[-1]) > 2 AND substr(p[-1], 2, 1) = '_' THEN {_RANKS} END AS rank,
    CASE WHEN regexp_matches(tx, '^-?\d+$') AND tx <> '-1' THEN TRY_CAST(tx AS INTEGER) END AS ncbi_taxid,
    CASE WHEN starts_with(p[-1], 't__SGB') THEN p[-1] END AS sgb_id,
    rel AS relative_abundance,
    CASE WHEN len(f) > 3 THEN TRY_CAST(f[4] AS DOUBLE) END AS coverage,
    CASE WHEN len(f) > 4 THEN CAST(trunc(TRY_CAST(f[5] AS DOUBLE)) AS BIGINT) END AS estimated_reads
  FROM w WHERE rel IS NOT NULL)
"""

_LABELS = """
, lab AS (SELECT sample_id, collection_id AS study_name FROM (
    SELECT cs.sample_id, cs.collection_id,
           row_number() OVER (PARTITION BY cs.sample_id ORDER BY (c.type = 'study') DESC NULLS LAST,
                              cs.collection_id) AS rn
    FROM collection_samples cs JOIN collections c ON c.collection_id = cs.collection_id) x WHERE rn = 1)
"""

_QC = """
, qc AS (SELECT sample_id, workflow_id, workflow_version,
    TRY_CAST(json_extract(text, '$.read_accounting.raw.number_reads') AS BIGINT) AS reads_raw,
    TRY_CAST(json_extract(text, '$.read_accounting.decontaminated.number_reads') AS BIGINT) AS reads_decontaminated,
    TRY_CAST(json_extract(text, '$.read_accounting.raw.number_bases') AS BIGINT) AS bases_raw,
    TRY_CAST(json_extract(text, '$.read_accounting.decontaminated.number_bases') AS BIGINT) AS bases_decontaminated,
    TRY_CAST(json_extract(text, '$.read_accounting.reads_surviving_fraction') AS DOUBLE) AS reads_surviving_fraction,
    TRY_CAST(json_extract(text, '$.read_accounting.bases_surviving_fraction') AS DOUBLE) AS bases_surviving_fraction,
    json_extract_string(text, '$.parameters.metaphlan_index') AS metaphlan_index,
    json_extract_string(text, '$.provenance.pipeline_version') AS pipeline_version,
    json_extract_string(text, '$.provenance.git_commit') AS git_commit,
    coalesce(array_to_string(CAST(json_extract(text, '$.provenance.input_ids') AS VARCHAR[]), ';'), '') AS run_ids
  FROM qc_manifests)
"""


def _files(d):
    return d.profile_files


def _qc(d):
    return parse_qc(d.qc_manifests).drop("line_no")


@register("parse_profiles", ("profile_lines", "profile_files"), _PARSED + "SELECT * FROM parsed")
def q_parse_profiles(d):
    """S10 + S17 + F17-F20: every published profile file parsed into typed rows."""
    return parse_metaphlan(_files(d))


@register("parse_manifests", ("qc_manifests",), _QC + "SELECT * FROM qc")
def q_parse_manifests(d):
    """Run manifests parsed into qc rows (missing levels -> NULL, run ids ';'-joined)."""
    return _qc(d)


@register("study_labels", ("collections", "collection_samples"), _LABELS + "SELECT * FROM lab")
def q_study_labels(d):
    """J19 + W3: one study label per sample, 'study' collections first."""
    return E.study_labels(d.collections, d.collection_samples)


@register("top_taxa", ("profile_lines", "profile_files", "collections", "collection_samples"),
          _PARSED + _LABELS + f"""
, m AS (SELECT lab.study_name, p.clade_name, avg(p.relative_abundance) AS mean_abundance,
               count(*) AS n_samples
        FROM parsed p JOIN lab ON lab.sample_id = p.sample_id
        WHERE p.rank = 'species' AND p.branch = 'full_data' AND p.workflow_version = '1-URGENT'
        GROUP BY lab.study_name, p.clade_name),
r AS (SELECT *, row_number() OVER (PARTITION BY study_name ORDER BY mean_abundance DESC, clade_name) AS rk FROM m)
SELECT study_name, clade_name, {r2("mean_abundance")} AS mean_abundance, n_samples FROM r WHERE rk <= 10
""")
def q_top_taxa(d):
    """Per study the 10 species with the highest mean abundance (pinned version and
    branch)."""
    rows = parse_metaphlan(_files(d)).withColumnRenamed("branch", "data_type")
    return X.top_taxa(rows, E.study_labels(d.collections, d.collection_samples),
                      version="1-URGENT", data_type="full_data", rank="species", k=10)


@register("study_depth", ("qc_manifests", "collections", "collection_samples"), _QC + _LABELS + f"""
SELECT lab.study_name, count(DISTINCT qc.sample_id) AS samples,
       {r2("avg(qc.reads_raw)")} AS mean_reads_raw
FROM qc JOIN lab ON lab.sample_id = qc.sample_id GROUP BY lab.study_name
""")
def q_study_depth(d):
    """Samples and mean raw depth per study."""
    return X.study_depth(_qc(d), E.study_labels(d.collections, d.collection_samples))


@register("published_studies", ("qc_manifests", "collections", "collection_samples"), _QC + _LABELS + """
SELECT DISTINCT lab.study_name, qc.workflow_version FROM qc JOIN lab ON lab.sample_id = qc.sample_id
""")
def q_published_studies(d):
    """Distinct (study, version) pairs with published qc rows."""
    return X.published_studies(_qc(d), E.study_labels(d.collections, d.collection_samples))


@register("find_sample_by_run", ("qc_manifests",), _QC + """
SELECT DISTINCT sample_id FROM qc WHERE contains(run_ids, 'SRR100001')
""")
def q_find_sample_by_run(d):
    """Samples whose run ids contain an accession fragment."""
    return X.find_sample_by_run(_qc(d), "SRR100001")


@register("etl_backlog", ("jobs", "etl_ingested"), """
, p AS (SELECT j.* FROM jobs j WHERE j.status = 'completed' AND j.workflow_id = 'shotgun'
          AND j.workflow_version = '1-URGENT'
          AND NOT EXISTS (SELECT 1 FROM etl_ingested w WHERE w.sample_id = j.sample_id
                          AND w.workflow_id = j.workflow_id AND w.workflow_version = j.workflow_version)),
b AS (SELECT count(*) AS backlog, min(completed_at) AS oldest_completed_at,
             (epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(min(completed_at))) / 3600.0 AS oldest_age_hours
      FROM p)
SELECT *, backlog >= 500 OR (backlog > 0 AND oldest_age_hours >= 24) AS ingest,
  CASE WHEN backlog >= 500 THEN 'threshold' WHEN backlog > 0 AND oldest_age_hours >= 24 THEN 'age'
       ELSE 'wait' END AS reason,
  CASE WHEN backlog >= 500 OR (backlog > 0 AND oldest_age_hours >= 24) THEN least(backlog, 1000)
       ELSE 0 END AS batch_size
FROM b
""")
def q_etl_backlog(d):
    """A27 + A28: backlog of the active shotgun version and the tick decision."""
    b = E.backlog(d.jobs, d.etl_ingested, "shotgun", "1-URGENT", AS_OF)
    return E.tick_decision(b)


@register("pending_queue", ("jobs", "etl_ingested"), """
SELECT j.sample_id, j.workflow_id, j.workflow_version, j.completed_at FROM jobs j
WHERE j.status = 'completed' AND j.workflow_id = 'shotgun' AND j.workflow_version = '1-URGENT'
  AND NOT EXISTS (SELECT 1 FROM etl_ingested w WHERE w.sample_id = j.sample_id
                  AND w.workflow_id = j.workflow_id AND w.workflow_version = j.workflow_version)
ORDER BY j.completed_at, j.sample_id LIMIT 100
""")
def q_pending_queue(d):
    """The next ETL batch (oldest completions first)."""
    return E.pending_queue(d.jobs, d.etl_ingested, "shotgun", "1-URGENT", limit=100)


@register("artifact_state", ("object_notifications",), """
, g AS (SELECT key,
    arg_max(size, (event_time, seq)) FILTER (WHERE event = 'create') AS size,
    arg_max(etag, (event_time, seq)) FILTER (WHERE event = 'create') AS etag,
    max((event_time, seq)) FILTER (WHERE event = 'create') AS lc,
    max((event_time, seq)) FILTER (WHERE event = 'delete') AS ld
  FROM object_notifications GROUP BY key)
SELECT key, size, etag, lc[1] AS created_at,
  CASE WHEN ld IS NOT NULL AND (lc IS NULL OR ld > lc) THEN ld[1] END AS archived_at
FROM g
""")
def q_artifact_state(d):
    """Current artifact rows from create/delete notifications (latest per key)."""
    return E.artifact_state(d.object_notifications)


@register("published_manifest", ("jobs", "samples", "workflows", "collections", "collection_samples"),
          _LABELS + """
SELECT j.sample_id, s.ncbi_accession AS run_ids, lab.study_name, j.workflow_id, j.workflow_version,
  's3://mirror/' || j.workflow_id || '/' || j.workflow_version || '/' || j.sample_id AS publish_prefix,
  j.completed_at
FROM jobs j LEFT JOIN samples s ON s.sample_id = j.sample_id LEFT JOIN lab ON lab.sample_id = j.sample_id
WHERE j.status = 'completed' AND j.completed_at >= TIMESTAMP '1998-01-01 00:00:00'
  AND EXISTS (SELECT 1 FROM workflows w WHERE w.workflow_id = j.workflow_id AND w.version = j.workflow_version)
""")
def q_published_manifest(d):
    """Completed jobs x samples x workflows since a cursor, with publish prefixes."""
    return E.published_manifest(d.jobs, d.samples, d.workflows, "s3://mirror",
                                since=dt.datetime(1998, 1, 1),
                                labels=E.study_labels(d.collections, d.collection_samples))


@register("profile_taxa", ("profile_lines", "profile_files", "qc_manifests", "taxa"), _PARSED + _QC + """
SELECT p.sample_id, p.workflow_version, p.branch, p.sgb_id, p.relative_abundance, t.lineage,
       qc.metaphlan_index AS db_version
FROM parsed p LEFT JOIN qc ON qc.sample_id = p.sample_id AND qc.workflow_id = p.workflow_id
  AND qc.workflow_version = p.workflow_version
LEFT JOIN taxa t ON t.sgb_id = p.sgb_id AND t.db_version = qc.metaphlan_index
WHERE p.sgb_id IS NOT NULL
""")
def q_profile_taxa(d):
    """SGB leaves of the parsed profiles with their taxon, joined on (sgb_id, db
    version); a sample's db version comes from its qc manifest."""
    prof = parse_metaphlan(_files(d)).filter(F.col("sgb_id").isNotNull())
    return (X.with_taxon(prof, _qc(d), d.taxa)
            .select("sample_id", "workflow_version", "branch", "sgb_id", "relative_abundance",
                    "lineage", "db_version"))


@register("lineage_rollup", ("profile_lines", "profile_files", "taxa"), _PARSED + f"""
SELECT p.sample_id, p.workflow_version, p.branch, t.lineage, {r2("sum(p.relative_abundance)")} AS relative_abundance
FROM parsed p JOIN taxa t ON t.sgb_id = p.sgb_id
WHERE p.sgb_id IS NOT NULL
GROUP BY p.sample_id, p.workflow_version, p.branch, t.lineage
""")
def q_lineage_rollup(d):
    """SGB leaf abundances relabelled to the taxon lineage and summed per sample."""
    prof = parse_metaphlan(_files(d))
    r = X.rollup_lineage(prof, d.taxa.select("sgb_id", "lineage"),
                         ["sample_id", "workflow_version", "branch"])
    return r.withColumn("relative_abundance", F.round("relative_abundance", 2))


_BRACKEN = r"""
, bf AS (SELECT sample_id, workflow_id, workflow_version, string_split(text, chr(10)) AS arr FROM bracken_files),
bl AS (SELECT sample_id, workflow_id, workflow_version, unnest(arr) AS line, unnest(range(len(arr))) AS line_no,
              list_filter(arr, lambda x: NOT regexp_matches(x, '^\s*$'))[1] AS first FROM bf),
bv AS (SELECT *, string_split(line, chr(9)) AS f, string_split(first, chr(9)) AS h FROM bl
       WHERE NOT regexp_matches(line, '^\s*$') AND line <> first),
bracken AS (
  SELECT sample_id, workflow_id, workflow_version, CAST(line_no AS INTEGER) AS line_no,
    f[list_position(h, 'name')] AS clade_name,
    CASE trim(f[list_position(h, 'taxonomy_lvl')]) WHEN 'D' THEN 'domain' WHEN 'K' THEN 'kingdom'
      WHEN 'P' THEN 'phylum' WHEN 'C' THEN 'class' WHEN 'O' THEN 'order' WHEN 'F' THEN 'family'
      WHEN 'G' THEN 'genus' WHEN 'S' THEN 'species' END AS rank,
    CASE WHEN regexp_matches(trim(f[list_position(h, 'taxonomy_id')]), '^-?\d+$')
          AND trim(f[list_position(h, 'taxonomy_id')]) <> '-1'
         THEN TRY_CAST(trim(f[list_position(h, 'taxonomy_id')]) AS INTEGER) END AS ncbi_taxid,
    CAST(trim(f[list_position(h, 'fraction_total_reads')]) AS DOUBLE) AS fraction_total_reads,
    CAST(CASE WHEN regexp_matches(trim(f[list_position(h, 'new_est_reads')]), '^-?\d+$')
          AND trim(f[list_position(h, 'new_est_reads')]) <> '-1'
         THEN TRY_CAST(trim(f[list_position(h, 'new_est_reads')]) AS INTEGER) END AS BIGINT) AS estimated_reads
  FROM bv WHERE len(f) >= len(h))
"""


@register("parse_bracken_reports", ("bracken_lines", "bracken_files"), _BRACKEN + "SELECT * FROM bracken")
def q_parse_bracken_reports(d):
    """S11 + F21: header-addressed bracken reports parsed per file; short rows dropped."""
    return O.parse_bracken(d.bracken_files)


@register("profiler_match", ("profile_lines", "profile_files", "bracken_lines", "bracken_files", "genus_map"),
          _PARSED + _BRACKEN + """
, mp AS (SELECT p.*, g.genus_taxid FROM parsed p LEFT JOIN genus_map g ON g.ncbi_taxid = p.ncbi_taxid
         WHERE p.rank = 'species' AND p.branch = 'full_data'),
sp AS (SELECT sample_id, workflow_id, workflow_version, ncbi_taxid, fraction_total_reads AS species_fraction
       FROM bracken WHERE rank = 'species'),
ge AS (SELECT sample_id, workflow_id, workflow_version, ncbi_taxid AS genus_taxid, fraction_total_reads AS genus_fraction
       FROM bracken WHERE rank = 'genus')
SELECT mp.sample_id, mp.workflow_version, mp.line_no, mp.clade_name, mp.ncbi_taxid, mp.genus_taxid,
  sp.species_fraction, ge.genus_fraction,
  CASE WHEN sp.species_fraction IS NOT NULL THEN 'species'
       WHEN ge.genus_fraction IS NOT NULL THEN 'genus' ELSE 'unmatched' END AS match_level
FROM mp
LEFT JOIN sp ON sp.sample_id = mp.sample_id AND sp.workflow_id = mp.workflow_id
  AND sp.workflow_version = mp.workflow_version AND sp.ncbi_taxid = mp.ncbi_taxid
LEFT JOIN ge ON ge.sample_id = mp.sample_id AND ge.workflow_id = mp.workflow_id
  AND ge.workflow_version = mp.workflow_version AND ge.genus_taxid = mp.genus_taxid
""")
def q_profiler_match(d):
    """Profile species matched to bracken rows of the same sample on species taxid,
    else on genus taxid, else unmatched (full_data branch)."""
    prof = parse_metaphlan(_files(d)).filter(F.col("branch") == "full_data").drop("branch")
    br = O.parse_bracken(d.bracken_files)
    m = X.match_profilers(prof, br, d.genus_map)
    return m.select("sample_id", "workflow_version", "line_no", "clade_name", "ncbi_taxid",
                    "genus_taxid", "species_fraction", "genus_fraction", "match_level")


@register("parse_resistome_reports", ("resistome_lines", "resistome_files"), r"""
, rf AS (SELECT sample_id, workflow_id, workflow_version, string_split(text, chr(10)) AS arr FROM resistome_files),
rl AS (SELECT sample_id, workflow_id, workflow_version, unnest(arr) AS line, unnest(range(len(arr))) AS line_no,
              list_filter(arr, lambda x: NOT regexp_matches(x, '^\s*$'))[1] AS first FROM rf),
rv AS (SELECT *, string_split(line, chr(9)) AS f,
              list_transform(string_split(first, chr(9)), lambda x: trim(regexp_replace(x, '^#+', ''))) AS h
       FROM rl WHERE NOT regexp_matches(line, '^\s*$') AND line <> first)
SELECT sample_id, workflow_id, workflow_version, CAST(line_no AS INTEGER) AS line_no,
  trim(f[list_position(h, 'Template')]) AS gene,
  CAST(trim(f[list_position(h, 'Template_Coverage')]) AS DOUBLE) AS template_coverage,
  CAST(trim(f[list_position(h, 'Template_Identity')]) AS DOUBLE) AS template_identity,
  CAST(trim(f[list_position(h, 'Depth')]) AS DOUBLE) AS depth,
  CAST(trim(f[list_position(h, 'Score')]) AS DOUBLE) AS score
FROM rv WHERE len(f) >= len(h)
""")
def q_parse_resistome_reports(d):
    """S12: '#'-header resistome reports with whitespace-padded numbers."""
    return O.parse_resistome(d.resistome_files)


_MARKERS = r"""
, mf AS (SELECT sample_id, workflow_id, workflow_version, string_split(text, chr(10)) AS arr FROM marker_files),
ml AS (SELECT sample_id, workflow_id, workflow_version, unnest(arr) AS line, unnest(range(len(arr))) AS line_no FROM mf),
mv AS (SELECT *, string_split(line, chr(9)) AS f FROM ml
       WHERE NOT regexp_matches(line, '^\s*$') AND NOT starts_with(line, '#'))
"""


@register("parse_marker_abundance", ("marker_lines", "marker_files"), _MARKERS + """
SELECT sample_id, workflow_id, workflow_version, CAST(line_no AS INTEGER) AS line_no,
       f[1] AS marker_name, TRY_CAST(f[2] AS DOUBLE) AS value
FROM mv WHERE len(f) >= 2 AND TRY_CAST(f[2] AS DOUBLE) IS NOT NULL
""")
def q_parse_marker_abundance(d):
    """Marker abundances; rows without a parsable value are skipped."""
    return O.parse_marker_abundance(d.marker_files)


@register("parse_marker_presence", ("marker_lines", "marker_files"), _MARKERS + """
SELECT sample_id, workflow_id, workflow_version, CAST(line_no AS INTEGER) AS line_no, f[1] AS marker_name
FROM mv WHERE f[1] <> ''
""")
def q_parse_marker_presence(d):
    """Marker presence; a listed marker is present, the value is dropped."""
    return O.parse_marker_presence(d.marker_files)
