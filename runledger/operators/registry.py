"""Sample identity, registration and catalog maintenance.

All operators work on whole batches: an archive report of many studies, a curation sheet
of many rows, a catalog of many samples. Identity is content-derived (md5 of the sorted
distinct run accessions), so grouping and de-duplication are plain hash aggregations.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import (canon_label, classify_source, derive_sample_id, has_accession,
                                  is_amplicon, is_orphan, normalize_srrs, parse_srrs, sample_id)
from ..functions.parse import json_drop_key
from .keyed import KeyedTable, first_per_key
from .state import insert_ignore, latest_per_key, upsert

LIBRARY_FIELDS = ("library_strategy", "library_selection", "library_source", "instrument_platform")


def sample_identity(samples: DataFrame) -> DataFrame:
    """F9-F13 + P11: content id, normalised accession list and validity per sample row."""
    acc = F.col("ncbi_accession")
    return samples.select(
        "sample_id", "ncbi_accession",
        normalize_srrs(parse_srrs(acc)).alias("normalized_accession"),
        F.when(has_accession(acc), sample_id(acc)).alias("content_id"),
        derive_sample_id(acc).alias("derived_id"),
        has_accession(acc).alias("has_accession"),
        is_orphan(acc).alias("is_orphan"))


def _blank_to_null(c):
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def group_runs(reports: DataFrame, collection_col: str = "source_accession",
               pos_col: str = "pos") -> DataFrame:
    """Run rows -> samples keyed by (collection, secondary sample accession).

    Rows missing either accession are dropped. A sample's runs are its sorted distinct run
    accessions; its attributes come from its first row (by ``pos_col``)."""
    r = (reports.withColumn("_srr", F.trim("run_accession"))
         .withColumn("_srs", F.trim("secondary_sample_accession"))
         .filter((F.coalesce(F.col("_srr"), F.lit("")) != "") & (F.coalesce(F.col("_srs"), F.lit("")) != "")))
    first = F.struct(F.col(pos_col), _blank_to_null("sample_accession").alias("biosample"),
                     _blank_to_null("secondary_study_accession").alias("sra_study"),
                     _blank_to_null("study_accession").alias("bioproject"))
    g = (r.groupBy(F.col(collection_col).alias("collection_id"), F.col("_srs").alias("sra_sample"))
         .agg(F.collect_set("_srr").alias("runs"), F.min_by(first, F.col(pos_col)).alias("first")))
    acc = normalize_srrs(F.col("runs"))
    return g.select(
        "collection_id", "sra_sample",
        F.md5(acc).alias("sample_id"), acc.alias("ncbi_accession"),
        F.col("first.biosample").alias("biosample_id"),
        F.col("first.sra_study").alias("sra_study"),
        F.col("first.bioproject").alias("bioproject"),
        F.size("runs").alias("n_runs"))


def library_composition(reports: DataFrame, by: str = "source_accession",
                        pos_col: str = "pos") -> DataFrame:
    """Per collection and library field, the count of each (stripped) value; blank ->
    'unknown'. ``rank`` orders by count, ties by first appearance."""
    long = (reports.select(by, pos_col, *LIBRARY_FIELDS)
            .unpivot([by, pos_col], list(LIBRARY_FIELDS), "field", "raw")
            .withColumn("value", canon_label("raw")))
    g = long.groupBy(by, "field", "value").agg(F.count(F.lit(1)).alias("n"),
                                               F.min(pos_col).alias("first_pos"))
    w = Window.partitionBy(by, "field").orderBy(F.desc("n"), F.asc("first_pos"))
    return g.withColumn("rank", F.row_number().over(w)).drop("first_pos")


# Fixed value: wording of the report.
AMPLICON_WARNING = ("%d of %d run(s) look like amplicon/16S (library_strategy=AMPLICON or "
                    "library_selection=PCR), not shotgun metagenomics")


def amplicon_warnings(reports: DataFrame, by: str = "source_accession") -> DataFrame:
    """Studies whose runs look like amplicon/16S (AMPLICON strategy or PCR selection);
    the flagged count is max(#amplicon, #pcr) of all runs."""
    n_amp = F.count_if(F.upper(F.trim("library_strategy")) == "AMPLICON")
    n_pcr = F.count_if(F.upper(F.trim("library_selection")) == "PCR")
    g = reports.groupBy(by).agg(n_amp.alias("n_amplicon"), n_pcr.alias("n_pcr"),
                                F.count(F.lit(1)).alias("n_runs"))
    flagged = F.greatest("n_amplicon", "n_pcr")
    return (g.filter(flagged > 0).withColumn("flagged", flagged)
            .withColumn("warning", F.format_string(AMPLICON_WARNING, F.col("flagged"), F.col("n_runs"))))


def is_amplicon_run(reports: DataFrame) -> DataFrame:
    """F16 as a column on run rows."""
    return reports.withColumn("is_amplicon", is_amplicon("library_strategy", "library_selection"))


def count_new(grouped: DataFrame, catalog: DataFrame, by: str = "collection_id") -> DataFrame:
    """Per submission, samples found / added (not in the catalog) / existing."""
    ids = grouped.select(by, "sample_id").distinct()
    known = catalog.select("sample_id").distinct().withColumn("_known", F.lit(1))
    j = ids.join(known, "sample_id", "left")
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("samples_found"),
                             F.count_if(F.col("_known").isNull()).alias("samples_added"),
                             F.count_if(F.col("_known").isNotNull()).alias("samples_existing"))


def source_of(accessions: DataFrame, col: str = "accession") -> DataFrame:
    """study source per submitted accession; unsupported ones get NULL (rejected)."""
    return accessions.withColumn("source", classify_source(col))


def curation_rows(rows: DataFrame, accession_col: str = "ncbi_accession",
                  index_col: str = "row_index", study_col: str = "study_name") -> tuple[DataFrame, DataFrame]:
    """U8 parse step: (valid annotation rows, dropped rows).

    A row without a non-blank accession token is dropped and reported with its index and
    subject label; a valid row gets its content id and keeps every other column as JSON
    metadata."""
    acc = F.trim(F.col(accession_col))
    subject = F.coalesce(*[F.col(c) for c in ("subject_id", "sample_id", "Subject_id", "Sample_id")
                           if c in rows.columns] or [F.lit(None).cast("string")])
    ok = has_accession(acc)
    meta_cols = [c for c in rows.columns if c not in (accession_col, index_col, study_col, "source_file")]
    valid = rows.filter(ok).select(
        sample_id(acc).alias("sample_id"), F.col(study_col).alias("study_name"),
        acc.alias("ncbi_accession"),
        F.to_json(F.struct(*[F.col(c) for c in meta_cols])).alias("metadata"), F.col(index_col).alias("row_index"))
    dropped = rows.filter(~ok).select(F.col(study_col).alias("study_name"),
                                      F.col(index_col).alias("row_index"),
                                      subject.alias("subject_id"))
    return valid, dropped


def import_curation(rows: DataFrame, annotations: DataFrame, **kw) -> dict[str, DataFrame]:
    """U8: upsert annotations keyed (sample_id, study_name); report per-study counts.

    rows_updated counts incoming keys that already had an annotation."""
    parsed, dropped = curation_rows(rows, **kw)
    keys = ["sample_id", "study_name"]
    # of several rows of one key the last in row order stays
    valid = latest_per_key(parsed, keys, ["row_index"]).drop("row_index")
    updated = valid.join(annotations.select(*keys), keys, "left_semi")
    summary = (parsed.groupBy("study_name").agg(F.count(F.lit(1)).alias("rows_loaded"))
               .join(updated.groupBy("study_name").agg(F.count(F.lit(1)).alias("rows_updated")),
                     "study_name", "full_outer")
               .join(dropped.groupBy("study_name").agg(F.count(F.lit(1)).alias("rows_dropped")),
                     "study_name", "full_outer")
               .select("study_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                       for c in ("rows_loaded", "rows_updated", "rows_dropped")]))
    table = upsert(annotations, valid, keys, ["ncbi_accession", "metadata"])
    return {"annotations": table, "dropped": dropped, "summary": summary}


def register_samples(samples: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert samples; metadata always replaced, accession/biosample only when given."""
    cols = ["metadata"] + [c for c in ("ncbi_accession", "biosample_id") if c in incoming.columns]
    src = incoming
    for c in ("ncbi_accession", "biosample_id"):
        if c in src.columns:
            src = src.withColumn(c, F.nullif(F.trim(F.col(c)), F.lit("")))
    merged = upsert(samples, src, ["sample_id"], cols)
    # a NULL incoming accession/biosample keeps the stored value
    old = samples.select("sample_id", *[F.col(c).alias(f"_o_{c}") for c in cols if c != "metadata"])
    out = merged.join(old, "sample_id", "left")
    for c in cols:
        if c != "metadata":
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_o_{c}"))).drop(f"_o_{c}")
    return out


def register_into(samples: KeyedTable, members: KeyedTable, incoming: DataFrame) -> DataFrame:
    """U3 on bucketed tables: upsert samples and attach them to their collections, touching only
    the buckets of the samples named; returns their rows with ``collections``, all of a sample's
    memberships in order.

    ``incoming``: sample_id, metadata, and any of ncbi_accession, biosample_id, collection_id
    (null: no collection). The accession is stored in its normal form; a blank accession or
    biosample keeps the stored one. ``members`` is keyed by (collection_id, sample_id) and
    bucketed by sample. Of several rows of one sample the first by text counts, but every row's
    collection is attached."""
    rows = incoming
    if "ncbi_accession" in rows.columns:
        rows = rows.withColumn("ncbi_accession", F.nullif(normalize_srrs(parse_srrs(F.col("ncbi_accession"))), F.lit("")))
    if "biosample_id" in rows.columns:
        rows = rows.withColumn("biosample_id", F.nullif(F.trim("biosample_id"), F.lit("")))
    samples.upsert(rows.drop("collection_id"), keep_if_null=("ncbi_accession", "biosample_id"))
    if "collection_id" in rows.columns:
        members.insert_ignore(rows.filter("collection_id is not null").select("collection_id", "sample_id"))
    of_sample = (members.lookup(rows.select("sample_id")).groupBy("sample_id")
                 .agg(F.array_sort(F.collect_set("collection_id")).alias("collections")))
    return (samples.lookup(rows).join(of_sample, "sample_id", "left")
            .withColumn("collections", F.coalesce("collections", F.array().cast("array<string>"))))


def add_memberships(members: DataFrame, new_members: DataFrame) -> DataFrame:
    """U4 membership part: idempotent attach of (collection, sample) pairs."""
    return insert_ignore(members, new_members.select("collection_id", "sample_id"),
                         ["collection_id", "sample_id"])


def reconcile_jobs(samples: DataFrame, workflows: DataFrame, jobs: DataFrame) -> DataFrame:
    """The pending jobs missing for sample x active workflow version.

    The active registry holds at most one version per workflow; it is folded into one array
    value (a scalar subquery) and exploded per sample, then anti-joined with existing jobs."""
    active = (workflows.filter(F.col("status") == "active")
              .agg(F.collect_list(F.struct(F.col("workflow_id"),
                                           F.col("version").alias("workflow_version")))))
    wanted = (samples.select("sample_id", F.explode(active.scalar()).alias("w"))
              .select("sample_id", "w.workflow_id", "w.workflow_version"))
    return (wanted.join(jobs.select("sample_id", "workflow_id", "workflow_version"),
                        ["sample_id", "workflow_id", "workflow_version"], "left_anti")
            .withColumn("status", F.lit("pending")))


def orphan_cleanup(samples: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """U13 (dry run): rows that deleting orphan samples would remove, per table."""
    orphans = samples.filter(is_orphan("ncbi_accession")).select("sample_id")
    out = orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit("samples").alias("table"), "n")
    for name, df in tables.items():
        out = out.unionByName(df.join(orphans, "sample_id", "left_semi")
                              .agg(F.count(F.lit(1)).alias("n"))
                              .select(F.lit(name).alias("table"), "n"))
    return out


def remove_orphans(samples: DataFrame, df: DataFrame) -> DataFrame:
    """U13 (apply): ``df`` without rows of orphan samples."""
    orphans = samples.filter(is_orphan("ncbi_accession")).select("sample_id")
    return df.join(orphans, "sample_id", "left_anti")


def id_map(samples: DataFrame) -> DataFrame:
    """Old sample id -> content id recomputed from the accession (changed ids only)."""
    return (samples.filter(has_accession("ncbi_accession"))
            .select(F.col("sample_id").alias("old_id"), sample_id("ncbi_accession").alias("new_id"))
            .filter(F.col("old_id") != F.col("new_id")))


def remap_sample_ids(df: DataFrame, mapping: DataFrame, col: str = "sample_id") -> DataFrame:
    """Propagate the id map to a table referencing samples."""
    m = mapping.withColumnRenamed("old_id", col)
    return (df.join(m, col, "left")
            .withColumn(col, F.coalesce(F.col("new_id"), F.col(col))).drop("new_id"))


def backfill_collections(samples: DataFrame) -> dict[str, DataFrame]:
    """Distinct ``metadata.cohort`` values -> collections and memberships; the key is
    stripped from the metadata."""
    cohort = F.get_json_object("metadata", "$['cohort']")
    tagged = samples.withColumn("_cohort", cohort).filter(F.col("_cohort").isNotNull())
    cols = tagged.select(F.col("_cohort").alias("collection_id")).distinct().select(
        "collection_id", F.lit("metadata").alias("source"), F.col("collection_id").alias("label"))
    members = tagged.select(F.col("_cohort").alias("collection_id"), "sample_id")
    stripped = samples.withColumn(
        "metadata", F.when(cohort.isNotNull(), json_drop_key("metadata", "cohort")).otherwise(F.col("metadata")))
    return {"collections": cols, "members": members, "samples": stripped}


def enforce_one_active(workflows: DataFrame) -> DataFrame:
    """U16 + W4: keep the newest active version per workflow active, retire the others."""
    w = Window.partitionBy("workflow_id").orderBy(F.desc("created_at"), F.desc("version"))
    act = F.col("status") == "active"
    actives = workflows.filter(act).withColumn("_rk", F.row_number().over(w)).select(
        "workflow_id", "version", "_rk")
    return (workflows.join(actives, ["workflow_id", "version"], "left")
            .withColumn("status", F.when(act & (F.col("_rk") > 1), F.lit("retired"))
                        .otherwise(F.col("status")))
            .drop("_rk"))


def purge_pending(jobs: DataFrame, workflows: DataFrame) -> DataFrame:
    """Drop pending jobs of retired versions. Pausing is reversible and purges
    nothing."""
    return jobs.join(purgeable_jobs(jobs, workflows).select("job_id"), "job_id", "left_anti")


def purgeable_jobs(jobs: DataFrame, workflows: DataFrame) -> DataFrame:
    """The pending jobs of retired versions (their count is the purge report)."""
    retired = workflows.filter(F.col("status") == "retired").select(
        "workflow_id", F.col("version").alias("workflow_version"))
    return jobs.filter(F.col("status") == "pending").join(
        retired, ["workflow_id", "workflow_version"], "left_semi")


def set_workflow_status(workflows: DataFrame, workflow_id: str, version: str,
                        status: str) -> DataFrame:
    """Set a version's status; activating retires the workflow's other active version."""
    if status not in ("active", "paused", "retired"):
        raise ValueError("status must be active, paused or retired")
    me = (F.col("workflow_id") == workflow_id) & (F.col("version") == version)
    same_wf = F.col("workflow_id") == workflow_id
    new = F.when(me, F.lit(status))
    if status == "active":
        new = new.when(same_wf & (F.col("status") == "active"), F.lit("retired"))
    return workflows.withColumn("status", new.otherwise(F.col("status")))


def latest_agents(agents: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Heartbeat upsert - first ``started_at`` kept, latest values otherwise."""
    allrows = agents.unionByName(heartbeats, allowMissingColumns=True)
    latest = F.max_by(F.struct(*[c for c in allrows.columns if c not in ("agent_id", "started_at")]),
                      F.struct("last_seen_at", *[c for c in allrows.columns if c not in ("agent_id", "started_at", "last_seen_at")]))
    return (allrows.groupBy("agent_id")
            .agg(F.min("started_at").alias("started_at"), latest.alias("s"))
            .select("agent_id", "started_at", "s.*"))


def add_to_collection(collections: DataFrame, members: DataFrame, new: DataFrame,
                      now) -> tuple[DataFrame, DataFrame]:
    """U4: upsert collections (label defaults to the id; re-declaring only bumps
    ``updated_at``) and attach their samples idempotently. ``new`` rows:
    (collection_id, source, type, label, sample_id)."""
    decl = (new.select("collection_id", "source", "type",
                       F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("collection_id")).alias("label"))
            .transform(first_per_key, ["collection_id"])
            .withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
            .withColumn("updated_at", F.lit(now).cast("timestamp_ntz")))
    if "updated_at" not in collections.columns:
        collections = collections.withColumn("updated_at", F.col("created_at"))
    cols = upsert(collections, decl, ["collection_id"], ["updated_at"])
    mem = add_memberships(members, new.filter(F.col("sample_id").isNotNull()))
    return cols, mem


def register_workflow(workflows: DataFrame, jobs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert workflow versions. A registered version becomes the one to run: other
    active versions of the same workflow are retired and their pending jobs purged; an
    existing row keeps its status (the reference behaviour; see README). Of several versions
    of one workflow in a batch, only the last (by ``created_at``, then version) is active."""
    keys = ["workflow_id", "version"]
    new = first_per_key(new, keys)
    order = [F.desc(c) for c in ("created_at", "version") if c in new.columns]
    last = F.row_number().over(Window.partitionBy("workflow_id").orderBy(*order)) == 1
    incoming = new.withColumn("status", F.when(last, F.lit("active")).otherwise(F.lit("retired")))
    keep = incoming.filter("status = 'active'").select("workflow_id", F.col("version").alias("_keep"))
    retire = (workflows.join(keep, "workflow_id")
              .filter((F.col("status") == "active") & (F.col("version") != F.col("_keep")))
              .select(*keys).distinct().withColumn("_retire", F.lit(True)))
    wf = (workflows.join(retire, keys, "left")
          .withColumn("status", F.when(F.col("_retire"), F.lit("retired")).otherwise(F.col("status")))
          .drop("_retire"))
    upd = [c for c in new.columns if c not in keys and c != "status"]
    out = upsert(wf, incoming, keys, upd)
    return out, purge_pending(jobs, out)


def register_accessions(reports: DataFrame, samples: DataFrame, collections: DataFrame,
                        members: DataFrame, submitted_by: str, now, dry_run: bool = False,
                        by: str = "source_accession") -> dict[str, DataFrame]:
    """U9 + U20 for a batch of submitted study accessions (one per distinct ``by``).

    Per accession: classify the source (F14), group its runs into samples (A24), count
    found / added / existing (A26). Accessions that are not study/project accessions or
    have no runs fail and are audited. Unless ``dry_run``: new samples are inserted
    (existing ones keep their metadata), the collection (upper-cased accession, type
    'project') is upserted with its memberships, and an audit row is appended per
    accession, successes and failures alike. A dry run returns the receipts only."""
    acc = F.trim(F.col(by))
    subs = reports.select(acc.alias("accession")).distinct()
    subs = (subs.withColumn("collection_id", F.upper("accession"))
            .withColumn("source", classify_source("accession")))
    grouped = group_runs(reports.withColumn(by, F.upper(F.trim(F.col(by)))), collection_col=by)
    counts = count_new(grouped, samples)
    rec = (subs.join(counts, "collection_id", "left")
           .select("accession", "collection_id", "source",
                   *[F.coalesce(c, F.lit(0)).alias(c) for c in ("samples_found", "samples_added",
                                                                "samples_existing")]))
    error = (F.when(F.col("source").isNull(), F.lit("not a study/BioProject accession"))
             .when(F.col("samples_found") == 0, F.lit("no runs found")))
    status = (F.when(error.isNotNull(), F.lit("failed"))
              .otherwise(F.lit("dry_run" if dry_run else "succeeded")))
    receipts = (rec.withColumn("error", error).withColumn("status", status)
                .withColumn("type", F.lit("project")))
    if dry_run:
        return {"receipts": receipts, "samples": samples, "collections": collections,
                "members": members}
    receipts = receipts.withColumn(
        "submission_id", F.md5(F.concat_ws("|", "accession", F.lit(str(now)), F.lit(submitted_by))))
    ok = receipts.filter(F.col("status") == "succeeded").select("collection_id", "source")
    g_ok = grouped.join(ok, "collection_id", "left_semi")
    new_samples = g_ok.select("sample_id", "ncbi_accession", "biosample_id",
                              F.to_json(F.struct("sra_sample", F.col("biosample_id").alias("biosample"),
                                                 "sra_study", "bioproject",
                                                 F.col("collection_id").alias("collection"))).alias("metadata"))
    out_samples = insert_ignore(samples, first_per_key(new_samples, ["sample_id"]), ["sample_id"])
    decl = (g_ok.select("collection_id", "sample_id").join(ok, "collection_id")
            .withColumn("type", F.lit("project")).withColumn("label", F.col("collection_id")))
    cols, mem = add_to_collection(collections, members, decl, now)
    audit = receipts.select("submission_id", F.lit("ena_accession").alias("method"), "accession",
                            "collection_id", "status", "error", "samples_found", "samples_added",
                            "samples_existing", F.lit(submitted_by).alias("submitted_by"),
                            F.lit(now).cast("timestamp_ntz").alias("submitted_at"))
    return {"receipts": receipts, "samples": out_samples, "collections": cols, "members": mem,
            "submissions": audit}


def ingest_sample_rows(rows: DataFrame, collection: str | None = None,
                       limit: int | None = None) -> dict[str, DataFrame]:
    """Bulk registration from sheet rows (``ncbi_accession``, ``study_name``,
    ``row_index``). Rows without a real run accession are skipped; the collection is the
    given one or the row's study name (none -> registered but unattached). ``limit`` caps
    the *registered* rows in row order; rows after the cut-off are not looked at, as in a
    sequential pass. Returns the registrations and one row of counters."""
    acc = F.trim("ncbi_accession")
    r = rows.withColumn("sample_id", derive_sample_id(acc)).withColumn(
        "collection_id", F.lit(collection) if collection else F.nullif(F.trim("study_name"), F.lit("")))
    valid = r.filter(F.col("sample_id").isNotNull())
    if limit is not None:
        cutoff = valid.orderBy("row_index").limit(limit).agg(F.max("row_index"),
                                                            F.count(F.lit(1)).alias("n"))
        cut = F.when(cutoff.select(F.col("n")).scalar() >= limit,
                     cutoff.select("max(row_index)").scalar())
        r = r.filter(cut.isNull() | (F.col("row_index") <= cut))
        valid = r.filter(F.col("sample_id").isNotNull())
    regs = valid.select("row_index", "sample_id", acc.alias("ncbi_accession"), "collection_id")
    counters = r.agg(F.count_if(F.col("sample_id").isNotNull()).alias("registered"),
                     F.count_if(F.col("sample_id").isNull()).alias("skipped"),
                     F.count_if(F.col("sample_id").isNotNull() & F.col("collection_id").isNull())
                     .alias("unattached"))
    return {"registrations": regs, "counters": counters}


def backfill_type(collections: DataFrame) -> DataFrame:
    """Collection type from its source."""
    return collections.withColumn(
        "type", F.when(F.col("source") == "sra_study", F.lit("study"))
        .when(F.col("source") == "bioproject", F.lit("project")).otherwise(F.col("type")))


def upsert_studies(studies: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """U8: curated study records by name. A re-import updates the source file and load time;
    stored metadata is replaced only by metadata that is given."""
    new = latest_per_key(incoming, ["study_name"], ["source_file"]).select(
        "study_name", F.col("source_file").alias("_f"), F.nullif(F.nullif(F.trim("metadata"), F.lit("")), F.lit("{}")).alias("_m"))
    j = studies.join(new, "study_name", "full_outer")
    hit = F.col("_f").isNotNull()
    return j.select("study_name", F.coalesce("_f", "source_file").alias("source_file"), F.coalesce("_m", "metadata").alias("metadata"),
                    F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("loaded_at")).alias("loaded_at"))


def study_samples_page(annotations: DataFrame, study_name: str, limit: int = 100,
                       offset: int = 0) -> DataFrame:
    """One study's annotated samples by sample id."""
    page = annotations.filter(F.col("study_name") == study_name).orderBy("sample_id")
    return page.limit(offset + limit).offset(offset) if offset else page.limit(limit)


def sample_annotations(annotations: DataFrame, sample_id: str) -> DataFrame:
    """A sample's annotations, ordered by study."""
    return annotations.filter(F.col("sample_id") == sample_id).orderBy("study_name")


def studies(curated_studies: DataFrame) -> DataFrame:
    """Curated studies by name."""
    return curated_studies.orderBy("study_name")
