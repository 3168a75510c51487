"""Lake analyses over parsed profiles and qc rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_taxa(profile: DataFrame, labels: DataFrame, version: str, data_type: str, rank: str,
             k: int = 10) -> DataFrame:
    """Per study, the k clades with the highest mean abundance (pinned version,
    branch and rank). ``row_number() <= k`` runs as a window group limit."""
    p = profile.filter((F.col("rank") == rank) & (F.col("data_type") == data_type)
                       & (F.col("workflow_version") == version))
    m = (p.join(labels, "sample_id").groupBy("study_name", "clade_name")
         .agg(F.avg("relative_abundance").alias("mean_abundance"), F.count(F.lit(1)).alias("n_samples")))
    w = Window.partitionBy("study_name").orderBy(F.desc("mean_abundance"), F.asc("clade_name"))
    return (m.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")
            .withColumn("mean_abundance", F.round("mean_abundance", 2)))


def study_depth(qc: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples and mean raw read depth per study."""
    return (qc.join(labels, "sample_id").groupBy("study_name")
            .agg(F.count_distinct("sample_id").alias("samples"),
                 F.round(F.avg("reads_raw"), 2).alias("mean_reads_raw")))


def published_studies(qc: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (study, version) pairs present in the lake."""
    return qc.join(labels, "sample_id").select("study_name", "workflow_version").distinct()


def find_sample_by_run(qc: DataFrame, accession: str) -> DataFrame:
    """Samples whose ';'-joined run ids contain ``accession``."""
    return qc.filter(F.col("run_ids").contains(accession)).select("sample_id").distinct()


def with_taxon(profile: DataFrame, qc: DataFrame, taxon: DataFrame) -> DataFrame:
    """Profile rows with their taxon, joined on (sgb_id, db_version); the db version of
    a published sample comes from the qc row of the same sample, workflow and version, so rows
    never fan out across versions."""
    keys = [k for k in ("sample_id", "workflow", "version", "workflow_id", "workflow_version")
            if k in profile.columns and k in qc.columns]
    dbv = qc.select(*keys, F.col("metaphlan_index").alias("db_version"))
    return profile.join(dbv, keys, "left").join(taxon, ["sgb_id", "db_version"], "left")


def rollup_lineage(profile: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """Leaf (SGB) abundances re-labelled to another lineage and summed per label;
    the total per sample is conserved."""
    leaves = profile.filter(F.col("sgb_id").isNotNull())
    return (leaves.join(mapping, "sgb_id").groupBy(*by, "lineage")
            .agg(F.sum("relative_abundance").alias("relative_abundance")))


def match_profilers(metaphlan: DataFrame, bracken: DataFrame, genus_of: DataFrame) -> DataFrame:
    """Each metaphlan species row matched to bracken in the same sample on the species
    taxid, else on its genus taxid (``genus_of``: species ncbi_taxid -> genus_taxid), else
    unmatched; ``match_level`` says which."""
    keys = ["sample_id", "workflow_id", "workflow_version", "data_type"]
    keys = [k for k in keys if k in metaphlan.columns and k in bracken.columns]
    mp = (metaphlan.filter(F.col("rank") == "species")
          .join(genus_of.select("ncbi_taxid", "genus_taxid"), "ncbi_taxid", "left"))
    sp = (bracken.filter(F.col("rank") == "species")
          .select(*keys, F.col("ncbi_taxid"), F.col("fraction_total_reads").alias("species_fraction")))
    ge = (bracken.filter(F.col("rank") == "genus")
          .select(*keys, F.col("ncbi_taxid").alias("genus_taxid"),
                  F.col("fraction_total_reads").alias("genus_fraction")))
    j = (mp.join(sp, keys + ["ncbi_taxid"], "left")
         .join(ge, keys + ["genus_taxid"], "left"))
    level = (F.when(F.col("species_fraction").isNotNull(), F.lit("species"))
             .when(F.col("genus_fraction").isNotNull(), F.lit("genus")).otherwise(F.lit("unmatched")))
    return j.withColumn("match_level", level)
