"""Lake tables and idempotent writes without a transactional format.

Replace-per-sample is *append + latest-wins*: every ingest appends its rows tagged with an
``ingest_id`` and, last of all, appends watermark rows naming the valid ingest per
``(sample_id, workflow, version)``. Readers keep only rows whose ingest id is the latest one
in the watermark, so

* a re-ingest replaces a sample's rows in every table at once (K2, K3);
* a crash between the data and the watermark leaves unlisted rows invisible;
* no job reads and overwrites the same path.

Tables are Parquet, partitioned by ``workflow/version[/data_type]`` and clustered by
``sample_id`` within files; ``compact`` rewrites only live rows into a new version
directory.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_root

_ID = [("sample_id", T.StringType()), ("study_name", T.StringType()), ("run_ids", T.StringType()),
       ("workflow", T.StringType()), ("version", T.StringType())]
_BRANCH = [("data_type", T.StringType())]


def _schema(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# The six lake tables and their columns.
SCHEMAS: dict[str, T.StructType] = {
    "taxonomic_profile_metaphlan": _schema(_ID + _BRANCH + [
        ("clade_name", T.StringType()), ("rank", T.StringType()), ("ncbi_taxid", T.IntegerType()),
        ("sgb_id", T.StringType()), ("relative_abundance", T.DoubleType()),
        ("coverage", T.DoubleType()), ("estimated_reads", T.LongType())]),
    "taxonomic_profile_bracken": _schema(_ID + _BRANCH + [
        ("clade_name", T.StringType()), ("rank", T.StringType()), ("ncbi_taxid", T.IntegerType()),
        ("fraction_total_reads", T.DoubleType()), ("estimated_reads", T.LongType())]),
    "resistome": _schema(_ID + _BRANCH + [
        ("gene", T.StringType()), ("template_coverage", T.DoubleType()),
        ("template_identity", T.DoubleType()), ("depth", T.DoubleType()), ("score", T.DoubleType())]),
    "qc_metrics": _schema(_ID + [
        ("reads_raw", T.LongType()), ("reads_decontaminated", T.LongType()),
        ("bases_raw", T.LongType()), ("bases_decontaminated", T.LongType()),
        ("reads_surviving_fraction", T.DoubleType()), ("bases_surviving_fraction", T.DoubleType()),
        ("metaphlan_index", T.StringType()), ("pipeline_version", T.StringType()),
        ("git_commit", T.StringType())]),
    "marker_abundance": _schema(_ID + _BRANCH + [("marker_name", T.StringType()), ("value", T.DoubleType())]),
    "marker_presence": _schema(_ID + _BRANCH + [("marker_name", T.StringType())]),
}
KEY = ["sample_id", "workflow", "version"]
WATERMARK = "etl_ingested"


def partition_cols(table: str) -> list[str]:
    return ["workflow", "version"] + (["data_type"] if "data_type" in SCHEMAS[table].fieldNames() else [])


def stored_schema(table: str) -> T.StructType:
    return T.StructType(SCHEMAS[table].fields + [T.StructField("ingest_id", T.StringType())])


def ensure_schema(spark: SparkSession, base: str) -> None:
    """K1: create every lake table (empty, with its schema) if missing."""
    import pyarrow.fs as pafs
    for name, schema in SCHEMAS.items():
        path = f"{base.rstrip('/')}/{name}"
        fs, p = pafs.FileSystem.from_uri(path if "://" in path else default_root(spark) + path)
        if fs.get_file_info(p).type == pafs.FileType.NotFound:
            (spark.createDataFrame([], stored_schema(name))
             .write.mode("append").partitionBy(*partition_cols(name)).parquet(path))


def align(rows: DataFrame, table: str) -> DataFrame:
    """K5: project rows on the table's columns; missing -> NULL, extras dropped."""
    schema = SCHEMAS[table]
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in rows.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*cols, *(["ingest_id"] if "ingest_id" in rows.columns else []))


def write_tables(tables: dict[str, DataFrame], base: str, ingest_id: str, rows_per_file: int = 2_000_000,
                 parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, int]:
    """K2 data half: append each table's rows for this ingest, clustered by sample. Returns the
    rows of each table, observed by the write itself (A29).

    A table named in ``parsers`` is given as its files (the table's partition columns,
    ``sample_id`` and what the parser reads, whose rows keep these columns): the files are
    clustered and then parsed by the tasks that write, so that texts are moved, not parsed rows,
    and a file is parsed once, not for the bounds of the ranges, too."""
    written = {}
    for name, rows in tables.items():
        seen = Observation(f"rows-{name}")
        parts = partition_cols(name)
        parse = (parsers or {}).get(name)
        # range-partition on (partition columns, sample): a hot workflow/version directory is
        # split over many tasks while each file stays clustered by sample
        if parse is None:
            df = align(rows, name).repartitionByRange(*parts, "sample_id")
        else:
            df = align(parse(rows.repartitionByRange(*parts, "sample_id")), name)
        df = (df.withColumn("ingest_id", F.lit(ingest_id)).sortWithinPartitions(*parts, "sample_id")
              .observe(seen, F.count(F.lit(1)).alias("n")))
        (df.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd")
         .partitionBy(*parts).parquet(f"{base.rstrip('/')}/{name}"))
        written[name] = seen.get["n"]
    return written


def mark_ingested(counts: DataFrame, base: str, ingest_id: str, at) -> DataFrame:
    """K4/K3 second half: append watermark rows (one per key) naming this ingest and its
    per-table row counts. Written after the data, so a crash before it hides the data."""
    wm = (counts.groupBy(*KEY)
          .agg(F.map_from_entries(F.collect_list(F.struct("table", "n"))).alias("row_counts"))
          .withColumn("ingest_id", F.lit(ingest_id))
          .withColumn("ingested_at", F.lit(at).cast("timestamp_ntz")))
    wm.write.mode("append").parquet(f"{base.rstrip('/')}/{WATERMARK}")
    return wm


WATERMARK_SCHEMA = _schema([(k, T.StringType()) for k in KEY] + [
    ("row_counts", T.MapType(T.StringType(), T.LongType())), ("ingest_id", T.StringType()),
    ("ingested_at", T.TimestampNTZType())])


def watermark_history(spark: SparkSession, base: str) -> DataFrame:
    """All watermark rows; none before the first ingest."""
    path = f"{base.rstrip('/')}/{WATERMARK}"
    try:
        return spark.read.schema(WATERMARK_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], WATERMARK_SCHEMA)


def read_watermark(spark: SparkSession, base: str) -> DataFrame:
    """Latest watermark row per key (an upsert by key, read side)."""
    wm = watermark_history(spark, base)
    w = Window.partitionBy(*KEY).orderBy(F.desc("ingested_at"), F.desc("ingest_id"))
    return wm.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def watermark_keys(wm: DataFrame) -> DataFrame:
    """The watermark keyed like jobs: (sample_id, workflow_id, workflow_version)."""
    return (wm.withColumnRenamed("workflow", "workflow_id")
            .withColumnRenamed("version", "workflow_version"))


def live(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Latest-wins: rows of the current ingest of their key only (K2/K3 read side).

    Rows of an ingest that never reached the watermark are left out by its id; of the others
    only the superseded (key, ingest) pairs are, which stay few, so a scan does not meet the
    whole watermark. The ids are one for each ingest, so they are broadcast: a shuffle by them
    would bring all rows of an ingest into one task."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ingested_at"), F.desc("ingest_id"))
    superseded = (history.withColumn("_rn", F.row_number().over(w)).filter("_rn > 1")
                  .select(*KEY, "ingest_id"))
    return (rows.join(F.broadcast(history.select("ingest_id").distinct()), "ingest_id", "left_semi")
            .join(superseded, KEY + ["ingest_id"], "left_anti").select(*rows.columns))


def _stored(spark: SparkSession, base: str, table: str) -> DataFrame:
    path = f"{base.rstrip('/')}/{table}"
    return spark.read.schema(stored_schema(table)).option("basePath", path).parquet(path)


def scan_lake(spark: SparkSession, base: str, table: str, **partition_eq) -> DataFrame:
    """One lake table (live rows only); equality filters on partition columns prune
    directories."""
    df = _stored(spark, base, table)
    for k, v in partition_eq.items():
        df = df.filter(F.col(k) == v)
    return live(df, watermark_history(spark, base))


def compact(spark: SparkSession, base: str, table: str, out: str) -> None:
    """Rewrite the live rows of a table into ``out`` (a new version directory)."""
    df = scan_lake(spark, base, table)
    parts = partition_cols(table)
    (df.repartitionByRange(*parts, "sample_id").sortWithinPartitions(*parts, "sample_id")
     .write.mode("overwrite").partitionBy(*parts).parquet(out))


def freeze_snapshot(spark: SparkSession, base: str, public_base: str) -> DataFrame:
    """K6: a point-in-time manifest of every data file with live rows, addressed under
    another base URL, plus each table's schema - readers load the listed files directly.

    ``rows`` and ``live_rows`` tell files that also hold superseded rows; for those the
    watermark's own files, listed as table ``etl_ingested``, say which rows count."""
    frames = []
    history = watermark_history(spark, base)
    for table in SCHEMAS:
        df = _stored(spark, base, table).select(*KEY, "ingest_id", F.col("_metadata.file_path").alias("file"))
        alive = live(df, history).groupBy("file").agg(F.count("*").alias("live_rows"))
        files = (df.groupBy("file").agg(F.count("*").alias("rows")).join(alive, "file")
                 .withColumn("table", F.lit(table)).withColumn("schema", F.lit(stored_schema(table).json())))
        frames.append(files)
    frames.append(history.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
                  .withColumn("live_rows", F.col("rows")).withColumn("table", F.lit(WATERMARK))
                  .withColumn("schema", F.lit(WATERMARK_SCHEMA.json())))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    prefix = base.rstrip("/")
    return out.withColumn("url", F.concat(F.lit(public_base.rstrip("/")),
                                          F.substring_index(F.col("file"), prefix, -1)))


def write_metadata_tsv(jobs: DataFrame, samples: DataFrame, out: str, files: int | None = 1) -> None:
    """K7: ``sample_id<TAB>NCBI_accession`` for a batch; accession from the sample row, or
    its metadata's accession key when the column is empty. A dispatch batch is one file;
    ``files=None`` writes an export of any size from as many tasks as it has partitions."""
    acc = F.coalesce(F.nullif(F.trim("ncbi_accession"), F.lit("")),
                     F.get_json_object("metadata", "$['ncbi_accession']"))
    rows = (jobs.select("sample_id").distinct().join(samples, "sample_id", "left")
            .select("sample_id", acc.alias("NCBI_accession")))
    ((rows if files is None else rows.coalesce(files)).write.mode("overwrite").option("sep", "\t").option("header", True).csv(out))
