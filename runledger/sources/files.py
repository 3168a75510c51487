"""Landed-file sources: curation / sample sheets, archive run reports, task logs
(S4, S5, S6, S20) and the keyed log upserts (K9, K10).

All readers take a directory or glob and return one DataFrame for all files in it, so a
thousand sheets are one distributed read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_root

TASK_LOG_MAX = 5 * 1024 * 1024           # fixed values: upload size limits
NEXTFLOW_LOG_MAX = 16 * 1024 * 1024
WRAPPER_LOG_MAX = 4 * 1024 * 1024
REPORT_FIELDS = ("run_accession", "secondary_sample_accession", "sample_accession",
                 "study_accession", "secondary_study_accession", "sample_title",
                 "library_strategy", "library_selection", "library_source", "instrument_platform")


def read_sheet(spark: SparkSession, path: str, key: str = "ncbi_accession") -> DataFrame:
    """UTF-8 TSV sheets with a header, every column a string.

    Every file has its own header: columns are matched by name, in any order, and a column a
    file lacks is NULL there. The key column is found case-insensitively and renamed to
    ``key``; files without it are an error that names them. Columns with a blank header name
    and fields beyond the header are dropped. Each row gets its 0-based index within its file
    and the file name. A sheet is parsed in one task, row by row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "source_file string, row_index long, names array<string>, cells map<string,string>"

    def parse(batches):
        import csv
        import io

        import pyarrow as pa
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = csv.reader(io.TextIOWrapper(io.BytesIO(raw.as_py()), "utf-8-sig", "replace", newline=""), delimiter="\t")
                header = [h.strip() for h in next(lines, [])]
                names = [key if h.lower() == key else h for h in header]
                out = [(name, None, sorted({n for n in names if n}), None)]       # the file's own row
                for i, cells in enumerate(line for line in lines if line):
                    out.append((name, i, None, [(n, c) for n, c in dict(zip(names, cells)).items() if n]))
                    if len(out) >= 5000:
                        yield _sheet_batch(pa, out)
                        out = []
                yield _sheet_batch(pa, out)

    rows = files.mapInArrow(parse, schema)
    heads = rows.filter("row_index is null").select("source_file", "names")
    missing = [r[0] for r in heads.filter(~F.array_contains("names", key)).limit(10).collect()]
    if missing:
        raise ValueError(f"sheet is missing an '{key}' column (case-insensitive): {missing}")
    names = [r[0] for r in heads.select(F.explode("names")).distinct().orderBy("col").collect()]
    return rows.filter("row_index is not null").select(
        *[F.element_at("cells", F.lit(n)).alias(n) for n in names], "source_file", "row_index")


def _sheet_batch(pa, rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.string()),
                                                    pa.map_(pa.string(), pa.string())))],
        names=["source_file", "row_index", "names", "cells"])


def read_run_reports(spark: SparkSession, path: str) -> DataFrame:
    """Landed archive run reports (JSON rows of 10 string fields), with the file they
    came from as the submitted accession's source and a position for first-row picks."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in REPORT_FIELDS])
    return (spark.read.schema(schema).json(path)
            .withColumn("source_file", F.input_file_name())
            .withColumn("pos", F.monotonically_increasing_id()))


LOG_NAMES = (".command.sh", ".command.out", ".command.err")


READ_BYTES = 32 << 20      # text that a task hands over at a time


def read_task_logs(spark: SparkSession, work_dir: str, max_bytes: int | None = TASK_LOG_MAX,
                   partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Task logs under ``work/<2 hex>/<rest>/.command.{sh,out,err}``.

    Spark's file sources skip names starting with '.', so the executors walk: one row per
    two-hex-digit prefix lists that prefix, the paths found are dealt over ``partitions``
    tasks (4 per core by default), and each task reads its files one by one. Returns
    (logs, rejected): logs carry the short task hash ``ab/cdef12`` and the log type; files
    over ``max_bytes`` (``None``: no limit) and files outside a hash folder are not read and
    come back with a reason. Content is decoded as UTF-8 with replacement characters."""
    root = work_dir.rstrip("/")
    if "://" not in root:
        root = default_root(spark) + root
    prefixes = spark.range(256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("prefix"))

    def walk(batches):
        import pandas as pd
        import pyarrow.fs as pafs
        for pdf in batches:
            for pre in pdf["prefix"].tolist():
                uri = f"{root}/{pre}"
                fs, base = pafs.FileSystem.from_uri(uri)
                found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
                rows = [(root, i.path, int(i.size)) for i in found if i.type == pafs.FileType.File and i.base_name in LOG_NAMES]
                yield pd.DataFrame(rows, columns=["root", "path", "length"])

    def read(batches):
        import pandas as pd
        import pyarrow.fs as pafs
        cols = ["task_hash", "log_type", "content", "path"]
        for pdf in batches:
            rows, held = [], 0
            for task_hash, log_type, base, path in zip(pdf["task_hash"], pdf["log_type"], pdf["root"], pdf["path"]):
                fs, _ = pafs.FileSystem.from_uri(base)
                with fs.open_input_stream(path, compression=None) as f:
                    text = f.read().decode("utf-8", "replace")
                rows.append((task_hash, log_type, text, path))
                held += len(text)
                if held >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=cols)

    n = partitions or spark.sparkContext.defaultParallelism * 4
    files = prefixes.repartition(min(256, n), "prefix").mapInPandas(walk, "root string, path string, length long")
    m = r"/([0-9a-f]{2})/([0-9a-f]{6})[0-9a-f]*/\.command\.(sh|out|err)$"
    tagged = (files.withColumn("task_hash", F.concat(F.regexp_extract("path", m, 1), F.lit("/"),
                                                     F.regexp_extract("path", m, 2)))
              .withColumn("log_type", F.regexp_extract("path", m, 3)))
    reason = F.when(F.col("log_type") == "", F.lit("not a task folder"))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, F.lit("over size"))
    tagged = tagged.withColumn("reason", reason)
    logs = (tagged.filter("reason is null").repartition(n, "path")
            .mapInPandas(read, "task_hash string, log_type string, content string, path string"))
    return logs, tagged.filter("reason is not null").select("path", "length", "reason")


def _too_long(column: str, max_bytes: int | None):
    return F.lit(False) if max_bytes is None else F.octet_length(F.encode(column, "UTF-8")) > max_bytes


def rejected_logs(incoming: DataFrame, max_bytes: int | None = TASK_LOG_MAX) -> DataFrame:
    """K9: the rows that ``upsert_task_logs`` does not store, with a reason."""
    return incoming.filter(_too_long("content", max_bytes)).withColumn("reason", F.lit("over size"))


def upsert_task_logs(logs: DataFrame, incoming: DataFrame, max_bytes: int | None = TASK_LOG_MAX) -> DataFrame:
    """K9: replace content on (run_name, task_hash, log_type); the last incoming row per key
    wins (by ``received_at``, then content); over-size content is not stored and comes back
    from ``rejected_logs``. ``max_bytes=None`` stores all."""
    keys = ["run_name", "task_hash", "log_type"]
    inc = incoming.filter(~_too_long("content", max_bytes))
    order = [F.desc(c) for c in ("received_at", "content") if c in inc.columns]
    w = Window.partitionBy(*keys).orderBy(*order)
    inc = inc.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    kept = logs.join(inc.select(*keys), keys, "left_anti")
    return kept.unionByName(inc.select(*logs.columns), allowMissingColumns=True)


RUN_LOG_LIMITS = {"nextflow_log": NEXTFLOW_LOG_MAX, "wrapper_output": WRAPPER_LOG_MAX}


def rejected_run_logs(run_events: DataFrame, limits: dict[str, int | None] = RUN_LOG_LIMITS) -> DataFrame:
    """Run logs that ``attach_run_logs`` does not store: (run_name, log, bytes)."""
    ex = run_events.filter(F.col("type") == "wrapper_exited")
    found = [ex.filter(_too_long(c, n)).select("run_name", F.lit(c).alias("log"), F.octet_length(F.encode(c, "UTF-8")).alias("bytes"))
             for c, n in limits.items() if c in ex.columns]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def attach_run_logs(logs: DataFrame, runs: DataFrame, run_events: DataFrame,
                    limits: dict[str, int | None] = RUN_LOG_LIMITS) -> tuple[DataFrame, DataFrame]:
    """Engine log (<= 16 MB) and wrapper output (<= 4 MB) carried by ``wrapper_exited``
    events of *known* runs are stored under run-level sentinel hashes; longer ones come back
    from ``rejected_run_logs``. Returns (logs, runs with ``log_uploaded_at``)."""
    ex = (run_events.filter(F.col("type") == "wrapper_exited")
          .join(runs.select("run_name"), "run_name", "left_semi"))
    parts = []
    for col, log_type in (("nextflow_log", "nextflow_log"), ("wrapper_output", "wrapper_output_log")):
        if col in ex.columns:
            parts.append(ex.filter(F.col(col).isNotNull() & ~_too_long(col, limits.get(col)))
                         .select("run_name", F.lit("run/" + log_type).alias("task_hash"),
                                 F.lit(log_type).alias("log_type"), F.col(col).alias("content"),
                                 F.col("utc_time").alias("received_at")))
    if not parts:
        return logs, runs
    inc = parts[0]
    for p in parts[1:]:
        inc = inc.unionByName(p)
    new_logs = upsert_task_logs(logs, inc, max_bytes=None)
    uploaded = (inc.filter(F.col("log_type") == "nextflow_log").groupBy("run_name")
                .agg(F.max("received_at").alias("_up")))
    new_runs = (runs.join(uploaded, "run_name", "left")
                .withColumn("log_uploaded_at", F.coalesce("_up", "log_uploaded_at")).drop("_up"))
    return new_logs, new_runs
