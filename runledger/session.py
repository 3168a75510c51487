"""SparkSession construction and the few session-level settings the library relies on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every runledger job expects. Timestamps are compared across engines, so the
# session zone is pinned to UTC; AQE re-plans joins and coalesces shuffle partitions at
# runtime and splits skewed join partitions (one process or run can hold a third of rows).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for a large cluster (about 100 TB of input, about 1000 executors). Shuffles start
# wide and AQE coalesces them to ~256 MB partitions; scans split at 512 MB; a side is
# broadcast when its stored size is under 32 MB or its measured runtime size under 64 MB; partitions more than
# 5x the median and over 1 GB are split by the skew-join rule.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    # sides whose stored size is known to be small (registries) are broadcast at once, so the
    # event log and the facts are not shuffled to meet them; AQE decides the others from
    # their measured size
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def get_session(master: str | None = None, app: str = "runledger",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if not (master or "").startswith("local"):
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is set by the deployment to a shared filesystem and is only read
    here. A local dir is created only for a local master (tests, local runs); on a cluster
    an absent setting is an error, as executors would write to their own disks.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="runledger-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A child of the checkpoint folder for intermediate tables that cut lineage."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/" + name


def default_root(spark: SparkSession) -> str:
    """``scheme://authority`` of the session's default filesystem. Paths without a scheme lie
    there for Spark; code that opens files by itself puts this in front of them."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    uri = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf)
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}"
