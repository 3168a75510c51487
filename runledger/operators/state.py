"""Keyed writes on state tables without a transactional table format.

Each operation takes the current table and a DataFrame of change rows (a batch; a single
change is a one-row batch) and returns the new table. ``write_versioned`` persists the
result: it writes a new version directory and then moves the pointer, so a table is never
read and overwritten in the same job, and readers see the old or the new version.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import default_root
from .keyed import first_per_key

POINTER = "CURRENT"


def _pointer(spark: SparkSession, base: str):
    import pyarrow.fs as pafs
    fs, path = pafs.FileSystem.from_uri(base if "://" in base else default_root(spark) + base)
    return fs, f"{path.rstrip('/')}/{POINTER}"


def write_versioned(table: DataFrame, base: str) -> str:
    """Persist a state table: a new version directory, then the pointer to it (replaced by a
    rename). A crash in between leaves the old version current. Returns the version."""
    version = f"v-{uuid.uuid4().hex}"
    table.write.parquet(f"{base.rstrip('/')}/{version}")
    fs, pointer = _pointer(table.sparkSession, base)
    with fs.open_output_stream(f"{pointer}.{version}", compression=None) as f:
        f.write(version.encode())
    fs.move(f"{pointer}.{version}", pointer)
    return version


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The current version of a state table."""
    fs, pointer = _pointer(spark, base)
    with fs.open_input_stream(pointer, compression=None) as f:
        return spark.read.parquet(f"{base.rstrip('/')}/{f.read().decode()}")


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list) -> DataFrame:
    """Keep the last row per key by ``order_cols`` (descending), deterministic."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() if isinstance(c, str) else c
                                            for c in order_cols])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, source: DataFrame, keys: list[str],
           update_cols: list[str] | None = None) -> DataFrame:
    """U1 (INSERT ... ON CONFLICT DO UPDATE): rows of ``source`` with a new key are inserted;
    on an existing key only ``update_cols`` take the source value, other columns keep the
    target's. Source must be unique on ``keys`` (see ``latest_per_key``)."""
    if update_cols is None:
        update_cols = [c for c in source.columns if c not in keys]
    t = target.withColumn("_t", F.lit(True))
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys],
                      F.lit(True).alias("_s"))
    j = t.join(s, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in source.columns and c in update_cols:
            out.append(F.when(F.col("_s").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        elif c in source.columns:
            out.append(F.when(F.col("_t").isNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """U2 (ON CONFLICT DO NOTHING): append only the source rows whose key is unseen."""
    return target.unionByName(new_rows(target, source, keys), allowMissingColumns=True)


def new_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows (one per key, see ``first_per_key``) whose key is not in target."""
    return first_per_key(source, keys).join(target.select(*keys).distinct(), keys, "left_anti")


def existing_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct source keys already present in target."""
    return source.select(*keys).distinct().join(target.select(*keys), keys, "left_semi")
