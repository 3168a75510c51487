"""State tables whose writes touch only the buckets of their keys.

A ``KeyedTable`` is a Parquet table partitioned by ``bucket``, a hash of its key. A batch of
changes is combined with the rows of the buckets that it falls into, and only these buckets
are replaced (dynamic partition overwrite), so a small batch on a large table reads and
writes a small part of it, and a lookup by key reads the buckets of its keys.

A merge first writes the new content of its buckets as a staged table beside the table and then
replaces the buckets from it. A staged table that was completed but not moved (a crash in
between) is moved by the next write: moving it again gives the same buckets. One writer at a
time, as with any plain folder; readers of a bucket that is just replaced may have to read
again.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"


def first_per_key(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key, the same whatever the order of the rows: the first by ``order``,
    ties by the row's own text. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    text = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    picked = F.min_by(F.struct(*rest), F.struct(*(order or []), text))
    return rows.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


@dataclass(frozen=True)
class KeyedTable:
    """``path``: folder; ``keys``: the unique key; ``buckets``: how many the table is split into;
    ``by``: the part of the key that decides the bucket (all of it, if empty), by which rows can
    be looked up. All are fixed for the table's life."""
    path: str
    keys: tuple[str, ...]
    buckets: int = 256
    by: tuple[str, ...] = ()

    # ---------------------------------------------------------------------------- files

    @property
    def _staging(self) -> str:
        return self.path.rstrip("/") + "__staged"

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int"))

    def _replace(self, rows: DataFrame) -> None:
        """Write whole buckets; each is one task's, sorted by key so that its row groups hold
        narrow key ranges."""
        (rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))

    def create(self, rows: DataFrame) -> None:
        """Write the table. Keys must be unique (see ``first_per_key``)."""
        (self._bucketed(rows).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys)
         .write.partitionBy(BUCKET).parquet(self.path))

    def recover(self, spark: SparkSession) -> int:
        """Move staged buckets that a crash left behind; returns how many batches."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self._staging)
        fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        moved = 0
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                batch = status.getPath()
                if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(batch, "_SUCCESS")):
                    staged = spark.read.parquet(batch.toString())
                    if staged.columns:
                        self._replace(staged)
                    moved += 1
                fs.delete(batch, True)
        return moved

    # ----------------------------------------------------------------------------- read

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in self._bucketed(rows.select(*(self.by or self.keys))).select(BUCKET).distinct().collect())

    def _of_buckets(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        return spark.read.parquet(self.path).filter(F.col(BUCKET).isin(buckets))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the keys (or parts of keys that hold ``by``) in ``wanted``, read from their
        buckets only (X3)."""
        found = self._of_buckets(wanted.sparkSession, self._touched(wanted)).drop(BUCKET)
        on = [k for k in self.keys if k in wanted.columns]
        return found.join(wanted.select(*on).distinct(), on, "left_semi").select(*found.columns)

    # ---------------------------------------------------------------------------- write

    def merge(self, changes: DataFrame, update: dict[str, Column] | None = None, insert: bool = True) -> list[int]:
        """Combine ``changes`` (unique by key) with the stored rows; returns the buckets written.

        Stored rows that a change meets take ``update`` (column -> expression over the stored
        column ``c`` and the change's ``new.c``; empty: they stay); other changes are inserted
        if ``insert``. Columns that a change lacks are null in inserted rows."""
        spark = changes.sparkSession
        self.recover(spark)
        buckets = self._touched(changes)
        if not buckets:
            return []
        stored = self._of_buckets(spark, buckets)
        keys, columns = list(self.keys), [c for c in stored.columns if c != BUCKET]
        new = self._bucketed(changes).select(*keys, BUCKET, F.struct(*changes.columns).alias("new"))
        met = stored.withColumn("_stored", F.lit(True)).join(new, [*keys, BUCKET], "full_outer" if insert else "left")
        out = []
        for c in columns:
            changed = (update or {}).get(c, F.col(c))
            fresh = F.col(f"new.{c}") if c in changes.columns else F.lit(None)
            out.append(F.col(c) if c in keys else
                       F.when(F.col("_stored").isNull(), fresh).when(F.col("new").isNull(), F.col(c)).otherwise(changed).alias(c))
        self._stage(met.select(*out, BUCKET))
        return buckets

    def _stage(self, rows: DataFrame) -> None:
        batch = f"{self._staging}/{uuid.uuid4().hex}"
        rows.write.parquet(batch)
        self.recover(rows.sparkSession)

    def upsert(self, changes: DataFrame, update_cols: list[str] | None = None,
               keep_if_null: tuple[str, ...] = (), order: list[str] | None = None) -> list[int]:
        """Insert, or set ``update_cols`` (all of the change's) on rows that exist; a null in a
        ``keep_if_null`` column leaves the stored value. Of several changes of one key the first
        by ``order`` counts."""
        cols = [c for c in update_cols or changes.columns if c not in self.keys]
        update = {c: F.coalesce(F.col(f"new.{c}"), F.col(c)) if c in keep_if_null else F.col(f"new.{c}") for c in cols}
        return self.merge(first_per_key(changes, list(self.keys), order), update)

    def insert_ignore(self, changes: DataFrame, order: list[str] | None = None) -> list[int]:
        """Insert the rows whose key is unseen."""
        return self.merge(first_per_key(changes, list(self.keys), order))
