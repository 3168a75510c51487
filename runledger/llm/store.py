"""Intermediate tables in the shared checkpoint folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from runledger.session import scratch_path


class Scratch:
    """Parquet tables of one run under ``spark.checkpoint.dir``.

    A kept table is computed once and cuts the lineage: what is lost with an executor is
    read again from the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, scratch_path(spark, f"{name}-{uuid.uuid4().hex}"), 0
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((kept, path))
        return kept

    def drop_all_but(self, *needed: DataFrame) -> None:
        """Delete the tables of this run that no later step reads."""
        stay = [(t, p) for t, p in self.tables if any(t is n for n in needed)]
        for table, name in self.tables:
            if not any(table is n for n in needed):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.tables = stay
