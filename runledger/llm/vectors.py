"""Blocks of vectors for search: matrices of bounded size that Spark shuffles as rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192         # candidates in a block
QUERY_ROWS = 512          # queries in a block


def usable(rows: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """``(vec_id long, v array<double>)``: vectors without null or non-finite components.

    Rows that repeat an id count once, with the smallest vector (combined map-side).
    ``zero``: whether zero vectors take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad))
    if not zero:
        rows = rows.filter(F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block: ids in ascending order and their vectors as one matrix."""
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(ids), -1)[order] if len(flat) else np.zeros((len(ids), 0))
    return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1],
                     "ids": pa.array([ids[order].tobytes()], pa.binary()),
                     "matrix": pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())})


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows(vec_id, v, part)`` -> ``(part, block, ids, matrix)``.

    A part is split by a hash of the id into as many blocks as its row count asks for, so a
    block has about ``size`` rows however large a part is."""
    counts = rows.groupBy("part").agg(F.ceil(F.count("*") / size).alias("n"))
    keyed = rows.join(counts, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    return keyed.select("part", "block", "vec_id", "v").groupBy("part", "block").applyInArrow(
        _pack, "part int, block int, ids binary, matrix binary")


def unpack(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    m = np.frombuffer(matrix, np.float64)
    return i, m.reshape(len(i), -1) if len(i) else np.zeros((0, 0))


def search_blocks(queries: DataFrame, candidates: DataFrame, search, score_type: str) -> DataFrame:
    """Run ``search(query ids, queries, ids, vectors) -> (query ids, ids, scores)`` on every
    query block and candidate block of one part. Rows: ``(query_id, vec_id, score)``."""
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                qi, qm, ci, cm = (batch.column(c)[k].as_py() for c in range(4))
                q, c, s = search(*unpack(qi, qm), *unpack(ci, cm))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, kind)],
                                                 names=["query_id", "vec_id", "score"])
    pairs = (queries.select("part", F.col("block").alias("qb"), F.col("ids").alias("qi"), F.col("matrix").alias("qm"))
             .join(candidates.select("part", F.col("block").alias("cb"), F.col("ids").alias("ci"),
                                     F.col("matrix").alias("cm")), "part"))
    # one task per few block pairs
    return (pairs.repartition(F.col("part"), F.col("qb"), F.col("cb")).select("qi", "qm", "ci", "cm")
            .mapInArrow(run, f"query_id long, vec_id long, score {score_type}"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1; ties to the smaller id."""
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
