"""Sums of small matrices over all rows of a table, one partial matrix a task."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SCHEMA = "grp long, line int, vals binary"


def _add(lines: pa.Table) -> pa.Table:
    """The sum of one matrix line over all tasks."""
    first = lines.column("vals")[0].as_py()
    total = np.zeros(len(first) // 8)
    for raw in lines.column("vals"):
        total += np.frombuffer(raw.as_buffer(), np.float64)
    return pa.table({"grp": lines.column("grp")[:1], "line": lines.column("line")[:1],
                     "vals": pa.array([total.tobytes()], pa.binary())})


def matrix_sums(rows: DataFrame, measure: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) \
        -> dict[int, np.ndarray]:
    """``{group: matrix}``: the sum over all batches of the matrices that ``measure`` gives.

    A task adds up its own batches and hands over one line of each matrix as a row. Lines are
    added in one group each, so the reduction spreads over as many tasks as a matrix has lines
    and a group holds one line a task. The driver sees one matrix for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, matrix in measure(batch):
                if group in totals:
                    totals[group] += matrix
                else:
                    totals[group] = np.array(matrix, np.float64)
        for group, matrix in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(matrix), group), pa.int64()), pa.array(np.arange(len(matrix)), pa.int32()),
                 pa.array([line.tobytes() for line in matrix], pa.binary())], names=["grp", "line", "vals"])

    added = rows.mapInArrow(run, _SCHEMA).groupBy("grp", "line").applyInArrow(_add, _SCHEMA).toArrow()
    found: dict[int, dict[int, np.ndarray]] = {}
    for group, line, raw in zip(*(added.column(c).to_pylist() for c in ("grp", "line", "vals"))):
        found.setdefault(group, {})[line] = np.frombuffer(raw, np.float64)
    return {g: np.stack([lines[k] for k in range(len(lines))]) for g, lines in found.items()}
