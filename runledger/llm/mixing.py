"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells (source, language, topic). Token counts per cell are summed over
all documents; every margin gets a target that flattens its shares, ``min(t, scale * t**power)``
with the scale chosen so that the targets add up to the token budget and none asks for more
than there is. Raking multiplies one factor per source, language and topic until the
expected tokens ``tokens * min(1, product of factors)`` meet all margins, or until sweeps stop
bringing them nearer (margins that contradict each other, or that capped cells cannot meet);
``deviation`` is the largest share by which a margin is still off. A document is kept
with its cell's calibrated probability, by a hash of its id, so a rerun keeps the same.

Cells, margins and factors stay Spark tables; token sums are combined map-side, so a source
with a third of all rows is no hot group. A document's text is never shuffled: cells join back by
their key, and Spark broadcasts them only if their stored size is under its threshold.

Topics, where the input has none, come from spherical k-means over the hashed word counts of all
documents. Their counts are stored once; every round reads them, and a task hands over one sum
per centroid. Sums are integers, so the order of tasks does not change them.

Defined results: null sources, languages and topics are values of their own; null and empty
texts have no tokens, count as topic 0, and are kept by their cell's probability (1 in a cell
without tokens); repeated rows share one decision; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .store import Scratch

TOPICS = 8
BUCKETS = 1024            # hashed words
BAG_ROWS = 1024           # documents whose bags a task holds as one matrix
CHUNKS = 16               # stored chunks of bags in a batch
UNIT = 1 << 20            # integer steps of a bag's entries in sums
BUDGET = 0.6              # share of all tokens to keep
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SWEEPS_KEPT = 4           # sweeps in one job
PROGRESS = 0.95           # a job must bring the deviation below this share of the one before
CELL_ROWS = 100_000       # cells that one task holds
TOLERANCE = 2e-3
GRID = 64


def _counts(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed word counts, words) of each text."""
    words = textops.Words(b, o)
    count = np.diff(words.bounds)
    docs = len(count)
    slot = np.repeat(np.arange(docs), count) * BUCKETS + (words.hashes >> np.uint64(54)).astype(np.int64)
    return np.bincount(slot, minlength=docs * BUCKETS).reshape(docs, BUCKETS), count


def _unit(counts: np.ndarray) -> np.ndarray:
    """Unit vectors of square-rooted counts."""
    bag = np.sqrt(counts).astype(np.float32)
    norm = np.sqrt((bag * bag).sum(axis=1, keepdims=True))
    return bag / np.maximum(norm, 1e-9)


def _bags(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of square-rooted hashed word counts, words) of each text."""
    counts, words = _counts(b, o)
    return _unit(counts), words


BAGS = "sizes binary, slots binary, counts binary, units binary"
BAG = "slots array<smallint>, counts array<int>"


def _store_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bags of every document with words, a row for each chunk of texts: per bag its size, then
    the slots, word counts and unit vector's entries above zero of all bags, one after the other."""
    textops.drop_large_cache()
    for batch in batches:
        data, offsets = textops.utf8(batch.column(0))
        for _, _, b, o in textops.chunks(data, offsets):
            counts, words = _counts(b, o)
            counts = counts[words > 0]
            if not len(counts):
                continue
            row, slot = np.nonzero(counts)
            columns = (np.bincount(row, minlength=len(counts)).astype(np.int32), slot.astype(np.int16),
                       counts[row, slot].astype(np.int32), _unit(counts)[row, slot])
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns],
                                             names=["sizes", "slots", "counts", "units"])


def _column(batch: pa.RecordBatch, name: str, i: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Stored bags as unit vectors, BAG_ROWS at a time: (matrix, row of each entry, slot of each
    entry, count of each entry if it was read)."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, slots = _column(batch, "sizes", i, np.int32), _column(batch, "slots", i, np.int16)
            units = _column(batch, "units", i, np.float32)
            counts = _column(batch, "counts", i, np.int32) if "counts" in batch.schema.names else None
            ends = np.cumsum(sizes, dtype=np.int64)
            for at in range(0, len(sizes), BAG_ROWS):
                size = sizes[at:at + BAG_ROWS]
                cut = slice(int(ends[at] - sizes[at]), int(ends[at + len(size) - 1]))
                row = np.repeat(np.arange(len(size)), size)
                x = np.zeros((len(size), BUCKETS), np.float32)
                x[row, slots[cut]] = units[cut]
                yield x, row, slots[cut], None if counts is None else counts[cut]


def _bag(i: int, row: np.ndarray, slot: np.ndarray, count: np.ndarray) -> tuple[list[int], list[int]]:
    lo, hi = np.searchsorted(row, [i, i + 1])
    return slot[lo:hi].tolist(), count[lo:hi].tolist()


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the task's smallest bag by slots, then counts."""
    best = None
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, slots = _column(batch, "sizes", i, np.int32), _column(batch, "slots", i, np.int16)
            row, counts = np.repeat(np.arange(len(sizes)), sizes), _column(batch, "counts", i, np.int32)
            first = slots[np.cumsum(sizes, dtype=np.int64) - sizes]
            for k in np.flatnonzero(first == first.min()):
                bag = _bag(int(k), row, slots, counts)
                best = bag if best is None else min(best, bag)
    if best is not None:
        yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.list_(pa.int16())), pa.array([best[1]], pa.list_(pa.int32()))],
                                         names=["slots", "counts"])


def _farthest(centers_value):
    """Task function: the task's bag that is least like its most similar centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for x, row, slot, count in _matrices(batches):
            near = np.round((x @ centers_value.value.T).max(axis=1), 5)
            if best is not None and near.min() > best[0]:
                continue
            for i in np.flatnonzero(near == near.min()):
                bag = (float(near[i]), *_bag(int(i), row, slot, count))
                best = bag if best is None else min(best, bag)
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([best[0]], pa.float64()), pa.array([best[1]], pa.list_(pa.int16())),
                 pa.array([best[2]], pa.list_(pa.int32()))], names=["near", "slots", "counts"])
    return run


def _sums(centers_value):
    """Task function: the sum of the bags nearest to each centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = centers_value.value
        total = np.zeros(centers.shape, np.int64)
        for x, row, slot, _ in _matrices(batches):
            near = np.argmax(x @ centers.T, axis=1)
            steps = np.rint(x[row, slot].astype(np.float64) * UNIT)
            total += np.bincount(near[row] * BUCKETS + slot, steps, total.size).astype(np.int64).reshape(total.shape)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([total[k].tobytes() for k in some], pa.binary())], names=["k", "sums"])
    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            add = np.frombuffer(raw.as_buffer(), np.int64)
            total[k] = total[k] + add if k in total else add
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "sums"])


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS, rounds: int = 12) -> np.ndarray:
    """Topic centroids (unit rows), fitted on all documents with words.

    The driver sees one bag for each starting centroid and one sum per centroid and round."""
    spark = docs.sparkSession
    textops.small_batches(spark)
    scratch = Scratch(spark, "topics")
    bags = scratch.keep(docs.select(F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")
                        .mapInArrow(_store_bags, BAGS))
    with textops.few_rows(spark, CHUNKS):
        centers = _centroids(bags, topics, rounds)
    scratch.drop_all_but()
    return centers


def _centroids(bags: DataFrame, topics: int, rounds: int) -> np.ndarray:
    context = bags.sparkSession.sparkContext
    first = bags.select("sizes", "slots", "counts").mapInArrow(_least, BAG).agg(F.min(F.struct("slots", "counts")).alias("bag")).first().bag
    if first is None:
        return np.zeros((1, BUCKETS), np.float32)

    def row(bag) -> np.ndarray:
        counts = np.zeros((1, BUCKETS))
        counts[0, bag.slots] = bag.counts
        return _unit(counts)
    centers = row(first)
    while len(centers) < topics:                              # farthest first, so no random start
        shared = context.broadcast(centers)
        far = (bags.mapInArrow(_farthest(shared), f"near double, {BAG}")
               .agg(F.min(F.struct("near", "slots", "counts")).alias("bag")).first().bag)
        if far.near >= 1:                                     # every bag is a centroid
            break
        centers = np.vstack([centers, row(far)])
    for _ in range(rounds):
        shared, before = context.broadcast(centers), centers
        centers = centers.copy()
        for k, raw in (bags.select("sizes", "slots", "units").mapInArrow(_sums(shared), "k int, sums binary")
                       .repartition(topics, "k").mapInArrow(_add_sums, "k int, sums binary").collect()):
            m = np.frombuffer(raw, np.int64).astype(np.float64)
            centers[k] = m / np.sqrt(m @ m)
        if np.array_equal(centers, before):
            break
    return centers


def _topics(centers_value, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.drop_large_cache()
        centers = centers_value.value
        for batch in batches:
            data, offsets = textops.utf8(batch.column(column))
            topic, tokens = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for i, j, b, o in textops.chunks(data, offsets):
                bag, count = _bags(b, o)
                topic[i:j], tokens[i:j] = np.argmax(bag @ centers.T, axis=1), count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topic), pa.array(tokens)],
                                             names=[*batch.schema.names, "__topic", "__tokens"])
    return run


def annotate(docs: DataFrame, centers: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__topic int`` and ``__tokens long`` (words)."""
    shared = docs.sparkSession.sparkContext.broadcast(centers)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    schema = docs.withColumns({"__topic": F.lit(0), "__tokens": F.lit(0).cast("long")}).schema
    return docs.mapInArrow(_topics(shared, docs.columns.index(text_col)), schema)


def _compact(cells: DataFrame) -> DataFrame:
    """Cells in as few partitions as their count asks for (one for CELL_ROWS cells)."""
    return cells.coalesce(max(1, -(-cells.count() // CELL_ROWS)))


def margin_targets(cells: DataFrame, dim: str, budget: float, power: float) -> DataFrame:
    """``(dim, target)``: ``min(t, scale * t**power)`` with the scale that spends the budget.

    The scale is bracketed three times by one aggregation over a grid of candidates."""
    t = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).filter("t > 0")
    hi = t.agg(F.max(F.pow("t", 1 - power))).first()[0]
    lo = 0.0
    for _ in range(3 if hi else 0):
        steps = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
        spent = t.agg(F.array(*[F.sum(F.least(F.col("t"), F.lit(x) * F.pow("t", power))) for x in steps])).first()[0]
        k = max([i for i, x in enumerate(spent) if x <= budget * (1 + 1e-12)], default=0)
        lo, hi = steps[k], steps[min(k + 1, GRID)]
    return t.select(dim, F.least(F.col("t"), F.lit(lo) * F.pow("t", power)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with ``probability``: the margins' factors multiplied, at most 1; and ``deviation``.

    A sweep scales every margin in turn; its sums are windows over the cells. After every
    ``SWEEPS_KEPT`` sweeps the cells are stored and the last corrections tested: raking ends
    when all are within ``tolerance`` or no longer shrink. ``deviation``, the same in every
    row, is the largest correction, as a share, that the last sweep asked for."""
    scratch = Scratch(cells.sparkSession, "rake")
    factors = {d: f"f_{i}" for i, d in enumerate(targets)}
    product = reduce(lambda a, b: a * b, [F.col(f) for f in factors.values()])
    expected = F.col("tokens") * F.least(F.lit(1.0), product)
    for d, goal in targets.items():
        goal = goal.select(F.col(d).alias("__d"), F.col("target").alias(f"t_{factors[d]}"))
        cells = cells.join(goal, cells[d].eqNullSafe(goal["__d"]), "left").drop("__d")
    cells = scratch.keep(_compact(scratch.keep(cells.withColumns({f: F.lit(1.0) for f in factors.values()}))))
    parts = max(1, -(-cells.count() // CELL_ROWS))
    deviation = float("inf")
    while True:
        step = cells.coalesce(parts)
        for _ in range(SWEEPS_KEPT):
            for d, f in factors.items():
                total = F.sum(expected).over(Window.partitionBy(d))
                step = step.withColumn(f"r_{f}", F.coalesce(F.when(total > 0, F.col(f"t_{f}") / total), F.lit(1.0)))
                step = step.withColumn(f, F.least(F.lit(1e9), F.greatest(F.lit(1e-9), F.col(f) * F.col(f"r_{f}"))))
        step = scratch.keep(step)
        off = step.agg(*[F.max(F.abs(F.col(f"r_{f}") - 1)) for f in factors.values()]).first()
        cells = step.drop(*[f"r_{f}" for f in factors.values()])
        before, deviation = deviation, max((x for x in off if x is not None), default=0.0)
        if deviation < tolerance or deviation > PROGRESS * before:
            break
    scratch.drop_all_but(step)
    return cells.select(*targets, "tokens", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), product))
                        .otherwise(1.0).alias("probability"), F.lit(deviation).alias("deviation"))


def calibrated_cells(cells: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS) -> DataFrame:
    """Sampling probability per cell (and the margins' ``deviation``). ``cells``: one row per cell, the margins' columns and ``tokens``."""
    cells = Scratch(cells.sparkSession, "cells").keep(_compact(cells))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    return rake(cells, {d: margin_targets(cells, d, budget * total, p) for d, p in powers.items()})


def keep_mask(id_col: str = "doc_id", probability: str = "probability"):
    """Whether a document's hash falls under its probability."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), id_col), 11) / F.lit(float(1 << 53))
    return u < F.col(probability)


def _attach(rows: DataFrame, cells: DataFrame) -> DataFrame:
    c = cells.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"),
                     F.col("probability").alias("__p"), F.col("deviation").alias("__off"))
    return rows.join(c, rows["source"].eqNullSafe(c["__s"]) & rows["lang"].eqNullSafe(c["__l"])
                     & rows["__topic"].eqNullSafe(c["__t"])).drop("__s", "__l", "__t")


def _cells(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("source", "lang", F.col("__topic").alias("topic"))
            .agg(F.sum("__tokens").alias("tokens")))


def mixture(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens, probability, kept, deviation)`` of every document."""
    scratch = Scratch(docs.sparkSession, "mix")
    marked = annotate(docs.select("doc_id", "text", "source", "lang"), fit_topics(docs))
    narrow = scratch.keep(marked.drop("text"))
    cells = calibrated_cells(scratch.keep(_cells(narrow)), budget)
    return _attach(narrow, cells).select(
        "doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"),
        F.col("__p").alias("probability"), keep_mask("doc_id", "__p").alias("kept"),
        F.col("__off").alias("deviation"))


def keep_mixture(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The sampled documents, columns unchanged. Texts are read again, not shuffled."""
    scratch = Scratch(docs.sparkSession, "mix")
    marked = annotate(docs, fit_topics(docs))
    cells = calibrated_cells(scratch.keep(_cells(marked.select("source", "lang", "__topic", "__tokens"))), budget)
    return _attach(marked, cells).filter(keep_mask("doc_id", "__p")).select(*docs.columns)
