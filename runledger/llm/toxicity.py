"""Toxicity scores: a character n-gram linear classifier with naive Bayes scaled features.

A feature is the presence of a character n-gram (hashed, over ASCII-lower-cased UTF-8 bytes
with ASCII punctuation and white space as blanks). Its value is its naive Bayes log-count
ratio between toxic and other training documents, drawn towards 0 as far as the ratio may come
from its standard error alone; a logistic regression on these scaled features gives the score.
Every n-gram slot met in training is a feature (2^20 slots, none left out).

Fitting uses a bounded sample: about ``FIT_ROWS`` labelled training rows chosen by a hash of
their id (all of them, if fewer), equal rows once. Counts per slot are summed over the sample on
the executors. The sample's slots are stored; every step of the regression reads them, a task
hands over one partial gradient, and the driver sees vectors of a number for each slot whose value
is not 0 (the weights of the others are 0 at every step), 2^20 at most, whatever the sample's texts
hold. Scoring reads every whole text of all documents in one pass without a
shuffle, with one broadcast weight per slot (4 MB).

Defined results: a null or empty text has no n-grams and gets the score of the intercept;
labels other than 0 and 1 and null ids are ignored in training; an id with several label rows
has the label of most of them (toxic, if as many); equal documents of one id are one training
row; without any training row the score is 0.5 everywhere; an empty table gives no rows; input
columns of any other name are carried through.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .store import Scratch

FIT_ROWS = 16_000         # expected size of the training sample
ORDERS = (4, 5, 6)        # n-gram lengths in bytes
BITS = 20                 # hashed n-gram slots
SLOTS = 1 << BITS
ALPHA = 1.0               # smoothing of the counts
DOUBT = 9.0               # squared standard errors at which a ratio is cut to a quarter
L2 = 1e-4
STEPS = 12                # gradients of the regression; later ones fit the sample's noise
MEMORY = 5                # earlier steps that shape the next one
TASKS = 4                 # tasks that read the bounded sample; each hands over one number a slot
BLOCKS = 4                # pieces in which partial sums are added up
STORED_ROWS = 128         # rows of the sample in a batch
STORED_SLOTS = 1 << 18    # slots that a task holds as arrays (or one row's, if it has more)
THRESHOLD = 0.7
PART_BYTES = 1 << 18      # text whose n-grams are held at a time


def _blank_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for c in range(128):
        if not chr(c).isalnum():
            t[c] = 32
    return t


_BLANK = _blank_table()


def ngram_slots(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: (start position, slot) of the n-grams inside the texts.

    Each text is read with a blank before and after it."""
    docs = len(offsets) - 1
    at = np.arange(docs) * 2 + 1
    padded = np.full(len(data) + 2 * docs, 32, np.uint64)
    where = np.arange(len(data)) + np.repeat(at, np.diff(offsets))
    padded[where] = _BLANK[data]
    ends = offsets[1:] + 2 * np.arange(1, docs + 1)                  # padded end of each text
    packed, width = padded.copy(), 1
    for n in ORDERS:
        while width < n:
            packed = packed[:-1] | (padded[width:] << np.uint64(8 * width)) if len(packed) > 1 else packed[:0]
            width += 1
        if not len(packed):
            return
        with np.errstate(over="ignore"):
            slot = ((packed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) \
                >> np.uint64(64 - BITS)
        inside = np.ones(len(packed), bool)
        for k in range(1, n):                                        # n-grams that cross a text's end
            cross = ends - k
            inside[cross[(cross >= 0) & (cross < len(packed))]] = False
        start = np.flatnonzero(inside)
        yield start, slot[start].astype(np.int64)


def _doc_of(offsets: np.ndarray) -> np.ndarray:
    docs = len(offsets) - 1
    return np.repeat(np.arange(docs), np.diff(offsets) + 2)


def _present(b: np.ndarray, o: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """The slots present in each text, each once. ``last`` is work space of one number a slot."""
    docs = len(o) - 1
    ends = o[1:] + 2 * np.arange(1, docs + 1)
    orders = [(np.searchsorted(start, np.concatenate([[0], ends])), slot) for start, slot in ngram_slots(b, o)]
    for k in range(docs):
        met = [slot[cuts[k]:cuts[k + 1]] for cuts, slot in orders]
        met = np.concatenate(met) if met else np.zeros(0, np.int64)
        at = np.arange(len(met), dtype=last.dtype)
        last[met] = at                                               # of equal slots one place stays
        yield met[last[met] == at]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, gaps): each text's present slots in order, as differences to the one before."""
    textops.drop_large_cache()
    last = np.zeros(SLOTS, np.int32)
    for batch in batches:
        data, offsets = textops.utf8(batch.column(0))
        for i, j, b, o in textops.chunks(data, offsets, PART_BYTES):
            rows = [np.diff(np.sort(met), prepend=0).astype(np.int32) for met in _present(b, o, last)]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))],
                names=["toxic", "gaps"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(label of each row, row of each entry, slot of each entry) of stored rows, about STORED_SLOTS slots at a time."""
    for batch in batches:
        ends, at = np.cumsum(np.asarray(batch.column(1).value_lengths(), np.int64)), 0
        while at < batch.num_rows:
            held = STORED_SLOTS + (ends[at - 1] if at else 0)
            end = max(at + 1, int(np.searchsorted(ends, held, side="right")))
            part, at = batch.slice(at, end - at), end
            size = np.asarray(part.column(1).value_lengths(), np.int64)
            total = np.cumsum(np.asarray(part.column(1).flatten(), np.int64))
            first = np.cumsum(size) - size
            before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(total) else first
            toxic = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
            yield toxic, np.repeat(np.arange(len(size)), size), total - np.repeat(before, size)


def _blocks(vectors: np.ndarray, *numbers: float) -> Iterator[pa.RecordBatch]:
    """The task's vectors in BLOCKS pieces, then its numbers."""
    parts = np.array_split(vectors, BLOCKS, axis=1)
    for k, part in enumerate([*parts, np.array(numbers)] if numbers else parts):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())],
                                         names=["k", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
            total[k] = total[k] + part if k in total else part
    for k, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "sums"])


def _sum_slots(rows: DataFrame, task, vectors: int, width: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' vectors of some width and numbers, added up piece by piece on the executors."""
    out, numbers = np.zeros((vectors, width)), np.zeros(0)
    pieces = np.array_split(out, BLOCKS, axis=1)
    for k, raw in (rows.coalesce(TASKS).mapInArrow(task, "k int, sums binary").repartition(BLOCKS, "k")
                   .mapInArrow(_add, "k int, sums binary").collect()):
        if k == BLOCKS:
            numbers = np.frombuffer(raw, np.float64)
        else:
            pieces[k][:] = np.frombuffer(raw, np.float64).reshape(pieces[k].shape)
    return out, numbers


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: documents per class and slot."""
    total = np.zeros((2, SLOTS))
    for toxic, row, slot in _stored(batches):
        hot = toxic[row] == 1
        total[1] += np.bincount(slot[hot], minlength=SLOTS)
        total[0] += np.bincount(slot[~hot], minlength=SLOTS)
    yield from _blocks(total)


def _residuals(used_value, model_value):
    """Task function: the used slots' sums of residuals; the loss and the sum of all residuals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, (of_used, bias) = used_value.value, model_value.value
        weights = np.zeros(SLOTS)
        weights[used] = of_used
        total, loss, every = np.zeros((1, SLOTS)), 0.0, 0.0
        for toxic, row, slot in _stored(batches):
            z = np.bincount(row, weights[slot], minlength=len(toxic)) + bias
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic
            total[0] += np.bincount(slot, off[row], minlength=SLOTS)
            loss += float(np.logaddexp(0, np.where(toxic == 1, -z, z)).sum())
            every += float(off.sum())
        yield from _blocks(total[:, used], loss, every)
    return run


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope shaped by the curvature met in earlier steps (limited-memory BFGS)."""
    if not steps:
        return slope / max(1.0, math.sqrt(slope @ slope))
    out, shares = slope.copy(), []
    for move, change in reversed(steps):
        share = (move @ out) / (change @ move)
        out -= share * change
        shares.append(share)
    move, change = steps[-1]
    out *= (move @ change) / (change @ change)
    for (move, change), share in zip(steps, reversed(shares)):
        out += move * (share - (change @ out) / (change @ move))
    return out


def _logistic(rows: DataFrame, ratios: np.ndarray, positive: int, n: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on presence times ratio. Weights per slot, intercept.

    A slot of ratio 0 keeps the coefficient 0, so the steps hold the others alone."""
    context = rows.sparkSession.sparkContext
    used = np.flatnonzero(ratios).astype(np.int32)
    ratios, places = ratios[used], context.broadcast(used)

    def look(at: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast((at[:-1] * ratios, at[-1]))
        (total,), (loss, every) = _sum_slots(rows, _residuals(places, shared), 1, len(used))
        shared.destroy()                 # unpersist would leave its blocks on the driver, 8 MB a step
        return loss / n + L2 / 2 * float(at[:-1] @ at[:-1]), np.append(ratios * total / n + L2 * at[:-1], every / n)

    at = np.zeros(len(used) + 1)
    at[-1] = math.log((positive + 1) / (n - positive + 1))
    loss, slope = look(at)
    steps, length, turn = [], 1.0, _direction(slope, [])
    for _ in range(STEPS - 1):
        new = at - length * turn
        new_loss, new_slope = look(new)
        if new_loss > loss - 1e-4 * length * float(slope @ turn):     # too far
            length /= 4
            continue
        move, change = new - at, new_slope - slope
        if move @ change > 1e-12:
            steps = [*steps, (move, change)][-MEMORY:]
        at, loss, slope, length = new, new_loss, new_slope, 1.0
        turn = _direction(slope, steps)
    places.destroy()
    weights = np.zeros(SLOTS)
    weights[used] = at[:-1] * ratios
    return weights, float(at[-1])


class Model:
    """Weight per slot and intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    textops.small_batches(spark)
    labels = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("toxic"))
              .filter("__id is not null and toxic in (0, 1)")
              .groupBy("__id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    n = labels.count()
    if n > fit_rows:
        labels = labels.filter(_drawn(fit_rows / n, "__id"))
    rows = (docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(labels), "__id"))                      # about fit_rows ids at most
    met = rows.select("__id").count()
    if met > 2 * fit_rows:                                           # ids with very many rows
        rows = rows.filter(_drawn(fit_rows / met, "text"))
    scratch = Scratch(spark, "toxicity")
    sample = scratch.keep(rows.dropDuplicates().select("text", "toxic").mapInArrow(_slots, "toxic int, gaps array<int>"))
    with textops.few_rows(spark, STORED_ROWS):
        model = _fit_stored(sample)
    scratch.drop_all_but()
    return model


def _fit_stored(sample: DataFrame) -> Model:
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(SLOTS), math.log((pos + 1) / (neg + 1)))
    return Model(*_logistic(sample, _ratios(sample, pos, neg), pos, pos + neg))


def _ratios(sample: DataFrame, pos: int, neg: int) -> np.ndarray:
    """The value of each slot; the counts behind it are not kept through the regression."""
    (clean, toxic), _ = _sum_slots(sample, _count, 2)
    ratios = np.log((toxic + ALPHA) / (pos + 2 * ALPHA) * (neg + 2 * ALPHA) / (clean + ALPHA))
    error = 1 / (toxic + ALPHA) + 1 / (clean + ALPHA)                # squared standard error
    ratios *= (ratios ** 2 / (ratios ** 2 + DOUBT * error)) ** 2
    ratios[(clean + toxic) == 0] = 0                                 # slots that no training text holds
    return ratios


def _drawn(share: float, col: str):
    return F.shiftrightunsigned(F.xxhash64(F.lit("fit"), col), 2) < F.lit(int(share * (1 << 62)))


def _score(model_value, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.drop_large_cache()
        weights, bias = model_value.value
        last = np.zeros(SLOTS, np.int32)
        for batch in batches:
            data, offsets = textops.utf8(batch.column(column))
            z = np.full(batch.num_rows, bias)
            for i, j, b, o in textops.chunks(data, offsets, PART_BYTES):
                z[i:j] += [weights[met].sum(dtype=np.float64) for met in _present(b, o, last)]
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)],
                                             names=[*batch.schema.names, "__score"])
    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))   # 4 MB
    docs = docs.drop(name)
    schema = docs.withColumn("__score", F.lit(0.0)).schema
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(_score(shared, docs.columns.index(text_col)), schema).withColumnRenamed("__score", name)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents whose score stays under THRESHOLD, columns unchanged."""
    model = fit(docs, labels, text_col=text_col)
    return score(docs, model, text_col, "__toxicity").filter(F.col("__toxicity") < THRESHOLD).drop("__toxicity")
