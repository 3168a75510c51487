"""Vectorised text helpers that run inside Spark tasks (numpy over Arrow buffers).

All functions work on chunks of whole texts: a chunk holds about ``CHUNK_BYTES`` of text and at
most ``CHUNK_TEXTS`` texts, or one text if that text is longer, so memory follows the longest
text, never the partition.
"""
from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
CHUNK_TEXTS = 4096
BATCH_ROWS = 2000         # rows of an Arrow batch between the JVM and a Python worker


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Task functions are shipped by value, so their module globals are rebuilt for each task;
    what is dear to build (a tokenizer, a word cache) is kept here instead."""
    name = "_runledger_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def small_batches(spark) -> None:
    """Let Arrow batches of texts stay small (a session setting that Spark reads when it runs
    a plan)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def few_rows(spark, rows: int):
    """Jobs inside read stored tables of long rows ``rows`` at a time, from Parquet and over Arrow."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, str(min(rows, int(before[k])) if int(before[k]) > 0 else rows))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def large_cache(key, build):
    """The worker's one large cache: made by ``build()`` and held until another is asked for, so
    that stages which share a worker do not add up."""
    store = worker_store()
    if store.get("cache_key") != key:
        store.pop("cache", None)
        store["cache"] = build()
        store["cache_key"] = key
    return store["cache"]


def drop_large_cache() -> None:
    """Called by tasks that need none."""
    store = worker_store()
    store.pop("cache", None)
    store.pop("cache_key", None)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random uint64 values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(x + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) \
        -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of consecutive runs of whole texts."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1), i + CHUNK_TEXTS)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


class Words:
    """Words of ASCII-lower-cased texts: maximal runs of bytes outside ``\\x20\\x09-\\x0D``.

    ``hashes`` has a 64-bit hash per word, ``bounds`` the first word of each text and the
    end (as offsets have)."""

    _sep = np.zeros(256, bool)
    _sep[[0x20, 9, 10, 11, 12, 13]] = True

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, docs = len(data), len(offsets) - 1
        if n == 0:
            self.hashes, self.bounds = np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
            return
        sep = self._sep[data]
        opens, shuts = sep.copy(), sep.copy()
        opens[1:], opens[0] = sep[:-1], True
        shuts[:-1], shuts[-1] = sep[1:], True
        edge = offsets[:-1][np.diff(offsets) > 0]
        opens[edge] = True
        shuts[(edge - 1)[1:]] = True
        starts = np.flatnonzero(opens & ~sep)
        ends = np.flatnonzero(shuts & ~sep) + 1
        self.hashes = span_hashes(data, starts, ends, fold=True)
        self.starts, self.ends = starts, ends
        self.bounds = np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``fold``: A-Z count as a-z."""
    store = worker_store()
    if ("bytes", fold) not in store:
        order = np.arange(256)
        if fold:
            order[65:91] += 32
        store["bytes", fold] = seeded(256, 7)[order]
    powers, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(store["bytes", fold][data] * powers[:len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, at least n of each."""
    store = worker_store()
    have = store.get("powers")
    if have is None or len(have[0]) < n:
        size, p = max(n, CHUNK_BYTES), 0x5851F42D4C957F2D
        base = np.full(size, p, np.uint64)
        inv = np.full(size, pow(p, -1, 1 << 64), np.uint64)
        base[0] = inv[0] = 1
        with np.errstate(over="ignore"):
            have = (np.multiply.accumulate(base), np.multiply.accumulate(inv))
        if size <= 4 * CHUNK_BYTES:               # a very long text's powers are not kept
            store["powers"] = have
    return have


SHINGLE = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer than ``width`` words has its whole word sequence as its one shingle;
    a text without words has none."""
    words = Words(data, offsets)
    h, bounds = words.hashes, words.bounds
    factor = seeded(width, 11)
    out = []
    with np.errstate(over="ignore"):
        m = len(h) - width + 1
        rolled = np.zeros(max(m, 0), np.uint64)
        for k in range(width):
            if m > 0:
                rolled += h[k:k + m] * factor[k]
        rolled = mix64(rolled)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if e - s >= width:
                v = rolled[s:e - width + 1].copy()
                v.sort()
                if len(v) > 1:
                    keep = np.empty(len(v), bool)
                    keep[0] = True
                    np.not_equal(v[1:], v[:-1], out=keep[1:])
                    v = v[keep]
                out.append(v)
            elif e > s:
                x = (h[s:e] * factor[:e - s]).sum(dtype=np.uint64) + np.uint64(e - s) * np.uint64(0xA24BAED4963EE407)
                out.append(mix64(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
