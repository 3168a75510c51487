"""Approximate nearest neighbours by learned space partitions.

Index: on a bounded sample, a graph joins each vector with its nearest neighbours; recursive
spectral bisection with swap refinement cuts the graph into parts of equal size with few edges
between them; a small neural network learns, from a vector, the distribution of its
neighbours' parts. Every row is then assigned to its most probable part (all rows are
indexed). A query goes to its ``PROBES`` most probable parts and is ranked there by the exact
inner product in double precision. A part of any size is searched in blocks of bounded size;
nothing in it is left out. A query that finds fewer than k there visits all other parts, too, so
it misses candidates only when it has k. A table too small to learn from is one part.

The sample (about SAMPLE_ROWS rows chosen by a hash of the id) and the network are the only
things on the driver and in broadcasts, and have a fixed bound.

Defined results: null vectors, zero vectors and such with null or non-finite components take
no part; a repeated id counts once; vectors whose length differs from the sample's most
common one are indexed in a part of their own per length; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .store import Scratch

SAMPLE_ROWS = 4_096       # expected size of the sample
NEIGHBOURS = 10           # edges per vector of the sample's graph
PARTS = 16
PROBES = 14               # parts that a query visits; unclustered data needs most of them
HIDDEN = 64
EPOCHS = 150


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest inner products of each row with the others."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for s in range(0, len(x) if k > 0 else 0, 512):
        score = x[s:s + 512] @ x.T
        score[np.arange(len(score)), np.arange(s, s + len(score))] = -np.inf
        out[s:s + 512] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, left: int) -> np.ndarray:
    """Side (True: first) of each node; ``left`` nodes go to the first side. a, b: edge ends."""
    n = len(nodes)
    degree = np.maximum(1, np.bincount(a, minlength=n) + np.bincount(b, minlength=n))
    root = np.sqrt(degree)
    v = np.random.default_rng(n).standard_normal(n)
    for _ in range(60):                                    # second eigenvector by power iteration
        v -= root * (v @ root) / (root @ root)
        w = v / root
        v = v + (np.bincount(a, w[b], n) + np.bincount(b, w[a], n)) / root
        v /= max(np.sqrt(v @ v), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[:left]] = True
    for _ in range(8):                                     # swap the nodes with most to gain
        cut = side[a] != side[b]
        gain = np.bincount(a, np.where(cut, 1, -1), n) + np.bincount(b, np.where(cut, 1, -1), n)
        p, q = np.flatnonzero(side), np.flatnonzero(~side)
        p, q = p[np.argsort(-gain[p], kind="stable")], q[np.argsort(-gain[q], kind="stable")]
        m = min(len(p), len(q))
        swap = int(np.sum(gain[p[:m]] + gain[q[:m]] > 2)) // 4
        if not swap:
            break
        before, trial = cut.sum(), side.copy()
        trial[p[:swap]], trial[q[:swap]] = False, True
        if (trial[a] != trial[b]).sum() >= before:
            break
        side = trial
    return side


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part number per node; part sizes differ by one at most."""
    n = len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    label = np.zeros(n, np.int64)

    def split(nodes: np.ndarray, first: int, count: int) -> None:
        label[nodes] = first
        if count == 1 or len(nodes) < 2:
            return
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[a] >= 0) & (place[b] >= 0)
        half = count // 2
        side = _bisect(nodes, place[a[inside]], place[b[inside]], len(nodes) * half // count)
        split(nodes[side], first, half)
        split(nodes[~side], first + half, count - half)
    split(np.arange(n), 0, parts)
    return label


class Router:
    """A network with one hidden layer: vector -> log-probabilities of the parts."""

    def __init__(self, dim: int, parts: int):
        rng = np.random.default_rng(parts)
        self.w1 = rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / max(dim, 1))
        self.b1 = np.zeros(HIDDEN)
        self.w2 = rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN)
        self.b2 = np.zeros(parts)
        self.scale = 1.0

    def one_part(self) -> "Router":
        """Send every vector to the first part."""
        self.w2[:] = 0
        return self

    def fit(self, x: np.ndarray, target: np.ndarray) -> "Router":
        """Cross-entropy against the target distributions, Adam on small batches."""
        self.scale = 1 / max(float(np.sqrt((x * x).mean())), 1e-12)
        x = x * self.scale
        rng = np.random.default_rng(1)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w1, self.b1, self.w2, self.b2)]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 256):
                xb, tb = x[order[s:s + 256]], target[order[s:s + 256]]
                h = np.maximum(xb @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                p = np.exp(z - z.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - tb) / len(xb)
                dh = d @ self.w2.T * (h > 0)
                step += 1
                for p_, g, (m, v) in zip((self.w1, self.b1, self.w2, self.b2),
                                         (xb.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)), state):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p_ -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self


def fit_router(rows: DataFrame, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS) -> tuple[Router, int]:
    """(router, vector length) learned from a bounded sample of ``rows(vec_id, v)``."""
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return Router(0, parts), 0
    dim, n = sizes[0].dim, sizes[0].n
    rows = rows.filter(F.size("v") == dim)
    if n > sample_rows:
        share = int(sample_rows / n * (1 << 62))
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "vec_id"), 2) < F.lit(share))
    got = rows.toArrow()
    order = np.argsort(got.column("vec_id").to_numpy(), kind="stable")
    x = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), dim)[order]
    if len(x) < 2 * parts:
        return Router(dim, parts).one_part(), dim
    graph = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1] + 1),
                       label[np.hstack([np.arange(len(x))[:, None], graph])].ravel()), 1 / (graph.shape[1] + 1))
    return Router(dim, parts).fit(x, target), dim


def _route(router_value, dim: int, parts: int, probes: int):
    """Task function: add the most probable parts; other lengths have a part of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w1, b1, w2, b2, scale = router_value.value
        for batch in batches:
            vs = batch.column(1)
            size = np.asarray(vs.value_lengths())
            usual = np.flatnonzero(size == dim)
            chosen: list = [[parts + int(s)] for s in size]
            if len(usual):
                x = vs.take(pa.array(usual)).flatten().to_numpy(zero_copy_only=False).reshape(len(usual), dim)
                order = np.argsort(-(np.maximum(x * scale @ w1 + b1, 0) @ w2 + b2), axis=1, kind="stable")[:, :probes].astype(int)
                for i, row in zip(usual.tolist(), order.tolist()):
                    chosen[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), vs, pa.array(chosen, pa.list_(pa.int32()))],
                                             names=["vec_id", "v", "parts"])
    return run


def _search(k: int):
    def run(query_ids, queries, ids, x):
        out_q, out_c, out_s = [], [], []
        for s in range(0, len(queries), 64):
            rough = queries[s:s + 64] @ x.T
            for i, row in enumerate(rough):
                q, query = query_ids[s + i], queries[s + i]
                row[ids == q] = -np.inf
                m = min(k, len(row))
                kth = np.partition(row, len(row) - m)[len(row) - m]
                slack = 1e-9 * (1 + abs(kth)) if np.isfinite(kth) else 0
                near = np.flatnonzero((row >= kth - slack) & (row > -np.inf))
                score = (x[near] * query).sum(axis=1)          # the same sum for equal vectors
                order = np.lexsort((ids[near], -score))[:k]
                out_q.append(np.full(len(order), q))
                out_c.append(ids[near][order])
                out_s.append(score[order])
        return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)
    return run


def search(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
           parts: int = PARTS, probes: int = PROBES) -> DataFrame:
    """``(query_id, rank, vec_id, score double)``: each query's k best in the parts it visits,
    which are all parts if its ``probes`` most probable ones hold fewer than k."""
    c = vectors.usable(candidates, id_col, vec_col, zero=False)
    q = vectors.usable(queries, id_col, vec_col, zero=False)
    router, dim = fit_router(c, parts)
    shared = candidates.sparkSession.sparkContext.broadcast((router.w1, router.b1, router.w2, router.b2, router.scale))
    schema = "vec_id long, v array<double>, parts array<int>"
    c = c.mapInArrow(_route(shared, dim, parts, 1), schema).select("vec_id", "v", F.col("parts")[0].alias("part"))
    q = q.mapInArrow(_route(shared, dim, parts, parts), schema)
    blocks = vectors.blocks(c, vectors.BLOCK_ROWS)

    def visit(asked: DataFrame, visited) -> DataFrame:
        rows = asked.select("vec_id", "v", F.explode(visited).alias("part"))
        return vectors.search_blocks(vectors.blocks(rows, vectors.QUERY_ROWS), blocks, _search(k), "double")
    found = Scratch(candidates.sparkSession, "index").keep(vectors.best(visit(q, F.slice("parts", 1, probes)), k))
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = q.filter(F.size("parts") > probes).join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    return vectors.best(found.drop("rank").unionByName(visit(short, F.slice("parts", probes + 1, parts))), k)
