"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are held in blocks. A block sorts its objects once per dimension. For a query, each
dimension's list is read from the end its weight prefers, all lists in step; every object met
is scored in full at once (random access). What no list has shown yet scores at most the sum
of the weights times the values last read, so reading stops as soon as that bound is below
the k-th best score. (An equal bound goes on, as a tie may go to a smaller id.)
Blocks' results meet in a ranked merge.

Defined results: null vectors and such with null or non-finite components take no part; a
repeated id counts once; vectors of other lengths than the query's are no candidates; an all
zero query scores 0 everywhere, so its ties go by id; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

FIRST_DEPTH = 16          # entries read from each list before the first test
GROWTH = 4                # each further round reads this many times as deep


def threshold_topk(query: np.ndarray, x: np.ndarray, rising: np.ndarray, skip: int, k: int) \
        -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, scores, objects scored) of the k best rows of ``x`` for one query.

    ``rising``: per dimension the positions in ascending order of value. ``skip``: position
    that is no candidate (-1: none). Rows of ``x`` are in order of id."""
    n = len(x)
    plus, minus = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(n, bool)
    if skip >= 0:
        seen[skip] = True
    top, scores, scored, depth = np.zeros(0, np.int64), np.zeros(0, x.dtype), 0, 0
    reach = FIRST_DEPTH if len(plus) + len(minus) else n
    while depth < n:
        end = min(n, reach)
        met = np.zeros(n, bool)
        if len(plus):
            met[rising[plus, n - end:n - depth].ravel()] = True
        if len(minus):
            met[rising[minus, depth:end].ravel()] = True
        if end == n:
            met[:] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        scored += len(new)
        s = (x @ query)[new] if 4 * len(new) > n else x[new] @ query
        top, scores = np.concatenate([top, new]), np.concatenate([scores, s])
        if len(top) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= kth
            top, scores = top[near], scores[near]
            order = np.lexsort((top, -scores))[:k]
            top, scores = top[order], scores[order]
        depth, reach = end, reach * GROWTH
        if len(top) >= k and depth < n:
            last = np.concatenate([x[rising[plus, n - depth], plus] * query[plus],
                                   x[rising[minus, depth - 1], minus] * query[minus]]).sum()
            if scores.min() > last:
                break
    order = np.lexsort((top, -scores))[:k]
    return top[order], scores[order], scored


def _search(k: int):
    def run(query_ids, queries, ids, x):
        # products stay exact in float64 below 2^53; larger ones are computed as integers
        limit = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, x.shape[1])
        kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64
        x, queries = x.astype(kind), queries.astype(kind)
        rising = np.argsort(x, axis=0, kind="stable").T
        own = np.searchsorted(ids, query_ids)
        out_q, out_c, out_s = [], [], []
        for i, q in enumerate(query_ids):
            at = int(own[i]) if own[i] < len(ids) and ids[own[i]] == q else -1
            top, scores, _ = threshold_topk(queries[i], x, rising, at, k)
            out_q.append(np.full(len(top), q))
            out_c.append(ids[top])
            out_s.append(scores.astype(np.int64))
        return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)
    return run


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
               vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score long)``: each query's k highest integer inner products.

    Vectors hold whole numbers. A candidate with the query's own id is left out. Every query
    meets every candidate block (queries are a stated set, joined in blocks)."""
    rows = [vectors.usable(t, id_col, vec_col, zero=True).withColumn("part", F.size("v")) for t in (candidates, queries)]
    found = vectors.search_blocks(vectors.blocks(rows[1], vectors.QUERY_ROWS),
                                  vectors.blocks(rows[0], vectors.BLOCK_ROWS), _search(k), "long")
    return vectors.best(found, k)
