"""Document quality: ridge regression on random Fourier features, calibrated by isotonic regression.

A document is described by statistics of its characters, words and lines. Random Fourier
features of the standardised statistics approximate a Gaussian kernel, so the ridge regression
on them is an approximate kernel regression. Its normal equations are sums over rows: each task
adds up its own, Spark adds the tasks' sums, and the driver solves a system whose size is the
number of features. All labelled rows enter, there is no sample.

The sums are kept apart by fold (a hash of the statistics, so copies fall into one fold). Each
fold is scored by the solution of the others; a fine histogram of these scores (``BINS`` cells,
counts from all rows) is pooled into a rising step function, and scores between the steps'
centres are interpolated.

Defined results: a null text counts as empty and an empty text has zero statistics, so it gets
the score of such; labels other than 0 and 1 and null ids do not train; repeated documents and
repeated label rows count each; without training rows the score is 0.5, with one class its
label; an empty table gives no rows. Input columns stay, but for one named like the result,
which is replaced; the text of any length is read whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .moments import matrix_sums
from .store import Scratch

FEATURES = 256            # random Fourier features
WIDTH = 1.0               # kernel width per square root of the number of statistics
RIDGE = 1e-4              # penalty per training row
FOLDS = 4
BINS = 4096               # cells of the raw scores from LOW to HIGH
LOW, HIGH = -1.0, 2.0
THRESHOLD = 0.7
REACH = 6.0               # standardised statistics are read within this range
SEED = 12

STATISTICS = ("chars", "upper", "digit", "space", "newline", "stop", "symbol", "beyond_ascii", "byte_entropy", "words",
              "word_length", "word_spread", "upper_words", "symbol_words", "symbol_ends", "distinct_words", "top_word",
              "distinct_pairs", "lines", "line_length", "distinct_lines", "top_line", "short_lines", "distinct_triples")

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SYMBOL, _LEAD, _INNER = range(8)


def _classes() -> np.ndarray:
    kind = np.full(256, _SYMBOL, np.uint8)
    kind[65:91], kind[97:123], kind[48:58] = _UPPER, _LOWER, _DIGIT
    kind[[32, 9, 10, 11, 12, 13]] = _SPACE
    kind[list(b".,;:!?'\"()-")] = _STOP
    kind[128:192], kind[192:] = _INNER, _LEAD
    return kind


_CLASS = _classes()


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def _repeats(owner: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: items, distinct items and the count of the most frequent one."""
    total = np.bincount(owner, minlength=docs)
    if not len(owner):
        return total, total, total
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
    run = np.diff(np.append(first, len(o)))
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, o[first], run)
    return total, np.bincount(o[first], minlength=docs), top


def _joined(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the runs of ``width`` words inside the texts."""
    if len(hashes) < width:
        return owner[:0], hashes[:0]
    factor, last = textops.seeded(width, 13), len(hashes) - width + 1
    with np.errstate(over="ignore"):
        mixed = sum(hashes[k:k + last] * factor[k] for k in range(width))
    inside = owner[:last] == owner[width - 1:]
    return owner[:last][inside], textops.mix64(mixed[inside])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a chunk."""
    docs = len(offsets) - 1
    sizes = np.diff(offsets)
    kind = _CLASS[data]
    text = np.repeat(np.arange(docs), sizes)
    counts = np.bincount(text * 8 + kind, minlength=docs * 8).reshape(docs, 8)
    chars = sizes - counts[:, _INNER]
    breaks = np.flatnonzero(data == 10)
    newline = np.bincount(text[breaks], minlength=docs)

    histogram = np.bincount(text * 256 + data, minlength=docs * 256).reshape(docs, 256)
    p = histogram / np.maximum(sizes, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)

    words = textops.Words(data, offsets)
    owner = np.repeat(np.arange(docs), np.diff(words.bounds))
    starts, ends = (words.starts, words.ends) if len(words.hashes) else (np.zeros(0, np.int64),) * 2
    sums = {k: np.concatenate([[0], np.cumsum(kind == k)]) for k in (_UPPER, _LOWER, _SYMBOL, _LEAD, _INNER)}
    part = {k: s[ends] - s[starts] for k, s in sums.items()}
    length = ends - starts - part[_INNER]
    n, distinct, top = _repeats(owner, words.hashes, docs)
    mean = _share(np.bincount(owner, length, docs), n)
    spread = np.sqrt(np.maximum(_share(np.bincount(owner, length.astype(float) ** 2, docs), n) - mean**2, 0))
    shouted = (part[_UPPER] >= 2) & (part[_LOWER] + part[_LEAD] == 0)
    pairs, distinct_pairs, _ = _repeats(*_joined(words.hashes, owner, 2), docs)
    triples, distinct_triples, _ = _repeats(*_joined(words.hashes, owner, 3), docs)

    # lines: between line breaks and the texts' edges, empty ones left out
    edges = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.append(edges[1:], len(data))
    full = line_ends > edges
    edges, line_ends = edges[full], line_ends[full]
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(edges) else line_ends
    full = line_ends > edges
    edges, line_ends = edges[full], line_ends[full]
    line_owner = text[edges]
    lines, distinct_lines, top_line = _repeats(
        line_owner, textops.span_hashes(data, edges, line_ends, fold=False) if len(edges) else np.zeros(0, np.uint64), docs)

    def words_with(which: np.ndarray) -> np.ndarray:
        return _share(np.bincount(owner[which], minlength=docs), n)

    return np.stack([
        np.log1p(chars), _share(counts[:, _UPPER], chars), _share(counts[:, _DIGIT], chars),
        _share(counts[:, _SPACE], chars), _share(newline, chars) * 10, _share(counts[:, _STOP], chars),
        np.sqrt(_share(counts[:, _SYMBOL], chars)), _share(counts[:, _LEAD], chars), entropy, np.log1p(n),
        mean, spread, words_with(shouted), words_with(part[_SYMBOL] == length),
        words_with(kind[ends - 1] == _SYMBOL), _share(distinct, n), _share(top, n),
        _share(distinct_pairs, pairs), np.log1p(lines), np.log1p(_share(chars, lines)),
        _share(distinct_lines, lines), _share(top_line, lines),
        _share(np.bincount(line_owner[line_ends - edges < 20], minlength=docs), lines),
        _share(distinct_triples, triples)], axis=1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    textops.drop_large_cache()
    for batch in batches:
        data, offsets = textops.utf8(batch.column(0))
        got: list[bytes] = []
        for _, _, b, o in textops.chunks(data, offsets):
            got.extend(line.tobytes() for line in statistics(b, o))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.binary())], names=["row", "stats"])


def document_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` without the text, with the binary column ``name``: the doubles of ``STATISTICS``."""
    textops.small_batches(docs.sparkSession)
    stay = [c for c in docs.columns if c.lower() not in (text_col.lower(), name.lower())]
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.struct(*[docs[f"`{c}`"] for c in stay]).alias("row"))
    done = rows.mapInArrow(_describe, rows.select("row").schema.add("stats", "binary"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in stay], F.col("stats").alias(name))


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    """Standardisation, random directions and phases, ridge weights and the calibration's knots."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray         # raw scores
    levels: np.ndarray        # calibrated scores

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        d = x.shape[1]
        draw = np.random.default_rng(SEED)
        turn = draw.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
        phase = draw.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -REACH, REACH)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + phase), np.ones((len(x), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.knots, self.levels)


def rising(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression: the rising sequence nearest to ``value`` (pool adjacent violators),
    as the number of the pool of each entry."""
    pools: list[list[float]] = []        # sum, weight, entries
    for v, w in zip(value.tolist(), weight.tolist()):
        pools.append([v * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.repeat(np.arange(len(pools)), [int(p[2]) for p in pools])


def ridge(gram: np.ndarray, penalty: float = RIDGE) -> np.ndarray:
    """Weights from the summed ``[features, target]`` products; the constant is not penalised."""
    d = len(gram) - 1
    n = gram[d - 1, d - 1]
    return np.linalg.solve(gram[:d, :d] + penalty * n * np.diag([1.0] * (d - 1) + [1e-9]), gram[:d, d])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """The model from all rows of ``stats`` (see ``document_statistics``) that have a label."""
    label = F.col(label_col).cast("int")
    # one row for each id: copies of a label are weights, so neither side of the join multiplies
    one = (labels.select(F.col(id_col).cast("long").alias("__id"), label.alias("y")).filter("__id is not null and y in (0, 1)")
           .groupBy("__id").agg(F.count("*").cast("double").alias("w"), F.sum("y").cast("double").alias("wy")))
    scratch = Scratch(stats.sparkSession, "quality")
    train = scratch.keep(
        stats.select(F.col(id_col).cast("long").alias("__id"), "stats").join(one, "__id")
        .select("stats", "w", "wy", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold")))

    def read(batch: pa.RecordBatch):
        return (_matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy())

    def moments(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x, w, wy, _ = read(batch)
        yield 0, np.stack([w @ x, w @ x**2, np.full(x.shape[1], w.sum()), np.full(x.shape[1], wy.sum())])

    def products(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x, w, wy, fold = read(batch)
        full = np.hstack([model.features(x), (wy / w)[:, None]])
        for f in np.unique(fold):
            at = fold == f
            yield int(f), (full[at] * w[at, None]).T @ full[at]

    def histogram(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x, w, wy, fold = read(batch)
        z = model.features(x)
        raw = np.einsum("ij,ij->i", z, held_out[fold])
        cell = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
        yield 0, np.stack([np.bincount(cell, v, BINS) for v in (w, wy, w * np.clip(raw, LOW, HIGH))])

    d = len(STATISTICS)
    model = Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    sums = matrix_sums(train, moments).get(0)
    if sums is not None:
        total, positive = sums[2, 0], sums[3, 0]
        model.levels = np.array([positive / total])
        if 0 < positive < total:
            model.mean = sums[0] / total
            spread = np.sqrt(np.maximum(sums[1] / total - model.mean**2, 0))
            model.scale = np.where(spread > 1e-9, spread, 1.0)
            folds = matrix_sums(train, products)
            gram = sum(folds.values())
            held_out = np.stack([ridge(gram - folds[f]) if f in folds and gram[-2, -2] > folds[f][-2, -2] else ridge(gram)
                                 for f in range(FOLDS)])
            model.weights = ridge(gram)
            w, wy, ws = matrix_sums(train, histogram)[0]
            cell = np.flatnonzero(w)
            pool = rising(wy[cell] / w[cell], w[cell])
            size = np.bincount(pool, w[cell])
            model.knots, model.levels = np.bincount(pool, ws[cell]) / size, np.bincount(pool, wy[cell]) / size
    scratch.drop_all_but()
    return model


def score(stats: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Rows of ``document_statistics`` with the column ``name`` in place of the statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(
        (model.mean, model.scale, model.weights, model.knots, model.levels))     # some thousand numbers
    stay = [c for c in stats.columns if c.lower() not in ("stats", name.lower())]
    rows = stats.select("stats", F.struct(*[stats[f"`{c}`"] for c in stay]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            raw = model.features(_matrix(batch.column(0))) @ model.weights
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.calibrated(raw))], names=["row", "score"])

    done = rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in stay], F.col("score").alias(name))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", name: str = "score") -> DataFrame:
    """All documents, without their text, with their quality; fitted on ``labels``. Texts are read
    once; the statistics (about 200 bytes a document) are kept in the shared folder."""
    stats = Scratch(docs.sparkSession, "quality").keep(document_statistics(docs, text_col))
    return score(stats, fit(stats, labels, id_col, label_col), name)
