"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a word;
dynamic programming carries the best score, the number of pieces on the best path and
whether its last piece is unknown. Ties are those of the tokenizer: among equal scores the
path whose last piece starts first stays; a character that no one-character piece covers may
stand as unknown at the lowest score less 10; neighbouring unknown pieces count as one.

A text is cut before every blank (a blank, or the mark U+2581, begins a word; the first word
gets one if it has none), so words are counted independently. Each worker remembers the counts
of the words it has met, by a 64-bit hash, and starts anew when ``CACHE_WORDS`` are held.

Defined results: a null or empty text has 0 tokens; repeated rows and null ids are kept row by
row; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model with their scores; the unknown piece is
    first. Control and byte pieces and runs of blanks are left out."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = [i for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.id_to_piece(i).strip(MARK) == ""
                    and len(m.id_to_piece(i)) > 1)]
    return [("<unk>", 0.0)] + [(m.id_to_piece(i), float(m.get_score(i))) for i in keep]


class UnigramCounter:
    """Piece counts of words under ``vocab`` (its first entry is the unknown piece)."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocab):
            self.automaton.add_word(piece, (len(piece), score, k == 0))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY

    def __call__(self, word: str) -> int:
        n = len(word)
        if n == 0:
            return 0
        score, count, last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = -1                                       # end of the current matches
        best, pieces, unk, single = None, 0, False, False
        unknown = self.unknown

        def close(upto):
            """Settle the ends at..upto - 1; only ``at`` has had matches."""
            nonlocal best, pieces, unk, single, at
            while at < upto:
                if at >= 0:
                    if not single:
                        s = score[at] + unknown
                        if best is None or s > best:
                            best, unk = s, True
                            pieces = count[at] + (0 if last[at] else 1)
                    score[at + 1], count[at + 1], last[at + 1] = best, pieces, unk
                at += 1
                best, single = None, False

        close(0)
        for end, (length, value, is_unk) in self.automaton.iter(word):
            if end != at:
                close(end)
            start = end + 1 - length
            s = score[start] + value
            if best is None or s > best:
                best, unk = s, is_unk
                pieces = count[start] + (0 if is_unk and last[start] else 1)
            if length == 1:
                single = True
        close(n)
        return count[n]


def _segments(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, texts) of the stretches between blanks, without an empty first one."""
    docs = len(o) - 1
    blank = np.flatnonzero(b == 32)
    owner = np.searchsorted(o, blank, side="right") - 1
    starts, texts = np.concatenate([o[:-1], blank + 1]), np.concatenate([np.arange(docs), owner])
    first = np.concatenate([np.ones(docs, bool), np.zeros(len(blank), bool)])
    order = np.lexsort((~first, starts, texts))
    starts, texts, first = starts[order], texts[order], first[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    final = np.ones(len(starts), bool)
    final[:-1] = texts[1:] != texts[:-1]
    ends[final] = o[1:][texts[final]]
    keep = ~(first & (ends == starts))
    return starts[keep], ends[keep], texts[keep]


def _counts(vocab_value, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, vocab = vocab_value.value
        counter, known = textops.large_cache(("unigram", mark), lambda: (UnigramCounter(vocab), {}))
        for batch in batches:
            col = batch.column(column)
            data, offsets = textops.utf8(col)
            if bytes(data.data).find(MARK.encode()) >= 0:         # the mark is a blank
                data, offsets = textops.utf8(pa.array([t and t.replace(MARK, " ") for t in col.to_pylist()], pa.string()))
            total = np.zeros(batch.num_rows, np.int64)
            for i, j, b, o in textops.chunks(data, offsets):
                starts, ends, texts = _segments(b, o)
                if not len(starts):
                    continue
                words, first, inverse = np.unique(textops.span_hashes(b, starts, ends, fold=False),
                                                  return_index=True, return_inverse=True)
                if len(known) + len(words) > CACHE_WORDS:
                    known.clear()
                raw, n = b.tobytes(), np.zeros(len(words), np.int64)
                for k, h in enumerate(words.tolist()):
                    c = known.get(h)
                    if c is None:
                        w = first[k]
                        c = known[h] = counter(MARK + raw[starts[w]:ends[w]].decode("utf-8", "replace"))
                    n[k] = c
                total[i:j] += np.bincount(texts, n[inverse], minlength=j - i).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)],
                                             names=[*batch.schema.names, "__tokens"])
    return run


def count_tokens(docs: DataFrame, vocab: list[tuple[str, float]], text_col: str = "text",
                 name: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``name``: tokens of the text (a column of that name is replaced)."""
    textops.small_batches(docs.sparkSession)
    docs = docs.drop(name)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast((hash(tuple(vocab)), vocab))   # the vocabulary only
    schema = docs.withColumn("__tokens", F.lit(0).cast("long")).schema
    return docs.mapInArrow(_counts(shared, docs.columns.index(text_col)), schema).withColumnRenamed("__tokens", name)
