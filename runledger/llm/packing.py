"""Sequence packing by minimum bin slack on the histogram of piece lengths.

Documents are tokenized and cut into pieces of at most the window size; a document's last
piece is its remainder. Packing never looks at single documents: it works on the counts per
piece length (at most ``capacity`` numbers). As long as pieces are left, the longest
remaining length opens a window and a subset-sum over the remaining multiset, held as a
bitset with bounded counts, finds the set of lengths that comes closest to filling it; the
counts are read back from the bitsets of the prefixes. The pattern found is used as often as
the counts allow. Pieces are then numbered within their length and looked up in the plan.

Numbering is two-level (length, then salt by the length's own count), so a length that very
many documents share is no hot group.

Defined results: a null or empty text is the end token alone; repeated rows are separate
documents; a null id is kept; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .store import Scratch

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
EOS = 1
RANK_ROWS = 20_000        # pieces that one numbering group should hold
CACHE_WORDS = 1_200_000   # words a Python worker remembers

# Texts made of these characters only (ASCII and most Latin letters up to U+017F) are split by
# white space and then by ``_WORD`` exactly as the tokenizer splits them: they need no
# composition and change case one to one. Any other text goes to the tokenizer as a whole.
_WORD = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|(?:[^\w\s]|_)+")
_OK = np.zeros(256, bool)
_OK[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True


def _odd_texts(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Texts that need the tokenizer's own splitting."""
    bad = ~_OK[b]
    if len(b) > 1:
        x, y = b[:-1], b[1:]
        bad[:-1] |= ((x == 0xC3) & ((y == 0x97) | (y == 0xB7))) | ((x == 0xC4) & (y == 0xB0)) | ((x == 60) & (y == 124))
    return np.unique(np.searchsorted(o, np.flatnonzero(bad), side="right") - 1)


class _Ragged:
    """Growing list of id sequences in flat arrays."""

    def __init__(self):
        self.flat, self.starts, self.lens = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.n = self.used = 0

    def append(self, flat: np.ndarray, lens: np.ndarray) -> None:
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 2, "<u4")])
        while len(self.lens) < self.n + len(lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros(len(x) // 2, x.dtype)]) for x in (self.starts, self.lens))
        self.flat[self.used:self.used + len(flat)] = flat
        self.lens[self.n:self.n + len(lens)] = lens
        self.starts[self.n:self.n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.n, self.used = self.n + len(lens), self.used + len(flat)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the sequences, one after the other; their lengths)."""
        lens = self.lens[which].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[which] - (ends - lens), lens) + np.arange(total)], lens


class _Keys:
    """Numbers 0, 1, .. of distinct hashes in order of arrival, as sorted arrays (12 bytes each).

    New hashes collect in a small part that is merged into the large one now and then."""

    def __init__(self):
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.n = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1. ``hashes`` are sorted and distinct."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, numbers in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = numbers[at[hit]]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Number new (sorted) hashes."""
        numbers = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.n += len(hashes)
        large, small = self.parts
        small = self._merge(small, (hashes, numbers))
        if len(small[0]) > 100_000:
            large, small = self._merge(large, small), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.parts = [large, small]
        return numbers

    @staticmethod
    def _merge(a, b):
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


class WordTokens:
    """Token ids of texts.

    A word (run without white space) is known by a 64-bit hash and encoded once per worker:
    it is split into the tokenizer's pieces, and these go through its bare model. The cache
    takes about 40 bytes a word and starts anew when it is full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the model's own names for the bytes of the characters of plain texts
        self.names = str.maketrans({c: "".join(x for x, _ in level.pre_tokenize_str(c))
                                    for c in map(chr, [*range(33, 127), *range(0xC0, 0x180)])})
        self._clear()

    def _clear(self) -> None:
        self.keys, self.words = _Keys(), _Ragged()

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words."""
        split = [_WORD.findall(w.lower()) for w in words]
        piece: dict[str, int] = {}
        at = np.fromiter((piece.setdefault(p, len(piece)) for parts in split for p in parts), np.int64)
        got = self.bare.encode([p.translate(self.names) for p in piece], is_pretokenized=True, add_special_tokens=False)
        pieces = _Ragged()
        pieces.append(np.array(got.ids, "<u4"), np.bincount(np.array(got.word_ids, np.int64), minlength=len(piece)))
        flat, lens = pieces.take(at)
        count = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(count)])]
        self.words.append(flat, np.diff(ends))

    def __call__(self, b: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a chunk."""
        words = textops.Words(b, o)
        out: list = [np.zeros(0, "<u4")] * (len(o) - 1)
        if len(words.hashes):
            known, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            if self.keys.n + len(known) > CACHE_WORDS:
                self._clear()
            at = self.keys.find(known)
            new = np.flatnonzero(at < 0)
            if len(new):
                raw = b.tobytes()
                self._learn([raw[s:e].decode("utf-8", "replace") for s, e in
                             zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())])
                at[new] = self.keys.add(known[new])
            ids, lens = self.words.take(at[inverse])
            cuts = np.concatenate([[0], np.cumsum(lens)])[words.bounds].tolist()
            out = [ids[s:e] for s, e in zip(cuts[:-1], cuts[1:])]
        for i in _odd_texts(b, o).tolist():
            text = b[o[i]:o[i + 1]].tobytes().decode("utf-8", "replace")
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return out


def worker_tokens(path: str) -> WordTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return textops.large_cache(("tokens", path), lambda: WordTokens(path))


def _cut(path: str, capacity: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(path)
        end = np.array([EOS], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            data, offsets = textops.utf8(batch.column(1))
            for i, j, b, o in textops.chunks(data, offsets):
                row, start, length, crc, total, parts = [], [], [], [], [], []
                for k, got in enumerate(tokens(b, o)):
                    got = got.tobytes() + end
                    n = len(got) // 4
                    for s in range(0, n, capacity):
                        piece = got[4 * s:4 * (s + capacity)]
                        row.append(i + k)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            parts.append(np.frombuffer(piece, "<i4"))
                columns = [ids.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens[, ids])`` of all documents.

    ``with_ids`` adds the token ids themselves; placing pieces does not need them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_cut(tokenizer_path, capacity, with_ids), schema)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within their counts) with the largest sum <= room."""
    mask, reach, steps, used = (1 << (room + 1)) - 1, 1, [], []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        steps.append(reach)
        used.append(length)
        left, k = min(counts[length], room // length), 1
        while left:                                   # bounded count by doubling shifts
            k = min(k, left)
            reach |= (reach << (k * length)) & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in zip(reversed(used), reversed(steps)):
        n = 0
        while not before >> total & 1:                # fewest of this length that reach back
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rows ``(length, lo, hi, sequence, per_window, offset)`` and the number of sequences.

    Pieces of ``length`` numbered lo..hi-1 go, ``per_window`` each, to the sequences from
    ``sequence`` on, one behind the other from ``offset``."""
    left = {x: c for x, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = best_fill(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        offset = 0
        for x in sorted(pattern, reverse=True):
            n = pattern[x]
            rows.append((x, taken[x], taken[x] + n * times, sequence, n, offset))
            taken[x] += n * times
            left[x] -= n * times
            if not left[x]:
                del left[x]
            offset += n * x
        sequence += times
    return rows, sequence


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (columns doc_id, start, length).

    Only the counts per length (at most ``capacity`` numbers) come to the driver; the plan
    that goes back has some rows per length and is broadcast."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = plan_windows(counts, capacity)
    plan = spark.createDataFrame(plan, "length long, lo long, hi long, sequence long, per long, at long")
    groups = spark.createDataFrame([(x, -(-n // RANK_ROWS)) for x, n in counts.items()], "length long, groups long")
    tie = ("doc_id", "start", "ids_crc32", "doc_tokens")
    salted = (pieces.join(F.broadcast(groups), "length")
              .withColumn("__g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "groups")).drop("groups"))
    sizes = salted.groupBy("length", "__g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__g").orderBy(*tie)
    ranked = (salted.withColumn("__r", F.row_number().over(within) - 1).join(bases, ["length", "__g"])
              .withColumn("__r", F.col("__r") + F.col("__base")))
    hit = (F.col("p.length") == F.col("x.length")) & F.col("x.__r").between(F.col("p.lo"), F.col("p.hi") - 1)
    step = F.col("x.__r") - F.col("p.lo")
    return (ranked.alias("x").join(F.broadcast(plan.alias("p")), hit)
            .select(*[F.col(f"x.{c}") for c in pieces.columns],
                    (F.col("p.sequence") + (step - step % F.col("p.per")) / F.col("p.per")).cast("long").alias("sequence_id"),
                    (F.col("p.at") + (step % F.col("p.per")) * F.col("x.length")).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and place all documents. Pieces are stored once in the shared folder."""
    textops.small_batches(docs.sparkSession)
    pieces = Scratch(docs.sparkSession, "pieces").keep(
        cut_documents(docs, tokenizer_path, id_col, text_col, capacity, with_ids))
    return place_pieces(pieces, capacity)
