"""Fill-in-the-middle transformation with memoised content-defined chunks.

A text is cut into chunks where a rolling hash of its last ``WINDOW`` bytes meets a fixed
pattern, so passages that documents share fall into equal chunks wherever they stand. A chunk's
boundary summary (code points, whether it holds a marker, its first and last characters) is
kept in a cache under the chunk's hash and used again only where the bytes are equal. Joined in
order, the summaries give the text's length in code points and its markers, also those across
chunks; cumulated counts find the chunk of each cut, and only that chunk is read for the
cut's place in bytes.

The middle is moved to the end: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``, ``plain`` the text as it is. Cuts and form follow from the id
alone, so a rerun or a repeated row gives the same output.

Defined results: a null text counts as empty, and an empty text is plain; a text that holds a
marker is plain, so every output can be rebuilt; rows that repeat an id are cut by the same
draws, each by its own length; a null id draws as the empty id; very long texts are handled
whole, one at a time; an empty table gives no rows. Input columns stay, but for those named
like a result column, which the results replace.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

MARKS = ("<P>", "<S>", "<M>")     # prefix, suffix, middle
FIM_SHARE, SPM_SHARE = 90, 20     # of 100 texts, and of 100 transformed texts
SEED = 1
WINDOW = 16                       # bytes that decide a chunk's end
MASK = (1 << 8) - 1               # one place of 256 ends a chunk
CACHE_BYTES = 64 << 20            # of chunk texts a worker keeps
KEPT_CHUNK = 1 << 16              # longer chunks are summarised each time
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all texts, in order; every text's end is one.

    A chunk ends before the start of a code point, where the hash of the ``WINDOW`` bytes before
    it meets the pattern and the window lies in the text."""
    ends = offsets[1:][np.diff(offsets) > 0]
    if len(data) <= WINDOW:
        return ends
    starts = np.arange(len(data) - WINDOW)
    hashes = textops.span_hashes(data, starts, starts + WINDOW, fold=False)
    place = np.flatnonzero((hashes & np.uint64(MASK)) == 0) + WINDOW
    place = place[(data[place] & 0xC0) != 0x80]
    first = offsets[np.searchsorted(offsets, place, side="right") - 1]      # start of the place's text
    return np.union1d(ends, place[place - first >= WINDOW])


class Summary:
    """What a chunk contributes to its text; ``head`` and ``tail`` hold up to two bytes."""
    __slots__ = ("raw", "chars", "marked", "head", "tail")

    def __init__(self, raw: bytes, marks: tuple[bytes, ...]):
        self.raw = raw
        self.chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))
        self.marked = any(m in raw for m in marks)
        edge = max(map(len, marks)) - 1
        self.head, self.tail = raw[:edge], raw[-edge:] if edge else b""

    def place(self, chars: int) -> int:
        """Byte position of a code point of this chunk."""
        if self.chars == len(self.raw):
            return chars
        return len(self.raw.decode("utf-8", "surrogatepass")[:chars].encode("utf-8", "surrogatepass"))


class ChunkCache:
    """Summaries by chunk hash, verified by content; the oldest half goes when it is full."""

    def __init__(self, marks: tuple[str, ...], limit: int = CACHE_BYTES):
        self.marks = tuple(m.encode() for m in marks)
        self.known: dict[int, Summary] = {}
        self.size, self.limit, self.hits, self.misses = 0, limit, 0, 0

    def get(self, key: int, raw: bytes) -> Summary:
        found = self.known.get(key)
        if found is not None and found.raw == raw:
            self.hits += 1
            return found
        self.misses += 1
        made = Summary(raw, self.marks)
        if found is None and len(raw) <= KEPT_CHUNK:
            if self.size + len(raw) > self.limit:
                for old in list(self.known)[:(len(self.known) + 1) // 2]:
                    self.size -= len(self.known.pop(old).raw)
            self.known[key] = made
            self.size += len(raw)
        return made


class Text:
    """A text as its chunks' summaries."""

    def __init__(self, chunks: list[Summary], marks: tuple[bytes, ...]):
        self.chunks = chunks
        self.chars = [0, *accumulate(c.chars for c in chunks)]
        self.bytes = [0, *accumulate(len(c.raw) for c in chunks)]
        self.marked = any(c.marked for c in chunks) or self._across(marks)

    @property
    def n(self) -> int:
        return self.chars[-1]

    def _across(self, marks: tuple[bytes, ...]) -> bool:
        """Whether a marker stands across chunks. The last bytes so far are carried on, so it
        may also span several short chunks."""
        edge = max(map(len, marks)) - 1
        last = b""
        for c in self.chunks:
            joint = last + c.head
            if any(m in joint for m in marks):
                return True
            last = c.tail if len(c.raw) >= edge else (last + c.raw)[-edge:] if edge else b""
        return False

    def cut(self, chars: int) -> int:
        """Byte position of a code point."""
        k = bisect_right(self.chars, chars) - 1
        return self.bytes[k] + (self.chunks[k].place(chars - self.chars[k]) if k < len(self.chunks) else 0)


def arrange(raw: bytes, text: Text, draws: tuple[int, int, int, int], marks: tuple[str, ...], fim: int, spm: int) \
        -> tuple[str, int | None, int | None, bytes]:
    """``(form, prefix_chars, middle_chars, output)`` of one text under four draws."""
    n = text.n
    if not n or text.marked or draws[2] % 100 >= fim:
        return "plain", None, None, raw
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = text.cut(first), text.cut(second)
    p, s, m = (x.encode() for x in marks)
    if draws[3] % 100 < spm:
        return "spm", first, second - first, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return "psm", first, second - first, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def _transform(marks: tuple[str, ...], fim: int, spm: int):
    coded = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = textops.large_cache(("fim", marks), lambda: ChunkCache(marks))
        for batch in batches:
            draws = [batch.column(c).to_pylist() for c in range(1, 5)]
            data, offsets = textops.utf8(batch.column(0))
            for i, j, b, o in textops.chunks(data, offsets):
                ends = chunk_ends(b, o)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                keys = textops.span_hashes(b, starts, ends, fold=False).tolist() if len(ends) else []
                of_text = np.searchsorted(starts, o).tolist()
                starts, ends, raw = starts.tolist(), ends.tolist(), b.tobytes()
                cols: list[list] = [[], [], [], [], []]
                for k in range(j - i):
                    text = Text([cache.get(keys[c], raw[starts[c]:ends[c]]) for c in range(of_text[k], of_text[k + 1])], coded)
                    form, prefix, middle, output = arrange(raw[o[k]:o[k + 1]], text, tuple(d[i + k] for d in draws),
                                                           marks, fim, spm)
                    for col, value in zip(cols, (text.n, form, prefix, middle, output)):
                        col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(5).slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())],
                    names=["row", *RESULTS])
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   marks: tuple[str, str, str] = MARKS, fim: int = FIM_SHARE, spm: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The four draws are the first four 8-digit groups of the hex sha256 of ``seed:id``. No marker
    may contain another, and a marker's first character stands in no other place of a marker,
    so that an output splits in one way only."""
    if any(a in b for a in marks for b in marks if a is not b) or any(m[0] in n[1:] for m in marks for n in marks):
        raise ValueError("markers overlap")
    textops.small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(text_col).cast("string").alias("t"), *draws, F.struct("*").alias("row"))
    schema = rows.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long") \
        .add("middle_chars", "long").add("output", "string")
    done = rows.mapInArrow(_transform(marks, fim, spm), schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in RESULTS], *RESULTS)


def restored(marks: tuple[str, str, str] = MARKS, output: str = "output", form: str = "form") -> F.Column:
    """The text rebuilt from ``output`` and ``form``; each marker occurs once in an output."""
    out = F.col(output)
    p, s, m = marks

    def between(left: str, right: str) -> F.Column:
        return F.substring_index(F.substring_index(out, right, 1), left, -1)

    middle = F.substring_index(out, m, -1)
    return (F.when(F.col(form) == "psm", F.concat(between(p, s), middle, between(s, m)))
            .when(F.col(form) == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(out))
