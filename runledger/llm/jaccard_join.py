"""N-gram Jaccard self-join with adaptive multi-match prefixes (near-duplicate classes).

Documents are sets of distinct word shingles. Two documents link when the Jaccard
similarity of their sets reaches the threshold (an exact integer test).

Method
1. *Order.* A fixed-size count sketch over all shingles of all documents estimates how
   common each shingle is. Shingles are ordered by frequency class, then hash; any fixed
   order keeps the prefix argument exact, a rare-first order keeps posting lists short.
2. *Adaptive prefix.* If two sets share at least T shingles, they share at least l of them
   within their first ``size - T + l`` shingles, for every l. Each document picks the l
   (1..L_MAX) with the least estimated cost: posting entries read plus candidates to verify,
   a longer prefix demanding l common prefix shingles. In a pair, the document that comes
   later by (size, id) probes with its own l; the earlier one is found by index entries,
   whose prefix may be shorter (``ceil(6n/7)`` common shingles are needed there at 0.75).
3. *Classes of equal sets* are joined first, so only one document of each goes on.
4. *Stars.* Each list names a head, the document with the largest share of shared shingles
   (the original of a group of copies). Every document is tested against the head it shares
   most with, and the links are contracted to components. Further rounds draw heads by a
   hash in lists of several components, while enough of their tests link.
5. *Rest.* Pairs from different components that share at least l prefix shingles, pass the
   size test and can still reach the threshold by the positions of their matches (after a
   match by what is left of both sets, before it by the shingles that other components
   hold, too) are tested. Pairs inside one component need no check, as they cannot change the classes; so
   a group of thousands of near copies costs about its size, not its square.
6. *Test.* Parity bitmaps of the sets rule out most pairs without their texts (the sets
   differ in at least as many shingles as the bitmaps differ in bits). The others are tested
   exactly on whole texts. Texts of documents in posting lists are found by an id filter of
   fixed size, so no text is shuffled to find them; what passes it by chance is never used.

List heads come from combined maxima and common shingles are salted, so no list is held in
one task's memory. Nothing is capped: a shingle shared by many documents is only ordered late.

Defined results: null or word-less texts have an empty set and link with nothing; a text
shorter than a shingle is one shingle (its whole word sequence); rows that repeat an id are
allowed (their sets all count under that id); null ids take no part and are not returned;
an empty table gives no rows. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .components import connected_components
from .store import Scratch

SKETCH_BITS = 18          # counters of the frequency sketch (a fixed 2 MB)
SKETCH_PARTS = 32         # pieces in which tasks hand it over
L_MAX = 4                 # longest prefix extension a document may choose
VERIFY_COST = 8.0         # cost of a verification in posting entries
VERIFY_ROWS = 64          # pairs whose sets are held at a time
SALTS = 16                # window groups of a shingle above the lowest frequency class
FILTER_BITS = 24          # bits of the id filter (a fixed 2 MB)
STAR_ROUNDS = 8           # rounds of drawn heads at most
STAR_YIELD = 0.05         # share of star tests that must link for another round
PARITY_BITS = 2048        # bits of a document's parity bitmap
STAR_SHARE = 0.4          # share of a prefix that a star pair must have in common
NUM, DEN = 75, 100        # similarity threshold as a fraction


def _scan(num_words: int):
    """Task function: one row per document plus the task's part of the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textops.drop_large_cache()
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        none = lambda n, t: pa.nulls(n, t)
        for batch in batches:
            ids = batch.column(0)
            data, offsets = textops.utf8(batch.column(1))
            size, h1, h2 = [], [], []
            for _, _, b, o in textops.chunks(data, offsets):
                for s in textops.shingle_sets(b, o, num_words):
                    size.append(len(s))
                    with np.errstate(over="ignore"):
                        h1.append(int(s.sum(dtype=np.uint64)))
                        h2.append(int(textops.mix64(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)))
                    np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1) \
                        if len(s) < 64 else _bump(sketch, s)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int32()),
                 pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)),
                 none(n, pa.int32()), none(n, pa.binary())], names=["doc_id", "n", "h1", "h2", "part", "counts"])
        if sketch.any():
            parts = np.split(sketch, SKETCH_PARTS)
            k = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays(
                [none(k, pa.int64()), none(k, pa.int32()), none(k, pa.int64()), none(k, pa.int64()),
                 pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "n", "h1", "h2", "part", "counts"])
    return run


def _bump(sketch: np.ndarray, s: np.ndarray) -> None:
    """Count a sorted set; equal counters are adjacent, so runs are added at once."""
    at = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sketch[at[first]] += np.diff(np.r_[first, len(at)])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up sketch pieces; one running array per piece number (at most SKETCH_PARTS)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            add = np.frombuffer(raw.as_buffer(), np.int64)
            total[part] = total[part] + add if part in total else add
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        names=["part", "counts"])


def _classes(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency class, estimated number of documents) of each counter."""
    mean = max(1.0, float(sketch.mean()))
    cls = np.clip(np.floor(2 * np.log2(np.maximum(1.0, sketch / (mean + 4 * np.sqrt(mean))))), 0, 31)
    return cls.astype(np.uint64), np.maximum(1.0, sketch - mean - 3 * np.sqrt(mean))


def _prefixes(num_words: int, sketch_value, num: int, den: int):
    """Task function: each document's prefix (ordered shingles) and its chosen l."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, freq = _classes(np.frombuffer(sketch_value.value, np.int64))
        for batch in batches:
            ids = batch.column(0)
            data, offsets = textops.utf8(batch.column(1))
            at = 0
            for _, _, b, o in textops.chunks(data, offsets):
                toks, lens, ells, sizes = [], [0], [], []
                for s in textops.shingle_sets(b, o, num_words):
                    n = len(s)
                    sizes.append(n)
                    if n == 0:
                        lens.append(lens[-1])
                        ells.append(0)
                        continue
                    slot = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    order = (cls[slot] << np.uint64(58)) | (s >> np.uint64(6))
                    by = np.argsort(order)
                    need = -(-num * n // den)                 # overlap with any partner not smaller
                    least = -(-2 * num * n // (num + den))    # overlap with a partner not smaller, as index side
                    df = freq[slot[by[:n - need + L_MAX]]]
                    cost = np.cumsum(df)
                    top = min(L_MAX, need)
                    ends = np.minimum(np.arange(1, top + 1) + n - need, n) - 1
                    ell = int(np.argmin(cost[ends] + VERIFY_COST * cost[ends] / np.arange(1, top + 1))) + 1
                    width = min(n, max(n - need + ell, n - least + L_MAX))
                    toks.append(order[by[:width]])
                    lens.append(lens[-1] + width)
                    ells.append(ell)
                flat = np.concatenate(toks).view(np.int64) if toks else np.zeros(0, np.int64)
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, k), pa.array(sizes, pa.int32()), pa.array(ells, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat))],
                    names=["doc_id", "n", "ell", "toks"])
                at += k
    return run


def _verify(num_words: int, num: int, den: int):
    """Task function: exact test of (a, b, text_a, text_b); yields linked pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, VERIFY_ROWS):
                sets = []
                for column in (2, 3):
                    data, offsets = textops.utf8(batch.column(column).slice(at, VERIFY_ROWS))
                    sets.append([s for _, _, b, o in textops.chunks(data, offsets)
                                 for s in textops.shingle_sets(b, o, num_words)])
                for i, (s, t) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    ok[at + i] = both > 0 and den * both >= num * (len(s) + len(t) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)],
                                             names=["a", "b"])
    return run


def _id_slots(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (textops.mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = _id_slots(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array((slot >> 6).astype(np.int32)), pa.array(np.int64(1) << (slot & 63))], names=["word", "bits"])


def _id_filter(ids: DataFrame) -> bytes:
    """A filter of fixed size (2 MB) that every one of ``ids`` passes and few others do."""
    words = (ids.mapInArrow(_filter_words, "word int, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def _fetch(num_words: int, filter_value):
    """Task function: the texts that pass the filter, with their parity bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(filter_value.value, np.int64)
        for batch in batches:
            slot = _id_slots(batch.column(0).to_numpy())
            batch = batch.filter(pa.array((words[slot >> 6] >> (slot & 63)) & 1 == 1))
            data, offsets = textops.utf8(batch.column(1))
            bits = []
            for _, _, b, o in textops.chunks(data, offsets):
                for s in textops.shingle_sets(b, o, num_words):
                    odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            flat = np.concatenate(bits) if bits else np.zeros(0, np.int64)
            k = PARITY_BITS // 64
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(flat))],
                names=["doc_id", "text", "parity"])
    return run


def _links(pairs: DataFrame, texts: DataFrame, scratch: Scratch, num_words: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, na, b, nb)`` that link, as ``(a, b)``.

    Two sets differ in at least as many shingles as their parity bitmaps differ in bits, so
    most pairs need no texts; the others are tested exactly."""
    bits = texts.select("doc_id", "parity")
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("parity").alias("pa")), "a")
            .join(bits.select(F.col("doc_id").alias("b"), F.col("parity").alias("pb")), "b")
            .filter(differ <= F.expr(f"na + nb - 2 * ceil({num} * (na + nb) / {num + den})"))
            .select("a", "b").distinct())
    near = scratch.keep(near)
    return scratch.keep(
        near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb").mapInArrow(_verify(num_words, num, den), "a long, b long"))


def _sketch(scan: DataFrame) -> np.ndarray:
    """The summed count sketch: a fixed 2 MB, whatever the input."""
    pieces = (scan.filter("part is not null").select("part", "counts")
              .repartition(SKETCH_PARTS, "part").mapInArrow(_sum_parts, "part int, counts binary").collect())
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(sketch) // SKETCH_PARTS
    for part, raw in pieces:
        sketch[part * width:(part + 1) * width] += np.frombuffer(raw, np.int64)
    return sketch


def _postings(pre: DataFrame) -> DataFrame:
    """``(tok, doc_id, n, ell, pos)`` without the entries that are alone under their shingle.

    Shingles above the lowest frequency class are salted (their entries all stay), so that a
    very common one is no single window group."""
    post = pre.select("doc_id", "n", "ell", F.posexplode("toks").alias("pos", "tok"))
    common = F.shiftrightunsigned("tok", 58) > 0
    post = post.withColumn("salt", F.when(common, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    group = Window.partitionBy("tok", "salt").orderBy("doc_id")
    return (post.withColumn("prev", F.lag("doc_id").over(group)).withColumn("next", F.lead("doc_id").over(group))
            .filter(F.col("prev").isNotNull() | F.col("next").isNotNull() | common)
            .select("tok", "doc_id", "n", "ell", "pos"))


def _star_pairs(post: DataFrame, num: int, den: int) -> DataFrame:
    """Each document with the list head of another component it shares most prefix shingles with.

    The head of a list is its entry of highest ``prio``. Heads are found by a map-side combined
    maximum, so a common shingle is no hot group."""
    heads = (post.groupBy("tok").agg(F.max(F.struct("prio", "doc_id", "n", "component")).alias("h"))
             .select("tok", F.col("h.doc_id").alias("hd"), F.col("h.n").alias("hn"), F.col("h.component").alias("hc")))
    near = (post.join(heads, "tok")
            .filter(f"component <> hc and {den} * least(n, hn) >= {num} * greatest(n, hn)")
            .groupBy("doc_id", "hd", "n", "hn").agg(F.count("*").alias("shared"))
            .filter(F.col("shared") >= F.lit(STAR_SHARE * (1 - num / den)) * F.col("n"))
            .groupBy("doc_id").agg(F.max(F.struct("shared", "hd", "n", "hn")).alias("best")))
    return near.select(F.col("doc_id").alias("a"), F.col("best.n").alias("na"),
                       F.col("best.hd").alias("b"), F.col("best.hn").alias("nb"))


def _mixed(post: DataFrame, links: DataFrame) -> DataFrame:
    """The entries, with their component, of lists that hold more than one component."""
    comp = connected_components(links).select(F.col("node").alias("doc_id"), "component")
    tagged = (post.join(comp, "doc_id", "left")
              .select("tok", "doc_id", "n", "ell", "pos", F.coalesce("component", "doc_id").alias("component")))
    mixed = (tagged.groupBy("tok").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo <> hi").select("tok"))
    return tagged.join(mixed, "tok")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           num_words: int = textops.SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """-> ``(doc_id long, n_shingles long, component_id long)``, one row per input row."""
    spark = docs.sparkSession
    textops.small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .filter("doc_id is not null"))
    scan = scratch.keep(docs.mapInArrow(
        _scan(num_words), "doc_id long, n int, h1 long, h2 long, part int, counts binary"))
    shared = spark.sparkContext.broadcast(_sketch(scan).tobytes())

    # one document for each class of equal sets
    sets = scan.filter("part is null").select("doc_id", "n", "h1", "h2")
    rep = sets.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = rep.select(F.col("rep").alias("doc_id")).distinct()
    pre = docs.mapInArrow(_prefixes(num_words, shared, num, den), "doc_id long, n int, ell int, toks array<long>")
    post = _postings(pre.filter("n > 0").join(reps, "doc_id", "left_semi"))
    # a document owes its own l only as a probe; as the smaller one of a pair it owes the probe's,
    # so every document with an entry goes on. Those with the largest share of shared shingles
    # (a copied original) become the heads of lists
    own = Window.partitionBy("doc_id")
    post = scratch.keep(post.withColumn("m", F.count("*").over(own))
                        .select("tok", "doc_id", "n", "ell", "pos", (F.col("m") / F.col("n")).alias("prio")))
    found = spark.sparkContext.broadcast(_id_filter(post.select("doc_id").distinct()))
    texts = scratch.keep(docs.mapInArrow(_fetch(num_words, found), "doc_id long, text string, parity array<long>"))
    star = post.withColumn("component", F.col("doc_id"))
    links = _links(scratch.keep(_star_pairs(star, num, den)), texts, scratch, num_words, num, den)
    tagged = scratch.keep(_mixed(post.drop("prio"), links))
    # later heads are drawn by a hash, as long as such tests find links at a fair rate (a group
    # of copies whose original is missing)
    for turn in range(STAR_ROUNDS):
        drawn = tagged.withColumn("prio", F.xxhash64("doc_id", F.lit(turn)).cast("double"))
        pairs = scratch.keep(_star_pairs(drawn, num, den))
        found = _links(pairs, texts, scratch, num_words, num, den)
        links = links.union(found)
        tagged = scratch.keep(_mixed(tagged.drop("component"), links))
        if found.count() < STAR_YIELD * pairs.count():
            break

    # pairs of different components that share at least the probe's l prefix shingles; of the
    # shingles before a match only those in lists of several components can be shared, too
    mine = Window.partitionBy("doc_id").orderBy("pos")
    tagged = scratch.keep(tagged.withColumn("r", F.row_number().over(mine) - 1)
                          .withColumn("m", F.count("*").over(own)))
    x = tagged.filter(f"m >= ell and pos < n - ceil({num} * n / {den}) + ell").select(
        "tok", F.col("doc_id").alias("b"), F.col("n").alias("nb"), "ell", F.col("pos").alias("pb"),
        F.col("component").alias("cb"), F.col("r").alias("rb"))
    y = tagged.select("tok", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"),
                      F.col("component").alias("ca"), F.col("r").alias("ra"))
    pairs = (x.join(y, "tok").filter(
        f"ca <> cb and (na < nb or (na = nb and a < b)) and {den} * na >= {num} * nb "
        f"and pa < na - ceil({2 * num} * na / {num + den}) + ell "
        f"and least(ra, rb) + least(na - pa, nb - pb) >= ceil({num} * (na + nb) / {num + den})")
        .groupBy("a", "b", "ell", "na", "nb")
        .agg(F.count("*").alias("shared"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .filter(f"shared >= ell and shared + least(na - pa - 1, nb - pb - 1) >= ceil({num} * (na + nb) / {num + den})")
        .select("a", "na", "b", "nb"))
    links = links.union(_links(pairs, texts, scratch, num_words, num, den))
    final = connected_components(links).select(F.col("node").alias("rep"), "component")
    scratch.drop_all_but(scan)
    rep = rep.join(final, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("c"))
    return (sets.join(rep, ["n", "h1", "h2"], "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("c", "doc_id").alias("component_id")))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose near-duplicate class has a smaller id.

    Documents without words are kept. An id is kept or dropped with all its rows: a class is one
    of ids, and rows that repeat an id may differ in text or other columns, so none stands for
    the others."""
    classes = near_duplicate_classes(docs, id_col, text_col)
    gone = (classes.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct())
    kept = docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
    return kept
