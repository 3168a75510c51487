"""What a fit leaves on the driver, and what its tasks hold."""
import os
import random

import numpy as np
import pyarrow as pa

from runledger.llm import mixing, textops, toxicity


def test_steps_leave_no_broadcast_behind(spark):
    docs = spark.createDataFrame([(i, f"{'vile slur' if i % 2 else 'kind word'} number {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    folder = spark.sparkContext._temp_dir
    before = set(os.listdir(folder))
    model = toxicity.fit(docs, labels)
    assert not {f for f in set(os.listdir(folder)) - before if os.path.getsize(os.path.join(folder, f)) > 1 << 20}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(40))


def test_stored_rows_are_held_by_their_slots():
    sizes = [9_000] * 40 + [0, toxicity.STORED_SLOTS + 5, 1]
    gaps = pa.array([[1] * n for n in sizes], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(len(sizes))], pa.int32()), gaps], names=["toxic", "gaps"])
    parts = list(toxicity._stored(iter([batch])))
    assert all(len(slot) <= toxicity.STORED_SLOTS or len(toxic) == 1 for toxic, _, slot in parts)
    assert [int(t) for toxic, _, _ in parts for t in toxic] == [i % 2 for i in range(len(sizes))]
    assert [int((row == k).sum()) for toxic, row, _ in parts for k in range(len(toxic))] == sizes
    assert all((slot[row == k] == np.arange(1, (row == k).sum() + 1)).all() for toxic, row, slot in parts for k in range(len(toxic)))


def test_settings_of_the_fit_are_given_back(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with textops.few_rows(spark, 3):
        assert spark.conf.get(key) == "3"
    assert spark.conf.get(key) == before


def test_bags_are_stored_by_chunks_of_texts():
    rng = random.Random(4)
    texts = ["", None, " "] + [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 60))) for _ in range(2500)]
    stored = list(mixing._store_bags(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert sum(b.num_rows for b in stored) == 1
    x, words = mixing._bags(*textops.utf8(pa.array(texts)))
    parts = list(mixing._matrices(iter(stored)))
    assert [len(p[0]) for p in parts] == [1024, 1024, 452]
    assert np.array_equal(np.concatenate([p[0] for p in parts]), x[words > 0])
    counts, _ = mixing._counts(*textops.utf8(pa.array(texts)))
    assert np.array_equal(np.concatenate([p[3] for p in parts]), counts[counts > 0])
    (least,) = mixing._least(iter(stored))
    bags = [(np.flatnonzero(c).tolist(), c[c > 0].tolist()) for c in counts[words > 0]]
    assert (least.column(0)[0].as_py(), least.column(1)[0].as_py()) == min(bags)


def test_steps_hold_only_the_slots_with_a_value(spark, monkeypatch):
    """pipeline: the driver's vectors are as wide as the slots whose ratio is not 0, and the weights are those of all slots."""
    rows = spark.createDataFrame([(k % 2, [k % 7, 3, 90 + k % 2 * 5]) for k in range(40)], "toxic int, gaps array<int>")
    ratios = toxicity._ratios(rows, 20, 20)
    used, widths, whole = np.flatnonzero(ratios), [], toxicity._sum_slots

    def watched(*a):
        out, numbers = whole(*a)
        widths.append(out.shape)
        return out, numbers
    monkeypatch.setattr(toxicity, "_sum_slots", watched)
    weights, _ = toxicity._logistic(rows, ratios, 20, 40)
    assert 0 < len(used) < 40 and set(widths) == {(1, len(used))} and len(widths) == toxicity.STEPS
    assert weights.shape == (toxicity.SLOTS,) and set(np.flatnonzero(weights)) <= set(used) and weights.any()
    assert not toxicity._logistic(rows, np.zeros(toxicity.SLOTS), 20, 40)[0].any()
