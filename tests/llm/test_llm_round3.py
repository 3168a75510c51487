"""Fill-in-the-middle, quality scores, whitening."""
import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from runledger.llm import fill_in_middle as fim
from runledger.llm import qdwh, quality, textops, whitening
from tests.conftest import SF_SMALL


# ------------------------------------------------------------------------ fill in the middle

def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain_version(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcde é☃𝄞\n") for _ in range(5000))
    texts = [None, "", "a", "<P>", "x<S", "<<M>>", "<M", "é", "𝄞" * 700, passage, passage * 3, "x" + passage, "ab" * 20_000,
             "q" * 255 + "<S>" + "q" * 900, "z" * (fim.KEPT_CHUNK + 10)]
    texts += ["".join(rng.choice(["<", "P", "S", "M", ">", "word ", "☃"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "gone", i) for i, t in enumerate(texts)] + [(None, "no id", "gone", 1), (5, "repeat", "gone", 2), (5, "repeat", "gone", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, `a.b` long")
    got = fim.fill_in_middle(df).withColumn("back", fim.restored())
    assert got.columns == ["doc_id", "text", "a.b", *fim.RESULTS, "back"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("<PSM>é𝄞x"), max_size=12), min_size=1, max_size=6))
def test_chunk_summaries_find_markers_across_chunks(parts):
    marks = tuple(m.encode() for m in fim.MARKS)
    text = "".join(parts)
    t = fim.Text([fim.Summary(p.encode(), marks) for p in parts if p], marks)
    assert t.n == len(text) and t.marked == any(m in text for m in fim.MARKS)
    for k in range(len(text) + 1):
        assert t.cut(k) == len(text[:k].encode())


def test_chunks_follow_content_and_the_cache_verifies():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 8000).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, k).astype(np.uint8), shared]) for k in (100, 777))
    data, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    ends = fim.chunk_ends(data, offsets).tolist()
    assert len(a) in ends and ends[-1] == len(data) and len(ends) > 20
    one = {e - len(a) for e in ends if e > 100 + 300 and e <= len(a)}       # ends in the shared part, from its end
    two = {e - len(data) for e in ends if e > len(a) + 777 + 300}
    assert one == two
    cache = fim.ChunkCache(fim.MARKS, limit=40)
    first = cache.get(7, b"one")
    assert cache.get(7, b"one") is first and cache.get(7, b"two").raw == b"two" and cache.hits == 1
    for k in range(100):
        cache.get(k, b"x" * 10)
    assert cache.size <= 40


def test_markers_must_not_overlap(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<", "<S>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, marks=marks)


# ------------------------------------------------------------------------------- quality

def plain_statistics(text):
    """A few of the statistics, by plain Python."""
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").split() if w]
    lines = [x for x in text.split("\n") if x]
    pairs = list(zip(words, words[1:]))
    lower = [w.lower() for w in words]
    return {"chars": math.log1p(len(text)), "words": math.log1p(len(words)), "lines": math.log1p(len(lines)),
            "upper": sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / max(len(text), 1),
            "beyond_ascii": sum(ord(c) > 127 for c in text) / max(len(text), 1),
            "word_length": sum(map(len, words)) / max(len(words), 1),
            "distinct_words": len(set(lower)) / max(len(words), 1),
            "distinct_pairs": len({(a.lower(), b.lower()) for a, b in pairs}) / max(len(pairs), 1),
            "distinct_lines": len(set(lines)) / max(len(lines), 1),
            "top_word": max(map(lower.count, set(lower)), default=0) / max(len(words), 1)}


def test_document_statistics():
    texts = ["", "One two two.\n\nLINE three\nLINE three\n", "é𝄞 é𝄞\n", "\n\n", "a", " x  y ", "AB!! CD!! $$$ 12"] * 2
    column = textops.pa.array(texts)
    x = quality.statistics(*textops.utf8(column))
    assert x.shape == (len(texts), len(quality.STATISTICS)) and np.isfinite(x).all()
    for text, row in zip(texts, x):
        got = dict(zip(quality.STATISTICS, row))
        for name, value in plain_statistics(text).items():
            assert got[name] == pytest.approx(value), (text, name)
    last = dict(zip(quality.STATISTICS, x[-1]))
    assert last["upper_words"] == 0.5 and last["symbol_words"] == 0.25 and last["symbol_ends"] == 0.25


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 5)), min_size=1, max_size=25))
def test_isotonic_regression_is_the_least_squares_rising_fit(data):
    v, w = (np.array(x, float) for x in zip(*data))
    pool = quality.rising(v, w)
    fit = (np.bincount(pool, v * w) / np.bincount(pool, w))[pool]
    assert (np.diff(fit) >= -1e-12).all()
    # max-min formula of isotonic regression
    mean = lambda i, j: (v[i:j + 1] @ w[i:j + 1]) / w[i:j + 1].sum()
    for k in range(len(v)):
        assert fit[k] == pytest.approx(max(min(mean(i, j) for j in range(k, len(v))) for i in range(k + 1)))


def test_partition_sums_equal_one_kernel_ridge_system(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs.select("doc_id", "text"))
    model = quality.fit(stats.repartition(7), labels)
    rows = stats.join(labels, "doc_id").filter("quality in (0, 1)").collect()
    x = np.stack([np.frombuffer(r.stats, np.float64) for r in rows])
    y = np.array([r.quality for r in rows], float)
    assert np.allclose(model.mean, x.mean(axis=0))
    z = model.features(x)
    gram = z.T @ z + quality.RIDGE * len(y) * np.diag([1.0] * quality.FEATURES + [1e-9])
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(gram, z.T @ y), atol=1e-6)
    # the features' products are near the Gaussian kernel
    s = (x - model.mean) / model.scale
    s = np.clip(s, -quality.REACH, quality.REACH)
    exact = np.exp(-((s[:40, None] - s[None, :40]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2 * x.shape[1]))
    near = z[:40, :-1] @ z[:40, :-1].T
    assert np.abs(near - exact).mean() < 0.06


def test_quality_on_held_out_documents(spark):
    out = E.queries()["op12_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.98
    assert out.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.collect())


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (1, "good words here", "x"), (2, None, "y"), (3, "", "y"), (None, "$$$ $$$", "z"),
                                  (4, "$ $$ " * 50_000, None)], "doc_id long, text string, score string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    out = quality.quality_scores(docs, label([(1, 1), (1, 1), (4, 0), (3, 0), (2, 7), (3, None), (None, 1), (99, 1)]))
    assert out.columns == ["doc_id", "score"]
    rows = out.collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] == by[3] and len({r.score for r in rows if r.doc_id == 1}) == 1
    for labels, want in ([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (77, 1)], 0.0):
        assert {r.score for r in quality.quality_scores(docs, label(labels)).collect()} == {want}
    assert quality.quality_scores(docs.limit(0), label([(1, 1)])).collect() == []


# ------------------------------------------------------------------------------ whitening

@pytest.mark.parametrize("name", ["random", "equal", "low_rank", "graded", "cluster", "diagonal", "ones", "zero", "single"])
def test_qdwh_eigenvectors(name):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    values = {"equal": [1.0] * 15 + [2.0] * 25, "low_rank": [0.0] * 36 + [1, 2, 3, 1e8], "graded": 10.0 ** -np.arange(40),
              "cluster": 1 + 1e-13 * np.arange(40)}
    x = rng.standard_normal((300, 40))
    a = {"random": x.T @ x, "diagonal": np.diag(np.arange(40.0)), "ones": np.ones((40, 40)), "zero": np.zeros((40, 40)),
         "single": np.array([[3.0]])}.get(name)
    if a is None:
        a = q @ np.diag(values[name]) @ q.T
    w, v = qdwh.eigen(a)
    size = max(np.abs(a).max(), 1e-300) * len(a)
    assert np.abs(w - np.linalg.eigvalsh((a + a.T) / 2)[::-1]).max() < 1e-13 * size
    assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-13 and np.abs(a @ v - v * w).max() < 1e-13 * size


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    values = np.array([-5, -1, -1e-9, -1e-3, 1e-12, 2, 3, 4, 5, 6, 7, 1e3])
    assert np.allclose(qdwh.polar(q @ np.diag(values) @ q.T), q @ np.diag(np.sign(values)) @ q.T, atol=1e-3)


def brute_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, v = np.linalg.eigh(c.T @ c / n)
    values, v = values[::-1], v[:, ::-1]
    return c @ v[:, :k] / np.sqrt(values[:k]), ((n * x - s) ** 2).sum(axis=1), values / values.sum()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whiten(df).collect()
    white, deviation, share = brute_whitening(vectors, 8)
    assert len(got) == 400 * 8
    sign = {r.component: np.sign(r.whitened * white[0, r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        assert r.n == 400 and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert r.whitened * sign[r.component] == pytest.approx(white[r.vec_id, r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)


def test_whitening_edge_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [3.0, 2.0]), (2, [1.0, None]), (3, None), (4, [nan, 1.0]), (5, []), (6, [0.0, 0.0]), (6, [0.0, 0.0]), (None, [3.0, 4.0]),
            (7, [1.0]), (8, [2.0]), (9, [1.0, 1.0, 1.0]), (10, [inf, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, n string, component int")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.component) for r in got) == [
        (-1, 1), (-1, 2), (1, 1), (1, 2), (6, 1), (6, 1), (6, 2), (6, 2), (7, 1), (8, 1), (9, 1), (9, 2), (9, 3)]
    by = {(r.vec_id, r.component): r for r in got}
    assert by[1, 1].n == 4 and by[7, 1].n == 2 and abs(by[7, 1].whitened) == pytest.approx(1)
    assert by[9, 1].whitened is None and by[9, 1].explained is None and by[9, 1].identity_error is None and by[9, 1].deviation == 0
    assert by[1, 1].identity_error < 1e-9 and by[1, 1].explained + by[1, 2].explained == pytest.approx(1)
    huge = spark.createDataFrame([(1, [1e300, -1e300]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    wide = whitening.whiten(huge).collect()
    assert len(wide) == 4 and all(r.deviation is None for r in wide)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_sums_and_deviations_stay_exact():
    rng = random.Random(4)
    x = np.array([[rng.randint(-2**62, 2**62), rng.randint(-9, 9)] for _ in range(50)])
    digits = sum(whitening._digits(x[k:k + 10]) for k in range(0, 50, 10))
    assert [whitening._number(c) for c in digits[:-1].T] == [sum(map(int, c)) for c in x.T] and digits[-1, 0] == 50
    for reach in (10, 1 << 20, 1 << 30, 1 << 36, 1 << 50, 1 << 61):
        x = np.array([[rng.randint(-reach, reach) for _ in range(3)] for _ in range(20)])
        sums = [sum(map(int, c)) for c in x.T]
        want = [sum((20 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        assert whitening._deviation(x, 20, sums) == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_quality_classifier", "op13_embedding_whitening"])
def test_new_queries_cover_their_tables(spark, name):
    out = E.queries()[name](spark, SF_SMALL)
    if name == "op13_embedding_whitening":
        assert out.count() == 8 * whitening.usable(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")).count()
        return
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
    if name == "op11_fill_in_middle":
        back = out.join(docs, "doc_id").filter(F.sha2("text", 256) != F.col("restored_sha256"))
        assert back.count() == 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op12_quality_classifier"])
def test_a_null_id_is_not_held_out(spark, tmp_path, name):
    docs = spark.createDataFrame([(None, "some words"), (1, None), (2, "other words here")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = E.queries()[name](spark, str(tmp_path)).collect()
    assert len(out) == 3 and all(isinstance(r.held_out, bool) and 0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
