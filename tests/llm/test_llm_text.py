"""Near duplicates, toxicity, mixing, HTML text and the shared text helpers."""
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.llm import components, html_text, jaccard_join, mixing, textops, toxicity


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    """{id: (set size, class)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB éß\t\n\x0b\x1c ☃", max_size=40), max_size=6))
def test_shingle_sets_match_plain_python(texts):
    data, offsets = textops.utf8(pa.array(texts, pa.string()))
    got = [s for _, _, b, o in textops.chunks(data, offsets, 16) for s in textops.shingle_sets(b, o)]
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        assert (set(got[i].tolist()) == set(got[j].tolist())) == (shingles(texts[i]) == shingles(texts[j]))


def near_copies(seed, groups=12):
    """Groups of copies whose similarity lies on both sides of the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    line = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
            rows.append(text.upper() if rng.random() < .2 else text + (" " + line if rng.random() < .3 else ""))
    rng.shuffle(rows)
    return [(i * 3 - 20, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_classes(df).collect()}
    assert got == brute_classes(rows)
    assert len({c for _, c in got.values()}) < len(got)


def test_classes_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "One two", "x"), (5, "one TWO", "x"), (6, long, "x"),
            (7, long + " end", "x"), (8, "a b c d e f", "x"), (8, "a b c d e f", "x"), (None, "one two", "x"), (9, "one two three", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("n", F.lit(1))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_classes(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 19_996, 6), (7, 19_997, 6), (8, 2, 8), (8, 2, 8), (9, 1, 9)]
    kept = jaccard_join.keep_one_per_class(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 3, 4, 6, 8, 8, 9]))
    assert jaccard_join.near_duplicate_classes(df.limit(0)).collect() == []


def test_pairs_whose_sides_choose_different_prefixes(spark, monkeypatch):
    """Whatever the sketch estimates, a pair may link by fewer shared prefix shingles than the
    smaller set's own l."""
    counts = np.random.default_rng(5).choice([0, 27], 1 << jaccard_join.SKETCH_BITS, p=[2 / 3, 1 / 3])
    monkeypatch.setattr(jaccard_join, "_sketch", lambda scan: counts.astype(np.int64))
    rng = random.Random(3)
    sets = []
    for g in range(3000):
        base = {f"s{g}x{i}" for i in range(rng.randint(4, 12))}
        sets += [base, base | {f"e{g}x{i}" for i in range(rng.randint(1, len(base) // 3))}]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id long, text string").coalesce(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_classes(df, num_words=1).collect()}
    near = {i for i in range(0, len(sets), 2) if 100 * len(sets[i]) >= 75 * len(sets[i + 1])}
    assert got == {i: i - i % 2 if i - i % 2 in near else i for i in range(len(sets))}


def test_a_prefix_length_serves_every_multiplicity():
    """Two sets with overlap T share at least l of their first ``n - T + l`` members."""
    rng = random.Random(4)
    for _ in range(300):
        x, y = (set(rng.sample(range(60), rng.randint(1, 50))) for _ in range(2))
        t = len(x & y)
        for ell in range(1, min(4, t) + 1):
            px, py = (set(sorted(s)[:len(s) - t + ell]) for s in (x, y))
            assert len(px & py) >= ell


def test_components_of_path_star_and_ring(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 100 + i) for i in range(30)]
    ring = [(500 + i, 500 + (i + 1) % 7) for i in range(7)]
    rng = random.Random(0)
    rows = path + star + ring + [(7, 7), (None, 3)]
    rng.shuffle(rows)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys([1000, *range(100, 130)], 100), **dict.fromkeys(range(500, 507), 500)}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ------------------------------------------------------------------------------- toxicity

def toxic_table(n=400):
    rng = random.Random(3)
    plain = ["river", "table", "green", "walk", "paper", "stone", "music", "window", "garden", "letter"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Vilegrub", "nastymuck", "foulwort"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_separates_held_out_documents(spark):
    rows = toxic_table()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert all((s >= toxicity.THRESHOLD) == bool(y) for s, y in held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, y in rows if not y}


def test_toxicity_weighs_more_ngrams_than_any_short_list(spark):
    """700 toxic words, each in few documents: thousands of n-grams carry the label, none alone."""
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    bad, plain = [word("bdgkz") for _ in range(700)], [word("aeimnorst") for _ in range(700)]
    rows = [(i, " ".join([rng.choice(plain) for _ in range(30)] + [rng.choice(bad) for _ in range(4 * (i % 3 == 0))]), int(i % 3 == 0))
            for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (model.weights != 0).sum() > 4096
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert sum(held) / len(held) > .97


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    """One id with many labels and many documents does not fill the sample; votes settle its label."""
    rows = toxic_table(200)
    hot = [(7, f"river stone walk {i}") for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows] + hot + [(8, rows[8][1])] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, 1)] * 400 + [(7, 0)] * 900, "doc_id long, toxic int")
    sizes, keep = [], toxicity.Scratch.keep

    def counted(self, df):
        kept = keep(self, df)
        sizes.append(kept.groupBy("toxic").count().collect())
        return kept
    monkeypatch.setattr(toxicity.Scratch, "keep", counted)
    toxicity.fit(docs, labels.filter("doc_id in (7, 8, 12)"), fit_rows=2000)      # equal rows once
    toxicity.fit(docs, labels.filter("doc_id in (7, 12)"), fit_rows=300)          # a draw of the hot id's rows
    assert {r.toxic: r["count"] for r in sizes[0]} == {0: 3001, 1: 2}
    assert 200 < sum(r["count"] for r in sizes[1]) < 400


def test_toxicity_edge_cases(spark):
    rows = toxic_table(120)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (None, "river", "s"),
                                  (902, "river " * 30_000 + "vilegrub foulwort", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 124 and got[900] == got[901] and got[902] > .5 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(docs.limit(0), model).collect() == []
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_ngram_slots_stay_inside_texts():
    data, offsets = textops.utf8(pa.array(["ab", "", "cdé"], pa.string()))
    owner = toxicity._doc_of(offsets)
    seen = [(int(owner[p]), n) for (ps, _), n in zip(toxicity.ngram_slots(data, offsets), toxicity.ORDERS) for p in ps]
    # with a blank on either side the texts have 4, 2 and 6 bytes
    assert sorted(seen) == [(0, 4), (2, 4), (2, 4), (2, 4), (2, 5), (2, 5), (2, 6)]


# --------------------------------------------------------------------------------- mixing

def test_raking_meets_feasible_margins(spark):
    rng = random.Random(5)
    rows = [(s, l, t, rng.randint(500, 5000)) for s in "abcd" for l in ("en", "fr", None) for t in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    total = sum(r[3] for r in rows)
    got = mixing.calibrated_cells(cells).toPandas()
    got["kept"] = got.tokens * got.probability
    assert abs(got.kept.sum() / total - mixing.BUDGET) < .01 and got.probability.between(0, 1).all()
    for d, p in mixing.POWERS.items():
        want = {r[0]: r.target for r in mixing.margin_targets(cells, d, mixing.BUDGET * total, p).collect()}
        have = got.groupby(d, dropna=False).kept.sum()
        assert abs(sum(want.values()) / (mixing.BUDGET * total) - 1) < 1e-3
        for k, v in want.items():
            assert abs(have[k if k is not None else np.nan] / v - 1) < .02


def test_raking_agrees_with_plain_ipf(spark):
    """Without capped cells the result is classic iterative proportional fitting."""
    t = np.array([[100.0, 300], [50, 20]])
    cells = spark.createDataFrame([(str(i), str(j), int(t[i, j])) for i in range(2) for j in range(2)], "a string, b string, tokens long")
    goal = {"a": {"0": 60.0, "1": 15.0}, "b": {"0": 35.0, "1": 40.0}}
    frames = {d: spark.createDataFrame(list(g.items()), f"{d} string, target double") for d, g in goal.items()}
    w = t.copy()
    for _ in range(200):
        w *= (np.array([60, 15]) / w.sum(axis=1))[:, None]
        w *= np.array([35, 40]) / w.sum(axis=0)
    got = {(r.a, r.b): r.tokens * r.probability for r in mixing.rake(cells, frames, tolerance=1e-9).collect()}
    assert all(abs(got[str(i), str(j)] - w[i, j]) < 1e-3 for i in range(2) for j in range(2))


def test_raking_reports_contradictory_margins(spark):
    """Margins of different sums cannot be met at once: raking ends and says by how much."""
    cells = spark.createDataFrame([(a, b, 100) for a in "xy" for b in "uv"], "a string, b string, tokens long")

    def frames(last):
        return {"a": spark.createDataFrame([("x", 60.0), ("y", 40.0)], "a string, target double"),
                "b": spark.createDataFrame([("u", 50.0), ("v", last)], "b string, target double")}
    off = {r.deviation for r in mixing.rake(cells, frames(150.0)).collect()}
    assert len(off) == 1 and off.pop() > .3
    met = mixing.rake(cells, frames(50.0)).collect()
    assert {r.deviation < mixing.TOLERANCE for r in met} == {True}
    assert abs(sum(r.tokens * r.probability for r in met if r.a == "x") - 60) < .5
    assert mixing.rake(cells.limit(0), frames(50.0)).collect() == []


def test_topics_are_fitted_on_all_documents(spark):
    """Two documents of 6,000 are a topic of their own, and the centroids are the means of all."""
    rng = random.Random(8)
    vocab = [[f"{t}{i}" for i in range(40)] for t in "abc"]
    texts = [" ".join(rng.choices(vocab[i % 2], k=60)) for i in range(5998)] + [" ".join(vocab[2][:30])] * 2
    docs = spark.createDataFrame([(7 if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    centers = mixing.fit_topics(docs, topics=3)
    x, _ = mixing._bags(*textops.utf8(pa.array(texts, pa.string())))
    near = np.argmax(x @ centers.T, axis=1)
    assert len({*near[-2:]}) == 1 and (near == near[-1]).sum() == 2
    for k in range(3):
        m = x[near == k].sum(axis=0)
        assert np.allclose(centers[k], m / np.sqrt(m @ m), atol=1e-4)


def test_mixture_edge_cases(spark):
    rows = [(1, None, None, "a"), (2, "", "en", None), (3, "x " * 50_000, "en", "a"), (4, "one two", "fr", "b"), (4, "one two", "fr", "b"),
            (None, "three", "fr", "b")] + [(10 + i, f"text number {i}", "en", "c") for i in range(30)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, topic string")
    got = mixing.mixture(docs).toPandas()
    assert len(got) == len(rows) and got.probability.between(0, 1).all() and got.tokens.sum() == 50_000 + 5 + 90
    kept = mixing.keep_mixture(docs)
    assert kept.columns == docs.columns
    ids = got[got.kept.astype(bool)].doc_id
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted("None" if i != i else str(int(i)) for i in ids)
    assert mixing.mixture(docs.limit(0)).collect() == []


# ----------------------------------------------------------------------------------- html

CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a <b>b</b>\n  c", "a b c"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>pear<td>12</table>", "Name  Qty\npear  12"),
    ("<table><tr><td rowspan=2>a<td>bb<tr><td>c</table>", "a  bb\n   c"),
    ("<div>x<div style='color:red; display : none'>no</div><span hidden>no</span>y</div>", "xy"),
    ("<pre>\n a\n  b</pre>t", " a\n  b\n\nt"),
    ("<title>T</title><script>var a='<p>no';</script><style>p{}</style>yes", "yes"),
    ("<p>fish &amp; chips&nbsp;&lt;3", "fish & chips <3"),
    ("<!-- no --><b>bold<p>in</b>out</p>", "bold\n\ninout"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<a href='x>y'>z</a", "z"), ("1 < 2 > 0", "1 < 2 > 0"), ("", ""),
]


@pytest.mark.parametrize("source,want", CASES)
def test_visible_text(source, want):
    assert html_text.visible_text(source) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>",
                                 "<b>", "</b>", "</x>", "<br>", "w1", "w2", " w3 ", "<!--c-->", "<h1>", " < ", " > "]), max_size=30))
def test_no_visible_word_is_lost(parts):
    source = "".join(parts)
    assert sorted(re.findall(r"w\d", html_text.visible_text(source))) == sorted(re.findall(r"w\d", re.sub(r"<!--.*?-->", "", source)))


def random_page(rng, depth=0):
    """(HTML with optional end tags left out at random, the lines that it shows); a list item is
    a word and inner lists."""
    word = lambda: rng.choice(["pear", "a fig", "x&amp;y", "<b>bold</b> one", "sp  ace"])
    seen = lambda w: re.sub(" +", " ", re.sub("<.*?>", "", w)).replace("&amp;", "&")
    end = lambda tag: rng.choice([f"</{tag}>", ""])

    def items(level):
        kind, number = rng.choice(["ul", "ol"]), rng.randint(1, 12)
        source, lines = f"<ul>\n" if kind == "ul" else f"<ol start={number}>", []
        for k in range(rng.randint(1, 3)):
            lead = "- " if kind == "ul" else f"{number + k}. "
            w = word()
            source += f"<li>{w}"
            lines.append(lead + seen(w))
            if level < 4 and rng.random() < 0.4:
                inner, shown = items(level + 1)
                source += inner
                lines += [" " * len(lead) + x for x in shown]
            source += end("li") + rng.choice(["", "\n  "])
        return source + f"</{kind}>", lines

    def table():
        grid = [[word() if rng.random() < 0.9 else "" for _ in range(3)] for _ in range(rng.randint(1, 3))]
        source = "<table>" + rng.choice(["", "<tbody>", "<tbody>\n"])
        for row in grid:
            source += "<tr>" + "".join(f"<td>{w}" + end("td") for w in row) + end("tr")
        shown = [[seen(w) for w in row] for row in grid]
        used = [c for c in range(3) if any(row[c] for row in shown)]
        width = [max(len(row[c]) for row in shown) for c in range(3)]
        lines = ["  ".join(row[c].ljust(width[c]) for c in used).rstrip() for row in shown]
        return source + "</table>", [x for x in lines if x]

    source, blocks = "", []
    for _ in range(rng.randint(1, 6)):
        pick = rng.randrange(5)
        if pick == 0:
            w = word()
            html, lines = f"<p>{w}{end('p')}", [seen(w)]
        elif pick == 1:
            html, lines = items(0)
        elif pick == 2:
            html, lines = table()
        elif pick == 3:
            html, lines = rng.choice(["<p hidden>no</p>", "<div style='display:none'>no<p>no</div>", "<script>no()</script>"]), []
        else:
            html, lines = "<pre>\n k  \tv\n  x</pre>", [" k  \tv", "  x"]
        source += html + rng.choice(["", "\n"])
        if lines:
            blocks.append("\n".join(lines))
    return source, "\n\n".join(blocks)


def test_random_pages_show_what_they_were_made_of():
    rng = random.Random(6)
    for _ in range(3000):
        source, want = random_page(rng)
        assert html_text.visible_text(source) == want.strip("\n"), source


@pytest.mark.parametrize("tag", ["div", "ul", "ul><li", "ol><li", "table", "table><tr><td", "blockquote", "b", "span><p"])
def test_deep_pages(tag):
    shut = "".join(f"</{t}>" for t in reversed(tag.split("><")))
    for source in (f"<{tag}>" * 5000 + "x", f"<{tag}>" * 5000 + "x" + shut * 5000 + "y"):
        text = html_text.visible_text(source)
        assert re.findall("[xy]", text) == re.findall("[xy]", source.replace(tag, "").replace(shut, ""))
        assert max(map(len, text.split("\n"))) <= html_text.INDENT + 2


def test_long_pages():
    assert html_text.visible_text("word " * 200_000).count("word") == 200_000
    assert html_text.visible_text("<p>word" * 50_000).count("\n\nword") == 49_999


def test_extract_text_edge_cases(spark):
    rows = [(1, "<p>a</p>", "keep"), (2, None, "x"), (3, "", None), (1, "<p>a</p>", "keep")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, html string, Text string, `__text` int")
    out = html_text.extract_text(df)
    assert out.columns == ["page_id", "__text", "text"]
    got = out.collect()
    assert sorted((r.page_id, r.text) for r in got if r.text is not None) == [(1, "a"), (1, "a"), (3, "")]
    assert len(got) == 4 and html_text.extract_text(df.limit(0)).collect() == []
