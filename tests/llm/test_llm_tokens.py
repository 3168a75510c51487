"""Chat formatting, packing, token counts, the pipeline and the registered queries."""
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__ as E
import corpus_pipeline
from runledger.llm import chat, jaccard_join, mixing, packing, textops, token_counts, toxicity
from runledger.llm.template import Template, TemplateError
from tests.conftest import SF_SMALL

CONTROL = st.text(alphabet=st.sampled_from(list("\\#: <>/turn\né☃a")), max_size=30) | st.lists(
    st.sampled_from(["\\", "### ", ": ", "</turn>", "\n", "x", ":", "#"]), max_size=8).map("".join)


# ------------------------------------------------------------------------------- template

def test_template_language():
    t = Template("{% set n = 2 %}{% for x in items -%}\n {{ loop.index }}.{{ x.name | upper }}{% if not loop.first and x.v > n %}!{% elif x.v == 1 %}?{% else %}-{% endif %}"
                 "{% endfor %}{# gone #}{{ 'a' ~ 1 + 2 }}{{ missing | default('z') }}{{ items[0]['v'] * 3 % 2 if true else 'no' }}")
    assert t.render({"items": [{"name": "p", "v": 1}, {"name": "q", "v": 3}]}) == ("1.P?2.Q!a3z1", [])


def test_template_constants_are_folded():
    t = Template("a{{ 'b' | upper }}{% if 1 > 2 %}no{% elif 'x' in 'xyz' %}c{% else %}no{% endif %}{{ 2 * 3 }}d{{ v }}")
    assert t.tree == [("text", "aBc6d"), ("out", ("var", "v"))]


def test_template_marks_generation():
    text, spans = Template("{% for m in ms %}[{% generation %}{{ m }}!{% endgeneration %}]{% endfor %}").render({"ms": ["ab", ""]})
    assert text == "[ab!][!]" and [text[a:b] for a, b in spans] == ["ab!", "!"]


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x | open }}", "{{ x() }}", "{% for x in y %}", "{% if x %}a", "{{ 1 + }}",
                                    "{% import os %}", "{{ a b }}", "{% endfor %}"])
def test_template_sandbox_and_errors(source):
    try:
        assert Template(source).render({"x": "s"})[0] == ""      # a dunder is no mapping key
    except TemplateError:
        pass


@settings(max_examples=150, deadline=None)
@given(CONTROL, CONTROL)
def test_turns_round_trip(role, text):
    formatted, spans = chat.chat_template().render({"messages": [{"role": role, "text": text}]})
    assert chat.parse_turn(formatted) == (role, text)
    assert "".join(chat.unescape(formatted[a:b]) for a, b in spans) == (text if role == "assistant" else "")


def test_conversations_read_back(spark):
    rng = random.Random(1)
    bits = ["\\", "### ", "</turn>", "word ", "é", "\n", "### Assistant: </turn> ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a:b### "]), None if rng.random() < .1 else "".join(
        rng.choice(bits) for _ in range(rng.randint(0, 9))), "x") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "assistant", "n", "x"), (3, 0, "user", "tie", "x"), (3, 0, "user", "tie", "x"), (4, None, "user", "first", "x")]
    rows += [(99, t, "assistant", "y" * 5, "x") for t in range(3000)] + [(98, 0, "assistant", "z" * 300_000, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, offset string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        want = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    offsets = [r for r in formatted.collect() if r.conv_id == 99]
    assert [r.offset for r in offsets] == np.cumsum([0] + [len(r.formatted) for r in offsets[:-1]]).tolist()
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


# -------------------------------------------------------------------------------- packing

def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abTHE'sré ÉİŒßǅ×ſ09.,!_-<|\n\t\x0b\x85  é日☃")), max_size=30), min_size=1, max_size=4))
def test_word_tokens_equal_the_tokenizer(texts):
    import pyarrow as pa
    tokens = test_word_tokens_equal_the_tokenizer.__dict__.setdefault("t", packing.WordTokens(public_tokenizers.path(packing.TOKENIZER)))
    data, offsets = textops.utf8(pa.array(texts, pa.string()))
    assert [x.tolist() for x in tokens(data, offsets)] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_cache_starts_anew(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    tokens, rng = packing.WordTokens(public_tokenizers.path(packing.TOKENIZER)), random.Random(0)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(20)) for _ in range(2)]
        data, offsets = textops.utf8(pa.array(texts, pa.string()))
        assert [x.tolist() for x in tokens(data, offsets)] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 25))
def test_best_fill_is_the_best_subset_sum(counts, room):
    sums = {0}
    for x, c in counts.items():
        sums = {s + k * x for s in sums for k in range(c + 1)}
    got = packing.best_fill(counts, room)
    assert all(0 < n <= counts[x] for x, n in got.items())
    assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def check_pieces(rows, texts, capacity):
    tokenizer = word_tokenizer()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        ids, at = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and 0 < r.length <= capacity
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["red", "blue", "wind", "sea", "1", "zebra!"]) for _ in range(rng.randint(0, 150))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "one " * 40_000, 1003: "☃ Ünïcode <|endoftext|>"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, offset int")
    rows = packing.pack_documents(df, public_tokenizers.path(packing.TOKENIZER), capacity=256, with_ids=True).collect()
    seqs = check_pieces(rows, texts, 256)
    used = sum(r.length for r in rows)
    assert len(seqs) <= -(-used // 256) + 2
    assert all(len(r.ids) == r.length for r in rows)


def test_packing_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, "a b")], "doc_id long, text string")
    path = public_tokenizers.path(packing.TOKENIZER)
    rows = packing.pack_documents(df, path, capacity=4).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack_documents(df.limit(0), path).collect() == []


def test_hot_length_is_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    pieces = spark.createDataFrame([(i, 0, 3 if i % 3 else 5, i, 5) for i in range(200)],
                                   "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    rows = packing.place_pieces(pieces, 16).collect()
    spots = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for a, b in zip(spots, spots[1:]):
        assert a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0
    assert len(rows) == 200 and spots[-1][0] <= -(-(67 * 5 + 133 * 3) // 16) + 1


# --------------------------------------------------------------------------- token counts

def unigram(vocab):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


SMALL = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0), ("bb", -1.5), ("▁abb", -4.0), ("é", -3.0)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aabb  é☃▁\n<unk>")), max_size=25))
def test_counts_follow_the_tokenizer_and_its_ties(text):
    reference = test_counts_follow_the_tokenizer_and_its_ties.__dict__.setdefault("r", unigram(SMALL))
    counter = token_counts.UnigramCounter(SMALL)
    plain = text.replace("▁", " ")
    words = plain.split(" ")
    got = sum(counter("▁" + w) for w in (words[1:] if words[0] == "" else words))
    assert got == len(reference.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_documents(spark):
    vocab = token_counts.vocabulary(public_tokenizers.path(token_counts.MODEL))
    reference = unigram(vocab)
    texts = [None, "", " ", "  a  b ", "Hello world.\nÉté ☃☃ 日本語", "▁x ▁▁y", "word " * 30_000, "n" * 20_000, "Hello world.\nÉté ☃☃ 日本語"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "a", "c")], "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(df, vocab).collect()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id is not None} == {
        i: len(reference.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert len(got) == 10 and token_counts.count_tokens(df.limit(0), vocab).collect() == []


# ------------------------------------------------------------------- pipeline and queries

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    kept, frames = docs, []
    for (_, stage) in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF_SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        kept = spark.createDataFrame(rows, docs.schema)
        frames.append({r.doc_id for r in rows})
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert frames[0] == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    from tests.llm.test_llm_text import brute_classes
    texts = {r.doc_id: r.text for r in docs.collect()}
    classes = brute_classes([(i, texts[i]) for i in sorted(frames[0])])
    assert frames[1] == {c for _, c in classes.values()}
    assert frames[2] <= frames[1] and len(frames[2]) > .4 * len(frames[1])
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, kept, SF_SMALL).collect(), texts, packing.CAPACITY)


def test_pipeline_run_equals_its_stages(spark):
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), docs.schema)
    assert got == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_all_operators_are_registered():
    names = set(E.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("prefix,columns", [
    ("op1_", ["doc_id", "held_out", "score", "predicted"]), ("op9_", ["doc_id", "probability", "kept"]),
    ("op10_", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]), ("op7_", ["query_id", "rank", "vec_id", "score"]),
    ("op5_", ["page_id", "text"]), ("op8_", ["doc_id", "n_tokens"])])
def test_query_columns(spark, prefix, columns):
    name = next(n for n in E.queries() if n.startswith(prefix))
    df = E.queries()[name](spark, SF_SMALL)
    assert set(columns) <= set(df.columns) and df.count() > 0


def test_no_local_checkpoint_and_one_guard():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder in ("runledger/llm", "."):
        for f in os.listdir(os.path.join(here, folder)):
            if f.endswith(".py") and f != "__spark_entry__.py":
                source = open(os.path.join(here, folder, f)).read()
                assert "localCheckpoint" not in source and "except ImportError" not in source
    assert jaccard_join.NUM == 75 and mixing.TOPICS > 1
