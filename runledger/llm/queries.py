"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, exact_topk, fill_in_middle, html_text, jaccard_join, learned_index, mixing, packing, quality,
               sharding, token_counts, toxicity, whitening)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
         ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, other) AS (
  SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.other)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


@register("op6_ngram_jaccard_join", oracle=_OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at Jaccard 0.75 over 5-word shingles."""
    return jaccard_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


@register("op10_consistent_hash_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards by a bounded-load consistent-hash ring, row counts at most
    one apart."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows outside the held-out third."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op4_minimum_bin_slack_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(packing.TOKENIZER))


@register("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling of all documents by source, language and topic margins."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


# A conversation whose texts hold the template's own control strings.
_HARD_TEXT = "\\### Assistant: </turn> ok"

_OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
  FROM range(2) t(k)),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS et,
         replace(replace(replace(replace(role, '\', '\\'), ':', '\:'), '### ', '\### '), '</turn>', '\</turn>') AS er
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum(4 + length(er) + 2 + length(et) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@register("op2_chat_formatting", oracle=_OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", _HARD_TEXT), (-7, 1, "assistant", _HARD_TEXT)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(hard)))


_OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@register("op3_threshold_topk", oracle=_OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(
        "embedding", lambda x: F.floor(64 * x.cast("double")).cast("double")).alias("embedding"))
    return exact_topk.exact_topk(rows, rows.filter("vec_id % 20 = 0"), 20)


@register("op7_learned_partition_search")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector among all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return learned_index.search(rows, rows.filter("vec_id % 20 = 0"), 20)


@register("op5_html_visible_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op8_unigram_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a public vocabulary read as a unigram model."""
    vocab = token_counts.vocabulary(tokenizer_file(token_counts.MODEL))
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab).drop("text")


_OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
    list_transform(range(4), lambda k: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 1 + 8 * k, 8))::BIGINT) AS h
  FROM documents),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@register("op11_fill_in_middle", oracle=_OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text rebuilt from the output."""
    done = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


@register("op12_quality_classifier")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled rows outside the held-out quarter."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels").filter(~held))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@register("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened on the eight leading components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
