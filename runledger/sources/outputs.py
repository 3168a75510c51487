"""Published pipeline outputs: paths, fetch, and file parsers.

Layout: ``<base>/<workflow>/<version>/<sample>/[<branch>/]<subpath>``. Paths are built from
keys, never listed. Files are fetched on the executors (``mapInPandas``), so one file is
one row and parallelism is the number of files; a missing or empty file yields NULL text
(a skipped branch), not a failed job. gzip is detected by its magic bytes, not by name.

Every parser is ``DataFrame -> DataFrame``: input rows are files (key columns + ``text``),
output rows are table rows with the key columns carried through. Parsing is built from
Spark expressions (split, element_at, try_cast, from_json); headers are read per file
from the file's own text before the lines are exploded, so no shuffle is needed.
"""
from __future__ import annotations

import dataclasses
import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import parse_float
from ..session import default_root

BRANCHES = ("full_data", "rarefied_data")
SENTINEL = "MARK_COMPLETE"
MANIFEST = "manifest.json"

# Single-letter rank prefixes of profile lineages and of bracken levels.
CLADE_RANKS = {"d": "domain", "k": "kingdom", "p": "phylum", "c": "class", "o": "order",
               "f": "family", "g": "genus", "s": "species", "t": "strain"}
BRACKEN_LEVELS = {"D": "domain", "K": "kingdom", "P": "phylum", "C": "class", "O": "order",
                  "F": "family", "G": "genus", "S": "species"}

# Python's str.splitlines() boundaries.
_LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
_OTHER_BREAK = "[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _text_lines() -> Column:
    """The lines of ``text``; a text with no break but "\\n" is split at that alone, which is much
    cheaper than the pattern of all breaks."""
    return F.when(F.col("text").rlike(_OTHER_BREAK), F.split("text", _LINE_BREAK)).otherwise(F.split("text", "\n"))


def _map(d: dict) -> Column:
    pairs = []
    for k, v in d.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


# ---------------------------------------------------------------------------- S7 / S8 / S16

def output_paths(keys: DataFrame, base: str, specs: list["OutputSpec"],
                 include_deferred: bool = False) -> DataFrame:
    """One row per (key, spec, branch) with the file's path.

    ``keys`` holds (sample_id, workflow_id, workflow_version). Specs are code constants, so
    they are attached as a literal array and exploded - no join, no listing."""
    items = []
    for s in specs:
        if s.defer and not include_deferred:
            continue
        for b in (BRANCHES if s.branched else (None,)):
            items.append(F.struct(F.lit(s.subpath).alias("subpath"), F.lit(s.table).alias("table"),
                                  F.lit(b).cast("string").alias("branch")))
    prefix = F.concat_ws("/", F.lit(base.rstrip("/")), "workflow_id", "workflow_version", "sample_id")
    return (keys.select("*", F.explode(F.array(*items)).alias("spec"))
            .select("*", "spec.*").drop("spec")
            .withColumn("path", F.when(F.col("branch").isNull(), F.concat_ws("/", prefix, "subpath"))
                        .otherwise(F.concat_ws("/", prefix, "branch", "subpath"))))


def sentinel_paths(keys: DataFrame, base: str) -> DataFrame:
    """Path of each sample's MARK_COMPLETE marker."""
    prefix = F.concat_ws("/", F.lit(base.rstrip("/")), "workflow_id", "workflow_version", "sample_id")
    return keys.withColumn("path", F.concat_ws("/", prefix, F.lit(SENTINEL)))


def _decode(raw: bytes) -> str:
    """Gunzip when the content starts with the gzip magic; UTF-8 with replacement."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    return raw.decode("utf-8", "replace")


def _open_bytes(uri: str, content: bool) -> tuple[bytes | None, str]:
    """(content, status): ``ok``, ``missing``, or ``error: ...`` for what may pass (permissions,
    timeouts, throttling)."""
    import pyarrow.fs as pafs
    try:
        fs, p = pafs.FileSystem.from_uri(uri)
        if fs.get_file_info(p).type == pafs.FileType.NotFound:
            return None, "missing"
        if not content:
            return None, "ok"
        # compression=None: never decompress by extension; the magic bytes decide
        with fs.open_input_stream(p, compression=None) as f:
            return f.read(), "ok"
    except FileNotFoundError:
        return None, "missing"
    except OSError as e:
        return None, f"error: {type(e).__name__}: {e}"[:200]


FETCH_BYTES = 32 << 20      # text that a fetch task hands over at a time


def fetch_outputs(paths: DataFrame, read_content: bool = True,
                  partitions: int | None = None) -> DataFrame:
    """S8 (+S16): add ``text`` (decoded content, NULL when missing or empty), ``exists`` and
    ``status`` (``ok``, ``missing`` or an error that a later fetch may not meet). Files are
    handed over one by one, at most about FETCH_BYTES of text at a time.

    Runs on the executors; each task opens only its own paths through pyarrow's filesystem
    layer (local, HDFS or object store URIs). Path rows are tiny, so they are first spread
    over an explicit number of partitions (by default 4 per core; an explicit count is
    not coalesced by AQE): a batch of thousands of files is fetched by thousands of tasks,
    not by the one or two partitions its keys happened to arrive in."""
    n = partitions or paths.sparkSession.sparkContext.defaultParallelism * 4
    root = default_root(paths.sparkSession)
    paths = paths.repartition(n, "path")
    out_schema = T.StructType(paths.schema.fields + [T.StructField("exists", T.BooleanType()),
                                                     T.StructField("text", T.StringType()),
                                                     T.StructField("status", T.StringType())])

    def fetch(batches):
        for pdf in batches:
            texts, status, held, first = [], [], 0, 0
            files = pdf["path"].tolist()
            for i, p in enumerate(files):
                raw, s = _open_bytes(p if "://" in p else root + p, read_content)
                texts.append(_decode(raw) if raw else None)
                status.append(s)
                held += len(texts[-1] or "")
                if held >= FETCH_BYTES or i + 1 == len(files):
                    yield pdf.iloc[first:i + 1].assign(exists=[x == "ok" for x in status], text=texts, status=status)
                    texts, status, held, first = [], [], 0, i + 1

    return paths.mapInPandas(fetch, out_schema)


def published(keys: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(keys whose MARK_COMPLETE and manifest both exist, keys skipped as unpublished)."""
    marks = fetch_outputs(sentinel_paths(keys, base), read_content=False)
    man = fetch_outputs(keys.withColumn("path", F.concat_ws(
        "/", F.lit(base.rstrip("/")), "workflow_id", "workflow_version", "sample_id", F.lit(MANIFEST))),
        read_content=False)
    k = ["sample_id", "workflow_id", "workflow_version"]
    ok = (marks.filter("exists").select(*k)
          .join(man.filter("exists").select(*k), k, "left_semi"))
    return keys.join(ok, k, "left_semi"), keys.join(ok, k, "left_anti")


# ---------------------------------------------------------------------------- lines / S17

def _lines(files: DataFrame) -> DataFrame:
    """Explode file text into (..., line_no, line, _f: its tab-separated fields); blank lines are
    dropped. A line is split before it is exploded, so that the filters and columns built on its
    fields read them and do not split it again."""
    split = F.transform(_text_lines(), lambda x: F.struct(x.alias("line"), F.split(x, "\t", -1).alias("_f")))
    return (files.filter(F.col("text").isNotNull())
            .select("*", F.posexplode(split).alias("line_no", "_l")).select("*", "_l.*").drop("text", "_l")
            .filter(~F.col("line").rlike(r"^\s*$")))


def skip_comment_lines(lines: DataFrame, comment: str | None = "#") -> DataFrame:
    """S17."""
    return lines if comment is None else lines.filter(~F.col("line").startswith(comment))


def _fi(i: int) -> Column:
    """0-based field i of the current row, NULL past the end."""
    return F.try_element_at(F.col("_f"), F.lit(i + 1))


def _header(files: DataFrame, strip_hash: bool = False) -> DataFrame:
    """Per file: the first non-blank line as an array of column names."""
    ls = F.filter(_text_lines(), lambda x: ~x.rlike(r"^\s*$"))
    h = F.split(ls[0], "\t", -1)
    if strip_hash:
        h = F.transform(h, lambda x: F.trim(F.ltrim(F.regexp_replace(x, "^#+", ""))))
    return files.withColumn("_header", h)


def _by_name(name: str) -> Column:
    """Field of the current row under header column ``name`` (NULL when absent)."""
    idx = F.array_position(F.col("_header"), F.lit(name))
    return F.when(idx > 0, F.try_element_at(F.col("_f"), idx.cast("int")))


def as_int(c: Column) -> Column:
    """Integer text; '-1' and non-integers -> NULL."""
    t = F.trim(c)
    return F.when(t.rlike(r"^-?\d+$") & (t != "-1"), t.try_cast("int"))


def as_bigint(c: Column) -> Column:
    """float text truncated to bigint; '-' or junk -> NULL."""
    return parse_float(c).try_cast("bigint")


# ---------------------------------------------------------------------------- parsers

def _last_element(lineage: Column) -> Column:
    return F.substring_index(lineage, "|", -1)


def clade_rank(clade: Column) -> Column:
    """rank from the last lineage element's one-letter prefix when it is 'x__...'."""
    last = _last_element(clade)
    return F.when((F.length(last) > 2) & (F.substring(last, 2, 1) == "_"),
                  F.try_element_at(_map(CLADE_RANKS), F.substring(last, 1, 1)))


def terminal_taxid(lineage: Column) -> Column:
    """F18."""
    return as_int(_last_element(lineage))


def sgb_id(clade: Column) -> Column:
    """F19."""
    last = _last_element(clade)
    return F.when(last.startswith("t__SGB"), last)


def parse_metaphlan(files: DataFrame) -> DataFrame:
    """Profile rows; comments/blanks skipped, rows with < 3 fields or an unparsable
    abundance dropped; abundance kept in native percent."""
    keys = [c for c in files.columns if c != "text"]
    rows = skip_comment_lines(_lines(files))
    rows = rows.filter(F.size("_f") >= 3).withColumn("_rel", parse_float(_fi(2)))
    rows = rows.filter(F.col("_rel").isNotNull())
    clade = _fi(0)
    n = F.size("_f")
    return rows.select(
        *keys, "line_no", clade.alias("clade_name"), clade_rank(clade).alias("rank"),
        terminal_taxid(_fi(1)).alias("ncbi_taxid"), sgb_id(clade).alias("sgb_id"),
        F.col("_rel").alias("relative_abundance"),
        F.when(n > 3, parse_float(_fi(3))).alias("coverage"),
        F.when(n > 4, as_bigint(_fi(4))).alias("estimated_reads"))


def parse_bracken(files: DataFrame) -> DataFrame:
    """Header TSV read by column name; short rows dropped; the fraction must parse."""
    keys = [c for c in files.columns if c != "text"]
    first = F.filter(_text_lines(), lambda x: ~x.rlike(r"^\s*$"))[0]
    rows = _lines(_header(files).withColumn("_first", first))
    # the header is the first non-blank line; rows shorter than it are dropped
    rows = rows.filter((F.col("line") != F.col("_first")) & (F.size("_f") >= F.size("_header")))
    return rows.select(
        *keys, "line_no",
        _by_name("name").alias("clade_name"),
        F.try_element_at(_map(BRACKEN_LEVELS), F.trim(_by_name("taxonomy_lvl"))).alias("rank"),
        as_int(_by_name("taxonomy_id")).alias("ncbi_taxid"),
        F.trim(_by_name("fraction_total_reads")).cast("double").alias("fraction_total_reads"),
        as_int(_by_name("new_est_reads")).cast("bigint").alias("estimated_reads"))


def parse_resistome(files: DataFrame) -> DataFrame:
    """S12: '#'-prefixed header; whitespace-padded numerics parsed strictly."""
    keys = [c for c in files.columns if c != "text"]
    hf = _header(files, strip_hash=True)
    first = F.filter(_text_lines(), lambda x: ~x.rlike(r"^\s*$"))[0]
    rows = _lines(hf.withColumn("_first", first))
    rows = rows.filter((F.col("line") != F.col("_first")) & (F.size("_f") >= F.size("_header")))
    num = {"template_coverage": "Template_Coverage", "template_identity": "Template_Identity",
           "depth": "Depth", "score": "Score"}
    return rows.select(*keys, "line_no", F.trim(_by_name("Template")).alias("gene"),
                       *[F.trim(_by_name(src)).cast("double").alias(dst) for dst, src in num.items()])


def parse_marker_abundance(files: DataFrame) -> DataFrame:
    """(marker_name, value); rows whose value does not parse are skipped."""
    keys = [c for c in files.columns if c != "text"]
    rows = skip_comment_lines(_lines(files))
    rows = rows.filter(F.size("_f") >= 2).withColumn("value", parse_float(_fi(1)))
    return rows.filter(F.col("value").isNotNull()).select(
        *keys, "line_no", _fi(0).alias("marker_name"), "value")


def parse_marker_presence(files: DataFrame) -> DataFrame:
    """A listed marker is present; the value column is dropped."""
    keys = [c for c in files.columns if c != "text"]
    rows = skip_comment_lines(_lines(files))
    return rows.filter(_fi(0) != "").select(*keys, "line_no", _fi(0).alias("marker_name"))


QC_SCHEMA = T.StructType([
    T.StructField("read_accounting", T.StructType([
        T.StructField("raw", T.StructType([T.StructField("number_reads", T.LongType()),
                                           T.StructField("number_bases", T.LongType())])),
        T.StructField("decontaminated", T.StructType([T.StructField("number_reads", T.LongType()),
                                                      T.StructField("number_bases", T.LongType())])),
        T.StructField("reads_surviving_fraction", T.DoubleType()),
        T.StructField("bases_surviving_fraction", T.DoubleType())])),
    T.StructField("parameters", T.StructType([T.StructField("metaphlan_index", T.StringType())])),
    T.StructField("provenance", T.StructType([
        T.StructField("pipeline_version", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.StringType()))])),
])


def parse_qc(files: DataFrame) -> DataFrame:
    """Manifest JSON -> one qc row; every level optional; run_ids joined by ';'."""
    keys = [c for c in files.columns if c != "text"]
    whole = F.get_json_object("text", "$").isNotNull()
    m = F.from_json(F.when(whole, F.col("text")).otherwise(F.raise_error(F.lit("malformed manifest"))), QC_SCHEMA)
    ra = m["read_accounting"]
    return files.filter(F.col("text").isNotNull()).select(
        *keys, F.lit(0).alias("line_no"),
        ra["raw"]["number_reads"].alias("reads_raw"),
        ra["decontaminated"]["number_reads"].alias("reads_decontaminated"),
        ra["raw"]["number_bases"].alias("bases_raw"),
        ra["decontaminated"]["number_bases"].alias("bases_decontaminated"),
        ra["reads_surviving_fraction"].alias("reads_surviving_fraction"),
        ra["bases_surviving_fraction"].alias("bases_surviving_fraction"),
        m["parameters"]["metaphlan_index"].alias("metaphlan_index"),
        m["provenance"]["pipeline_version"].alias("pipeline_version"),
        m["provenance"]["git_commit"].alias("git_commit"),
        F.coalesce(F.array_join(m["provenance"]["input_ids"], ";"), F.lit("")).alias("run_ids"))


# ---------------------------------------------------------------------------- S18 / G1-G2

@dataclasses.dataclass(frozen=True)
class OutputSpec:
    """One published file: where it is, which table it feeds and how it is parsed.
    ``parser`` is any ``DataFrame -> DataFrame`` over file rows (G1)."""
    subpath: str
    table: str
    parser: Callable[[DataFrame], DataFrame]
    tags: tuple = ()              # (column, value) pairs added to every row (G2)
    branched: bool = True
    defer: bool = False


# The output registry of the profiling workflow, version 2.2.1.
SPECS: dict[tuple[str, str], list[OutputSpec]] = {
    ("cmgd_nextflow", "2.2.1"): [
        OutputSpec("metaphlan_markers/marker_rel_ab_w_read_stats.tsv.gz",
                   "taxonomic_profile_metaphlan", parse_metaphlan),
        OutputSpec("kraken/bracken.species.txt.gz", "taxonomic_profile_bracken", parse_bracken),
        OutputSpec("kraken/bracken.genus.txt.gz", "taxonomic_profile_bracken", parse_bracken),
        OutputSpec("resistome/card_kma.res.gz", "resistome", parse_resistome),
        OutputSpec(MANIFEST, "qc_metrics", parse_qc, branched=False),
        OutputSpec("metaphlan_markers/marker_abundance.tsv.gz", "marker_abundance",
                   parse_marker_abundance, defer=True),
        OutputSpec("metaphlan_markers/marker_presence.tsv.gz", "marker_presence",
                   parse_marker_presence, defer=True),
    ],
}


def specs_for(workflow: str, version: str) -> list[OutputSpec]:
    """The registry entry; an unknown (workflow, version) is an error."""
    try:
        return SPECS[(workflow, version)]
    except KeyError:
        raise KeyError(f"no output specs for {workflow} {version}") from None


def parse_tables(files: DataFrame, specs: list[OutputSpec]) -> dict[str, DataFrame]:
    """Parse fetched files per spec and union the rows of each table.

    Key columns of ``files`` are carried; ``branch`` becomes the lake's ``data_type``."""
    out: dict[str, DataFrame] = {}
    for s in specs:
        f = files.filter((F.col("subpath") == s.subpath) & F.col("text").isNotNull())
        rows = s.parser(f.drop("subpath", "table", "path", "exists"))
        for col, val in s.tags:
            rows = rows.withColumn(col, F.lit(val))
        out[s.table] = out[s.table].unionByName(rows, allowMissingColumns=True) if s.table in out else rows
    return out
