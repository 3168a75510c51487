"""Parsers on the file shapes of the published outputs, and the ingest round trip."""
import datetime as dt
import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from runledger.operators import etl as E
from runledger.sources import lake
from runledger.sources import outputs as O

# Own small files in the published formats; taxa, genes and numbers are made up here.
METAPHLAN = "\n".join([
    "#mpa_vJan25_CHOCOPhlAnSGB_202503", "#clade\ttaxid\tabundance\tcoverage\treads",
    "UNCLASSIFIED\t-1\t40.25\t-\t12",
    "k__Archaea\t2157\t59.75\t1.5\t90",
    "k__Archaea|p__Thermoplasmatota|g__Picro|s__Picro_novus\t2157|2283794|46630\t7.125\t0.75\t33",
    "k__Archaea|p__Thermoplasmatota|g__Picro|s__Picro_novus|t__SGB77\t2157|2283794|46630|-1\t7.125\t0.75\tmany",
    "", "k__Archaea|c__Lonely", "k__Fungi\t4751\tnone\t-\t-", ""])
BRACKEN = "\r\n".join([
    "name\ttaxonomy_id\ttaxonomy_lvl\tkraken_assigned_reads\tadded_reads\tnew_est_reads\tfraction_total_reads",
    "Picro novus\t46630\tS\t20\t5\t25\t0.0625", "Picro\t46629\tG\t21\t9\t30\t0.075", "cut\t1\tS"])
RESISTOME = "\n".join([
    "#Template\tScore\tExpected\tTemplate_length\tTemplate_Identity\tTemplate_Coverage\tQuery_Identity\tQuery_Coverage\tDepth\tq_value\tp_value",
    "gene:7|xyz-2\t  840\t  30\t  600\t  88.50\t  97.25\t  90.00\t  91.00\t  4.75\t700.00\t2.0e-09"])
PRESENCE = "#head\nmk_one\t1\n\nmk_two\t1\n"
ABUNDANCE = "mk_one\t2.25\nmk_two\t?\nmk_three\n"
MANIFEST = json.dumps({
    "provenance": {"input_ids": ["ERR7", "ERR8", "ERR9"], "git_commit": "c0ffee1", "pipeline_version": "9.0"},
    "read_accounting": {"decontaminated": {"number_bases": 4200, "number_reads": 42},
                        "bases_surviving_fraction": None, "raw": {"number_reads": 50, "number_bases": 5000},
                        "reads_surviving_fraction": 0.84},
    "parameters": {"metaphlan_index": "own_index"}})


def files(spark, text):
    return spark.createDataFrame([("s1", text)], "sample_id string, text string")


def test_metaphlan(spark):
    """Comments, blank, short and non-numeric rows go; the rank is that of the last level, the
    taxid the last of its lineage (none for -1 or a blank), the SGB the strain level."""
    got = [(r["rank"], r["ncbi_taxid"], r["sgb_id"], r["relative_abundance"], r["coverage"], r["estimated_reads"])
           for r in O.parse_metaphlan(files(spark, METAPHLAN)).orderBy("line_no").collect()]
    assert got[:3] == [(None, None, None, 40.25, None, 12), ("kingdom", 2157, None, 59.75, 1.5, 90),
                       ("species", 46630, None, 7.125, 0.75, 33)]
    assert got[3][:4] == ("strain", None, "t__SGB77", 7.125) and len(got) == 4


def test_other_parsers(spark):
    rows = O.parse_bracken(files(spark, BRACKEN)).orderBy("line_no").collect()
    assert [(r["clade_name"], r["rank"], r["ncbi_taxid"], r["estimated_reads"], r["fraction_total_reads"]) for r in rows] == [
        ("Picro novus", "species", 46630, 25, 0.0625), ("Picro", "genus", 46629, 30, 0.075)]
    [gene] = O.parse_resistome(files(spark, RESISTOME)).collect()
    assert (gene["gene"], gene["score"], gene["template_identity"], gene["template_coverage"], gene["depth"]) == (
        "gene:7|xyz-2", 840.0, 88.5, 97.25, 4.75)
    assert {r["marker_name"] for r in O.parse_marker_presence(files(spark, PRESENCE)).collect()} == {"mk_one", "mk_two"}
    assert [(r["marker_name"], r["value"]) for r in O.parse_marker_abundance(files(spark, ABUNDANCE)).collect()] == [("mk_one", 2.25)]


def test_manifest(spark):
    [q] = O.parse_qc(files(spark, MANIFEST)).collect()
    assert (q["reads_raw"], q["bases_raw"], q["reads_decontaminated"], q["bases_decontaminated"]) == (50, 5000, 42, 4200)
    assert (q["reads_surviving_fraction"], q["bases_surviving_fraction"]) == (0.84, None)
    assert (q["metaphlan_index"], q["pipeline_version"], q["git_commit"], q["run_ids"]) == ("own_index", "9.0", "c0ffee1", "ERR7;ERR8;ERR9")
    [none] = O.parse_qc(files(spark, "{}")).collect()
    assert none["bases_raw"] is None and none["run_ids"] == ""


def _publish(base, wf, ver, sample, gz=True, sentinel=True, manifest=True, branches=("full_data",)):
    root = os.path.join(base, wf, ver, sample)
    os.makedirs(root, exist_ok=True)
    if sentinel:
        open(os.path.join(root, "MARK_COMPLETE"), "w").close()
    if manifest:
        with open(os.path.join(root, "manifest.json"), "w") as f:
            f.write(MANIFEST)
    for b in branches:
        for sub, text in (("metaphlan_markers/marker_rel_ab_w_read_stats.tsv.gz", METAPHLAN),
                          ("kraken/bracken.species.txt.gz", BRACKEN),
                          ("resistome/card_kma.res.gz", RESISTOME)):
            p = os.path.join(root, b, sub)
            os.makedirs(os.path.dirname(p), exist_ok=True)
            data = text.encode()
            with open(p, "wb") as f:   # same name, plain or gzip content: detected by magic
                f.write(gzip.compress(data) if gz else data)


def test_ingest_round_trip(spark):
    base = tempfile.mkdtemp(prefix="rl-out-")
    lk = tempfile.mkdtemp(prefix="rl-lake-")
    wf, ver = "cmgd_nextflow", "2.2.1"
    _publish(base, wf, ver, "sA", gz=True)
    _publish(base, wf, ver, "sB", gz=False, branches=("full_data", "rarefied_data"))
    _publish(base, wf, ver, "sC", sentinel=False)          # not published yet
    keys = spark.createDataFrame([("sA", wf, ver), ("sB", wf, ver), ("sC", wf, ver)],
                                 "sample_id string, workflow_id string, workflow_version string")
    labels = spark.createDataFrame([("sA", "study1"), ("sB", "study1")], "sample_id string, study_name string")
    lake.ensure_schema(spark, lk)
    res = E.ingest(spark, keys, base, lk, wf, ver, labels, as_of=dt.datetime(2026, 1, 1))
    assert [r["sample_id"] for r in res["skipped_unpublished"].collect()] == ["sC"]
    counts = {(r["table"], r["sample_id"]): r["n"] for r in res["counts"].collect()}
    assert counts[("taxonomic_profile_metaphlan", "sA")] == 4       # one branch
    assert counts[("taxonomic_profile_metaphlan", "sB")] == 8       # two branches
    assert counts[("qc_metrics", "sA")] == 1
    prof = lake.scan_lake(spark, lk, "taxonomic_profile_metaphlan")
    assert prof.count() == 12
    row = prof.filter("sample_id = 'sA' AND rank = 'kingdom'").collect()[0]
    assert row["study_name"] == "study1" and row["run_ids"] == "ERR7;ERR8;ERR9" and row["data_type"] == "full_data"
    # re-ingest of sA replaces its rows (latest wins), other samples untouched
    E.ingest(spark, keys.filter("sample_id = 'sA'"), base, lk, wf, ver, labels,
             as_of=dt.datetime(2026, 1, 2))
    prof = lake.scan_lake(spark, lk, "taxonomic_profile_metaphlan")
    assert prof.count() == 12
    assert prof.filter("sample_id = 'sA'").select("ingest_id").distinct().count() == 1
    # a pruned read of one partition
    assert lake.scan_lake(spark, lk, "resistome", data_type="rarefied_data").count() == 1
    # the frozen manifest lists files with live rows, and says which also hold superseded ones
    m = lake.freeze_snapshot(spark, lk, "https://example.org/frozen").collect()
    prof = [r for r in m if r["table"] == "taxonomic_profile_metaphlan"]
    assert sum(r["live_rows"] for r in prof) == 12 and all(r["url"].startswith("https://example.org/frozen/") for r in m)
    assert "etl_ingested" in {r["table"] for r in m}


def test_empty_lake_and_version_strings(spark):
    lk = tempfile.mkdtemp(prefix="rl-lake-")
    lake.ensure_schema(spark, lk)
    assert all(lake.scan_lake(spark, lk, t).count() == 0 for t in lake.SCHEMAS)
    rows = spark.createDataFrame([("a", "w", "2.1"), ("a", "w", "2.10")], "sample_id string, workflow string, version string")
    lake.write_tables({"marker_presence": rows.selectExpr("*", "'full_data' AS data_type", "'m' AS marker_name")}, lk, "i1")
    assert lake.scan_lake(spark, lk, "marker_presence").count() == 0           # not in the watermark yet
    counts = rows.selectExpr("*", "'marker_presence' AS table", "1L AS n")
    lake.mark_ingested(counts, lk, "i1", dt.datetime(2026, 1, 1))
    assert {r["version"] for r in lake.scan_lake(spark, lk, "marker_presence").collect()} == {"2.1", "2.10"}


def test_files_are_clustered_before_they_are_parsed(spark):
    """A table given by its files holds the parser's rows; each file is parsed once, by the write."""
    cols = "sample_id string, workflow string, version string, data_type string, text string"
    texts = [(f"s{i:02d}", "w", v, b, f"#c\nk__A|s__{i}\t2|{i}\t{i}.5\t-\t{i}.0\njunk\nk__B\t2\t1.25")
             for i in range(40) for v in ("1", "2") for b in ("full_data", "rarefied_data")]
    files = spark.createDataFrame(texts + [("empty", "w", "1", "full_data", None), (None, "w", "1", "full_data", "k__C\t3\t1")], cols).repartition(6)
    table, calls = "taxonomic_profile_metaphlan", spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    plain, filed = tempfile.mkdtemp(prefix="rl-lake-"), tempfile.mkdtemp(prefix="rl-lake-")
    assert lake.write_tables({table: O.parse_metaphlan(files)}, plain, "i1") == {table: 321}
    n = lake.write_tables({table: files}, filed, "i1",
                          parsers={table: lambda f: O.parse_metaphlan(f.mapInArrow(seen, f.schema))})
    assert n == {table: 321} and calls.value == 162
    a, b = (lake._stored(spark, at, table) for at in (plain, filed))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and b.count() == 321
    per_file = b.groupBy(F.input_file_name().alias("f")).agg(F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"),
                                                             F.first("version").alias("v"), F.first("data_type").alias("t")).collect()
    for x in per_file:                                   # the files of a directory hold ranges of samples
        assert not any(y["lo"] < x["lo"] < y["hi"] for y in per_file if (x["v"], x["t"]) == (y["v"], y["t"]) and x["lo"] and y["lo"])


def test_ingest_ids_do_not_shuffle_the_rows(spark):
    rows = spark.createDataFrame([("a", "w", "1", "i1"), ("a", "w", "1", "i2"), ("b", "w", "1", "i1"), ("c", "w", "1", "i3")],
                                 "sample_id string, workflow string, version string, ingest_id string")
    history = (rows.filter("ingest_id <> 'i3'").withColumn("ingested_at", F.expr("if(ingest_id = 'i1', TIMESTAMP_NTZ '2026-01-01', TIMESTAMP_NTZ '2026-01-02')")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live = lake.live(rows, history)
        plan = live._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [ingest_id" in plan
        assert sorted((r["sample_id"], r["ingest_id"]) for r in live.collect()) == [("a", "i2"), ("b", "i1")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_paths_never_list(spark):
    keys = spark.createDataFrame([("s1", "wf", "v")], "sample_id string, workflow_id string, workflow_version string")
    paths = {r["path"] for r in O.output_paths(keys, "/base", O.specs_for("cmgd_nextflow", "2.2.1")).collect()}
    assert "/base/wf/v/s1/manifest.json" in paths
    assert "/base/wf/v/s1/full_data/kraken/bracken.species.txt.gz" in paths
    assert len(paths) == 9            # 4 branched specs x 2 branches + manifest
    with pytest.raises(KeyError):
        O.specs_for("cmgd_nextflow", "9.9")


def test_match_profilers_fallback(spark):
    from runledger.operators.taxa import match_profilers
    mp = spark.createDataFrame([("s1", "species", 10), ("s1", "species", 11), ("s1", "species", 12)],
                               "sample_id string, rank string, ncbi_taxid int")
    br = spark.createDataFrame([("s1", "species", 10, 0.5), ("s1", "genus", 100, 0.2)],
                               "sample_id string, rank string, ncbi_taxid int, fraction_total_reads double")
    genus = spark.createDataFrame([(10, 100), (11, 100), (12, 200)], "ncbi_taxid int, genus_taxid int")
    got = {r["ncbi_taxid"]: r["match_level"] for r in match_profilers(mp, br, genus).collect()}
    assert got == {10: "species", 11: "genus", 12: "unmatched"}


def test_backlog_ticks_take_each_completion_once(spark, monkeypatch):
    """Waiting, age, threshold; a replayed batch and a crash before the watermark add nothing."""
    import uuid

    from runledger.session import scratch_path
    from runledger.streaming import backlog as B
    root = scratch_path(spark, "backlog-" + uuid.uuid4().hex).replace("file:", "")
    now = dt.datetime(2026, 1, 1)
    specs = [O.OutputSpec(O.MANIFEST, "qc_metrics", O.parse_qc, branched=False)]

    def complete(*names):
        for s in names:
            folder = f"{root}/pub/w/1/{s}"
            os.makedirs(folder, exist_ok=True)
            for name, text in ((O.MANIFEST, "{}"), (O.SENTINEL, "")):
                with open(f"{folder}/{name}", "w") as f:
                    f.write(text)
        spark.createDataFrame([(s, "w", "1", now) for s in names], B.COMPLETIONS).write.mode("append").parquet(f"{root}/in")

    def tick(hours, **rule):
        return B.tick(spark, f"{root}/in", f"{root}/state", f"{root}/pub", f"{root}/lake", "w", "1",
                      now + dt.timedelta(hours=hours), specs=specs, **{"threshold": 3, **rule})

    complete("a", "b")
    assert tick(1)["decision"]["reason"] == "wait"
    complete("c", "a")                                        # a again: the same job
    with monkeypatch.context() as m:
        m.setattr(lake, "mark_ingested", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            tick(2)
    assert lake.scan_lake(spark, f"{root}/lake", "qc_metrics").count() == 0
    done = tick(3)
    assert done["decision"]["reason"] == "threshold" and done["written"] == {"qc_metrics": 3}
    assert tick(4)["decision"]["backlog"] == 0
    complete("d")
    assert tick(30, max_age_hours=48)["decision"]["reason"] == "wait"
    assert tick(50)["written"] == {"qc_metrics": 1}           # no new record: the age alone
    rows = lake.scan_lake(spark, f"{root}/lake", "qc_metrics").select("sample_id").collect()
    assert sorted(r.sample_id for r in rows) == ["a", "b", "c", "d"]
    with monkeypatch.context() as m:                          # counts that disagree leave no watermark
        m.setattr(lake, "write_tables", lambda *a: {"qc_metrics": 7})
        complete("e")
        with pytest.raises(RuntimeError, match="differ"):
            tick(90)
    assert lake.read_watermark(spark, f"{root}/lake").count() == 4
