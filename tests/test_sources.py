import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import types as T

from runledger.operators import etl as E
from runledger.operators import registry as G
from runledger.sources import events as EV
from runledger.sources import files as FS

T0 = dt.datetime(2026, 1, 1)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_sheet_import(spark):
    d = tempfile.mkdtemp(prefix="rl-sheet-")
    _write(f"{d}/a.tsv", "NCBI_Accession\tsubject_id\tdisease\nSRR1;SRR2\tA\tIBD\n\tD\thealthy\nSRR3\tC\tIBD\n")
    rows = FS.read_sheet(spark, f"{d}/a.tsv").withColumn("study_name", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("st"))
    empty = spark.createDataFrame([], "sample_id string, study_name string, ncbi_accession string, metadata string")
    res = G.import_curation(rows, empty)
    dropped = res["dropped"].collect()
    assert [(r["row_index"], r["subject_id"]) for r in dropped] == [(1, "D")]
    s = res["summary"].collect()[0]
    assert (s["rows_loaded"], s["rows_updated"], s["rows_dropped"]) == (2, 0, 1)
    ann = res["annotations"]
    again = G.import_curation(rows, ann)
    s2 = again["summary"].collect()[0]
    assert (s2["rows_loaded"], s2["rows_updated"]) == (2, 2)          # idempotent re-import
    assert again["annotations"].count() == 2
    meta = json.loads(ann.filter("ncbi_accession = 'SRR1;SRR2'").collect()[0]["metadata"])
    assert meta == {"subject_id": "A", "disease": "IBD"}
    _write(f"{d}/bad/b.tsv", "accession\tsubject_id\nSRR1\tA\n")
    with pytest.raises(ValueError, match="b.tsv"):
        FS.read_sheet(spark, f"{d}/bad/b.tsv")


def test_sheets_are_read_by_their_own_headers(spark):
    d = tempfile.mkdtemp(prefix="rl-sheets-")
    _write(f"{d}/a.tsv", "ncbi_accession\tdisease\nSRR1\tIBD\n")
    _write(f"{d}/b.tsv", "disease\tNCBI_Accession\thost\t_cohort\t\nhealthy\tSRR9\thuman\tpilot\tx\tbeyond\nshort\n")
    _write(f"{d}/c.tsv", "ncbi_accession\n")
    got = {(os.path.basename(r["source_file"]), r["row_index"]): (r["ncbi_accession"], r["disease"], r["host"], r["_cohort"])
           for r in FS.read_sheet(spark, d).collect()}
    assert got == {("a.tsv", 0): ("SRR1", "IBD", None, None), ("b.tsv", 0): ("SRR9", "healthy", "human", "pilot"),
                   ("b.tsv", 1): (None, "short", None, None)}


def test_later_sheet_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([(i, "SRR1", d, "st") for i, d in enumerate(["x", "z", "a"])],
                                 "row_index long, ncbi_accession string, disease string, study_name string")
    empty = spark.createDataFrame([], "sample_id string, study_name string, ncbi_accession string, metadata string")
    [r] = G.import_curation(rows, empty)["annotations"].collect()
    assert json.loads(r["metadata"])["disease"] == "a"


def test_task_logs_walk_and_upsert(spark):
    w = tempfile.mkdtemp(prefix="rl-work-")
    _write(f"{w}/ab/cdef1234567890/.command.out", "hello")
    _write(f"{w}/ab/cdef1234567890/.command.err", "x" * 50)
    _write(f"{w}/cd/0123456789/.command.sh", "echo")
    _write(f"{w}/cd/0123456789/other.txt", "ignored")
    logs, oversize = FS.read_task_logs(spark, w, max_bytes=10)
    got = {(r["task_hash"], r["log_type"]): r["content"] for r in logs.collect()}
    assert got == {("ab/cdef12", "out"): "hello", ("cd/012345", "sh"): "echo"}
    assert {(os.path.basename(r["path"]), r["reason"]) for r in oversize.collect()} == {(".command.err", "over size")}
    _write(f"{w}/ef/xyz/.command.sh", "outside")
    with open(f"{w}/cd/0123456789/.command.out", "wb") as f:
        f.write(b"a\xffb")
    logs, rejected = FS.read_task_logs(spark, w, max_bytes=None)
    got = {(r["task_hash"], r["log_type"]): r["content"] for r in logs.collect()}
    assert got["ab/cdef12", "err"] == "x" * 50 and got["cd/012345", "out"] == "a\ufffdb"
    assert [r["reason"] for r in rejected.collect()] == ["not a task folder"]
    stored = spark.createDataFrame([("r1", "ab/cdef12", "out", "old")],
                                   "run_name string, task_hash string, log_type string, content string")
    inc = spark.createDataFrame([("r1", "ab/cdef12", "out", "new"), ("r1", "ab/cdef12", "err", "e")],
                                "run_name string, task_hash string, log_type string, content string")
    out = {(r["log_type"]): r["content"] for r in FS.upsert_task_logs(stored, inc).collect()}
    assert out == {"out": "new", "err": "e"}
    assert {r["log_type"]: r["content"] for r in FS.upsert_task_logs(stored, inc, max_bytes=2).collect()} == {"out": "old", "err": "e"}
    assert [(r["log_type"], r["reason"]) for r in FS.rejected_logs(inc, 2).collect()] == [("out", "over size")]


def test_fetch_reports_what_it_could_not_read(spark, monkeypatch):
    from runledger.sources import outputs as O
    d = tempfile.mkdtemp(prefix="rl-fetch-")
    for i in range(5):
        _write(f"{d}/f{i}", "y" * 1000)
    monkeypatch.setattr(O, "FETCH_BYTES", 1500)
    paths = spark.createDataFrame([(f"{d}/f{i}",) for i in range(5)] + [(f"{d}/none",), (d,)], "path string")
    got = {os.path.basename(r["path"]): r for r in O.fetch_outputs(paths, partitions=1).collect()}
    assert all(got[f"f{i}"]["status"] == "ok" and len(got[f"f{i}"]["text"]) == 1000 for i in range(5))
    assert (got["none"]["status"], got["none"]["exists"]) == ("missing", False)
    assert got[os.path.basename(d)]["status"].startswith("error") and not got[os.path.basename(d)]["exists"]


def test_run_events_validation(spark):
    d = tempfile.mkdtemp(prefix="rl-ev-")
    lines = [{"run_name": "r1", "type": "wrapper_exited", "utc_time": "2026-01-01T00:00:00", "exit_code": 1},
             {"run_name": "r1", "type": "wrapper_exited", "utc_time": "2026-01-01T00:00:00"},
             {"run_name": "r1", "type": "bogus", "utc_time": "2026-01-01T00:00:00"},
             {"run_name": "r1", "type": "slurm_state", "utc_time": "2026-01-01T00:00:00", "state": "RUNNING"}]
    _write(f"{d}/e.json", "\n".join(json.dumps(x) for x in lines) + "\n{not json\n")
    ok, bad = EV.split_valid(EV.read_run_events(spark, d))
    assert ok.count() == 2
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["malformed", "missing exit_code", "unknown type"]


def test_weblog_reader_and_strip(spark):
    d = tempfile.mkdtemp(prefix="rl-wl-")
    ev = {"runId": "u1", "runName": "r1", "event": "process_completed", "utcTime": "2026-01-01T00:00:00",
          "metadata": {"workflow": {"start": {"offset": {"availableZoneIds": ["A", "B"], "id": "Z"}}}},
          "trace": {"tag": "S1:r1", "process": "P", "status": "COMPLETED", "task_id": "1"}}
    _write(f"{d}/w.json", json.dumps(ev) + "\n")
    df = EV.read_weblog(spark, d)
    r = df.collect()[0]
    assert r["valid"] and r["utc_time"] == T0
    assert json.loads(r["metadata"]) == {"workflow": {"start": {"offset": {"id": "Z"}}}}
    runs = spark.createDataFrame([("r1", "wf", "v1")], "run_name string, workflow_id string, workflow_version string")
    facts = EV.to_task_executions(EV.enrich_events(df.withColumn("id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)), runs)).collect()
    assert facts[0]["sample_id"] == "S1" and facts[0]["workflow_id"] == "wf" and facts[0]["attempt"] == 1


@pytest.mark.parametrize("offset", [{"availableZoneIds": ["A", 'x]"y'], "id": "Z"}, {"id": "Z", "availableZoneIds": []},
                                    {"a": 1, "availableZoneIds": ["q"], "id": "Z"}, {"availableZoneIds": ["only"]}])
def test_strip_keeps_the_rest_of_the_document(spark, offset):
    doc = {"k": "availableZoneIds", "workflow": {"complete": {"offset": offset}, "n": [1, 2]}}
    other = {"list": {"availableZoneIds": ["stays"]}}
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps(other),), (None,)], "m string")
    got = [r[0] for r in df.select(EV.strip_blobs(df.m)).collect()]
    doc["workflow"]["complete"]["offset"].pop("availableZoneIds")
    assert json.loads(got[0]) == doc and json.loads(got[1]) == other and got[2] is None


def test_junk_time_is_quarantined(spark):
    d = tempfile.mkdtemp(prefix="rl-junk-")
    rows = [{"runName": "r", "event": "started", "utcTime": t} for t in ("2026-01-01T00:00:00Z", "yesterday", "")]
    _write(f"{d}/w.json", "\n".join(map(json.dumps, rows)))
    assert sorted((r["valid"], r["utc_time"]) for r in EV.read_weblog(spark, d).collect() if r["valid"]) == [(True, T0)]
    _write(f"{d}/run/e.json", json.dumps({"run_name": "r", "type": "heartbeat", "utc_time": "soon"}))
    [r] = EV.read_run_events(spark, f"{d}/run").collect()
    assert (r["valid"], r["reject_reason"]) == (False, "bad utc_time")


def test_only_retired_versions_are_purged(spark):
    wf = spark.createDataFrame([("w", "1", "active", T0), ("w", "2", "paused", T0), ("w", "3", "retired", T0)],
                               "workflow_id string, version string, status string, created_at timestamp")
    jobs = spark.createDataFrame([(i, "w", str(i), "pending") for i in (1, 2, 3)] + [(4, "w", "3", "running")],
                                 "job_id long, workflow_id string, workflow_version string, status string")
    assert sorted(r["job_id"] for r in G.purge_pending(jobs, wf).collect()) == [1, 2, 4]
    assert G.purgeable_jobs(jobs, wf).count() == 1
    new = spark.createDataFrame([("w", "5", T0), ("w", "6", T0 + dt.timedelta(days=1))],
                                "workflow_id string, version string, created_at timestamp")
    out, _ = G.register_workflow(wf, jobs, new)
    rows = [(r["version"], r["status"]) for r in out.collect()]
    assert sorted(rows) == [("1", "retired"), ("2", "paused"), ("3", "retired"), ("5", "retired"), ("6", "active")]


def test_collections_and_workflow_register(spark):
    cols = spark.createDataFrame([("C1", "study", "study", "c1", T0)],
                                 "collection_id string, source string, type string, label string, created_at timestamp")
    mem = spark.createDataFrame([("C1", "s1")], "collection_id string, sample_id string")
    new = spark.createDataFrame([("C1", "study", "study", "", "s1"), ("C2", "segment", "group", None, "s2")],
                                "collection_id string, source string, type string, label string, sample_id string")
    c2, m2 = G.add_to_collection(cols, mem, new, T0 + dt.timedelta(days=1))
    by = {r["collection_id"]: r for r in c2.collect()}
    assert by["C1"]["created_at"] == T0 and by["C1"]["updated_at"] == T0 + dt.timedelta(days=1)
    assert by["C2"]["label"] == "C2"
    assert m2.count() == 2
    wf = spark.createDataFrame([("wf", "v1", "active", 2), ("wf", "v0", "retired", 2)],
                               "workflow_id string, version string, status string, max_retries int")
    jobs = spark.createDataFrame([(1, "s1", "wf", "v1", "pending"), (2, "s2", "wf", "v1", "running")],
                                 "job_id long, sample_id string, workflow_id string, workflow_version string, status string")
    new_wf = spark.createDataFrame([("wf", "v2", 3)], "workflow_id string, version string, max_retries int")
    w2, j2 = G.register_workflow(wf, jobs, new_wf)
    st = {r["version"]: r["status"] for r in w2.collect()}
    assert st == {"v0": "retired", "v1": "retired", "v2": "active"}
    assert [r["job_id"] for r in j2.collect()] == [2]                 # pending job of v1 purged


def test_artifact_state_out_of_order(spark):
    n = spark.createDataFrame(
        [("k1", "create", 10, "e1", T0, 1), ("k1", "delete", None, None, T0 + dt.timedelta(hours=1), 3),
         ("k2", "delete", None, None, T0, 2), ("k2", "create", 5, "e2", T0 + dt.timedelta(hours=2), 1)],
        "key string, event string, size long, etag string, event_time timestamp, seq long")
    got = {r["key"]: r for r in E.artifact_state(n).collect()}
    assert got["k1"]["archived_at"] == T0 + dt.timedelta(hours=1) and got["k1"]["size"] == 10
    assert got["k2"]["archived_at"] is None and got["k2"]["etag"] == "e2"


def test_register_accessions_and_bulk_rows(spark):
    rep = spark.createDataFrame(
        [("PRJNA1", "SRR2", "SRS1", "SAMN1", 1), ("PRJNA1", "SRR1", "SRS1", "SAMN1", 2),
         ("PRJNA1", "SRR3", "SRS2", "SAMN2", 3), ("SRR999", "SRR9", "SRS9", "SAMN9", 4)],
        "source_accession string, run_accession string, secondary_sample_accession string, "
        "sample_accession string, pos long")
    for c in ("study_accession", "secondary_study_accession"):
        rep = rep.withColumn(c, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("PRJNA1"))
    samples = spark.createDataFrame([], "sample_id string, ncbi_accession string, biosample_id string, metadata string")
    cols = spark.createDataFrame([], "collection_id string, source string, type string, label string, created_at timestamp")
    mem = spark.createDataFrame([], "collection_id string, sample_id string")
    dry = G.register_accessions(rep, samples, cols, mem, "me", T0, dry_run=True)
    r = {x["accession"]: x for x in dry["receipts"].collect()}
    assert (r["PRJNA1"]["samples_found"], r["PRJNA1"]["samples_added"], r["PRJNA1"]["status"]) == (2, 2, "dry_run")
    assert r["SRR999"]["status"] == "failed"
    assert dry["samples"].count() == 0                      # dry run writes nothing
    res = G.register_accessions(rep, samples, cols, mem, "me", T0)
    assert res["samples"].count() == 2 and res["members"].count() == 2
    assert {x["status"] for x in res["submissions"].collect()} == {"succeeded", "failed"}
    again = G.register_accessions(rep, res["samples"], res["collections"], res["members"], "me", T0)
    r2 = {x["accession"]: x for x in again["receipts"].collect()}
    assert (r2["PRJNA1"]["samples_added"], r2["PRJNA1"]["samples_existing"]) == (0, 2)
    assert again["samples"].count() == 2 and again["members"].count() == 2

    rows = spark.createDataFrame(
        [(0, "SRR1", "st"), (1, "Not applicable", "st"), (2, "SRR2", ""), (3, "NA", "st"), (4, "SRR3", "st")],
        "row_index long, ncbi_accession string, study_name string")
    c = G.ingest_sample_rows(rows)["counters"].collect()[0]
    assert (c["registered"], c["skipped"], c["unattached"]) == (3, 2, 1)
    c2 = G.ingest_sample_rows(rows, limit=2)["counters"].collect()[0]
    assert (c2["registered"], c2["skipped"], c2["unattached"]) == (2, 1, 1)


def test_strict_backfill_raises_on_junk(spark):
    df = spark.createDataFrame([(1, "r", "u", "process_completed", T0, '{"process": "P", "attempt": "x"}')],
                               "id long, run_name string, run_id string, event string, utc_time timestamp, trace string")
    runs = spark.createDataFrame([("r", "wf", "v")], "run_name string, workflow_id string, workflow_version string")
    tel = EV.enrich_events(df, runs)
    assert EV.to_task_executions(tel).collect()[0]["attempt"] == 1
    with pytest.raises(Exception):
        EV.to_task_executions(tel, strict=True).collect()


def test_versioned_state_survives_a_torn_write(spark):
    from runledger.operators import state as ST
    base = tempfile.mkdtemp(prefix="rl-state-")
    ST.write_versioned(spark.createDataFrame([(1, "a")], "k int, v string"), base)
    spark.createDataFrame([(2, "lost")], "k int, v string").write.parquet(f"{base}/v-torn")     # no pointer moved
    assert [tuple(r) for r in ST.read_current(spark, base).collect()] == [(1, "a")]
    ST.write_versioned(spark.createDataFrame([(1, "b")], "k int, v string"), base)
    assert [tuple(r) for r in ST.read_current(spark, base).collect()] == [(1, "b")]


def test_malformed_manifest_is_an_error(spark):
    from runledger.sources import outputs as O
    bad = spark.createDataFrame([("s1", '{"read_accounting": ')], "sample_id string, text string")
    with pytest.raises(Exception, match="malformed manifest"):
        O.parse_qc(bad).collect()


def test_task_log_source_equals_the_walk(spark, tmp_path):
    from runledger.sources.logsource import task_logs
    for place, name, text in (("ab/cdef1234567", ".command.out", b"out \xff"), ("ab/cdef1234567", ".command.sh", b""),
                              ("ab/cdef1234567/deep", ".command.err", b"deep"), ("00/0123456", ".command.err", b"x" * 50),
                              ("00/0123456", ".exitcode", b"0"), ("zz/0123456", ".command.out", b"not hex")):
        folder = tmp_path / "work" / place
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(text)
    root = str(tmp_path / "work")
    logs, rejected = FS.read_task_logs(spark, root, max_bytes=40)
    got = task_logs(spark, root, max_bytes=40)
    assert sorted((r.task_hash, r.log_type, r.content) for r in got.filter("reason is null").collect()) == \
        sorted((r.task_hash, r.log_type, r.content) for r in logs.collect())
    assert sorted((r.path, r.length, r.reason) for r in got.filter("reason is not null").collect()) == \
        sorted((r.path, r.length, r.reason) for r in rejected.collect())
    assert got.rdd.getNumPartitions() == 2
    assert task_logs(spark, f"{root}/none").collect() == []
