"""Published files that exist for some samples at a time."""
import contextlib
import glob

from pyspark.sql import functions as F

from runledger.operators import etl as E
from runledger.plans import q_state as Q
from runledger.plans.domain import Domain
from runledger.sources import lake
from runledger.sources import outputs as O

SF = "/root/testdata/sf0.001"


def test_waves_read_every_sample_and_withdraw_its_files(spark):
    d = Domain(spark, SF, materialize=True)
    spec = [s for s in O.specs_for("cmgd_nextflow", "2.2.1") if s.table == "taxonomic_profile_metaphlan"]
    most = []

    def read(keys, root):
        here = root.removesuffix(root.rpartition("/")[2])
        most.append(len(glob.glob(f"{here}published-*/**/manifest.json", recursive=True)))
        return O.fetch_outputs(O.output_paths(keys, root, spec)).select("sample_id", "branch", "status", F.md5("text").alias("m"))

    got = Q._by_waves(d, "test-waves", read, wave=40)
    n = d.qc_manifests.filter("workflow_version = '1-URGENT'").count()
    assert len(most) == -(-n // 40) and sum(most) == n and max(most) < n
    whole = Q._by_waves(d, "test-whole", read, wave=n)
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0 and got.count() == 2 * n
    assert {r.status for r in got.select("status").distinct().collect()} == {"ok", "missing"}


def test_lines_of_every_break(spark):
    rows = [("a", "x\t1\r\ny\t\t2\n\n \nz w\rv"), ("b", "p\t1\nq\t2\n"), ("c", "")]
    got = O._lines(spark.createDataFrame(rows, "k string, text string"))
    assert [(r.k, r.line_no, r.line, r._f) for r in got.orderBy("k", "line_no").collect()] == [
        ("a", 0, "x\t1", ["x", "1"]), ("a", 1, "y\t\t2", ["y", "", "2"]), ("a", 4, "z", ["z"]), ("a", 5, "w", ["w"]),
        ("a", 6, "v", ["v"]), ("b", 0, "p\t1", ["p", "1"]), ("b", 1, "q\t2", ["q", "2"])]


def test_backlog_is_ingested_by_waves_of_staged_files(spark, tmp_path):
    """the published files of one wave lie there at a time, and the result is that of the whole batch."""
    d = Domain(spark, SF, materialize=True)
    keys, files = Q._to_publish(d)
    n, most, whole = keys.count(), [], None
    for wave in (40, n):
        root = f"{tmp_path}/{wave}"
        stage = Q._staging(d, files, f"{root}/pub", zipped=True)

        @contextlib.contextmanager
        def watched(keys):
            with stage(keys):
                most.append(len(glob.glob(f"{root}/pub/**/manifest.json", recursive=True)))
                yield
        lake.ensure_schema(spark, f"{root}/lake")
        got = E.ingest_waves(spark, keys, f"{root}/pub", f"{root}/lake", "shotgun", "1-URGENT", specs=Q._TAGGED, wave=wave, stage=watched)
        assert glob.glob(f"{root}/pub/**/*.json", recursive=True) == []
        seen = (got["written"], sorted(r.sample_id for r in got["skipped_unpublished"].collect()),
                sorted(map(tuple, got["counts"].collect())), lake.read_watermark(spark, f"{root}/lake").count())
        whole = whole or seen
        assert seen == whole and seen[0]["qc_metrics"] == seen[3]
    assert len(most) == -(-n // 40) + 1 and sum(most) == 2 * n and max(most[:-1]) < n


def test_samples_are_withdrawn_by_many_tasks(spark, tmp_path):
    """The folders of a wave are not deleted by the one task into which AQE brings so few bytes."""
    ids = [f"S{i}" for i in range(200)]
    keys = spark.createDataFrame([(i, "shotgun", "1-URGENT") for i in [*ids, *ids[:20], None]],
                                 "sample_id string, workflow_id string, workflow_version string").checkpoint()
    files = [(f"shotgun/1-URGENT/{i}/{p}", "x") for i in [*ids, "other"] for p in ("manifest.json", "full_data/m/a.gz", "rarefied_data/m/a.gz")]
    Q._write_files(spark.createDataFrame(files, "path string, text string"), str(tmp_path))
    assert len(glob.glob(f"{tmp_path}/shotgun/1-URGENT/*/*/m/a.gz")) == 402
    sc = spark.sparkContext
    sc.setJobGroup("withdraw", "withdraw")
    try:
        Q._withdraw(keys, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert glob.glob(f"{tmp_path}/shotgun/1-URGENT/*") == [f"{tmp_path}/shotgun/1-URGENT/other"]
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("withdraw") for s in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) == sc.defaultParallelism * 4
