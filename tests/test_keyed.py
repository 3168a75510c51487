"""Bucketed state tables and path resolution."""
import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from runledger.operators import registry as G
from runledger.operators.keyed import KeyedTable, first_per_key
from runledger.session import default_root, scratch_path


def files(path):
    return {f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.fixture
def folder(spark):
    return scratch_path(spark, f"keyed-{random.randrange(1 << 60)}").replace("file:", "")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_small_batches_rewrite_their_buckets_only(spark, folder):
    t = KeyedTable(f"{folder}/t", ("id",), 64)
    t.create(spark.range(5000).select("id", F.lit("old").alias("v"), (F.col("id") * 2).alias("w")))
    before = files(t.path)
    changes = spark.createDataFrame([(i * 37, "new") for i in range(9)] + [(9999, "new")], "id long, v string")
    touched = t.upsert(changes)
    after = files(t.path)
    assert 1 <= len(touched) <= 10
    assert {f.split("bucket=")[1].split("/")[0] for f in before ^ after} == {str(b) for b in touched}
    assert len(before & after) == len(before) - len(touched)
    got = {r.id: (r.v, r.w) for r in t.read(spark).collect()}
    assert len(got) == 5001 and got[37] == ("new", 74) and got[9999] == ("new", None) and got[1] == ("old", 2)
    found = t.lookup(spark.createDataFrame([(37,), (12345,)], "id long"))
    assert [r.id for r in found.collect()] == [37]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan


def test_upsert_rules(spark, folder):
    t = KeyedTable(f"{folder}/t", ("a", "b"), 8, by=("b",))
    t.create(spark.createDataFrame([("x", 1, "p", "q"), ("y", 1, "p", None)], "a string, b int, u string, k string"))
    changes = spark.createDataFrame([("x", 1, "n", None), ("x", 1, "m", None), ("z", 2, "n", "k"), ("z", 2, "n", "k")],
                                    "a string, b int, u string, k string")
    for _ in range(2):                      # the same batch again changes nothing
        t.upsert(changes, keep_if_null=("k",))
        assert rows(t.read(spark)) == [("x", 1, "m", "q"), ("y", 1, "p", None), ("z", 2, "n", "k")]
    t.upsert(changes, order=["u"], update_cols=["u"])
    assert t.insert_ignore(changes.limit(0)) == []
    t.insert_ignore(spark.createDataFrame([("y", 1, "no", "no"), ("w", 1, "yes", None)], "a string, b int, u string, k string"))
    assert rows(t.lookup(spark.createDataFrame([(1,)], "b int"))) == [("w", 1, "yes", None), ("x", 1, "m", "q"), ("y", 1, "p", None)]
    t.merge(spark.createDataFrame([("q", 5, "only updates")], "a string, b int, u string"),
            {"u": F.col("new.u")}, insert=False)
    assert t.read(spark).filter("a = 'q'").count() == 0


def test_a_crash_between_staging_and_moving_is_mended(spark, folder, monkeypatch):
    t = KeyedTable(f"{folder}/t", ("id",), 4)
    t.create(spark.range(100).select("id", F.lit(0).alias("v")))
    stop = lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_replace", stop)
        with pytest.raises(RuntimeError):
            t.upsert(spark.range(100).select("id", F.lit(1).alias("v")))
    assert t.read(spark).agg(F.sum("v")).first()[0] == 0
    os.makedirs(f"{t._staging}/torn")                        # a staged table that was never completed
    shutil.copy(sorted(files(t.path))[0], f"{t._staging}/torn/x.parquet")
    assert t.recover(spark) == 1 and t.recover(spark) == 0
    assert t.read(spark).agg(F.sum("v"), F.count("*")).first() == (100, 100)


def test_first_per_key_does_not_depend_on_order(spark):
    data = [("a", 2, None), ("a", 1, "x"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "n")]
    want = {"a": (1, "x"), None: (4, "n")}
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(data, len(data)), "k string, n int, t string").repartition(3)
        assert {r.k: (r.n, r.t) for r in first_per_key(df, ["k"], ["n"]).collect()} == want
    assert first_per_key(df.select("k"), ["k"]).count() == 2


def test_registration_returns_all_memberships(spark, folder):
    samples = KeyedTable(f"{folder}/s", ("sample_id",), 8)
    members = KeyedTable(f"{folder}/m", ("collection_id", "sample_id"), 8, by=("sample_id",))
    samples.create(spark.createDataFrame([("s1", "SRR1", "B1", "{}"), ("s2", None, None, "{}")],
                                         "sample_id string, ncbi_accession string, biosample_id string, metadata string"))
    members.create(spark.createDataFrame([("old", "s1")], "collection_id string, sample_id string"))
    incoming = spark.createDataFrame([("s1", " ", "", '{"a":1}', "new"), ("s1", " ", "", '{"a":1}', "also"), ("s3", "SRR9; SRR2;SRR9", "B3", None, None)],
                                     "sample_id string, ncbi_accession string, biosample_id string, metadata string, collection_id string")
    got = {r.sample_id: r for r in G.register_into(samples, members, incoming).collect()}
    assert got["s1"].collections == ["also", "new", "old"] and (got["s1"].ncbi_accession, got["s1"].biosample_id) == ("SRR1", "B1")
    assert got["s1"].metadata == '{"a":1}' and got["s3"].collections == [] and got["s3"].ncbi_accession == "SRR2;SRR9"
    assert len(got) == 2 and samples.read(spark).count() == 3 and members.read(spark).count() == 3


def test_paths_without_a_scheme_lie_on_the_default_filesystem(spark):
    assert default_root(spark) == "file://"
    spark.conf.set("fs.defaultFS", "viewfs://cluster/")
    try:
        assert default_root(spark) == "viewfs://cluster"
    finally:
        spark.conf.unset("fs.defaultFS")
    assert default_root(spark) == "file://"
