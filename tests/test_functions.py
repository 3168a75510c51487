import pytest
from pyspark.sql import functions as F

from runledger.functions import display as D
from runledger.functions import identity as I
from runledger.functions import parse as P


def one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_golden_sample_ids(spark):
    # golden values of the content id rule
    got = one(spark, I.sample_id("x"), [("SRR002;SRR001;SRR001",), ("ERR12",), (" SRR001 ; SRR002 ;",)])
    assert got == ["ec101225381fb2f2671abe5d836abc00", "11d7b629eda5d48ec9f9bc61a92faa64",
                   "ec101225381fb2f2671abe5d836abc00"]


def test_derive_sample_id_placeholders(spark):
    got = one(spark, I.derive_sample_id("x"), [("NA",), ("",), (None,), ("SRR001;weird",)])
    assert got[:3] == [None, None, None]
    # a real accession keeps *all* tokens of the row
    assert got[3] == one(spark, I.sample_id("x"), [("SRR001;weird",)])[0]


def test_has_accession_and_orphan(spark):
    rows = [(" ; ",), (None,), ("SRR1",)]
    assert one(spark, I.has_accession("x"), rows) == [False, False, True]
    assert one(spark, I.is_orphan("x"), rows) == [True, True, False]


def test_classify_source(spark):
    got = one(spark, I.classify_source("x"), [("PRJNA1",), (" srp9 ",), ("ERP1",), ("SRR1",)])
    assert got == ["bioproject", "sra_study", "sra_study", None]


def test_parse_tag(spark):
    got = one(spark, P.parse_tag("x"), [("S1:r1",), ("S1",), ("",), (None,)])
    assert got == ["S1", "S1", None, None]


def test_parse_int_and_float(spark):
    assert one(spark, P.parse_int("x"), [("3",), ("x",), ("",), (None,), ("3.7",), (" 4 ",)]) == [3, 1, 1, 1, 1, 4]
    assert one(spark, P.parse_float("x"), [("98.5",), ("5d",), ("1_000",), ("",), ("junk",), ("1e3",)]) == \
        [98.5, None, 1000.0, None, None, 1000.0]


def test_trace_flatten_mixed_types(spark):
    df = spark.createDataFrame([('{"%cpu": "98.5", "exit": 137, "attempt": "x", "process": "A"}',),
                                ('{"%cpu": 98.5, "exit": "2147483647", "process": ""}',)], "trace string")
    rows = df.select(*P.task_fact_columns("trace")).collect()
    assert rows[0]["pct_cpu"] == 98.5 and rows[1]["pct_cpu"] == 98.5
    assert rows[0]["exit_code"] == "137" and rows[1]["exit_code"] == "2147483647"
    assert rows[0]["attempt"] == 1
    assert rows[1]["process"] is None


def test_short_hash_and_labels(spark):
    assert one(spark, D.short_task_hash("x"), [("ab/cdef123456",), ("ab/cd",)]) == ["ab/cdef12", "ab/cd"]
    assert one(spark, D.exit_label("x"), [("137",), (None,), ("9",)])[1:3] == ["Signal / unknown", ""]
    assert one(spark, D.fmt_duration("x"), [(123.0,), (4500.0,), (184000.0,), (7500000.0,)], "x double") == \
        ["123ms", "4.5s", "3m 4s", "2h 5m"]


def test_ratio_pct_half_up(spark):
    got = one(spark, D.ratio_pct("a", "b"), [(29, 20000), (1, 0), (1, 3)], "a long, b long")
    assert got == [0.15, None, 33.33]


def test_tail_text(spark):
    assert one(spark, D.tail_text("x", 3), [("abcdef",), ("ab",)]) == ["def", "ab"]


def test_misc_derived_columns(spark):
    import datetime as dt
    assert one(spark, D.run_id_or_sentinel("a", "b"), [(None, "r1"), ("u1", "r1")], "a string, b string") == \
        ["pre-weblog:r1", "u1"]
    assert one(spark, I.is_run_name("x"), [("r0a1b2c3d-0000-1111-2222-333344445555",), ("R0A1B2C3D00001111222233334444555" + "5",),
                                           ("run1",), (None,)]) == [True, True, False, False]
    assert one(spark, D.queue_wait("a", "b"), [("2026-01-01 00:00:00", "2026-01-01 00:01:30"),
                                               ("2026-01-01 00:02:00", "2026-01-01 00:01:00"),
                                               ("junk", "2026-01-01 00:00:00"), (None, None)],
               "a string, b string") == [90, None, None, None]
    assert one(spark, D.clamp_pct("a", "b"), [(3, 4), (5, 0), (-1, 2), (9, 3)], "a long, b long") == \
        [75.0, 100.0, 0.0, 100.0]
    assert one(spark, D.severity("x"), [(7.0,), (3.5,), (1.0,)], "x double") == ["high", "elevated", "normal"]
    assert one(spark, D.severity("x", overview=True), [(3.5,), (4.5,)], "x double") == ["normal", "elevated"]
    assert one(spark, D.publish_prefix("s3://m/", F.col("a"), F.col("b"), F.col("c")),
               [("wf", "1.0", "s1")], "a string, b string, c string") == ["s3://m/wf/1.0/s1"]
    as_of = dt.datetime(2026, 1, 10)
    df = spark.createDataFrame(
        [(1, 0, None), (1, 0, dt.datetime(2026, 1, 1)), (1, 0, dt.datetime(2026, 1, 9)), (1, 1, None), (0, 0, None)],
        "samples_remaining long, samples_running long, last_completed_at timestamp_ntz")
    assert [r[0] for r in df.select(D.is_stalled_collection(as_of)).collect()] == [True, True, False, False, False]


def test_json_members_keep_their_types(spark):
    rows = [('{"n":3,"o":{"k":[1,2.5,null]},"z":null,"cohort":"x","b":true}', '{"n":3,"o":{"k":[1,2.5,null]},"z":null,"b":true}', True),
            ('{"cohort":null,"big":12345678901234567890123,"u":"\\u00e9"}', '{"big":12345678901234567890123,"u":"é"}', True),
            ('{"a":1}', '{"a":1}', False), ("{}", "{}", False), ("[1]", "[1]", False), ("nope", "nope", False), (None, None, None),
            ('{"a":1,"a":2,"cohort":"y"}', '{"a":"2"}', True)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select(P.json_drop_key("t", "cohort").alias("d"), P.json_has_key("t", "cohort").alias("h")).collect()
    assert [(r.d, r.h) for r in got] == [(w, h) for _, w, h in rows]


def test_the_three_payload_forms_flatten_alike(spark):
    from runledger.sources import events as EV
    traces = ['{"task_id": 7, "process": "P", "exit": 0, "attempt": "2", "%cpu": "12.5", "memory": 4294967296, "status": "COMPLETED"}',
              '{"process": "P", "attempt": "x", "realtime": null, "rchar": "1e3", "hash": ""}', '{"process": "P", "process": "Q"}',
              "junk", "[]", '{"process": {"nested": [1, 2]}}', '{"process": ""}']
    rows = [(i, "r", "u", "s", "w", "1", None, "process_completed", None, t) for i, t in enumerate(traces)]
    log = spark.createDataFrame(rows, "id long, run_name string, run_id string, sample_id string, workflow_id string, "
                                      "workflow_version string, utc_time timestamp_ntz, event string, metadata string, trace string")
    plain = EV._task_facts(log, None)
    once = EV.to_task_executions(log)
    typed = EV.variant_task_executions(EV.to_variant_log(log))
    key = lambda r: (r.telemetry_id, str(r))
    assert len(plain.collect()) >= 3
    for r, o, t in zip(*(sorted((r for r in f.collect() if r.telemetry_id != 2), key=key) for f in (plain, once, typed))):
        assert r == o == t
    # one parse for all members; the filter on the process, pushed below it, names its own twice
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 3 and plan.split("Filter")[0].count("from_json") == 1 and "get_json_object" not in plan
