"""The job-level state stream: equal to the batch fold, timers by event time."""
import datetime as dt
import random

from pyspark.sql import functions as F

from runledger.operators import lifecycle as L
from runledger.session import scratch_path
from runledger.streaming import jobs as J
from runledger.streaming import streams as S

SCHEMA = ("seq long, run_name string, event string, sample_id string, workflow_id string, workflow_version string, "
          "run_id string, utc_time timestamp")
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def row(seq, minute, event, run, sample=None):
    wf = ("w", "1") if event == "claim" else (None, None)
    return (seq, run, event, sample, *wf, None, at(minute))


def workflows(spark, budget):
    return spark.createDataFrame([("w", "1", budget)], "workflow_id string, version string, max_retries int")


def replay(spark, name, batches, budget=1, **clock):
    """One micro-batch for each list of rows, the stream started anew each time."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    root = scratch_path(spark, f"test-{name}-{random.randrange(1 << 60)}")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{root}/in")
        src = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        S.run_to_parts(J.job_stream(src, workflows(spark, budget), **clock), "append", f"{root}/out", f"{root}/ck")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return J.current_jobs(spark, f"{root}/out")


def test_stream_equals_batch_fold_on_random_logs(spark):
    rng = random.Random(12)
    rows = []
    for seq in range(1, 900):
        run = f"r{rng.randrange(14)}"
        event = rng.choice(["claim", "claim", "claim", "submitted", "started", "sentinel", "completed", "failed", "expire"])
        sample = f"s{rng.randrange(9)}" if event in ("claim", "sentinel") else None
        rows.append(row(seq, seq, event, run, sample))
    batches = [rows[:200], rows[200:230], rows[230:]]
    got = replay(spark, "random", [rng.sample(b, len(b)) for b in batches], budget=3)
    want = L.fold_jobs(spark.createDataFrame(rows, SCHEMA), workflows(spark, 3))
    pick = sorted(got.columns)
    assert sorted(map(tuple, got.select(pick).collect()), key=str) == sorted(map(tuple, want.select(pick).collect()), key=str)
    dead = J.dead_letters(got)
    assert sorted(dead.columns) == sorted(L.dead_letters(want).columns)
    assert dead.exceptAll(L.dead_letters(want).select(dead.columns)).count() == 0


def test_timers_follow_the_event_clock(spark):
    """A's claim expires after 5 minutes without a penalty; B's heartbeat moves its limit, then B
    is failed and its job swept; C lives on. Late events change nothing."""
    batches = [
        [row(1, 0, "claim", "A", "a"), row(2, 0, "claim", "B", "b"), row(3, 1, "started", "B"), row(4, 1, "claim", "C", "c"),
         row(5, 2, "started", "C")],
        [row(6, 10, "heartbeat", "C")],
        [row(7, 11, "heartbeat", "C"), row(8, 12, "heartbeat", "B")],
        [row(9, 20, "heartbeat", "C")],
        [row(10, 21, "heartbeat", "C")],
    ]
    clock = {"clock": "event", "heartbeat_minutes": 15, "claim_ttl_minutes": 5}
    by = {r.sample_id: r for r in replay(spark, "ttl", batches[:3], budget=0, **clock).collect()}
    assert (by["a"].status, by["a"].retry_count, by["a"].run_name) == ("pending", 0, None)
    assert by["b"].status == by["c"].status == "running"
    more = [[row(11, 30, "heartbeat", "C")], [row(12, 31, "heartbeat", "C")],
            [row(13, 32, "sentinel", "B", "b"), row(14, 33, "heartbeat", "C")]]
    by = {r.sample_id: r for r in replay(spark, "beat", batches[:3] + more, budget=0, **clock).collect()}
    assert (by["b"].status, by["b"].retry_count, by["b"].dead_letter, by["b"].dead_letter_run) == ("failed", 1, True, "B")
    assert by["c"].status == "running"


def test_finished_runs_are_forgotten_after_their_retention(spark):
    batches = [[row(1, 0, "claim", "A", "a"), row(2, 1, "completed", "A"), row(3, 1, "claim", "Z", "z"), row(4, 1, "submitted", "Z")],
               [row(5, 500, "submitted", "Z")], [row(6, 501, "submitted", "Z")],
               [row(7, 502, "claim", "A", "q"), row(8, 503, "expire", "A")]]
    got = replay(spark, "retention", batches, budget=5, clock="event", retention_minutes=60)
    by = {r.sample_id: r for r in got.collect()}
    assert (by["a"].status, by["a"].retry_count) == ("pending", 1)
    assert by["q"].status == "pending"          # the forgotten run began anew, merely claimed, and expired


def test_steps_of_unknown_runs_and_repeats(spark):
    got = replay(spark, "unknown", [[row(1, 0, "started", "A"), row(2, 0, "sentinel", "A", "a")],
                                    [row(3, 1, "claim", "A", "a"), row(4, 1, "started", "A"), row(4, 1, "started", "A"),
                                     row(5, 2, "submitted", "A"), row(6, 2, "expire", "A")]])
    assert [(r.sample_id, r.status, r.retry_count) for r in got.collect()] == [("a", "running", 0)]
    assert J.dead_letters(got).count() == 0 and got.filter(F.col("completed_seq").isNotNull()).count() == 0


def test_runs_that_share_a_bucket_keep_their_own_state_and_timers(spark):
    """one call of a machine serves many runs; limits that are equal, moved and shared stay each run's own."""
    batches = [[row(k, k % 3, "claim", f"r{k}", f"s{k}") for k in range(1, 40)],
               [row(100 + k, 3, "started", f"r{k}") for k in range(1, 40, 2)] + [row(150, 3, "heartbeat", "r2")],
               [row(160, 9, "heartbeat", "r1")], [row(161, 9, "heartbeat", "r1")],
               [row(162, 21, "heartbeat", "r1")], [row(163, 21, "heartbeat", "r1")]]
    clock = {"clock": "event", "heartbeat_minutes": 15, "claim_ttl_minutes": 5}
    by = {r.sample_id: r for r in replay(spark, "bucket", batches, budget=0, buckets=1, **clock).collect()}
    assert len(by) == 39 and by["s1"].status == "running"
    assert {(r.status, r.retry_count) for s, r in by.items() if int(s[1:]) % 2 and s != "s1"} == {("failed", 1)}
    assert {(r.status, r.retry_count) for s, r in by.items() if not int(s[1:]) % 2} == {("pending", 0)}
