"""Live streaming behaviour: the keyed run state machine's timers (T4/T5) and late events."""
import datetime as dt
import os
import tempfile
import time

from runledger.streaming import streams as S

SCHEMA = "run_name string, seq long, event string, run_id string, utc_time timestamp_ntz"
T0 = dt.datetime(2026, 1, 1)


def _drop(spark, d, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(d, name))


def test_run_state_timers_and_late_events(spark):
    root = tempfile.mkdtemp(prefix="rl-live-")
    src_dir = os.path.join(root, "in")
    os.makedirs(src_dir)
    _drop(spark, src_dir, [("zombie", 1, "claim", None, T0), ("zombie", 2, "started", "u1", T0),
                           ("stale", 3, "claim", None, T0),
                           ("done", 4, "claim", None, T0), ("done", 5, "started", "u3", T0),
                           ("done", 6, "completed", None, T0)], "b0")
    src = spark.readStream.schema(SCHEMA).parquet(src_dir + "/*")
    q = (S.run_state_stream(src, heartbeat_minutes=2 / 60, claim_ttl_minutes=2 / 60)
         .writeStream.format("memory").queryName("live_runs").outputMode("update")
         .option("checkpointLocation", os.path.join(root, "ckpt"))
         .trigger(processingTime="1 second").start())
    try:
        # processAllAvailable() would wait on the timer batches; poll with a deadline instead
        time.sleep(5)
        # a late 'started' for the completed run must not roll it back
        _drop(spark, src_dir, [("done", 7, "started", "late", T0)], "b1")
        deadline = time.time() + 60
        final = {}
        while time.time() < deadline:
            rows = spark.table("live_runs").collect()
            final = {}
            for r in rows:
                if r["reason"] or r["run_name"] not in final:
                    final[r["run_name"]] = (r["status"], r["reason"])
            if final.get("zombie", ("",))[0] == "failed" and final.get("stale", ("",))[0] == "expired":
                break
            time.sleep(1)
    finally:
        q.stop()
    assert final["zombie"] == ("failed", "heartbeat timeout")
    assert final["stale"] == ("expired", "claim ttl")
    statuses = {r["status"] for r in spark.table("live_runs").collect() if r["run_name"] == "done"}
    assert statuses == {"completed"}


def test_weekly_window_starts_monday(spark):
    """The 7-day tumbling window with the Thursday-epoch offset equals date_trunc('week')."""
    from pyspark.sql import functions as F
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=13 * i), "COMPLETED" if i % 3 else "FAILED")
            for i in range(120)]
    df = spark.createDataFrame(rows, "utc_time timestamp_ntz, status string")
    got = {r["bucket_start"].replace(tzinfo=None): (r["total"], r["failed"])
           for r in S.timeline_stream(df, "week", late="3650 days").collect()}
    want = {r["b"]: (r["total"], r["failed"]) for r in
            df.groupBy(F.date_trunc("week", "utc_time").alias("b"))
              .agg(F.count("*").alias("total"),
                   F.count_if(F.col("status") == "FAILED").alias("failed")).collect()}
    assert got == want
    assert all(b.weekday() == 0 for b in got)


class _State:
    """A group state as the run machine sees it, its clock set by the test."""
    exists, hasTimedOut, value, wait, now = False, False, None, None, 0

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value

    def remove(self):
        self.exists, self.value = False, None

    def setTimeoutDuration(self, ms):
        self.wait = ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def test_runs_of_a_bucket_keep_their_own_state_and_limits():
    import pandas as pd
    fn, state = S._run_state_fn(1000, 400, True, 5000), _State()

    def call(now, rows=(), timed_out=False):
        state.now, state.hasTimedOut, state.wait = now, timed_out, None
        pdf = pd.DataFrame(list(rows), columns=["run_name", "seq", "event", "run_id", "utc_time"])
        pdf["utc_time"] = pd.to_datetime(pdf["utc_time"])
        return {r.run_name: (r.status, r.reason) for out in fn((0,), iter([pdf] if rows else []), state) for r in out.itertuples()}

    got = call(0, [("b", 3, "started", "u", T0), ("a", 1, "claim", None, T0), ("b", 2, "claim", None, None),
                   (None, 4, "claim", None, None), ("x", 5, "started", None, T0)])
    assert got == {"a": ("claimed", None), "b": ("running", None), None: ("claimed", None)} and state.wait == 400
    # the claims ran out while b has new events; b's own limit moved
    assert call(500, [("b", 6, "heartbeat", None, T0)]) == {"b": ("running", None), "a": ("expired", "claim ttl"), None: ("expired", "claim ttl")}
    assert state.wait == 1000
    assert call(1500, timed_out=True) == {"b": ("failed", "heartbeat timeout")} and state.wait == 4000
    assert call(1600, [("a", 7, "started", "late", T0)]) == {"a": ("expired", None)}
    assert call(5500, timed_out=True) == {} and sorted(state.value[0], key=str) == ["a", "b"]
    call(6600, timed_out=True)
    assert not state.exists
