"""Pages by cursor, and repeats dropped within the watermark."""
import datetime as dt
import random

from runledger.operators import paging
from runledger.operators import runs as R
from runledger.session import scratch_path
from runledger.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def test_cursor_pages_make_up_the_whole_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *[T0 + dt.timedelta(hours=h) for h in range(6)]]), rng.choice([None, "a", "b"]), i) for i in range(120)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, s string, id long")
    for order in ([("t", "desc"), ("id", "desc")], [("s", "asc"), ("t", "desc"), ("id", "asc")]):
        want = df.orderBy(*paging.ordering(order)).collect()
        got, cursor = [], None
        while True:
            part = paging.page(df, order, 17, cursor).collect()
            got += part
            if len(part) < 17:
                break
            cursor = paging.cursor_of(part[-1], order)
        assert got == want


def test_the_cursor_reaches_the_scan(spark):
    path = scratch_path(spark, f"paging-{random.randrange(1 << 60)}")
    spark.range(1000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) t", "id").write.parquet(path)
    order = [("t", "desc"), ("id", "desc")]
    page = paging.page(spark.read.parquet(path), order, 5, {"t": T0 + dt.timedelta(hours=500), "id": 500})
    assert [r.id for r in page.collect()] == [499, 498, 497, 496, 495]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(t," in plan and "TakeOrderedAndProject" in plan


def test_runs_page_by_cursor(spark):
    rows = [(f"r{i}", "running", "w", T0 if i % 3 else None, T0, T0, None, None, None) for i in range(30)]
    runs = spark.createDataFrame(rows, "run_name string, status string, workflow_id string, claimed_at timestamp_ntz, "
                                       "started_at timestamp_ntz, last_heartbeat_at timestamp_ntz, wrapper_exit_code long, "
                                       "submitted_at timestamp_ntz, log_uploaded_at timestamp_ntz")
    first = R.runs_page(runs, T0, limit=12).collect()
    rest = R.runs_page(runs, T0, limit=12, cursor=paging.cursor_of(first[-1], R.RUN_ORDER)).collect()
    assert rest == R.runs_page(runs, T0, limit=12, offset=12).collect()


def test_repeats_are_dropped_within_the_watermark_only(spark):
    schema = "k string, utc_time timestamp_ntz"
    root = scratch_path(spark, f"repeats-{random.randrange(1 << 60)}")
    at = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("a", at(0)), ("a", at(0)), ("b", at(1)), (None, at(1)), ("n", None), ("n", None)], [("a", at(3)), (None, at(2))],
               [("z", at(200))], [("y", at(201))], [("a", at(202))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        src = spark.readStream.schema(schema).parquet(f"{root}/in")
        S.run_to_parts(S.drop_repeats(src, ["k"], "24 hours"), "append", f"{root}/out", f"{root}/ck")
    got = sorted((r.k or "", r.utc_time) for r in spark.read.parquet(f"{root}/out").collect() if r.utc_time)
    assert got == [("", at(1)), ("a", at(0)), ("a", at(202)), ("b", at(1)), ("y", at(201)), ("z", at(200))]
    assert spark.read.parquet(f"{root}/out").filter("utc_time is null").count() == 2
