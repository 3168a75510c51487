import datetime as dt

import pytest

from runledger.operators.filters import MetricFilter


def test_default_window_is_seven_days():
    f = MetricFilter(as_of=dt.datetime(2024, 1, 8)).effective()
    assert f.window_days == 7
    assert MetricFilter(as_of=dt.datetime(2024, 1, 8)).lower_bound() == dt.datetime(2024, 1, 1)


def test_any_time_filter_suppresses_default():
    assert MetricFilter(since=dt.datetime(2024, 1, 1)).effective().window_days is None
    assert MetricFilter(until=dt.datetime(2024, 1, 1)).effective().window_days is None
    assert MetricFilter(window_hours=3, as_of=dt.datetime(2024, 1, 1)).effective().window_days is None
    assert MetricFilter(all_time=True).effective().lower_bound() is None


def test_window_validation():
    with pytest.raises(ValueError):
        MetricFilter(window_days=1, window_hours=1).effective()
    with pytest.raises(ValueError):
        MetricFilter(window_days=0).effective()
    with pytest.raises(ValueError):
        MetricFilter(window_days=2).lower_bound()   # relative window needs as_of


def test_filter_pushdown(spark):
    from runledger.plans.domain import Domain
    from tests.conftest import SF_SMALL
    d = Domain(spark, SF_SMALL)
    f = MetricFilter(since=dt.datetime(2000, 1, 1), until=dt.datetime(2000, 12, 31))
    plan = f.apply(d.task_executions)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan


def test_event_date_partition_pruning(spark, tmp_path):
    """A time window on a fact table partitioned by event_date prunes partitions."""
    from pyspark.sql import functions as F
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20, i % 24)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, utc_time timestamp_ntz").withColumn("event_date", F.to_date("utc_time"))
    path = str(tmp_path / "facts")
    df.write.partitionBy("event_date").parquet(path)
    facts = spark.read.parquet(path)
    f = MetricFilter(since=dt.datetime(2024, 1, 5), until=dt.datetime(2024, 1, 7, 23))
    out = f.apply(facts, keys=())
    utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    plan = utils.explainString(out._jdf.queryExecution(), "formatted")
    part = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters:")]
    assert part and "event_date" in part[0] and "2024-01-05" in part[0] and "2024-01-07" in part[0]
    assert out.count() == sum(1 for _, t in rows if dt.datetime(2024, 1, 5) <= t <= dt.datetime(2024, 1, 7, 23))
