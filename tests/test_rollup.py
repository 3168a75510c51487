"""Daily rollup states against the facts themselves."""
import random
from datetime import date, datetime, timedelta

import pytest

from runledger.operators import rollup

SCHEMA = "process string, attempt int, status string, utc_time timestamp, pct_cpu double, pct_mem double, peak_rss long"


def facts(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 5 + ["cold", None]), rnd.randint(1, 2), rnd.choice(["COMPLETED", "FAILED"]),
             datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 6 * 1440)),
             rnd.choice([None, 50.0, rnd.random() * 100]), None, rnd.randint(1, 10**9)) for _ in range(n)]


def test_states_merge_to_the_direct_counts_and_quantiles(spark, tmp_path):
    batches = [facts(6000, 1), facts(3000, 2), [("late", 1, "FAILED", datetime(2024, 1, 2), None, None, 5)]]
    path = str(tmp_path / "states")
    for i in (0, 1, 2, 1):                                        # a replayed batch replaces itself
        rollup.write_batch(spark.createDataFrame(batches[i], SCHEMA), path, i)
    states = rollup.read_states(spark, path)
    first, last = date(2024, 1, 2), date(2024, 1, 4)
    rows = [r for b in batches for r in b if r[0] and first <= r[3].date() <= last]
    got = {(r.process, r.attempt): r for r in rollup.window_report(states, first, last).collect()}
    assert got.keys() == {r[:2] for r in rows}
    for key, g in got.items():
        mine = [r for r in rows if r[:2] == key]
        assert (g.rows, g.failed) == (len(mine), sum(r[2] == "FAILED" for r in mine))
        assert g.q_pct_mem is None and g.avg_pct_mem is None
        for column, value in ((4, g.q_pct_cpu), (6, g.q_peak_rss)):
            seen = [r[column] for r in mine if r[column] is not None]
            if not seen:
                assert value is None
                continue
            below, upto = sum(v < value for v in seen) / len(seen), sum(v <= value for v in seen) / len(seen)
            slack = .01 + 1 / len(seen)
            assert below - slack <= .95 <= upto + slack            # the value's ranks hold 95 %
    days = {r.event_date: r.rows for r in rollup.daily_timeline(states).collect()}
    assert sum(days.values()) == sum(r[0] is not None for b in batches for r in b)


def test_empty_facts_give_empty_states(spark):
    assert rollup.window_report(rollup.daily_state(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("q", [0.0, 0.5, 1.0])
def test_quantile_of_equal_values(spark, q):
    rows = [("p", 1, "COMPLETED", datetime(2024, 1, 1 + i % 3), 7.0, 7.0, 7) for i in range(500)]
    (r,) = rollup.window_report(rollup.daily_state(spark.createDataFrame(rows, SCHEMA)), quantile=q).collect()
    assert (r.q_pct_cpu, r.q_peak_rss, r.avg_pct_cpu) == (7.0, 7.0, 7.0)
