"""The banded exact quantile against Spark's exact percentile: groups below the sketch's
accuracy (whole-range band), far above it (narrow band), and bands that a poor sketch misses."""
import random

import pytest
from pyspark.sql import functions as F

from runledger.operators.quantiles import group_quantile


@pytest.mark.parametrize("accuracy", [3, 50, 1000, 10_000])
def test_group_quantile_matches_percentile(spark, accuracy):
    rnd = random.Random(7)
    rows = []
    for g in range(6):
        n = [1, 2, 5, 300, 4000, 12000][g]
        for _ in range(n):
            v = rnd.choice([rnd.random() * 100, float(rnd.randint(0, 20))])   # ties included
            rows.append((f"g{g}", v, None if rnd.random() < 0.1 else v * 2))
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"]: r for r in group_quantile(df, ["k"], ["a", "b"], 0.95, accuracy=accuracy).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(F.percentile("a", 0.95).alias("a"),
                                                   F.percentile("b", 0.95).alias("b")).collect()}
    for k, w in want.items():
        assert got[k]["q_a"] == pytest.approx(w["a"], rel=1e-12, abs=1e-12), k
        if w["b"] is None:
            assert got[k]["q_b"] is None
        else:
            assert got[k]["q_b"] == pytest.approx(w["b"], rel=1e-12, abs=1e-12), k


def test_ties_are_one_row_in_a_band(spark):
    """90 % of a group are equal, and the quantile lies among them: what is ordered in one window
    is the band's distinct values, not its rows."""
    n, accuracy = 200_000, 1000
    df = spark.range(n).select(F.lit("g").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id") / 7).otherwise(50.0).alias("a"))
    out = group_quantile(df, ["k"], ["a"], 0.5, accuracy=accuracy)
    assert out.first()["q_a"] == 50.0
    rnd = df.withColumn("a", F.when(F.col("id") % 10 == 0, F.rand(1) * 100).otherwise(F.col("a"))) if "id" in df.columns else df
    got = group_quantile(rnd, ["k"], ["a"], 0.95, accuracy=accuracy)
    assert got.first()["q_a"] == pytest.approx(rnd.agg(F.percentile("a", 0.95)).first()[0])
    plan = got._jdf.queryExecution()
    got.collect()
    rows = {}
    todo = [plan.executedPlan()]
    while todo:                                     # rows that reach the window's sort
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
            todo.append(node.plan())
            continue
        if name == "Window":
            rows[name] = node
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    assert "Window" in rows
    exchanged = rows["Window"]
    while not exchanged.nodeName().startswith("HashAggregate"):
        exchanged = exchanged.children().apply(0) if exchanged.children().size() else exchanged.plan()
    assert 0 < exchanged.metrics().apply("numOutputRows").value() <= 8 * n / accuracy


def test_quantile_groups_with_null_keys_and_no_values(spark):
    rows = [(None, 1.0, None), (None, 3.0, None), ("a", None, None), ("b", 2.0, float("nan")), ("b", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: (r.q_a, r.q_b) for r in group_quantile(df, ["k"], ["a", "b"], 0.5).collect()}
    assert got[None] == (2.0, None) and got["b"][0] == 3.0 and got["b"][1] != got["b"][1] and got.get("a", (None, None)) == (None, None)
    assert {r.k: r.q_a for r in group_quantile(df, ["k"], ["a"], 0.5, method="approx").collect()}["b"] == 2.0
