"""Connected components of a large edge table by contraction."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

MAX_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, component)``, component = its smallest node.

    Each round hooks every node to its smallest neighbour, follows one more such hook and
    contracts: edges are rewritten between the hooked nodes, so inner edges vanish. The
    minimum is combined map-side, so a node with very many edges is no hot group. The
    rounds' small tables are kept in the shared folder. Self-loops and nulls are ignored; an
    empty table gives an empty result."""
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.filter("a is not null and b is not null and a <> b")
                     .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    hooks = []
    while not e.isEmpty():
        if len(hooks) == MAX_ROUNDS:
            raise RuntimeError("components did not converge")
        hook = (e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                         .alias("x")).groupBy(F.col("x.a").alias("u")).agg(F.min("x.b").alias("m"))
                .select("u", F.least("u", "m").alias("p")))
        hook = scratch.keep(hook)
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hooks.append(hook.join(up, "p").select("u", F.col("pp").alias("p")))
        to = hooks[-1]
        e = scratch.keep(
            e.join(to.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
            .join(to.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b").filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    labels = nodes.withColumn("component", F.col("node"))
    out = scratch.keep(reduce(
        lambda t, h: t.join(h.withColumnRenamed("u", "component"), "component", "left")
        .select("node", F.coalesce("p", "component").alias("component")), hooks, labels))
    scratch.drop_all_but(out)
    return out
