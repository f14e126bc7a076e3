"""Graph operators (C7): connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.scratch import Scratch, by_shuffle


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scope: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(*scope, id, root) for every node with an edge; root is the component's least id.

    Undirected. Each round every group of equal labels learns the least label that any
    of its members has beside it, jumps to that label's own label, and hands it to all
    members. Whole groups move, not nodes, so long chains need few rounds, whether their
    ids are sorted (the jumps double) or shuffled (the groups merge). Labels are written between rounds: no lineage grows
    and no link or label reaches the driver, only the question whether one has changed.
    No join of a round is broadcast, whatever its files' size, and so not the caller's with the result.
    Nodes of degree zero are the caller's: left-join and coalesce to the own id.
    The rounds run when the function is called. Only the table of the result stays, in
    ``scratch`` where the caller has one.
    """
    scope = scope or []
    own = Scratch(edges.sparkSession, "components", scratch)
    one = edges.select(*scope, F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    both = own.write("edges", one.unionByName(one.select(*scope, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = by_shuffle(own.write("labels0", both.groupBy(*scope, "u").agg(F.least(F.min("v"), F.first("u")).alias("root")).withColumnRenamed("u", "id")))
    turn = 0
    while True:
        heads = labels.withColumnsRenamed({"id": "v", "root": "r"})
        near = both.join(heads, [*scope, "v"]).groupBy(*scope, "u").agg(F.min("r").alias("near")).withColumnRenamed("u", "id")
        hooks = labels.join(near, [*scope, "id"]).groupBy(*scope, "root").agg(F.min("near").alias("near")).select(*scope, "root", F.least("root", "near").alias("hook"))
        beyond = labels.select(*scope, F.col("id").alias("hook"), F.col("root").alias("far"))
        jump = hooks.join(beyond, [*scope, "hook"]).select(*scope, "root", "far")
        moved = labels.join(jump, [*scope, "root"]).select(*scope, "id", F.col("root").alias("old"), F.col("far").alias("root"))
        step = own.write(f"labels{turn + 1}", moved)
        changed = not step.where("old <> root").isEmpty()
        labels = by_shuffle(step.drop("old"))
        turn += 1
        if not changed:
            own.keep(f"labels{turn}")
            return labels
        own.drop(f"labels{turn - 1}")
