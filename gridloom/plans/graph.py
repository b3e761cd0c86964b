"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .spread import spread_join


def connected_components(edges: DataFrame, src="src", dst="dst", key: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """(*key, node, component): the smallest node that can be reached, for every node with an edge.

    Each round takes the least label among neighbours and then the label of that label, so a chain of length n ends
    after some log n rounds. ``key`` columns keep several graphs apart. A round is two joins and an aggregate with
    partial sums; labels are written to the shared folder. Edges with a null end are left out. With ``spread``, nodes with
    many edges and labels of many nodes are dealt to several tasks, for graphs that may have such.
    """
    keys = list(key)
    both = edges.select(*keys, F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = written(both.union(both.select(*keys, "b", "a")).distinct(), "edges")
    labels = written(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        ends = labels.withColumnRenamed("node", "b")
        met = spread_join(both, ends, [*keys, "b"], "a") if spread else both.join(ends, [*keys, "b"])
        near = met.groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(*keys, F.col("node").alias("via"), F.col("component").alias("jumped"))
        jumped = spread_join(written(step, "step"), jump, [*keys, "via"], "node") if spread else step.join(jump, [*keys, "via"])
        step = written(jumped.select(*keys, "node", "old", F.least("via", "jumped").alias("component")), "labels")
        changed = step.filter("old <> component").limit(1).count()
        labels = step.drop("old")
        if not changed:
            return labels
