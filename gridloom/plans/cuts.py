"""Which edges of a graph part it: bridges and pairs, from one spanning forest and random labels.

Every edge outside of the forest gets a random number of 64 bits, every edge of it the exclusive or of the numbers of all edges
that go past it, from below it to elsewhere. An edge with label 0 is a bridge; two edges with one label part the graph together.
(Both can be wrong with a probability of some 2^-64 for each edge or pair.) What lies below an edge of the forest is an interval
of a tour around it, so its size and sums are differences of running totals.

All steps are joins and aggregates whose number grows with the logarithm of the graph: the forest by each component's least
edge to another one, the tour's order by doubling its steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import running
from .scratch import written, written_and_found


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of a spanning forest, (node, component)) of written edges (e, a, b), e a different number for each. A component is
    named by one of its nodes."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(nodes.withColumn("component", F.col("node")), "labels")
    live = edges.filter("a <> b").select("e", "a", "b")
    tree = None
    while True:
        both = live.union(live.select("e", F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("from")).agg(F.min(F.struct("e", "b")).alias("x")).select("from", "x.e", F.col("x.b").alias("to"))
        best, more = written_and_found(best, "least", F.lit(True))
        if not more:
            return edges.join(tree, "e", "left_semi") if tree is not None else edges.limit(0), labels
        tree = best.select("e").distinct() if tree is None else tree.union(best.select("e").distinct())
        back = best.select(F.col("from").alias("to"), F.col("to").alias("back"))
        step = best.join(back, "to").select("from", F.when((F.col("back") == F.col("from")) & (F.col("from") < F.col("to")), F.col("from")).otherwise(F.col("to")).alias("to"))
        step, more = written(step, "steps"), True
        while more:  # each component goes where its least edge leads; two that lead to each other end there
            jump = step.select(F.col("from").alias("to"), F.col("to").alias("next"))
            step = step.join(jump, "to").select("from", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            step, more = written_and_found(step, "steps", F.col("moved"))
            step = step.drop("moved")
        of = lambda c: step.select(F.col("from").alias(c), F.col("to").alias(f"{c}_to"))
        labels = written(labels.join(of("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")), "labels")
        live = live.join(of("a"), "a", "left").join(of("b"), "b", "left").select("e", F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        live = written(live.filter("a <> b"), "live")


def tour(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, arc, e, tail, head, place): both directions of every edge of the forest in the order of a walk around its
    component's tree, places from 0. An arc is 2 e, or 2 e + 1 for the direction back."""
    arc = lambda k, tail, head: tree.select((F.col("e") * 2 + k).alias("arc"), "e", F.col(tail).alias("tail"), F.col(head).alias("head"))
    arcs = arc(0, "a", "b").union(arc(1, "b", "a")).join(labels.withColumnRenamed("node", "tail"), "tail")
    around = Window.partitionBy("tail").orderBy("arc")
    every = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arcs = arcs.withColumn("first", F.min("arc").over(every)).withColumn("turn", F.coalesce(F.lead("arc").over(around), F.col("first")))
    arcs = written(arcs, "arcs")
    # after the arc to a node comes the one that follows its way back, around that node; the walk ends before the root's first arc
    starts = arcs.filter("tail = component").select("component", F.col("first").alias("start")).distinct()
    after = arcs.join(starts, "component").select(F.col("arc").bitwiseXOR(F.lit(1)).alias("arc"), F.when(F.col("turn") != F.col("start"), F.col("turn")).alias("next"))
    ranks, more = written_and_found(after.withColumn("left", F.col("next").isNotNull().cast("long")), "ranks", F.col("next").isNotNull())
    while more:
        jump = ranks.select(F.col("arc").alias("next"), F.col("next").alias("further"), F.col("left").alias("more"))
        met = ranks.join(jump, "next", "left").select("arc", F.col("further").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        ranks, more = written_and_found(met, "ranks", F.col("next").isNotNull())
    sizes = arcs.groupBy("component").agg(F.count("*").alias("n"))
    placed = arcs.join(ranks.select("arc", "left"), "arc").join(sizes, "component")
    return placed.select("component", "arc", "e", "tail", "head", (F.col("n") - 1 - F.col("left")).alias("place"))


def cut_labels(edges: DataFrame, values: DataFrame, sums: list[str]) -> tuple[DataFrame, DataFrame]:
    """((e, component, label, tree, first, last, n, *sums), (component, n, *sums)) of edges (e, a, b) and nodes (node, *sums),
    which must hold all ends of edges, once each. n and sums of an edge are those of the nodes below it, first and last its
    place in the tour; outside of the forest they are null. Nodes without edges are components, too."""
    edges = written(edges.select("e", "a", "b"), "edges")
    values = written(values.select("node", *sums), "nodes")
    tree, labels = spanning_forest(edges)
    tree = written(tree, "tree")
    rest = written(edges.join(tree.select("e"), "e", "left_anti").withColumn("label", F.xxhash64(F.lit(29), "e")), "rest")
    marks = rest.select(F.explode(F.array("a", "b")).alias("node"), "label").groupBy("node").agg(F.bit_xor("label").alias("mark"))
    known = values.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    components = known.groupBy("component").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    walked = written(tour(tree, labels), "tour")
    down = walked.groupBy("component", "e").agg(F.min(F.struct("place", "head")).alias("down"), F.max("place").alias("last"))
    down = down.select("component", "e", F.col("down.head").alias("node"), F.col("down.place").alias("first"), "last")
    held = down.join(values, "node").join(marks, "node", "left").withColumn("mark", F.coalesce("mark", F.lit(0).cast("long")))
    held = written(held, "below")
    names = {"n": ("one", "sum"), "label": ("mark", "bit_xor"), **{c: (c, "sum") for c in sums}}
    ends = held.select("component", F.col("first").alias("place"), F.lit(1).cast("long").alias("one"), "mark", *sums)
    ups = held.select("component", F.col("last").alias("place"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("mark"), *[F.lit(0).cast(values.schema[c].dataType).alias(c) for c in sums])
    total = running(ends.unionByName(ups), ["component"], "place", {f"all_{k}": v for k, v in names.items()})
    total = written(total.select("component", "place", *[f"all_{k}" for k in names]), "totals")
    at = lambda side: total.select("component", F.col("place").alias(side), *[F.col(f"all_{k}").alias(f"{side}_{k}") for k in names])
    met = held.withColumn("one", F.lit(1).cast("long")).join(at("first"), ["component", "first"]).join(at("last"), ["component", "last"])
    below = [(F.col(f"last_{k}") - F.col(f"first_{k}") + F.col(c)).alias(k) for k, (c, kind) in names.items() if kind == "sum"]
    label = F.col("last_label").bitwiseXOR(F.col("first_label")).bitwiseXOR(F.col("mark")).alias("label")
    found = met.select("e", "component", label, F.lit(True).alias("tree"), "first", "last", *below)
    others = rest.join(labels.withColumnRenamed("node", "a"), "a").select("e", "component", "label", F.lit(False).alias("tree"))
    return found.unionByName(others, allowMissingColumns=True), components
