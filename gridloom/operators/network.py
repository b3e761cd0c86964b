"""Flows, threats, losses, zones and connectivity over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import negative, positive
from ..plans.cuts import cut_labels
from ..plans.graph import connected_components
from ..plans.scratch import written

# fixed values, in MW: volumes that count, by how much a threat must exceed the least one kept, sizes that are told apart
SMALL_VOLUME, REPLACES, TELLS = 0.05, 1e-3, 1e-3


def ptdf_flows(ptdf: DataFrame, injections: DataFrame) -> DataFrame:
    """(branch, version, point, flow): the matrix as (branch, injection, coefficient) times (injection, version, point, value)."""
    return ptdf.join(injections, "injection").groupBy("branch", "version", "point").agg(F.sum(F.col("coefficient") * F.col("value")).alias("flow"))


def post_contingency_flows(lodf: DataFrame, flows: DataFrame) -> DataFrame:
    """(branch, contingency, version, point, flow): the flow and what the outaged elements' flows add to it."""
    moved = lodf.join(flows.withColumnsRenamed({"branch": "outaged", "flow": "lost"}), "outaged")
    added = moved.groupBy("branch", "contingency", "version", "point").agg(F.sum(F.col("coefficient") * F.col("lost")).alias("added"))
    return flows.join(added, ["branch", "version", "point"]).select("branch", "contingency", "version", "point", (F.col("flow") + F.col("added")).alias("flow"))


def _kept_threats(n: int) -> Column:
    """The fold of ``all``, an array of (place, contingency, flow) in order: kept entries (k, i, contingency, flow) by rising size, those
    whose sizes don't differ by TELLS falling by the number i with which they came. Ranked, largest first."""
    entry = "array<struct<k:double,i:int,contingency:string,flow:double>>"
    below = f"if(abs(e.k - x.k) < {TELLS}, e.i > x.i, e.k < x.k)"
    put = lambda s: f"concat(filter({s}, e -> {below}), array(x), filter({s}, e -> NOT {below}))"
    step = f"if(size(s) < {n}, {put('s')}, if(x.k - s[0].k > {REPLACES}, {put(f'slice(s, 2, {n})')}, s))"
    found = "transform(all, (x, i) -> named_struct('k', abs(x.flow), 'i', i, 'contingency', x.contingency, 'flow', x.flow))"
    return F.expr(f"reverse(aggregate({found}, cast(array() AS {entry}), (s, x) -> {step}))")


def top_threats(flows: DataFrame, n: int, ratings: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """(branch, version, point, rank, contingency, flow): n of the largest absolute flows, as a solver keeps them that goes through
    the contingencies one by one: as long as fewer than n are kept each one is; then one that is larger than the least by more
    than REPLACES takes its place. Of sizes that differ by less than TELLS the one that came later is the lesser. With ratings
    (branch, rating) only flows over them count. ``order`` is (contingency, place); without it contingencies come by name.

    A branch's flows at a point, one for each contingency, meet in one row and are folded there with a state of n entries; there
    is no window, and no key holds more than that."""
    if ratings is not None:
        flows = flows.join(ratings, "branch").filter(F.abs("flow") > F.col("rating"))
    if order is not None:
        flows = flows.join(order, "contingency")
    place = F.col("place" if order is not None else "contingency")
    rows = flows.groupBy("branch", "version", "point").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "contingency", F.col("flow").cast("double").alias("flow")))).alias("all"))
    kept = rows.select("branch", "version", "point", F.posexplode(_kept_threats(n)).alias("k", "t"))
    return kept.select("branch", "version", "point", (F.col("k") + 1).alias("rank"), "t.contingency", "t.flow")


def max_threat(flows: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(branch, version, point, contingency, flow): the largest absolute flow, by the rule of top_threats."""
    return top_threats(flows, 1, order=order).drop("rank")


def overload_total(flows: DataFrame, ratings: DataFrame) -> DataFrame:
    """(version, point, overload) of flows over (branch, rating)."""
    over = F.greatest(F.abs("flow") - F.col("rating"), F.lit(0.0))
    return flows.join(ratings, "branch").groupBy("version", "point").agg(F.sum(over).alias("overload"))


def overload_by_contingency(flows: DataFrame, ratings: DataFrame) -> DataFrame:
    """(version, point, contingency, overload) with a total per point, whose contingency is null."""
    over = F.greatest(F.abs("flow") - F.col("rating"), F.lit(0.0))
    joined = flows.join(ratings, "branch")
    rolled = joined.rollup(F.struct("version", "point").alias("at"), "contingency").agg(F.sum(over).alias("overload"))
    return rolled.filter("at IS NOT NULL").select("at.version", "at.point", "contingency", "overload")


def ac_losses(flows: DataFrame, branches: DataFrame, voltage: float = 400.0) -> DataFrame:
    """(region, version, point, losses): r * (flow / voltage)^2, half to the region of each end."""
    loss = F.col("r") * F.pow(F.col("flow") / F.lit(voltage), F.lit(2.0))
    halves = flows.join(branches.withColumnRenamed("id", "branch"), "branch").select("version", "point", F.explode(F.array("region1", "region2")).alias("region"), (loss / 2).alias("half"))
    return halves.groupBy("region", "version", "point").agg(F.sum("half").alias("losses"))


def hvdc_losses(hvdc: DataFrame, power="setpoint") -> DataFrame:
    """(id, losses): converter, cable, converter. The rectifier's factor (in percent) is on the side that the power comes
    from; the cable's current solves vdc * i - r * i^2 = power behind the rectifier. Lines with r = 0 are left out."""
    p = F.abs(power)
    first = F.when(F.col(power) >= 0, F.col("loss1")).otherwise(F.col("loss2")) / 100
    second = F.when(F.col(power) >= 0, F.col("loss2")).otherwise(F.col("loss1")) / 100
    sent = p * (1 - first)
    current = (F.col("vdc") - F.sqrt(F.greatest(F.col("vdc") * F.col("vdc") - 4 * F.col("r") * sent, F.lit(0.0)))) / (2 * F.col("r"))
    cable = F.col("r") * current * current
    return hvdc.filter("r <> 0").select("id", (p * first + cable + (sent - cable) * second).alias("losses"))


def zone_balance(injections: DataFrame, hvdc: DataFrame) -> DataFrame:
    """(zone, balance): generation less load of (zone, type, p), and HVDC lines' set points into zone2 and out of zone1."""
    signed = injections.select("zone", F.when(F.col("type") == "LOAD", -F.col("p")).otherwise(F.col("p")).alias("p"))
    ends = hvdc.select(F.explode(F.array(F.struct(F.col("zone1").alias("zone"), (-F.col("setpoint")).alias("p")), F.struct(F.col("zone2").alias("zone"), F.col("setpoint").alias("p")))).alias("e")).select("e.zone", "e.p")
    return signed.unionByName(ends).groupBy("zone").agg(F.sum("p").alias("balance"))


def redispatch_volumes(preventive: DataFrame, curative: DataFrame) -> DataFrame:
    """(kind, version, point, up, down, cur_up, cur_down) of (kind, version, point, value) and, with ``contingency``, of
    curative values, whose volumes are the largest over contingencies; rows with nothing of SMALL_VOLUME are left out."""
    keys = ["kind", "version", "point"]
    a = preventive.filter("NOT isnan(value)").groupBy(*keys).agg(F.sum(positive(F.col("value"))).alias("up"), F.sum(negative(F.col("value"))).alias("down"))
    c = curative.filter("NOT isnan(value)").groupBy(*keys, "contingency").agg(F.sum(positive(F.col("value"))).alias("u"), F.sum(negative(F.col("value"))).alias("d"))
    c = c.groupBy(*keys).agg(F.max("u").alias("cur_up"), F.min("d").alias("cur_down"))
    names = ["up", "down", "cur_up", "cur_down"]
    both = a.join(c, keys, "full_outer").select(*keys, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    return both.filter(F.greatest(*[F.abs(n) for n in names]) >= SMALL_VOLUME)


def cost_totals(costs: DataFrame, categories: list[str]) -> DataFrame:
    """(version, point, one total per category) of (category, version, point, cost)."""
    sums = [F.sum(F.when(F.col("category") == c, F.col("cost")).otherwise(F.lit(0.0))).alias(c) for c in categories]
    return costs.groupBy("version", "point").agg(*sums)


def zones(branches: DataFrame, hvdc_bridges: DataFrame | None = None) -> DataFrame:
    """(node, zone, connected): the smallest node that closed branches lead to, and whether that is the largest zone's.
    ``hvdc_bridges`` (node1, node2) join zones, too."""
    nodes = branches.select(F.explode(F.array("node1", "node2")).alias("node")).distinct()
    edges = branches.filter("closed").select(F.col("node1").alias("src"), F.col("node2").alias("dst"))
    if hvdc_bridges is not None:
        edges = edges.union(hvdc_bridges.select("node1", "node2"))
    found = nodes.join(connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("zone"))
    main = found.groupBy("zone").count().agg(F.max_by("zone", F.struct("count", -F.col("zone"))).alias("main"))
    return found.crossJoin(F.broadcast(main)).select("node", "zone", (F.col("zone") == F.col("main")).alias("connected"))  # main is one row


def lost_pockets(branches: DataFrame, contingencies: DataFrame, node_power: DataFrame) -> DataFrame:
    """(contingency, n_nodes, lost_generation, lost_load): nodes outside of the main component once the outaged branches
    are open. ``contingencies`` is (contingency, branch), ``node_power`` (node, generation, load); ids are unique.

    Outages of one or two closed branches read the graph once for all of them: its bridges and the pairs that part it come
    from ``plans.cuts``, and what is cut off are differences of running totals. Those of more branches, and those where two
    components are the largest (the one with the smallest node is then the main one), are solved on the graph, keyed by
    contingency."""
    nodes = branches.select(F.explode(F.array("node1", "node2")).alias("node")).distinct()
    power = nodes.join(node_power, "node", "left").select("node", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("generation", "load")])
    closed = branches.filter("closed").select(F.monotonically_increasing_id().alias("e"), F.col("id").alias("branch"), F.col("node1").alias("a"), F.col("node2").alias("b"))
    closed = written(closed, "closed")
    parts, components = cut_labels(closed, power, ["generation", "load"])
    parts, components = written(parts, "parts"), written(components, "components")
    total = components.agg(F.sum("n").alias("n"), F.sum("generation").alias("generation"), F.sum("load").alias("load")).first()
    if total["n"] is None:
        return _solved_pockets(branches, contingencies.limit(0), node_power)
    out = contingencies.join(closed.select("branch", "e"), "branch", "left").groupBy("contingency").agg(F.collect_set("e").alias("es"))
    few = out.filter("size(es) <= 2").select("contingency", F.get("es", F.lit(0)).alias("x_e"), F.get("es", F.lit(1)).alias("y_e"))
    for side in ("x", "y"):
        own = parts.select(F.col("e").alias(f"{side}_e"), F.struct("component", "label", "tree", "first", "last", "n", "generation", "load").alias(side))
        whole = components.select(F.col("component").alias(f"{side}_component"), F.struct("n", "generation", "load").alias(f"{side}_all"))
        few = few.join(own, f"{side}_e", "left").withColumn(f"{side}_component", F.col(f"{side}.component")).join(whole, f"{side}_component", "left")
    others = []
    for r in components.orderBy(F.desc("n")).limit(4).collect():  # two outages touch two components at most
        touched = F.lit(r["component"]).eqNullSafe(F.col("x_component")) | F.lit(r["component"]).eqNullSafe(F.col("y_component"))
        others.append(F.when(~touched, _sizes(F.lit(r["n"]), F.lit(r["generation"]), F.lit(r["load"]))))
    found = few.withColumn("every", F.concat(_parts(), F.filter(F.array(*others), lambda p: p.isNotNull())))
    most = F.array_max(F.transform("every", lambda p: p["n"]))
    found = written(found.withColumn("main", F.filter("every", lambda p: p["n"] == most)).select("contingency", "main"), "main")
    lost = {"n_nodes": "n", "lost_generation": "generation", "lost_load": "load"}
    cut = found.filter("size(main) = 1").select("contingency", *[(F.lit(total[c]) - F.col("main")[0][c]).alias(name) for name, c in lost.items()])
    hard = out.filter("size(es) > 2").select("contingency").union(found.filter("size(main) > 1").select("contingency"))
    return cut.filter("n_nodes > 0").unionByName(_solved_pockets(branches, contingencies.join(hard, "contingency", "left_semi"), node_power))


def _sizes(n: Column, generation: Column, load: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), generation.cast("double").alias("generation"), load.cast("double").alias("load"))


def _parts() -> Column:
    """What the outaged branches' components fall into, from the columns x and y (labels of edges, and what is below them) and
    x_all and y_all (their components)."""
    x, y, x_all, y_all = (F.col(c) for c in ("x", "y", "x_all", "y_all"))

    def parts(*each):
        """An array of parts, each a list of what it adds up and a list of what it leaves out."""
        return F.array(*[_sizes(*[sum((t[c] for t in more[1:]), more[0][c]) - sum((t[c] for t in less), F.lit(0)) for c in ("n", "generation", "load")]) for more, less in each])

    bridge = lambda t: F.coalesce(t["tree"] & (t["label"] == 0), F.lit(False))
    inside = lambda t, u: (u["first"] < t["first"]) & (t["last"] < u["last"])
    none = F.array().cast("array<struct<n:bigint,generation:double,load:double>>")
    alone = lambda t, whole: F.when(t.isNull(), none).when(bridge(t), parts(([t], []), ([whole], [t]))).otherwise(parts(([whole], [])))
    bridges = (
        F.when(inside(y, x), parts(([y], []), ([x], [y]), ([x_all], [x])))
        .when(inside(x, y), parts(([x], []), ([y], [x]), ([x_all], [y])))
        .otherwise(parts(([x], []), ([y], []), ([x_all], [x, y])))
    )
    pair = (
        F.when(~y["tree"], parts(([x], []), ([x_all], [x])))
        .when(~x["tree"], parts(([y], []), ([x_all], [y])))
        .when(inside(y, x), parts(([x], [y]), ([x_all, y], [x])))
        .when(inside(x, y), parts(([y], [x]), ([x_all, x], [y])))
        .otherwise(parts(([x, y], []), ([x_all], [x, y])))
    )
    together = (
        F.when(bridge(x) & bridge(y), bridges)
        .when(bridge(x), alone(x, x_all))
        .when(bridge(y), alone(y, y_all))
        .when((x["label"] == y["label"]) & (x["tree"] | y["tree"]), pair)
        .otherwise(parts(([x_all], [])))
    )
    return F.when(F.col("x_component") == F.col("y_component"), together).otherwise(F.concat(alone(x, x_all), alone(y, y_all)))


def _solved_pockets(branches: DataFrame, contingencies: DataFrame, node_power: DataFrame) -> DataFrame:
    """lost_pockets by solving a copy of the graph for every contingency, all together."""
    every = written(contingencies.select("contingency").distinct(), "contingencies")
    if not every.limit(1).count():
        return every.select("contingency", F.lit(0).cast("long").alias("n_nodes"), F.lit(0.0).alias("lost_generation"), F.lit(0.0).alias("lost_load"))
    nodes = branches.select(F.explode(F.array("node1", "node2")).alias("node")).distinct()
    pairs = branches.filter("closed").select(F.col("id").alias("branch"), "node1", "node2").crossJoin(every).join(contingencies, ["contingency", "branch"], "left_anti")
    found = connected_components(pairs, "node1", "node2", key=("contingency",))
    placed = nodes.crossJoin(every).join(found, ["contingency", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    main = placed.groupBy("contingency", "component").count().groupBy("contingency").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("main"))
    out = placed.join(main, "contingency").filter("component <> main").join(node_power, "node", "left")
    return out.groupBy("contingency").agg(F.count("*").alias("n_nodes"), F.sum(F.coalesce("generation", F.lit(0.0))).alias("lost_generation"), F.sum(F.coalesce("load", F.lit(0.0))).alias("lost_load"))


def section_flows(sections: DataFrame, flows: DataFrame) -> DataFrame:
    """(section, version, point, flow, margin, overload) of (id, max_flow_n, weights map): sections without limit or
    branches drop out."""
    parts = sections.filter("max_flow_n IS NOT NULL").select(F.col("id").alias("section"), "max_flow_n", F.explode("weights").alias("branch", "weight"))
    total = parts.join(flows, "branch").groupBy("section", "max_flow_n", "version", "point").agg(F.sum(F.col("weight") * F.col("flow")).alias("flow"))
    return total.select("section", "version", "point", "flow", (F.col("max_flow_n") - F.abs("flow")).alias("margin"), F.greatest(F.abs("flow") - F.col("max_flow_n"), F.lit(0.0)).alias("overload"))


def proportional_share(members: DataFrame, totals: DataFrame) -> DataFrame:
    """(group, id, share, value): a group's total in proportion to ``reference``; alike if the references add up to 0."""
    sums = members.groupBy("group").agg(F.sum("reference").alias("all"), F.count("*").alias("n"))
    share = F.when(F.col("all") == 0, 1 / F.col("n")).otherwise(F.col("reference") / F.nullif("all", F.lit(0.0)))
    return members.join(sums, "group").join(totals, "group").select("group", "id", share.alias("share"), (share * F.col("total")).alias("value"))


def reserve_share(units: DataFrame, outages: DataFrame) -> DataFrame:
    """(id, share): the largest outage of generation over contingencies, spread over adjustable units by maxP, rounded to
    a tenth and maxP at most; 0 for others. ``units`` is (id, max_p, adjustable), ``outages`` (contingency, lost)."""
    largest = outages.groupBy("contingency").agg(F.sum("lost").alias("lost")).agg(F.coalesce(F.max("lost"), F.lit(0.0)).alias("largest"))
    total = units.agg(F.sum(F.when(F.col("adjustable"), F.col("max_p"))).alias("all"))
    both = units.crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(total))  # one row each
    share = F.least("max_p", F.round(F.col("largest") / F.col("all") * F.col("max_p"), 1))
    return both.select("id", F.when(F.col("adjustable"), share).otherwise(F.lit(0.0)).alias("share"))
