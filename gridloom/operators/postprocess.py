"""Series derived from results: loads, overloads, costs, completed controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import nan, divide, gt, lt, negative, positive

DEFAULT_PROBABILITY = 0.0010000000474974513  # fixed value: 0.001 in single precision
FLOW, THREAT, TMP_THREAT = "FLOW_", "MAX_THREAT_1_FLOW_", "MAX_TMP_THREAT_FLOW_"


def qualify(name: Column, schema: str | None) -> Column:
    return F.concat_ws("<>", F.lit(schema), name) if schema else name


def split_qualified(name: Column) -> Column:
    return F.split(name, "<>")


def match_preventive(ids: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """ids that have a result series."""
    return ids.join(names.select(F.col("name").alias("__n")).distinct(), F.concat(F.lit(prefix), "id") == F.col("__n"), "left_semi")


def match_curative(ids: DataFrame, names: DataFrame, prefix: str, contingencies: DataFrame) -> DataFrame:
    """(id, contingency, name) of result series prefix + id + '_' + contingency. Names are cut at every '_' and looked up,
    so neither all pairs are made nor prefixes scanned."""
    rest = names.select("name").distinct().filter(F.col("name").startswith(prefix)).withColumn("parts", F.split(F.substring("name", len(prefix) + 1, 1 << 20), "_"))
    cuts = rest.select("name", "parts", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))).alias("k")).filter("k < size(parts)")
    pairs = cuts.select("name", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "_").alias("id"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "_").alias("contingency"))
    return pairs.join(ids.select("id"), "id", "left_semi").join(contingencies.select(F.col("id").alias("contingency")), "contingency", "left_semi").select("id", "contingency", "name")


def branch_ratings(ratings: DataFrame, monitoring: DataFrame, mode: str = "n") -> DataFrame:
    """(branch, or_rating, ex_rating): of monitored branches their threshold, of others the analysis one; ITAM has its own.
    The reverse rating is the forward one if not set; branches without are left out."""
    pick = lambda v: F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v)
    names = ["thresholdN", "thresholdNEndOr", "analysisThresholdN", "analysisThresholdNEndOr", "thresholdN1", "thresholdN1EndOr", "analysisThresholdNk", "analysisThresholdNkEndOr", "thresholdITAM", "thresholdITAMEndOr"]
    wide = ratings.groupBy("branch").agg(*map(pick, names)).join(monitoring, "branch")
    if mode == "itam":
        a, b = F.col("thresholdITAM"), F.col("thresholdITAMEndOr")
    elif mode == "n":
        watched = F.col("mode_n") == "MONITORED"
        a, b = F.when(watched, F.col("thresholdN")).otherwise(F.col("analysisThresholdN")), F.when(watched, F.col("thresholdNEndOr")).otherwise(F.col("analysisThresholdNEndOr"))
    else:
        watched = F.col("mode_nk") == "MONITORED"
        a, b = F.when(watched, F.col("thresholdN1")).otherwise(F.col("analysisThresholdNk")), F.when(watched, F.col("thresholdN1EndOr")).otherwise(F.col("analysisThresholdNkEndOr"))
    return wide.select("branch", a.alias("or_rating"), F.coalesce(b, a).alias("ex_rating")).filter("or_rating IS NOT NULL")


def load_percent(flow: Column, forward: Column, reverse: Column) -> Column:
    """100 * flow / rating; with different ratings by the flow's sign, so that a flow of 0 gives NaN."""
    rating = F.when(forward == reverse, forward).when(gt(flow, F.lit(0.0)), forward).when(lt(flow, F.lit(0.0)), reverse).otherwise(F.when(F.isnan(flow), nan()).otherwise(F.lit(0.0)))
    return divide(flow * 100, rating)


def overload(flow: Column, forward: Column, reverse: Column) -> Column:
    """What exceeds the rating, with the flow's sign; NaN stays NaN."""
    return F.when(F.isnan(flow), flow).when(flow > forward, flow - forward).when(flow < -reverse, flow + reverse).otherwise(F.lit(0.0))


def branch_loading(flows: DataFrame, ratings: DataFrame) -> DataFrame:
    """(branch, version, point, load, overload) of (branch, version, point, flow)."""
    joined = flows.join(ratings, "branch")
    sides = (F.col("flow"), F.col("or_rating"), F.col("ex_rating"))
    return joined.select("branch", "version", "point", load_percent(*sides).alias("load"), overload(*sides).alias("overload"))


def loading_series(loading: DataFrame, prefix: str) -> DataFrame:
    """(name, version, point, value) of ``<prefix>Load_<branch>`` and ``<prefix>Overload_<branch>``."""
    pair = F.array(F.struct(F.concat(F.lit(f"{prefix}Load_"), "branch").alias("name"), F.col("load").alias("value")), F.struct(F.concat(F.lit(f"{prefix}Overload_"), "branch").alias("name"), F.col("overload").alias("value")))
    return loading.select("version", "point", F.explode(pair).alias("x")).select("x.name", "version", "point", "x.value")


def rating_series(ratings: DataFrame, points: DataFrame, prefix: str) -> DataFrame:
    """The ratings in use at every point, echoed as series."""
    pair = F.array(F.struct(F.concat(F.lit(f"{prefix}_"), "branch").alias("name"), F.col("or_rating").alias("value")), F.struct(F.concat(F.lit(f"{prefix}EndOr_"), "branch").alias("name"), F.col("ex_rating").alias("value")))
    return ratings.select(F.explode(pair).alias("x")).join(points.select("version", "point").distinct()).select("x.name", "version", "point", "x.value")


def overall_overload(base: DataFrame, outage: DataFrame) -> DataFrame:
    o = outage.select("branch", "version", "point", F.col("overload").alias("outage"))
    return base.join(o, ["branch", "version", "point"]).select("branch", "version", "point", (F.abs("overload") + F.abs("outage")).alias("overall"))


def redispatch(results: DataFrame, costs: DataFrame, probability: DataFrame | None = None, having: DataFrame | None = None) -> DataFrame:
    """(keys, up, down, cost_up, cost_down, cost) of (equipment, version, point, value[, contingency]). Costs are null for all if any equipment with
    results lacks one; preventive results count with probability 1. ``having`` is the equipment of the results, if less than these tells it."""
    keys = ["equipment", *(["contingency"] if "contingency" in results.columns else []), "version", "point"]
    missing = (results if having is None else having).select("equipment").distinct().join(costs.filter("cost_up IS NOT NULL AND cost_down IS NOT NULL"), "equipment", "left_anti").agg((F.count("*") == 0).alias("configured"))
    rows = results.withColumn("up", positive(F.col("value"))).withColumn("down", negative(F.col("value"))).join(costs.select("equipment", F.col("cost_up").alias("u"), F.col("cost_down").alias("d")), "equipment", "left")
    rows = rows.join(probability, ["contingency", "version", "point"]) if probability is not None else rows.withColumn("probability", F.lit(1.0))
    rows = rows.crossJoin(F.broadcast(missing))  # one row
    up = F.when(F.col("configured"), F.col("up") * F.col("u") * F.col("probability"))
    down = F.when(F.col("configured"), F.abs("down") * F.col("d") * F.col("probability"))
    return rows.select(*keys, "up", "down", up.alias("cost_up"), down.alias("cost_down"), (up + down).alias("cost"))


def shedding(results: DataFrame, costs: DataFrame, probability: DataFrame | None = None, having: DataFrame | None = None) -> DataFrame:
    """(keys, shed, cost) of load shedding, gated in the same way. ``costs`` is (equipment, cost)."""
    keys = ["equipment", *(["contingency"] if "contingency" in results.columns else []), "version", "point"]
    gate = (results if having is None else having).select("equipment").distinct().join(costs.filter("cost IS NOT NULL"), "equipment", "left_anti").agg((F.count("*") == 0).alias("configured"))
    rows = results.join(costs.select("equipment", F.col("cost").alias("c")), "equipment", "left")
    rows = rows.join(probability, ["contingency", "version", "point"]) if probability is not None else rows.withColumn("probability", F.lit(1.0))
    return rows.crossJoin(F.broadcast(gate)).select(*keys, F.col("value").alias("shed"), F.when(F.col("configured"), F.col("value") * F.col("c") * F.col("probability")).alias("cost"))


def all_costs_configured(results: DataFrame, costs: DataFrame, required: list[str]) -> DataFrame:
    """(equipment) with results that lacks a required cost: none means that cost series can be made."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    return results.select("equipment").distinct().join(costs.filter(complete), "equipment", "left_anti")


def contingency_probability(contingencies: DataFrame, ts: DataFrame) -> DataFrame:
    """(contingency, version, point, probability): the named series, else the base value, else the default."""
    points = ts.select("version", "point").distinct()
    grid = contingencies.join(points)
    values = ts.select(F.col("name").alias("prob_series"), "version", "point", F.col("value").alias("v"))
    return grid.join(values, ["prob_series", "version", "point"], "left").select(F.col("id").alias("contingency"), "version", "point", F.coalesce("v", "prob_base", F.lit(DEFAULT_PROBABILITY)).alias("probability"))


def losses_cost(losses: DataFrame, cost: float | None) -> DataFrame:
    """(version, point, value) of (version, point, losses); nothing without a cost."""
    return losses.filter(F.lit(cost is not None)).select("version", "point", (F.col("losses") * F.lit(float(cost or 0.0))).alias("value"))


def postprocess(parts: list[DataFrame], schema: str | None = None) -> DataFrame:
    """All derived series (name, version, point, value), qualified."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.withColumn("name", qualify(F.col("name"), schema))


def optimized_init(controls: DataFrame, values: DataFrame, points: DataFrame) -> DataFrame:
    """(name, id, version, point, value) initial series of HVDC lines and PSTs: mapped values, else the own one.
    ``controls`` is (id, prefix, base)."""
    grid = controls.join(points.select("version", "point").distinct())
    return grid.join(values.select("id", "version", "point", "value"), ["id", "version", "point"], "left").select(F.concat("prefix", "id").alias("name"), "id", "version", "point", F.coalesce("value", "base").alias("value"))


def tap_angles(taps: DataFrame, angles: DataFrame) -> DataFrame:
    """(id, version, point, angle): a PST's angle by its tap; ``angles`` is (id, tap, alpha)."""
    return taps.withColumn("tap", F.col("value").cast("int")).join(angles, ["id", "tap"], "left").select("id", "version", "point", F.col("alpha").alias("angle"))


def fill_preventive(results: DataFrame, initial: DataFrame) -> DataFrame:
    """(name, version, point, value): results, and the initial value where a result is NaN or has no series."""
    first = initial.select("name", "version", "point", F.col("value").alias("init"))
    return results.join(first, ["name", "version", "point"], "full_outer").select("name", "version", "point", F.when(F.col("value").isNull() | F.isnan("value"), F.coalesce("init", "value")).otherwise(F.col("value")).alias("value"))


def fill_curative(curative: DataFrame, preventive: DataFrame) -> DataFrame:
    """(kind, id, contingency, version, point, value): NaN gives way to the preventive value of the same kind and id."""
    before = preventive.select("kind", "id", "version", "point", F.col("value").alias("before"))
    return curative.join(before, ["kind", "id", "version", "point"], "left").select("kind", "id", "contingency", "version", "point", F.when(F.isnan("value"), F.coalesce("before", "value")).otherwise(F.col("value")).alias("value"))
