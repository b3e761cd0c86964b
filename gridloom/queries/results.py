"""Series derived from results (A18, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postprocess as post
from ..sources import results as res
from ..functions.guards import nan
from ..plans.spread import dealt
from .registry import query

r6 = lambda c: F.round(c, 6)
# every ninth flow is missing
FLOWS = "SELECT branch, version, point, CASE WHEN (point + CAST(substr(branch, 4) AS INT)) % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE flow END AS flow FROM flows"
OUT = "SELECT branch, version, point, flow * 2 AS flow FROM f"


def flows(t):
    hole = (F.col("point") + F.substring("branch", 4, 9).cast("int")) % 9 == 0
    return t.flows.withColumn("flow", F.when(hole, nan()).otherwise(F.col("flow")))


def _rated(watched: str, normal: str, other: str) -> str:
    pick = lambda v: f"max(value) FILTER (variable = '{v}')"
    a, b = f"CASE WHEN {watched} THEN {pick(normal)} ELSE {pick(other)} END", f"CASE WHEN {watched} THEN {pick(normal + 'EndOr')} ELSE {pick(other + 'EndOr')} END"
    return f"SELECT * FROM (SELECT r.branch, {a} AS or_rating, coalesce({b}, {a}) AS ex_rating FROM ratings r JOIN monitoring m ON m.branch = r.branch GROUP BY r.branch, mode_n, mode_nk) WHERE or_rating IS NOT NULL"


RATED = {"n": _rated("mode_n = 'MONITORED'", "thresholdN", "analysisThresholdN"), "nk": _rated("mode_nk = 'MONITORED'", "thresholdN1", "analysisThresholdNk"), "itam": _rated("true", "thresholdITAM", "thresholdITAM")}
OVER = "CASE WHEN isnan(flow) THEN flow WHEN flow > or_rating THEN flow - or_rating WHEN flow < -ex_rating THEN flow + ex_rating ELSE 0 END"
LOAD = "CASE WHEN isnan(flow) THEN flow WHEN or_rating = ex_rating OR flow > 0 THEN 100 * flow / or_rating WHEN flow < 0 THEN 100 * flow / ex_rating ELSE CAST('NaN' AS DOUBLE) END"


def _loading_sql(source: str) -> str:
    return f"SELECT f.branch, version, point, round({LOAD}, 6) AS load, {OVER} AS overload FROM {source} f JOIN rated r ON r.branch = f.branch"


def loading(t, mode="n"):
    source = flows(t) if mode == "n" else flows(t).withColumn("flow", F.col("flow") * 2)
    return post.branch_loading(source, post.branch_ratings(t.ratings, t.monitoring, mode))


@query(
    "f1_ids_with_results",
    """
    SELECT DISTINCT id FROM branch WHERE concat('FLOW_', id) IN (SELECT concat('FLOW_', branch)
    FROM flows WHERE flow > 30)""",
    "branch", "flows",
)
def f1(t):
    names = t.flows.filter("flow > 30").select(F.concat(F.lit("FLOW_"), F.col("branch")).alias("name"))
    return post.match_preventive(t.branch.select("id"), names, "FLOW_").distinct()


@query(
    "f2_curative_series",
    """
    SELECT DISTINCT t.branch AS id, t.contingency, concat('FLOW_', t.branch, '_', t.contingency) AS name
    FROM threats t WHERE t.contingency <> 'cty_4' AND t.flow > 40""",
    "threats",
)
def f2(t):
    names = t.threats.filter("flow > 40").select(F.concat(F.lit("FLOW_"), F.col("branch"), F.lit("_"), F.col("contingency")).alias("name"))
    return post.match_curative(t.branch.select("id"), names, "FLOW_", t.contingency.filter("id <> 'cty_4'"))


@query("f3_f4_ratings", "SELECT * FROM rated", "ratings", "monitoring", rated=RATED["n"])
def f3(t):
    return post.branch_ratings(t.ratings, t.monitoring)


@query(
    "f5_load_percent",
    f"""
    SELECT branch, version, point, load FROM ({_loading_sql('f')})
    WHERE NOT isnan(load)""",
    "flows", "ratings", "monitoring", f=FLOWS, rated=RATED["n"],
)
def f5(t):
    return loading(t).filter("NOT isnan(load)").select("branch", "version", "point", r6("load").alias("load"))


@query(
    "f5_load_missing",
    f"""
    SELECT branch, version, point FROM ({_loading_sql('f')}) WHERE isnan(load)""",
    "flows", "ratings", "monitoring", f=FLOWS, rated=RATED["n"],
)
def f5_missing(t):
    return loading(t).filter("isnan(load)").select("branch", "version", "point")


@query(
    "f6_overload",
    f"""
    SELECT branch, version, point, overload FROM ({_loading_sql('f')})
    WHERE NOT isnan(overload)""",
    "flows", "ratings", "monitoring", f=FLOWS, rated=RATED["n"],
)
def f6(t):
    return loading(t).filter("NOT isnan(overload)").select("branch", "version", "point", "overload")


@query(
    "f7_base_case_series",
    f"""
    SELECT concat('basecaseOverload_', branch) AS name, version, point, overload AS value
    FROM ({_loading_sql('f')}) WHERE NOT isnan(overload)""",
    "flows", "ratings", "monitoring", f=FLOWS, rated=RATED["n"],
)
def f7(t):
    return post.loading_series(loading(t), "basecase").filter("name LIKE 'basecaseOverload%' AND NOT isnan(value)")


@query(
    "f8_outage_loading",
    f"""
    SELECT * FROM ({_loading_sql('o')}) WHERE NOT isnan(overload) AND NOT isnan(load)""",
    "flows", "ratings", "monitoring", f=FLOWS, o=OUT, rated=RATED["nk"],
)
def f8(t):
    return loading(t, "nk").filter("NOT isnan(overload) AND NOT isnan(load)").withColumn("load", r6("load"))


@query(
    "f8_itam_loading",
    f"""
    SELECT * FROM ({_loading_sql('o')}) WHERE NOT isnan(overload) AND NOT isnan(load)""",
    "flows", "ratings", "monitoring", f=FLOWS, o=OUT, rated=RATED["itam"],
)
def f8_itam(t):
    return loading(t, "itam").filter("NOT isnan(overload) AND NOT isnan(load)").withColumn("load", r6("load"))


@query(
    "f8_rating_series",
    """
    SELECT concat('rating_', branch) AS name, version, point, or_rating AS value
    FROM rated CROSS JOIN (SELECT DISTINCT version, point FROM flows)
    UNION ALL SELECT concat('ratingEndOr_', branch), version, point, ex_rating
    FROM rated CROSS JOIN (SELECT DISTINCT version, point FROM flows)""",
    "flows", "ratings", "monitoring", rated=RATED["nk"],
)
def f8_ratings(t):
    return post.rating_series(post.branch_ratings(t.ratings, t.monitoring, "nk"), t.flows, "rating")


@query(
    "f9_overall_overload",
    f"""
    SELECT a.branch, a.version, a.point, abs(a.o) + abs(b.o) AS overall
    FROM (SELECT f.branch, version, point, {OVER} AS o FROM f JOIN rated r ON r.branch = f.branch) a
    JOIN (SELECT f.branch, version, point, {OVER} AS o FROM o f JOIN rated_k r ON r.branch = f.branch) b ON a.branch = b.branch AND a.version =
    b.version AND a.point = b.point WHERE NOT isnan(a.o)""",
    "flows", "ratings", "monitoring", f=FLOWS, o=OUT, rated=RATED["n"], rated_k=RATED["nk"],
)
def f9(t):
    return post.overall_overload(loading(t), loading(t, "nk")).filter("NOT isnan(overall)")


_COSTS = "SELECT equipment, cost_up, coalesce(cost_down, 3) AS cost_down FROM costs"


def _costs(t):
    return t.kept_costs.select("equipment", "cost_up", F.coalesce("cost_down", F.lit(3.0)).alias("cost_down"))


@query(
    "f10_redispatch_split",
    """
    SELECT equipment, version, point, greatest(value, 0) AS up, least(value, 0) AS down
    FROM redispatch WHERE NOT isnan(value)""",
    "redispatch",
)
def f10(t):
    return post.redispatch(t.redispatch, _costs(t)).filter("NOT isnan(up)").select("equipment", "version", "point", "up", "down")


@query(
    "f11_redispatch_cost",
    """
    SELECT r.equipment, version, point, greatest(value, 0) * cost_up AS cost_up, abs(least(value, 0)) * cost_down AS cost_down, greatest(value, 0) *
    cost_up + abs(least(value, 0)) * cost_down AS cost FROM redispatch r
    JOIN c ON c.equipment = r.equipment WHERE NOT isnan(value)""",
    "redispatch", "costs", c=_COSTS,
)
def f11(t):
    return post.redispatch(t.redispatch, _costs(t)).filter("NOT isnan(cost)").select("equipment", "version", "point", "cost_up", "cost_down", "cost")


_PROB = """
    SELECT c.id AS contingency, p.version, p.point, coalesce(t.value, c.prob_base, 0.0010000000474974513) AS probability
    FROM contingency c CROSS JOIN (SELECT DISTINCT version, point
    FROM ts) p LEFT JOIN ts t ON t.name = c.prob_series AND t.version = p.version AND t.point = p.point"""


def _by_contingency(t):
    return t.redispatch_for(t.contingency.count()).crossJoin(t.contingency.select(F.col("id").alias("contingency")))


def _probability(t):
    return t.once("probability", lambda: post.contingency_probability(t.contingency, t.kept_ts))


@query(
    "f11_curative_cost",
    """
    SELECT r.equipment, p.contingency, r.version, r.point, round((greatest(value, 0) * cost_up + abs(least(value, 0)) * cost_down) * p.probability, 6)
    AS cost FROM redispatch r JOIN c ON c.equipment = r.equipment
    JOIN prob p ON p.version = r.version AND p.point = r.point WHERE NOT isnan(value)""",
    "redispatch", "costs", "contingency", "ts", c=_COSTS, prob=_PROB,
)
def f11_curative(t):
    return post.redispatch(_by_contingency(t), _costs(t), _probability(t), t.redispatch).filter("NOT isnan(cost)").select("equipment", "contingency", "version", "point", r6("cost").alias("cost"))


@query(
    "f12_load_shedding",
    """
    SELECT r.equipment, p.contingency, r.version, r.point, value AS shed, round(value * cost_up * p.probability, 6) AS cost
    FROM redispatch r JOIN c ON c.equipment = r.equipment JOIN prob p ON p.version = r.version AND p.point = r.point
    WHERE NOT isnan(value)""",
    "redispatch", "costs", "contingency", "ts", c=_COSTS, prob=_PROB,
)
def f12(t):
    return post.shedding(_by_contingency(t), _costs(t).select("equipment", F.col("cost_up").alias("cost")), _probability(t), t.redispatch).filter("NOT isnan(cost)").withColumn("cost", r6("cost"))


@query("f13_all_costs_configured", "SELECT equipment FROM costs WHERE type = 'GENERATOR' AND cost_down IS NULL", "costs")
def f13(t):
    return post.all_costs_configured(t.redispatch, t.costs, ["cost_up", "cost_down"])


@query("f14_contingency_probability", "SELECT * FROM prob", "contingency", "ts", prob=_PROB)
def f14(t):
    return post.contingency_probability(t.contingency, t.ts)


@query("f15_losses_cost", "SELECT version, point, sum(value) * 55 AS value FROM ts GROUP BY version, point", "ts")
def f15(t):
    return post.losses_cost(t.ts.groupBy("version", "point").agg(F.sum("value").alias("losses")), 55.0)


@query("f16_all_postprocessing", f"""SELECT name, version, point, value FROM (
    SELECT concat('all<>basecaseLoad_', branch) AS name, version, point, load AS value
    FROM ({_loading_sql('f')}) UNION ALL SELECT concat('all<>basecaseOverload_', branch), version, point, overload
    FROM ({_loading_sql('f')})
    UNION ALL SELECT 'all<>LOSSES_COST', version, point, sum(value) * 55 FROM ts GROUP BY version, point) WHERE NOT isnan(value)""", "flows", "ratings", "monitoring", "ts", f=FLOWS, rated=RATED["n"])
def f16(t):
    cost = f15(t).select(F.lit("LOSSES_COST").alias("name"), "version", "point", "value")
    return post.postprocess([post.loading_series(loading(t), "basecase"), cost], "all").filter("NOT isnan(value)").withColumn("value", r6("value"))


_INIT = """
    SELECT concat('HVDC_', h.id) AS name, h.id, p.version, p.point, coalesce(t.value, h.setpoint) AS value
    FROM hvdc h CROSS JOIN (SELECT DISTINCT version, point FROM ts) p
    LEFT JOIN ts t ON t.name = concat('ts_', CAST(h.num AS STRING)) AND t.version = p.version AND t.point = p.point"""


def _init(t):
    controls = dealt(t.hvdc.select("id", F.lit("HVDC_").alias("prefix"), F.col("setpoint").alias("base")), t.points(), "id")
    mapped = t.kept_ts.select(F.regexp_replace("name", "ts_", "hvdc_").alias("id"), "version", "point", "value")
    return post.optimized_init(controls, mapped, t.kept_ts)


@query("f17_optimized_init", "SELECT * FROM init", "hvdc", "ts", init=_INIT)
def f17(t):
    return _init(t)


@query(
    "f17_tap_angles",
    """
    SELECT p.id, t.version, t.point, CAST(CAST(trunc(t.value) AS INT) % 5 AS DOUBLE) / 4 AS angle
    FROM pst p JOIN ts t ON t.name = concat('ts_', CAST(p.num AS STRING))""",
    "pst", "ts",
)
def f17_angles(t):
    taps = t.ts.select(F.regexp_replace("name", "ts_", "pst_").alias("id"), "version", "point", "value").join(t.pst.select("id"), "id", "left_semi")
    angles = taps.select("id", F.col("value").cast("int").alias("tap")).distinct().withColumn("alpha", (F.col("tap") % 5).cast("double") / 4)
    return post.tap_angles(taps, angles)


@query(
    "f18_fill_preventive",
    """
    SELECT name, version, point, CASE WHEN point % 2 = 0 AND CAST(substr(id, 6) AS INT) % 3 <> 0 THEN 1 ELSE value END AS value
    FROM init""",
    "hvdc", "ts", init=_INIT,
)
def f18(t):
    some = _init(t).filter(F.substring("id", 6, 9).cast("int") % 3 != 0).select("name", "version", "point", F.when(F.col("point") % 2 == 0, F.lit(1.0)).otherwise(nan()).alias("value"))
    return post.fill_preventive(some, _init(t))


@query(
    "f19_fill_curative",
    """
    SELECT 'hvdc' AS kind, i.id, c.id AS contingency, i.version, i.point, CASE WHEN (i.point + c.num) % 2 = 0 THEN 1 ELSE i.value END AS value
    FROM init i CROSS JOIN contingency c""",
    "hvdc", "ts", "contingency", init=_INIT,
)
def f19(t):
    init = dealt(_init(t).select("id", "version", "point", "value"), t.contingency.count(), "id", "version", "point")  # as they meet again
    before = init.select(F.lit("hvdc").alias("kind"), "id", "version", "point", "value")
    c = t.contingency.select(F.col("id").alias("contingency"), "num")
    after = before.crossJoin(c).withColumn("value", F.when((F.col("point") + F.col("num")) % 2 == 0, F.lit(1.0)).otherwise(nan())).drop("num")
    return post.fill_curative(after, before.hint("shuffle_hash"))  # few rows in a task


@query("f20_schema_names", "SELECT DISTINCT concat('run<>', name) AS qualified, 'run' AS schema, name FROM ts", "ts")
def f20(t):
    q = t.ts.select(post.qualify(F.col("name"), "run").alias("qualified")).distinct()
    parts = post.split_qualified(F.col("qualified"))
    return q.select("qualified", parts[0].alias("schema"), parts[1].alias("name"))


# ---- A18: result lines written from the flows ------------------------------------------------------------------

def _files(t):
    """Flows with their values as text and the file that they are written to."""
    return t.kept_flows.select("point", F.concat(F.lit("result_s"), F.col("point").cast("string")).alias("file"), F.col("point").alias("variant"), "branch", F.col("flow").cast("int").cast("string").alias("v"))


def result_lines(t):
    """Lines of result files: base-case flows and flows after outages 1 and 2; the file of variant 2 has an unknown outage."""
    lines = [
        "concat('R3 ;;', branch, ';', v, ';')", "concat('R3C ;;', branch, ';', CASE WHEN point = 2 AND branch = 'br_1' THEN '9' ELSE '1' END, ';', v, ';')",
        "concat('R3B ;;', branch, ';;;2;', v, ';1;-1;')",
    ]
    fixed = ["R3 ;PAR LIGNE;LIGNE;TRANSIT N;", "C4 ;INCIDENTS;NUMERO;TYPE;OUVRAGE;", "C4 ;;    1;N-1L;cty_a;", "C4 ;;    2;N-1L;cty_b;", "C1 ;;0;"]
    f = _files(t)
    return f.select("file", "variant", F.explode(F.array(*map(F.expr, lines))).alias("line")).union(f.select("file", "variant").distinct().select("file", "variant", F.explode(F.array(*map(F.lit, fixed))).alias("line")))


@query("a18_ingest_results", """
    SELECT point AS variant, x.name, x.kind, x.value FROM (SELECT * FROM flows WHERE point <> 2) CROSS JOIN LATERAL (VALUES
        ('FLOW_' || branch, 'double', CAST(CAST(flow AS INT) AS STRING)), ('FLOW_' || branch || '_cty_a', 'double', CAST(CAST(flow AS INT) AS STRING)),
        ('MAX_THREAT_1_NAME_' || branch, 'string', 'cty_b'), ('MAX_THREAT_1_FLOW_' || branch, 'double', CAST(CAST(flow AS INT) AS STRING)),
        ('MAX_THREAT_2_NAME_' || branch, 'string', 'cty_a'), ('MAX_THREAT_2_FLOW_' || branch, 'double', '-1')) x(name, kind, value)
    UNION ALL SELECT DISTINCT point, 'ERROR_CODE', 'double', '0' FROM flows WHERE point <> 2 UNION ALL SELECT x.v, 'ERROR_CODE', 'double', '1' FROM (SELECT 2 AS v UNION ALL SELECT max(point) + 1 FROM flows) x""", "flows")
def a18(t):
    """A file for every point; one more is expected that isn't there."""
    points = t.kept_flows.select("point")
    expected = points.distinct().union(points.agg((F.max("point") + 1).cast("int").alias("point"))).withColumnRenamed("point", "variant")
    return res.ingest_result_records(result_lines(t), expected)


# Per branch and point one line of each kind of record: the line, and (name, value) of what it says. An empty cell says nothing
# where it may be empty; 0 is the base case, other numbers are those of the file's list of outages.
EACH = [
    ("concat('C2 ;;', branch, ';x;', v, ';;')", [("'LOST_GEN_' || branch", "v")]),
    ("concat('C2B ;;cty_z;', branch, ';', v, ';')", [("'LOST_LOAD_' || branch || '_cty_z'", "v")]),
    ("concat('C5 ;;area_', branch, ';', v, ';')", [("'INIT_BAL_AREA_area_' || branch", "v")]),
    ("concat('R1 ;;', branch, ';x;', v, ';;')", [("'INIT_BAL_LOAD_' || branch", "v")]),
    ("concat('R1B ;1;', branch, ';', v, ';')", [("'LOAD_CUR_' || branch || '_cty_a'", "v")]),
    ("concat('R1C ;group_', branch, ';', v, ';')", [("'LOAD_group_' || branch", "v")]),
    ("concat('R2 ;;', branch, ';x;y;', v, ';8;')", [("'INIT_BAL_GEN_' || branch", "v"), ("'GEN_' || branch", "'8'")]),
    ("concat('R2B ;2;', branch, ';', v, ';')", [("'GEN_CUR_' || branch || '_cty_b'", "v")]),
    ("concat('R2C ;group_', branch, ';', v, ';')", [("'GEN_group_' || branch", "v")]),
    ("concat('R2D ;1;', branch, ';', v, ';')", [("'BAT_CUR_' || branch || '_cty_a'", "v")]),
    ("concat('R3 ;;', branch, ';', v, ';')", [("'FLOW_' || branch", "v")]),
    ("concat('R3B ;;', branch, ';1;', v, ';2;', v, ';;;')", [("'MAX_TMP_THREAT_NAME_' || branch", "'cty_a'"), ("'MAX_TMP_THREAT_FLOW_' || branch", "v"), ("'MAX_THREAT_1_NAME_' || branch", "'cty_b'"), ("'MAX_THREAT_1_FLOW_' || branch", "v")]),
    ("concat('R3C ;;', branch, ';2;', v, ';')", [("'FLOW_' || branch || '_cty_b'", "v")]),
    ("concat('R4 ;;', branch, ';0;', v, ';')", [("'MV_' || branch", "v")]),
    ("concat('R4B ;;', branch, ';2;x;unit;', v, ';9;')", [("'MV_POW_' || branch || '_cty_b_unit'", "v"), ("'MV_COST_' || branch || '_cty_b_unit'", "'9'")]),
    ("concat('R5 ;;', branch, ';', v, ';3;')", [("'PST_' || branch", "v"), ("'PST_TAP_' || branch", "'3'")]),
    ("concat('R5B ;1;', branch, ';', v, ';3;')", [("'PST_CUR_' || branch || '_cty_a'", "v"), ("'PST_CUR_TAP_' || branch || '_cty_a'", "'3'")]),
    ("concat('R6 ;;', branch, ';', v, ';;')", [("'HVDC_' || branch", "v")]),
    ("concat('R6B ;2;', branch, ';', v, ';')", [("'HVDC_CUR_' || branch || '_cty_b'", "v")]),
    ("concat('R7 ;;', branch, ';', v, ';;1;2;')", [("'GEN_VOL_DOWN_' || branch", "v"), ("'GEN_CUR_VOL_DOWN_' || branch", "'1'"), ("'GEN_CUR_VOL_UP_' || branch", "'2'")]),
    ("concat('R8B ;;', branch, ';', v, ';')", [("'LOSSES_' || branch", "v")]),
    ("concat('R10;;', branch, ';x;open ', v, ';')", [("'TOPOLOGY_' || branch", "'open ' || v")]),
]
ONCE = ["C1 ;;0;", "C4 ;;    1;N-1L;cty_a;", "C4 ;;    2;N-1L;cty_b;", "R7 ;;BATTERY;5;;;6;", "R8 ;;12;", "R9 ;;1;2;3;4;5;;7;;"]
SAID_ONCE = [("ERROR_CODE", 0), ("BAT_VOL_DOWN_BATTERY", 5), ("BAT_CUR_VOL_UP_BATTERY", 6), ("LOSSES", 12), ("GEN_COST", 1), ("BAT_COST", 2), ("LOAD_COST", 3), ("OVERLOAD_OUTAGES", 4), ("OVERLOAD_BASECASE", 5), ("BAT_CUR_COST", 7)]
_SAID = ", ".join(f"({name}, '{'string' if '_NAME_' in name or 'TOPOLOGY' in name else 'double'}', {value})" for _, said in EACH for name, value in said)


@query("a18_all_records", f"""
    SELECT point AS variant, x.name, x.kind, x.value FROM (SELECT branch, point, CAST(CAST(flow AS INT) AS STRING) AS v
    FROM flows) CROSS JOIN LATERAL (VALUES {_SAID}) x(name, kind, value)
    UNION ALL SELECT point, x.name, 'double', x.value FROM (SELECT DISTINCT point FROM flows) CROSS JOIN (VALUES {', '.join(f"('{n}', '{k}')" for n, k in SAID_ONCE)}) x(name, value)""", "flows")
def a18_all(t):
    """Every kind of record, each with its header line."""
    f = _files(t)
    each = f.select("file", "variant", F.explode(F.array(*[F.expr(line) for line, _ in EACH])).alias("line"))
    once = [*ONCE, *[f"{tag};{marker};" for tag, marker in res.HEADERS.items()]]
    return res.ingest_result_records(each.union(f.select("file", "variant").distinct().select("file", "variant", F.explode(F.array(*map(F.lit, once))).alias("line"))))
