"""Flows, threats, losses, zones, checks (N, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..operators import network as net
from .registry import ORACLE_SQL, query

r6 = lambda c: F.round(c, 6)
RATING = "SELECT branch, value AS rating FROM ratings WHERE variable = 'thresholdN1'"


def rating(t):
    return t.ratings.filter("variable = 'thresholdN1'").select("branch", F.col("value").alias("rating"))


def threats(t):
    """Flows after each contingency, by the library's own operator."""
    return net.post_contingency_flows(t.lodf, t.flows)


@query(
    "n1_flow_from_ptdf",
    """
    SELECT p.branch, t.version, t.point, round(sum(p.coefficient * t.value), 5) AS flow
    FROM ptdf p JOIN ts t ON t.name = p.injection GROUP BY 1, 2, 3""",
    "ptdf", "ts",
)
def n1(t):
    return net.ptdf_flows(t.ptdf, t.ts.withColumnRenamed("name", "injection")).withColumn("flow", F.round("flow", 5))


@query("n2_post_contingency_flow", "SELECT branch, contingency, version, point, round(flow, 6) AS flow FROM threats", "threats")
def n2(t):
    return threats(t).withColumn("flow", r6("flow"))


def _top_sql(n: int, rows: str = "SELECT *, contingency AS place FROM threats") -> str:
    """The solver's rule as a recursion over the contingencies in their order, with the kept ones as a list."""
    below = "CASE WHEN abs(e.k - f.k) < 0.001 THEN e.i > f.i ELSE e.k < f.k END"
    put = lambda s: f"list_filter({s}, lambda e: {below}) || [struct_pack(k := f.k, i := f.i, c := f.contingency, flow := f.flow)] || list_filter({s}, lambda e: NOT {below})"
    return f"""
    RECURSIVE f AS (SELECT branch, version, point, contingency, flow, abs(flow) AS k,
                           row_number() OVER (PARTITION BY branch, version, point ORDER BY place, contingency) AS i FROM ({rows})),
    kept(branch, version, point, n, s) AS (
        SELECT branch, version, point, i, [struct_pack(k := k, i := i, c := contingency, flow := flow)] FROM f WHERE i = 1
        UNION ALL
        SELECT f.branch, f.version, f.point, f.i, CASE WHEN len(s) < {n} THEN {put('s')} WHEN f.k - s[1].k > 0.001 THEN {put(f's[2:{n}]')} ELSE s END
        FROM kept JOIN f ON f.branch = kept.branch AND f.version = kept.version AND f.point = kept.point AND f.i = kept.n + 1),
    last AS (SELECT branch, version, point, list_reverse(arg_max(s, n)) AS s FROM kept GROUP BY branch, version, point)
    SELECT branch, version, point, CAST(r AS INT) AS rank, s[r].c AS contingency, round(s[r].flow, 6) AS flow
    FROM (SELECT *, unnest(range(1, len(s) + 1)) AS r FROM last)"""


def _recursive(name: str, sql: str, *bindings: str, **extra: str) -> None:
    """The twin of a query whose own clauses are recursive: they go on with the bindings' WITH."""
    from ..sources.bindings import with_bindings

    head, _, body = sql.strip().partition(" ")
    ORACLE_SQL[name] = with_bindings("", *bindings, **extra).replace("WITH ", f"WITH {head} ", 1).rstrip() + ",\n" + body


@query("n3_top_threats")
def n3(t):
    return net.top_threats(threats(t), 3).withColumn("flow", r6("flow"))


@query("n3_threats_over_rating")
def n3_over(t):
    return net.top_threats(threats(t), 2, rating(t)).withColumn("flow", r6("flow"))


def _near(t):
    """Flows some of which differ by less than a thousandth."""
    return t.threats.withColumn("flow", F.round("flow") + F.regexp_replace("contingency", "cty_", "").cast("double") * 0.0003)


_NEAR = "SELECT branch, contingency, version, point, round(flow) + CAST(replace(contingency, 'cty_', '') AS DOUBLE) * 0.0003 AS flow, {} AS place FROM threats"


@query("n3_near_threats")
def n3_near(t):
    order = t.contingency.select(F.col("id").alias("contingency"), F.col("num").alias("place"))
    return net.top_threats(_near(t), 3, order=order).withColumn("flow", r6("flow"))


@query("n3_near_threats_backwards")
def n3_back(t):
    order = t.contingency.select(F.col("id").alias("contingency"), (-F.col("num")).alias("place"))
    return net.top_threats(_near(t), 3, order=order).withColumn("flow", r6("flow"))


@query("n4_max_threat")
def n4(t):
    return net.max_threat(threats(t)).withColumn("flow", r6("flow"))


_OVER = "SELECT t.*, t.contingency AS place FROM threats t JOIN rating r ON r.branch = t.branch WHERE abs(t.flow) > r.rating"
_recursive("n3_top_threats", _top_sql(3), "threats")
_recursive("n3_threats_over_rating", _top_sql(2, _OVER), "threats", "ratings", rating=RATING)
_recursive("n3_near_threats", _top_sql(3, _NEAR.format("CAST(replace(contingency, 'cty_', '') AS INT)")), "threats")
_recursive("n3_near_threats_backwards", _top_sql(3, _NEAR.format("-CAST(replace(contingency, 'cty_', '') AS INT)")), "threats")
_recursive("n4_max_threat", _top_sql(1).replace("CAST(r AS INT) AS rank, ", ""), "threats")


@query(
    "n5_overload_total",
    """
    SELECT f.version, f.point, round(sum(greatest(abs(f.flow) - r.rating, 0)), 6) AS overload
    FROM flows f JOIN rating r ON r.branch = f.branch GROUP BY 1, 2""",
    "flows", "ratings", rating=RATING,
)
def n5(t):
    return net.overload_total(t.flows, rating(t)).withColumn("overload", r6("overload"))


@query(
    "n5_overload_by_contingency",
    """
    SELECT f.version, f.point, f.contingency, round(sum(greatest(abs(f.flow) - r.rating, 0)), 6) AS overload
    FROM threats f JOIN rating r ON r.branch = f.branch GROUP BY GROUPING SETS ((f.version, f.point, f.contingency), (f.version, f.point))""",
    "threats", "ratings", rating=RATING,
)
def n5_k(t):
    return net.overload_by_contingency(threats(t), rating(t)).withColumn("overload", r6("overload"))


@query(
    "n6_ac_losses",
    """
    SELECT region, version, point, round(sum(half), 9) AS losses FROM (SELECT unnest([b.region1, b.region2]) AS region, f.version, f.point, b.r *
    pow(f.flow / 400, 2) / 2 AS half FROM flows f JOIN branch b ON b.id = f.branch)
    GROUP BY 1, 2, 3""",
    "flows", "branch",
)
def n6(t):
    return net.ac_losses(t.flows, t.branch).withColumn("losses", F.round("losses", 9))


@query("n7_hvdc_losses", """
    SELECT id, round(p * a / 100 + r * i * i + (s - r * i * i) * b / 100, 6) AS losses
    FROM (SELECT *, (vdc - sqrt(greatest(vdc * vdc - 4 * r * s, 0))) / (2 * r) AS i
    FROM (SELECT *, p * (1 - a / 100) AS s
    FROM (SELECT id, r, vdc, abs(setpoint) AS p, CASE WHEN setpoint >= 0 THEN loss1 ELSE loss2 END AS a, CASE WHEN setpoint >= 0 THEN loss2 ELSE loss1 END AS b FROM hvdc WHERE r <> 0)))""", "hvdc")
def n7(t):
    return net.hvdc_losses(t.hvdc).withColumn("losses", r6("losses"))


@query(
    "n8_zone_balance",
    """
    SELECT zone, round(sum(p), 5) AS balance FROM (SELECT substation AS zone, CASE type WHEN 'LOAD' THEN -p0 ELSE target_p END AS p
    FROM equipment UNION ALL SELECT zone1, -setpoint FROM hvdc UNION ALL SELECT zone2, setpoint
    FROM hvdc) GROUP BY zone""",
    "equipment", "hvdc",
)
def n8(t):
    p = F.when(F.col("type") == "LOAD", F.col("p0")).otherwise(F.col("target_p"))
    return net.zone_balance(t.equipment.select(F.col("substation").alias("zone"), "type", p.alias("p")), t.hvdc).withColumn("balance", F.round("balance", 5))


_RD = "SELECT CASE WHEN num % 2 = 0 THEN 'HYDRO' ELSE 'NUCLEAR' END AS kind, version, point, value, num FROM redispatch"
_CUR = "SELECT r.kind, r.version, r.point, c.id AS contingency, r.value * (c.num - 2) AS value FROM rd r CROSS JOIN contingency c"


def _kinds(t):
    return t.redispatch.withColumn("kind", F.when(F.col("num") % 2 == 0, "HYDRO").otherwise("NUCLEAR"))


def _curative(t):
    c = t.contingency.select(F.col("id").alias("contingency"), F.col("num").alias("k"))
    return _kinds(t).crossJoin(c).withColumn("value", F.col("value") * (F.col("k") - 2))


@query("n9_redispatch_volumes", """
    SELECT * FROM (SELECT coalesce(a.kind, c.kind) AS kind, coalesce(a.version, c.version) AS version, coalesce(a.point, c.point) AS point,
    coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(cur_up, 0) AS cur_up, coalesce(cur_down, 0) AS cur_down
    FROM (SELECT kind, version, point, sum(greatest(value, 0)) AS up, sum(least(value, 0)) AS down FROM rd WHERE NOT isnan(value) GROUP BY 1, 2, 3) a
    FULL JOIN (SELECT kind, version, point, max(u) AS cur_up, min(d) AS cur_down
    FROM (SELECT kind, version, point, contingency, sum(greatest(value, 0)) AS u, sum(least(value, 0)) AS d
    FROM cur WHERE NOT isnan(value) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) c
    ON a.kind = c.kind AND a.version = c.version AND a.point = c.point) WHERE greatest(abs(up), abs(down), abs(cur_up), abs(cur_down)) >= 0.05""", "redispatch", "contingency", rd=_RD, cur=_CUR)
def n9(t):
    return net.redispatch_volumes(_kinds(t), _curative(t))


@query(
    "n10_cost_totals",
    """
    SELECT version, point, sum(CASE WHEN kind = 'HYDRO' THEN abs(value) * 2 ELSE 0 END) AS HYDRO, sum(CASE WHEN kind = 'NUCLEAR' THEN abs(value) * 2
    ELSE 0 END) AS NUCLEAR FROM rd WHERE NOT isnan(value) GROUP BY version, point""",
    "redispatch", rd=_RD,
)
def n10(t):
    rows = _kinds(t).filter("NOT isnan(value)").select(F.col("kind").alias("category"), "version", "point", (F.abs("value") * 2).alias("cost"))
    return net.cost_totals(rows, ["HYDRO", "NUCLEAR"])


_ZONES = """
    SELECT n.node, coalesce(min(least(r.b, n.node)), n.node) AS zone FROM (SELECT node1 AS node FROM branch UNION SELECT node2 FROM branch) n LEFT JOIN reach r ON r.a = n.node GROUP BY n.node"""


def _with_reach(sql: str, edges: str) -> str:
    """A recursive closure before the query: WITH RECURSIVE has to come first."""
    from ..sources.bindings import with_bindings

    body = with_bindings("", "branch", edges=edges)
    return body.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f", reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)\n{sql}"


def n11(t):
    return net.zones(t.branch)


def _power(t):
    return t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("generation"), (F.col("n_nationkey") * 2).cast("double").alias("load"))


def n12(t):
    cut = t.contingency.select(F.col("id").alias("contingency"), F.col("element").alias("branch"))
    return net.lost_pockets(t.branch, cut, _power(t))


def n12_pairs(t):
    """Every pair of nations' branches is an outage."""
    one = t.contingency.select("num", F.col("element").alias("branch"))
    other = one.select(F.col("num").alias("num2"), F.col("branch").alias("branch2"))
    name = F.concat(F.lit("cty_"), F.col("num").cast("string"), F.lit("_"), F.col("num2").cast("string"))
    cut = one.join(other, F.col("num") < F.col("num2")).select(name.alias("contingency"), F.explode(F.array("branch", "branch2")).alias("branch"))
    return net.lost_pockets(t.branch, cut, _power(t))


query("n11_zones")(n11)
query("n12_lost_pockets")(n12)
query("n12_lost_pockets_of_pairs")(n12_pairs)
ORACLE_SQL["n11_zones"] = _with_reach(
    f"SELECT node, zone, zone = (SELECT zone FROM ({_ZONES}) GROUP BY zone ORDER BY count(*) DESC, zone LIMIT 1) AS connected FROM ({_ZONES})",
    "SELECT node1 AS a, node2 AS b FROM branch WHERE closed UNION SELECT node2, node1 FROM branch WHERE closed",
)


def _pockets_sql(outages: str) -> str:
    """Pockets by reachability, for outages (contingency, x, y) of nations' branches; y may be null."""
    pockets = """
        SELECT n.contingency, n.node, coalesce(min(least(r.b, n.node)), n.node) AS zone
        FROM (SELECT c.contingency, x.node FROM outages c CROSS JOIN (SELECT node1 AS node FROM branch UNION SELECT node2 FROM branch) x) n
        LEFT JOIN reach r ON r.k = n.contingency AND r.a = n.node GROUP BY n.contingency, n.node"""
    sql = f"""SELECT z.contingency, count(*) AS n_nodes, sum(CAST(z.node AS DOUBLE)) AS lost_generation, sum(CAST(z.node * 2 AS DOUBLE)) AS lost_load
        FROM ({pockets}) z JOIN (SELECT contingency, zone FROM (SELECT contingency, zone, row_number() OVER (PARTITION BY contingency
        ORDER BY count(*) DESC, zone) AS n FROM ({pockets}) GROUP BY contingency, zone)
        WHERE n = 1) g ON g.contingency = z.contingency
        WHERE z.zone <> g.zone GROUP BY z.contingency"""
    edges = f"""SELECT c.contingency AS k, x.a, x.b FROM ({outages}) c
        CROSS JOIN (SELECT id, node1 AS a, node2 AS b FROM branch WHERE closed UNION SELECT id, node2, node1 FROM branch WHERE closed) x
        WHERE x.id <> c.x AND x.id <> coalesce(c.y, '')"""
    body = _with_reach(sql, edges)
    step = "SELECT k, a, b FROM edges UNION SELECT r.k, r.a, e.b FROM reach r JOIN edges e ON e.k = r.k AND e.a = r.b"
    body = body.replace("reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)", f"outages AS ({outages}), reach(k, a, b) AS ({step})")
    return body


_BRANCH_OF = "concat('br_', CAST({0} AS STRING))"
ORACLE_SQL["n12_lost_pockets"] = _pockets_sql(
    f"SELECT concat('cty_', CAST(n_nationkey AS STRING)) AS contingency, {_BRANCH_OF.format('n_nationkey')} AS x, CAST(NULL AS STRING) AS y FROM nation"
)
ORACLE_SQL["n12_lost_pockets_of_pairs"] = _pockets_sql(
    f"""SELECT concat('cty_', CAST(a.n_nationkey AS STRING), '_', CAST(b.n_nationkey AS STRING)) AS contingency, {_BRANCH_OF.format('a.n_nationkey')} AS x, {_BRANCH_OF.format('b.n_nationkey')} AS y
        FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"""
)


@query("n13_section_flow", """
    SELECT section, version, point, flow, max_flow_n - abs(flow) AS margin, greatest(abs(flow) - max_flow_n, 0) AS overload FROM (
        SELECT concat('sec_', CAST(n_regionkey AS STRING)) AS section, 30.0::DOUBLE AS max_flow_n, f.version, f.point, sum((n_nationkey % 3 - 1) * f.flow) AS flow FROM nation JOIN flows f ON f.branch = concat('br_', CAST(n_nationkey AS STRING)) WHERE n_regionkey < 4 GROUP BY 1, 2, 3, 4)""", "flows")
def n13(t):
    weights = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("br_"), F.col("n_nationkey").cast("string")), (F.col("n_nationkey") % 3 - 1).cast("double"))))
    sections = t.nation.groupBy("n_regionkey").agg(weights.alias("weights"))
    return net.section_flows(sections.select(F.concat(F.lit("sec_"), F.col("n_regionkey").cast("string")).alias("id"), F.when(F.col("n_regionkey") < 4, F.lit(30.0)).alias("max_flow_n"), "weights"), t.flows)


@query("n14_proportional_group", """
    SELECT substation AS "group", id, round(CASE WHEN s = 0 THEN 1.0 / n ELSE max_p / s END, 9) AS share, round(CASE WHEN s = 0 THEN 1.0 / n ELSE max_p / s END * 1000, 6) AS value
    FROM (SELECT *, sum(max_p) OVER (PARTITION BY substation) AS s, count(*) OVER (PARTITION BY substation) AS n FROM equipment WHERE type = 'GENERATOR')""", "equipment")
def n14(t):
    members = t.equipment.filter("type = 'GENERATOR'").select(F.col("substation").alias("group"), "id", F.col("max_p").alias("reference"))
    totals = members.select("group").distinct().withColumn("total", F.lit(1000.0))
    return net.proportional_share(members, totals).select("group", "id", F.round("share", 9).alias("share"), r6("value").alias("value"))


@query("n15_reserve_share", """
    SELECT id, CASE WHEN num % 2 = 0 THEN least(max_p, round((SELECT max(l) FROM (SELECT sum(max_p) AS l FROM equipment WHERE type = 'GENERATOR' GROUP BY num % 97)) / (SELECT sum(max_p) FROM equipment WHERE type = 'GENERATOR' AND num % 2 = 0) * max_p, 1)) ELSE 0 END AS share FROM equipment WHERE type = 'GENERATOR'""", "equipment")
def n15(t):
    g = t.equipment.filter("type = 'GENERATOR'")
    lost = g.select((F.col("num") % 97).alias("contingency"), F.col("max_p").alias("lost"))
    return net.reserve_share(g.select("id", "max_p", (F.col("num") % 2 == 0).alias("adjustable")), lost)


# ---- H ---------------------------------------------------------------------------------------------------------


def _contingencies(t):
    """One per nation: two suppliers' equipment, said to be generators; every fourth names something unknown."""
    e = t.equipment.select(F.regexp_replace("voltage_level", "vl_", "cty_").alias("id"), F.col("id").alias("element"), "num")
    element = F.struct(F.lit("GENERATOR").alias("type"), F.when(F.col("num") % 20 == 0, F.lit("unknown")).otherwise(F.col("element")).alias("id"))
    return e.groupBy("id").agg(F.collect_list(element).alias("elements"))


@query(
    "h1_valid_contingencies",
    """
    SELECT replace(voltage_level, 'vl_', 'cty_') AS id, bool_and(num % 20 <> 0 AND type = 'GENERATOR') AS valid, CASE WHEN bool_or(num % 20 = 0) THEN
    'not found' WHEN bool_or(type <> 'GENERATOR') THEN 'type differs' END AS reason
    FROM equipment GROUP BY 1""",
    "equipment",
)
def h1(t):
    return checks.check_contingencies(_contingencies(t), t.equipment)


@query(
    "h2_unknown_contingency_refs",
    """
    SELECT type AS kind, id, concat('cty_', CAST(num % 9 * 6 AS STRING)) AS contingency
    FROM equipment WHERE num % 9 > 4""",
    "equipment", "contingency",
)
def h2(t):
    refs = t.equipment.select(F.col("type").alias("kind"), "id", F.array(F.lit("cty_1"), F.concat(F.lit("cty_"), (F.col("num") % 9 * 6).cast("string"))).alias("contingencies"))
    return checks.check_contingency_refs(refs, t.contingency)


def remedial_lines(t):
    """A file's lines, one for each nation, some of them faulty."""
    k = F.col("n_nationkey")
    line = F.concat(F.lit("cty_"), (k % 7 * 6).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("|br_"), k.cast("string"))).otherwise(F.lit("")), F.lit(";"), F.when(k % 11 == 5, "x").otherwise("1"), F.lit(";"), F.when(k % 2 == 0, "+").otherwise(""), F.lit("br_"), k.cast("string"), F.when(k % 8 == 3, "").otherwise(";"))
    rows = t.nation.select((k + 2).alias("line_no"), line.alias("value"))
    return rows.union(t.nation.filter("n_nationkey = 0").select(F.lit(1).alias("line_no"), F.lit("NB;30;").alias("value")))


@query(
    "h3_remedial_lines",
    """
    SELECT n_nationkey + 2 AS line_no, concat('cty_', CAST(n_nationkey % 7 * 6 AS STRING)) AS contingency, CASE WHEN n_nationkey % 3 = 0 THEN
    concat('br_', CAST(n_nationkey AS STRING)) ELSE '' END AS constraints, CASE WHEN n_nationkey % 2 = 1 THEN concat('br_', CAST(n_nationkey AS
    STRING)) ELSE '' END AS opened, CASE WHEN n_nationkey % 2 = 0 THEN concat('br_', CAST(n_nationkey AS STRING)) ELSE '' END AS closed
    FROM nation""",
)
def h3(t):
    r = checks.read_remedials(remedial_lines(t))
    return r.select("line_no", "contingency", F.array_join("constraints", "|").alias("constraints"), F.array_join("open", ";").alias("opened"), F.array_join("close", ";").alias("closed"))


@query(
    "h4_remedial_file_checks",
    """
    SELECT 1 AS line_no, 'count differs' AS problem UNION ALL SELECT n_nationkey + 2, CASE WHEN n_nationkey % 8 = 3 THEN 'no ; at the end' ELSE
    'count is no number' END FROM nation WHERE n_nationkey % 8 = 3 OR n_nationkey % 11 = 5""",
)
def h4(t):
    return checks.check_remedial_file(remedial_lines(t))


@query("h5_remedial_refs", """
    SELECT n_nationkey + 2 AS line_no, concat('br_', CAST(n_nationkey AS STRING)) AS element, 'action is no branch or switch' AS problem
    FROM nation WHERE n_nationkey >= 20
    UNION ALL SELECT n_nationkey + 2, concat('br_', CAST(n_nationkey AS STRING)), 'constraint is not monitored'
    FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 4 IN (0, 1)
    UNION ALL SELECT n_nationkey + 2, concat('cty_', CAST(n_nationkey % 7 * 6 AS STRING)), 'unknown contingency' FROM nation WHERE n_nationkey % 7 > 4""")
def h5(t):
    known = t.branch.filter("node1 < 20").select("id", F.lit("LINE").alias("type"))
    return checks.check_remedial_refs(checks.read_remedials(remedial_lines(t)), known, t.monitoring, t.contingency)


@query(
    "h6_orphan_end_ratings",
    """
    SELECT branch, variable FROM ratings r WHERE variable LIKE '%EndOr' AND NOT EXISTS (SELECT 1
    FROM ratings f WHERE f.branch = r.branch AND concat(f.variable, 'EndOr') = r.variable)""",
    "ratings",
)
def h6(t):
    return checks.drop_orphan_ratings(t.ratings)[1]


@query("h7_cost_pairs", "SELECT equipment AS id, 'redispatching' AS kind, cost_down IS NOT NULL AS eligible FROM costs", "costs")
def h7(t):
    up = t.costs.filter("cost_up IS NOT NULL").select(F.col("equipment").alias("id"), F.lit("redispatching").alias("kind"), F.lit("up").alias("direction"))
    down = t.costs.filter("cost_down IS NOT NULL").select(F.col("equipment").alias("id"), F.lit("redispatching").alias("kind"), F.lit("down").alias("direction"))
    return checks.check_cost_pairs(up.union(down))
