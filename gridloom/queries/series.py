"""Series, calculations, statistics, data tables (A, B, S, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import calculate, const, series
from ..operators import stats, tables
from ..sources import series as src
from .registry import query

r6 = lambda c: F.round(c, 6)
FIVE = ["ts_0", "ts_1", "ts_2", "ts_3", "ts_4"]

# ---- A ---------------------------------------------------------------------------------------------------------


@query("a3_rle", "SELECT name, version, min(point) AS \"offset\", CAST(count(*) AS INT) AS length, any_value(value) AS value FROM (SELECT *, point - row_number() OVER (PARTITION BY name, version, value ORDER BY point) AS g FROM t) GROUP BY name, version, value, g", "ts", t="SELECT name, version, point, floor(value / 500) AS value FROM ts")
def a3(t):
    return src.compress_rle(t.ts.withColumn("value", F.floor(F.col("value") / 500).cast("double")))


@query("a3_expand_rle", "SELECT name, version, point, floor(value / 500) AS value FROM ts", "ts")
def a3_expand(t):
    runs = a3(t).groupBy("name", "version").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "value"))).alias("r"))
    values = src.expand_rle(F.transform("r", lambda x: x["value"]), F.transform("r", lambda x: x["length"]))
    return runs.select("name", "version", F.posexplode(values).alias("point", "value"))


@query("a4_resolve_version", """
    SELECT name, version, instant, value FROM ev WHERE version IN (0, 1) UNION ALL
    SELECT name, v.version, instant, value FROM ev CROSS JOIN (SELECT CAST(0 AS INT) AS version UNION ALL SELECT 1) v WHERE name IN (SELECT name FROM ev GROUP BY name HAVING max(ev.version) = -1)""", "ev")
def a4(t):
    return src.resolve_version(t.ev, [0, 1]).select("name", "version", "instant", "value")


_HALVES = "SELECT name, version, instant, value, CAST(row_number() OVER (PARTITION BY name, version ORDER BY instant) - 1 AS INT) AS point FROM ts"


@query("a5_append", _HALVES, "ts")
def a5(t):
    new = t.ts.filter("point >= 40").withColumn("point", (F.col("point") - 40).cast("int"))
    return src.append_ts(t.ts.filter("point < 40"), new, src.APPEND).select("name", "version", "instant", "value", "point")


@query("a5_append_overlap", "SELECT DISTINCT name, version FROM ts WHERE point BETWEEN 30 AND 40", "ts")
def a5_overlap(t):
    return src.overlapping(t.ts.filter("point <= 40"), t.ts.filter("point >= 30"))


@query("a6_merge_index", """
    SELECT name, version, count(DISTINCT step) <= 1 AS regular, CASE WHEN count(DISTINCT step) <= 1 THEN max(step) END AS spacing_seconds
    FROM (SELECT name, version, epoch(lead(instant) OVER (PARTITION BY name, version ORDER BY instant)) - epoch(instant) AS step FROM ev) GROUP BY name, version""", "ev")
def a6(t):
    return src.merge_index(t.ev)


@query("a7_export_wide", "SELECT instant AS Time, version AS Version, " + ", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in FIVE) + " FROM cells GROUP BY instant, version HAVING " + " OR ".join(f"count(*) FILTER (name = '{n}') > 0" for n in FIVE), "cells")
def a7(t):
    return src.export_wide(t.cells, FIVE, check=False)


@query(
    "a9_catalog",
    """
    SELECT name, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, count(*) AS n_points, min(instant) AS first_instant,
    max(instant) AS last_instant FROM ev GROUP BY name""",
    "ev",
)
def a9(t):
    return src.catalog(t.ev).withColumn("versions", F.array_join("versions", ","))


@query(
    "a9_exists",
    """
    SELECT DISTINCT concat('ts_', CAST(n_nationkey AS STRING)) AS name
    FROM nation WHERE concat('ts_', CAST(n_nationkey AS STRING)) IN (SELECT name
    FROM cells)""",
    "cells",
)
def a9_exists(t):
    return src.exists(t.cells, t.nation.select(F.concat(F.lit("ts_"), F.col("n_nationkey").cast("string")).alias("name")))


@query("a10_index_unicity", "SELECT count(DISTINCT k) AS n_indexes, count(DISTINCT k) <= 1 AS \"unique\" FROM (SELECT string_agg(CAST(epoch(instant) AS STRING), ',' ORDER BY instant) AS k FROM cells GROUP BY name, version)", "cells")
def a10(t):
    return src.check_index_unicity(t.cells)


@query(
    "a11_undefined_versions",
    """
    SELECT n.name, CAST(v.version AS INT) AS version FROM (SELECT name
    FROM ev GROUP BY name HAVING max(version) >= 0) n CROSS JOIN (SELECT 0 AS version
    UNION ALL SELECT 1 UNION ALL SELECT 7) v WHERE NOT EXISTS (SELECT 1
    FROM ev e WHERE e.name = n.name AND e.version = v.version)""",
    "ev",
)
def a11(t):
    return src.undefined_versions(t.ev, [0, 1, 7])


@query(
    "a12_computation_range",
    """
    SELECT name, version, point, value FROM ts WHERE version IN (0, 2) AND (point BETWEEN 3 AND 9 OR point BETWEEN 20 AND 22)""",
    "ts",
)
def a12(t):
    return src.computation_range(t.ts, [0, 2], [(20, 22), (3, 9)]).select("name", "version", "point", "value")


@query("a13_filter_by_ranges", "SELECT name, version, point, value FROM ts WHERE point BETWEEN 1 AND 5", "ts")
def a13(t):
    return src.filter_by_ranges(t.ts, [(1, 3), (2, 5), (-9, -2)]).select("name", "version", "point", "value")


@query("a13_ranges_of_series", """
    SELECT name, version, point, value FROM ts WHERE EXISTS (
        SELECT 1 FROM nation n WHERE ts.name = concat('ts_', CAST(n.n_nationkey AS STRING))
        AND (ts.version = 1 AND ts.point BETWEEN n.n_nationkey AND n.n_nationkey + 5 OR ts.version <> 1 AND ts.point BETWEEN 2 * n.n_nationkey + 20 AND 3 * n.n_nationkey + 22))""", "ts")
def a13_table(t):
    """Ranges of their own for every series and version, as a table."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("ts_"), k.cast("string")).alias("name")
    rows = t.nation.select(name, F.lit(1).alias("version"), k.alias("low"), (k + 5).alias("high"))
    rows = rows.unionByName(t.nation.select(name, F.explode(F.array(F.lit(0), F.lit(2))).alias("version"), (2 * k + 20).alias("low"), (3 * k + 22).alias("high")))
    return src.filter_by_range_table(t.ts, rows).select("name", "version", "point", "value")


@query("a14_slice_points", "SELECT name, version, point, value FROM ts WHERE point BETWEEN 10 AND 19", "ts")
def a14(t):
    return src.slice_points(t.ts, 10, 19).select("name", "version", "point", "value")


# ---- B ---------------------------------------------------------------------------------------------------------


@query("b1_constants", "SELECT DISTINCT 'seven' AS name, version, point, CAST(7.5 AS DOUBLE) AS value FROM ts", "ts")
def b1(t):
    return calculate(t.ts, {"seven": const(7.5)}, index=t.ts).drop("instant")


_PAIR = """
    SELECT a.version, a.point, a.instant, a.value AS a, b.value AS b
    FROM ts a JOIN ts b ON a.version = b.version AND a.point = b.point
    WHERE a.name = 'ts_0' AND b.name = 'ts_1'"""


@query("b2_reference", "SELECT 'copy' AS name, version, point, value FROM ts WHERE name = 'ts_3'", "ts")
def b2(t):
    """A series by its name; the name of none is an error, whose text names it."""
    try:
        calculate(t.kept_ts, {"copy": series("ts_none")})
    except ValueError:
        return calculate(t.kept_ts, {"copy": series("ts_3")}).drop("instant")
    raise AssertionError("a missing series was taken")


_OPERATORS = """SELECT x.name, version, point, round(x.value, 6) AS value FROM p CROSS JOIN LATERAL (VALUES ('reversed', 1000 - a), ('times', 3 * a + b), ('over', CASE WHEN a = 0 THEN NULL ELSE 1000 / a END),
    ('atleast', CASE WHEN a >= b THEN 1 ELSE 0 END), ('clamped', greatest(least(a - b, 100), -100)), ('minus', -(a * 0.5) + abs(b - 700))) x(name, value) WHERE x.value IS NOT NULL"""


@query("u3_operators", _OPERATORS, "ts", p=_PAIR)
def u3(t):
    a, b = series("ts_0"), series("ts_1")
    found = {"reversed": 1000 - a, "times": 3 * a + b, "over": 1000 / a, "atleast": a >= b, "clamped": (a - b).min(100).max(-100), "minus": -(a * 0.5) + (b - 700).abs()}
    return calculate(t.ts, found).filter("abs(value) < double('infinity')").select("name", "version", "point", r6("value").alias("value"))


@query("b3_arithmetic", """SELECT x.name, version, point, round(x.value, 6) AS value FROM p CROSS JOIN LATERAL (VALUES ('sum', a + b), ('difference', a - b * 2), ('product', a * b), ('ratio', CASE WHEN b - 600 = 0 THEN NULL ELSE a / (b - 600) END)) x(name, value) WHERE x.value IS NOT NULL""", "ts", p=_PAIR)
def b3(t):
    a, b = series("ts_0"), series("ts_1")
    return calculate(t.ts, {"sum": a + b, "difference": a - b * 2, "product": a * b, "ratio": a / (b - 600)}).filter("value < double('infinity') AND value > double('-infinity')").select("name", "version", "point", r6("value").alias("value"))


@query(
    "b4_comparisons",
    """
    SELECT x.name, version, point, x.value FROM p CROSS JOIN LATERAL (VALUES ('greater', CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END), ('less', CASE
    WHEN a < 500 THEN 1.0::DOUBLE ELSE 0 END)) x(name, value)""",
    "ts", p=_PAIR,
)
def b4(t):
    a, b = series("ts_0"), series("ts_1")
    return calculate(t.ts, {"greater": a > b, "less": a < 500}).drop("instant")


@query("b5_unary", "SELECT x.name, version, point, x.value FROM p CROSS JOIN LATERAL (VALUES ('minus', -a), ('abs', abs(a - b))) x(name, value)", "ts", p=_PAIR)
def b5(t):
    a, b = series("ts_0"), series("ts_1")
    return calculate(t.ts, {"minus": -a, "abs": (a - b).abs()}).drop("instant")


@query(
    "b6_clamp",
    """
    SELECT x.name, version, point, x.value FROM p CROSS JOIN LATERAL (VALUES ('capped', least(a, 400.0::DOUBLE)), ('floored', greatest(a,
    400.0::DOUBLE))) x(name, value)""",
    "ts", p=_PAIR,
)
def b6(t):
    return calculate(t.ts.filter("name <> 'ts_2'"), {"capped": series("ts_0").min(400), "floored": series("ts_0").max(400)}).drop("instant")


@query("b7_time", "SELECT 'time' AS name, version, point, CAST(epoch(instant) AS DOUBLE) AS value FROM p", "ts", p=_PAIR)
def b7(t):
    return calculate(t.ts, {"time": series("ts_0").time()}).drop("instant")


@query(
    "b8_nested",
    """
    SELECT 'nested' AS name, version, point, round((a + b) * CASE WHEN a > b THEN 1.0 ELSE 0 END - abs(-a) / 4, 6) AS value
    FROM p""",
    "ts", p=_PAIR,
)
def b8(t):
    a, b = series("ts_0"), series("ts_1")
    total = a + b
    return calculate(t.ts, {"nested": total * (a > b) - (-a).abs() / 4}).select("name", "version", "point", r6("value").alias("value"))


@query(
    "b9_calculated_store",
    """
    SELECT name, version, point, value FROM ts WHERE name IN ('ts_0', 'ts_1') AND version = 1
    UNION ALL SELECT 'sum', version, point, a + b FROM p WHERE version = 1""",
    "ts", p=_PAIR,
)
def b9(t):
    a, b = series("ts_0"), series("ts_1")
    return calculate(t.ts, {"ts_0": a, "ts_1": b, "sum": a + b}, versions=[1]).drop("instant")


# ---- S ---------------------------------------------------------------------------------------------------------

_STATS = """
    SELECT p.name, round(sum(s), 6) AS sum, min(lo) AS min, max(hi) AS max, round(avg(m), 6) AS avg, any_value(q.median) AS median
    FROM (SELECT name, version, sum(value) AS s, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM part GROUP BY name, version) p
    JOIN (SELECT name, list_sort(list(value))[count(*) // 2 + 1] AS median FROM part GROUP BY name) q ON p.name = q.name GROUP BY p.name"""


def _stats(df):
    return df.select("name", r6("sum").alias("sum"), "min", "max", r6("avg").alias("avg"), "median")


@query("s1_s5_statistics", _STATS, "ts", part="SELECT * FROM ts")
def s1(t):
    return _stats(stats.series_stats(t.ts))


@query("s6_statistics_in_range", _STATS, "ts", part="SELECT * FROM ts WHERE version IN (0, 1) AND (point BETWEEN 5 AND 20 OR point BETWEEN 30 AND 31)")
def s6(t):
    return _stats(stats.series_stats(t.ts, ranges=[(5, 20), (30, 31)], versions=[0, 1]))


@query("s1_sum_of_nothing", "SELECT DISTINCT name, CAST(0 AS DOUBLE) AS sum FROM ts", "ts")
def s1_empty(t):
    return stats.sum_or_zero(t.ts, t.ts, ranges=[(5000, 6000)])


@query(
    "s8_result_estimate",
    """
    SELECT CAST(count(*) FILTER (mode_n <> 'NO') + 2 * 5 * count(*) FILTER (mode_nk <> 'NO') + 2 * count(*) FILTER (mode_nk <> 'NO') AS BIGINT) AS
    n_results FROM monitoring""",
    "monitoring",
)
def s8(t):
    return stats.estimate_results(t.monitoring, 5, True, False)


# ---- D ---------------------------------------------------------------------------------------------------------


@query("d1_create", "SELECT p_partkey AS row_id, p_brand AS brand, p_type AS kind FROM part")
def d1(t):
    return tables.create_from(t.part.select(F.col("p_partkey").alias("row_id"), F.array("p_brand", "p_type").alias("cells")), ["brand", "kind"])


@query("d3_get", "SELECT 'brand:' || brand AS brand, 'kind:' || kind AS kind, 'size:' || size AS size FROM datatable", "datatable")
def d3(t):
    return tables.get(t.datatable)


@query("d4_column", "SELECT kind FROM datatable", "datatable")
def d4(t):
    return tables.data(t.datatable, "kind")


@query("d5_lines", "SELECT row_id, 'brand=' || brand || ',kind=' || kind || ',size=' || size AS line FROM datatable", "datatable")
def d5(t):
    return tables.lines(t.datatable).select("row_id", F.array_join(F.transform(F.map_entries("line"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("line"))


_WHERE = {"brand": ["BRAND#1", "brand#2"], "kind": ["economy"]}
_SQL_WHERE = "lower(brand) IN ('brand#1', 'brand#2') AND lower(kind) = 'economy'"


@query("d6_filter", f"SELECT size, brand FROM datatable WHERE {_SQL_WHERE}", "datatable")
def d6(t):
    return tables.filter_rows(t.datatable, ["size", "brand"], _WHERE)


@query("d7_search_first", f"SELECT size FROM datatable WHERE {_SQL_WHERE} ORDER BY row_id LIMIT 1", "datatable")
def d7(t):
    return tables.search_first_value(t.datatable, "size", _WHERE)


@query("d8_search_list", f"SELECT size FROM datatable WHERE {_SQL_WHERE}", "datatable")
def d8(t):
    return tables.search_value_list(t.datatable, "size", _WHERE)


@query("d9_remove_lines", f"SELECT * FROM datatable WHERE NOT ({_SQL_WHERE})", "datatable")
def d9(t):
    return tables.remove_lines(t.datatable, _WHERE)


@query(
    "d10_add_lines",
    """
    SELECT * FROM datatable UNION ALL SELECT row_id + (SELECT max(row_id)
    FROM datatable) + 1, brand, kind, size FROM datatable WHERE size = '7'""",
    "datatable",
)
def d10(t):
    return tables.add_lines(t.datatable, t.datatable.filter("size = '7'").select("row_id", "size", "kind", "brand"))


@query(
    "d11_replace_values",
    f"""
    SELECT row_id, brand, CASE WHEN {_SQL_WHERE} THEN 'X' ELSE kind END AS kind, CASE WHEN {_SQL_WHERE} THEN '0' ELSE size END AS size
    FROM datatable""",
    "datatable",
)
def d11(t):
    return tables.replace_values(t.datatable, ["kind", "size"], _WHERE, ["X", "0"])
