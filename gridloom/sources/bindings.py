"""Grid tables derived from the star-schema tables of a data folder.

Each binding is one statement in the common subset of Spark SQL and ANSI SQL; names in braces are base tables or other
bindings. ``bind`` gives the DataFrame; ``with_bindings`` puts the same statements before a query as text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

BINDINGS = {
    # series: one per nation, versions by return flag, monthly index without gaps
    "idx": """
        SELECT instant, CAST(row_number() OVER (ORDER BY instant) - 1 AS INT) AS point
        FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS instant FROM {lineitem}) i""",
    "cells": """
        SELECT concat('ts_', CAST(s_nationkey AS STRING)) AS name, CAST(ascii(l_returnflag) % 3 AS INT) AS version,
               CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS instant, sum(l_quantity) AS value
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
        GROUP BY s_nationkey, ascii(l_returnflag) % 3, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP)""",
    "ts": """
        SELECT n.name, v.version, i.point, i.instant, coalesce(c.value, 0.0) AS value
        FROM (SELECT concat('ts_', CAST(n_nationkey AS STRING)) AS name FROM {nation}) n CROSS JOIN (SELECT DISTINCT version FROM {cells}) v CROSS JOIN {idx} i
        LEFT JOIN {cells} c ON c.name = n.name AND c.version = v.version AND c.instant = i.instant""",
    # an hourly store: some series have version -1 only
    "ev": """
        SELECT event_type AS name, CAST(CASE WHEN event_type IN ('click', 'view') THEN -1 ELSE user_id % 3 END AS INT) AS version,
               CAST(date_trunc('hour', ts) AS TIMESTAMP) AS instant, CAST(count(*) AS DOUBLE) AS value
        FROM {events} GROUP BY event_type, CASE WHEN event_type IN ('click', 'view') THEN -1 ELSE user_id % 3 END, CAST(date_trunc('hour', ts) AS TIMESTAMP)""",
    "equipment": """
        SELECT concat('eq_', CAST(s_suppkey AS STRING)) AS id, s_suppkey AS num,
               CASE WHEN s_suppkey % 3 = 0 THEN 'GENERATOR' WHEN s_suppkey % 3 = 1 THEN 'LOAD' ELSE 'BATTERY' END AS type,
               concat('vl_', CAST(s_nationkey AS STRING)) AS voltage_level, concat('sub_', CAST(n_regionkey AS STRING)) AS substation,
               s_suppkey % 11 <> 7 AS connected, s_suppkey % 11 <> 5 AS in_main_cc,
               s_acctbal AS target_p, CASE WHEN s_suppkey % 2 = 0 THEN -abs(s_acctbal) / 2 ELSE 10.0 END AS min_p,
               CASE WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal) / 4 ELSE abs(s_acctbal) / 4 + 10.0 END AS max_p,
               abs(s_acctbal) / 2 AS p0, abs(s_acctbal) / 8 AS fixed_p, abs(s_acctbal) * 3 / 8 AS variable_p
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "hvdc": """
        SELECT concat('hvdc_', CAST(s_suppkey AS STRING)) AS id, s_suppkey AS num, abs(s_acctbal) / 8 AS max_p, s_acctbal / 4 AS setpoint,
               CASE WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal) / 16 END AS range_cs12, CASE WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal) / 4 END AS range_cs21,
               CAST(0.5 AS DOUBLE) AS loss1, CAST(0.25 AS DOUBLE) AS loss2, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1.5 END AS DOUBLE) AS r, CAST(400 AS DOUBLE) AS vdc,
               concat('sub_', CAST(s_nationkey % 5 AS STRING)) AS zone1, concat('sub_', CAST((s_nationkey + 2) % 5 AS STRING)) AS zone2
        FROM {supplier}""",
    "pst": """
        SELECT concat('pst_', CAST(n_nationkey AS STRING)) AS id, n_nationkey AS num, -3 AS low_tap, n_nationkey % 4 + 1 AS high_tap, n_nationkey % 3 AS tap FROM {nation}""",
    "branch": """
        SELECT concat('br_', CAST(n_nationkey AS STRING)) AS id, n_nationkey AS node1, (n_nationkey * 7 + 3) % 25 AS node2,
               concat('sub_', CAST(n_regionkey AS STRING)) AS region1, concat('sub_', CAST((n_regionkey + n_nationkey % 2) % 5 AS STRING)) AS region2,
               CAST(n_nationkey + 1 AS DOUBLE) / 128 AS r, n_nationkey % 6 <> 1 AS closed FROM {nation}""",
    # flows: integers, so that sums don't depend on their order
    "flows": """
        SELECT concat('br_', CAST(user_id % 25 AS STRING)) AS branch, CAST(0 AS INT) AS version, CAST(dayofyear(ts) - 1 AS INT) AS point,
               CAST(sum(CAST(floor(value) AS BIGINT) - 20) AS DOUBLE) AS flow
        FROM {events} GROUP BY user_id % 25, CAST(dayofyear(ts) - 1 AS INT)""",
    "contingency": """
        SELECT concat('cty_', CAST(n_nationkey AS STRING)) AS id, concat('br_', CAST(n_nationkey AS STRING)) AS element, n_nationkey AS num,
               CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 1 AS DOUBLE) / 128 END AS prob_base, CASE WHEN n_nationkey = 3 THEN 'ts_3' END AS prob_series
        FROM {nation}""",
    "ratings": """
        SELECT concat('br_', CAST(n_nationkey AS STRING)) AS branch, v.variable, CAST(10 + 2 * n_nationkey + v.extra AS DOUBLE) AS value
        FROM {nation} CROSS JOIN (SELECT 'thresholdN' AS variable, 0 AS extra UNION ALL SELECT 'thresholdNEndOr', 5 UNION ALL SELECT 'analysisThresholdN', 8
                                  UNION ALL SELECT 'thresholdN1', 10 UNION ALL SELECT 'thresholdITAM', 20 UNION ALL SELECT 'thresholdITAMEndOr', 24) v
        WHERE (v.variable <> 'thresholdN' OR n_nationkey % 3 <> 0) AND (v.variable NOT LIKE '%EndOr' OR n_nationkey % 2 = 0) AND (v.variable <> 'thresholdITAM' OR n_nationkey % 5 <> 0)""",
    "monitoring": """
        SELECT concat('br_', CAST(n_nationkey AS STRING)) AS branch, CASE WHEN n_nationkey % 3 = 0 THEN 'RESULT' ELSE 'MONITORED' END AS mode_n,
               CASE WHEN n_nationkey % 4 = 0 THEN 'NO' WHEN n_nationkey % 4 = 1 THEN 'RESULT' ELSE 'MONITORED' END AS mode_nk FROM {nation}""",
    "threats": """
        SELECT f.branch, c.id AS contingency, f.version, f.point, f.flow + l.coefficient * o.flow AS flow
        FROM {flows} f CROSS JOIN {contingency} c JOIN {lodf} l ON l.branch = f.branch AND l.contingency = c.id
        JOIN {flows} o ON o.branch = c.element AND o.version = f.version AND o.point = f.point""",
    "lodf": """
        SELECT concat('br_', CAST(a.n_nationkey AS STRING)) AS branch, c.id AS contingency, c.element AS outaged, CAST((a.n_nationkey * 13 + c.num * 7) % 64 AS DOUBLE) / 64 - 0.5 AS coefficient
        FROM {nation} a CROSS JOIN {contingency} c""",
    "ptdf": """
        SELECT concat('br_', CAST(a.n_nationkey AS STRING)) AS branch, concat('ts_', CAST(b.n_nationkey AS STRING)) AS injection, CAST((a.n_nationkey * 13 + b.n_nationkey * 7) % 64 AS DOUBLE) / 64 - 0.5 AS coefficient
        FROM {nation} a CROSS JOIN {nation} b""",
    # redispatching and shedding results per generator or load: every tenth missing
    "redispatch": """
        SELECT e.id AS equipment, e.num, e.type, t.version, t.point,
               CASE WHEN (e.num + t.point) % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST((e.num * 7 + t.point * 3) % 64 - 32 AS DOUBLE) END AS value
        FROM {equipment} e CROSS JOIN (SELECT DISTINCT version, point FROM {ts}) t WHERE e.type = 'GENERATOR'""",
    "costs": """
        SELECT id AS equipment, CAST(num % 8 + 1 AS DOUBLE) AS cost_up, CASE WHEN num % 30 <> 0 THEN CAST(num % 4 + 1 AS DOUBLE) END AS cost_down, type FROM {equipment}""",
    "datatable": """
        SELECT p_partkey AS row_id, p_brand AS brand, p_type AS kind, CAST(p_size AS STRING) AS size FROM {part}""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or binding as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = BINDINGS[name]
    return spark.sql(sql, **{n: bind(spark, sf_dir, n) for n in _needs(sql)})


def _order(names, found: dict[str, str]) -> dict[str, str]:
    for n in names:
        if n not in BASE and n not in found:
            sql = BINDINGS[n]
            _order(_needs(sql), found)
            found[n] = re.sub(r"\{(\w+)\}", r"\1", sql)
    return found


def with_bindings(sql: str, *names: str, **extra: str) -> str:
    """``sql`` after WITH clauses of the bindings that it names, and of extra ones."""
    clauses = _order(names, {}) | {k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in extra.items()}
    return ("WITH " + ",\n".join(f"{n} AS ({q})" for n, q in clauses.items()) + "\n" if clauses else "") + sql
