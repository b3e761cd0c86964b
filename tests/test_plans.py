"""Rules by an index, limits and points in blocks of one series, variants as ordered text."""

import collections
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.operators import limits, mapping
from gridloom.operators.mapping import Rule
from gridloom.plans import scan, spread
from gridloom.plans.scratch import written
from gridloom.queries import QUERIES
from gridloom.queries import mapping as mapped
from gridloom.queries.registry import Tables
from gridloom.sources import results
from gridloom.sources import series as src

EQUIPMENT = "id string, type string, substation string, num int, connected boolean, in_main_cc boolean, max_p double"


def equipment(spark, n=400):
    rng = random.Random(2)
    rows = [(f"e{k}", rng.choice(["GENERATOR", "LOAD", "LINE"]), rng.choice([f"s{k % 50}", None]), k % 90, rng.random() < 0.9, rng.random() < 0.9, float(k)) for k in range(n)]
    return spark.createDataFrame(rows, EQUIPMENT)


def matches(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


def test_indexed_rules_match_as_evaluated_ones(spark):
    e, rules = equipment(spark), []
    for k in range(60):
        rules.append(Rule("GENERATOR", f"a{k}", ("targetP", "maxP"), where=f"substation = 's{k % 40}'", key="max_p" if k % 3 else 2.5, ignore_limits=k % 2 == 0))
        rules.append(Rule("LOAD", f"b{k}", where=f"num = {k} AND substation = 's{k % 50}'", key_series="keys" if k % 4 == 0 else None))
    rules += [Rule("LINE", "c", where="num = 3"), Rule("GENERATOR", "d", where="max_p > 100 AND substation = 's1'"), Rule("LINE", "f"), Rule("GENERATOR", "g", where="num = '7'")]
    got = mapping.rule_matches(rules, e)
    want = mapping._scanned(list(enumerate(rules)), e)
    assert got.columns == want.columns and matches(got) == matches(want) and got.count() > 100
    assert mapping.rule_matches([], e).count() == 0
    assert matches(mapping.build_mapping(rules, e)) == matches(mapping.last_rule_wins(want).filter("applied").drop("applied"))


def test_ten_thousand_rules_are_joined(spark):
    e = equipment(spark, 200)
    rules = [Rule("GENERATOR", f"a{k}", where=f"substation = 's{k}'") for k in range(9_990)] + [Rule("LINE", f"b{k}", where=f"num > {k}") for k in range(10)]
    got = mapping.rule_matches(rules, e)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "a7000" not in plan
    rows = e.collect()
    want = sum(r.type == "GENERATOR" and r.substation is not None and r.connected and r.in_main_cc for r in rows) + sum(r.type == "LINE" and r.num > k for r in rows for k in range(10))
    assert got.count() == want


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_limits_of_one_long_series_in_blocks(spark, monkeypatch, block):
    """The running extremes of one equipment, whether its points lie in one block or in many."""
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = random.Random(3)
    power = [round(rng.uniform(-50, 50) * (1 + k / 100), 2) for k in range(300)]
    rows = [(0, k, "g", True, p, None, None, -10.0, 10.0) for k, p in enumerate(power)]
    df = spark.createDataFrame(rows, "version int, point int, id string, ignore_limits boolean, p double, max_p_mapped double, min_p_mapped double, base_min double, base_max double")
    got = {r.point: (r.min_limit, r.max_limit) for r in limits.extend_limits(df)[0].collect()}
    low, high = -10.0, 10.0
    for k, p in enumerate(power):
        want = (float((p - 0.5) // 1) if p < low - 1e-4 else low, float((p + 1.0) // 1) if p > high + 1e-4 else high)
        assert got[k] == want, k
        low, high = min(low, p), max(high, p)


def test_points_of_one_long_series_are_numbered_in_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        ts = spark.range(5000).selectExpr("'a' AS name", "1 AS version", "CAST(0 AS INT) AS point", "timestamp_seconds((id * 7919) % 5000) AS instant", "CAST((id * 7919) % 5000 AS DOUBLE) AS value")
        ts = ts.unionByName(ts.filter("value < 10").withColumn("name", F.lit("b")))
        got = src.renumber(ts)
        assert got.columns == ts.columns and got.schema["point"].dataType.simpleString() == "int"
        rows = got.collect()
        assert len(rows) == 5010 and all(r.point == r.value for r in rows)
        assert src.renumber(ts.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_variants_as_ordered_text(spark, tmp_path):
    values = [(1, 0, "targetP", f"g{k:03d}", 100.0 + k, ) for k in range(300)] + [(1, 0, "p0", "l1", 5.004), (1, 2, "fixedActivePower", "l2", 3.0), (1, 2, "variableActivePower", "l2", 4.25),
              (1, 2, "disconnected", "x", 0.0), (1, 2, "disconnected", "y", 1.0), (1, 1, "targetP", "g001", 7.0004), (2, 0, "targetP", "g001", 9.0)]
    base = [("g001", "targetP", 7.0), ("l1", "p0", 1.0)]
    changes = results.variant_changes(spark.createDataFrame(values, "version int, point int, variable string, id string, value double"), spark.createDataFrame(base, "id string, variable string, base double"))
    points = spark.createDataFrame([(1, p) for p in range(3)] + [(2, 0)], "version int, point int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        results.write_variants(changes, points, 1, str(tmp_path / "variants"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted(Path(tmp_path / "variants").glob("part-*"))
    assert len(files) > 1
    lines = "".join(f.read_text() for f in files).splitlines()
    many = "".join(f"g{k:03d};{100 + k};" for k in range(300))
    assert lines == ["NT;3;", "0;p0;1;l1;5.004;", f"0;targetP;300;{many}", "1;", "2;OUTAGES;1;x;", "2;p0;1;l2;7.25;"]


def test_twenty_thousand_series_as_a_wide_file(spark, tmp_path):
    n = 20_000
    ts = spark.range(3 * n).selectExpr(f"concat('s', lpad(CAST(id % {n} AS STRING), 5, '0')) AS name", "1 AS version", "CAST(id DIV %d AS INT) AS point" % n, "timestamp_seconds(3600 * (id DIV %d)) AS instant" % n, "CASE WHEN id = 7 THEN NULL ELSE CAST(id AS DOUBLE) END AS value")
    src.write_wide_series(ts, str(tmp_path / "wide"))
    lines = [line for f in sorted((tmp_path / "wide").glob("part-*")) for line in f.read_text().splitlines()]
    header = "Time;Version;" + ";".join(f"s{k:05d}" for k in range(n))
    assert lines[0] == header
    body = [line.split(";") for line in lines if line != header]
    assert [b[0] for b in body] == [f"1970-01-01T0{p}:00:00Z" for p in range(3)] and all(len(b) == n + 2 for b in body)
    assert body[0][2 + 7] == "" and body[2][2:5] == ["40000.0", "40001.0", "40002.0"] and body[1][-1] == "39999.0"
    few = ts.filter("name < 's00003'")
    src.write_wide_series(few, str(tmp_path / "few"), gzip=True)
    src.write_wide(src.export_wide(few, ["s00000", "s00001", "s00002"]), str(tmp_path / "pivot"))
    rows = lambda p: sorted((r.name, r.instant, r.value) for r in src.read_ts_csv(spark, [str(tmp_path / p)])[0].collect())
    assert rows("few") == rows("pivot") and len(rows("few")) == 9
    with pytest.raises(ValueError):
        src.write_wide_series(few.filter("name <> 's00001' OR point > 0"), str(tmp_path / "no"))


def test_variant_deltas_list_every_change(spark):
    values = [(1, p, "targetP", f"g{k:04}", float(k)) for p in range(2) for k in range(900)] + [(1, 0, "disconnected", "l2", 0.0), (1, 0, "disconnected", "l1", 0.0)]
    base = [(f"g{k:04}", "targetP", float(k) if k == 5 else -1.0) for k in range(900)]
    points = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "version int, point int")
    deltas = results.variant_deltas(spark.createDataFrame(values, "version int, point int, variable string, id string, value double"), spark.createDataFrame(base, "id string, variable string, base double"), points)
    got = {(r.point, r.key): (r.n, r["items"]) for r in deltas.collect()}
    every = ";".join(f"g{k:04};{float(k)}" for k in range(900) if k != 5)
    assert got == {(0, "targetP"): (899, every), (1, "targetP"): (899, every), (0, "OUTAGES"): (2, "l1;l2"), (2, None): (None, None)}


def test_small_tables_are_dealt_before_they_make_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "MADE_ROWS", 2000)
    ids = [f"e{k:03}" for k in range(300)]
    rows = [(0, "LOAD", "p0", "a", x, None, ["b", "c"][k % 2], False) if k % 3 else (0, "LOAD", "p0", "a", x, float(k), None, True) for k, x in enumerate(ids)]
    rows += [(1, "LOAD", "q0", "b", x, 2.0, None, False) for x in ids]
    found = spark.createDataFrame(rows, "rule_id int, type string, variable string, series string, id string, key_number double, key_series string, ignore_limits boolean").coalesce(1)
    found = written(found, "found")
    series = {(n, p): float(k * 7 - p) for k, n in enumerate("abc") for p in range(40) if n != "c" or p % 2}
    ts = spark.createDataFrame([(n, 1, p, v) for (n, p), v in series.items()], "name string, version int, point int, value double")
    ts = written(ts, "ts")
    made = mapping.scale_down(found, ts).withColumn("task", F.spark_partition_id()).collect()
    assert max(collections.Counter(r.task for r in made).values()) < 4000 < len(made) == 24_000
    got = {(r.variable, r.id, r.point): r.value for r in made}
    for p in range(40):
        keys = [k if n is None else abs(series.get((n, p), 0.0)) for _, _, v, _, _, k, n, _ in rows if v == "p0"]
        for x, key in zip(ids, keys):
            assert got["p0", x, p] == pytest.approx(series["a", p] * key / sum(keys))
            assert got["q0", x, p] == pytest.approx(series["b", p] / 300)


@pytest.mark.parametrize("name", ["f11_curative_cost", "f12_load_shedding", "f19_fill_curative", "e18_hvdc_limits"])
def test_rows_of_points_are_made_by_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(spread, "MADE_ROWS", 20_000 if name[0] == "f" else 2000)
    counts = [r["count"] for r in QUERIES[name](spark, "/root/testdata/sf0.01").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert max(counts) < sum(counts) / 4


@pytest.fixture
def own_limits_shuffled(spark, monkeypatch):
    """Tasks of 500 rows, and equipment that is too large to be broadcast."""
    monkeypatch.setattr(spread, "MADE_ROWS", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Tables(spark, "/root/testdata/sf0.01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["e15_tolerance_snap", "e16_limit_correction", "e17_ignored_limits"])
def test_corrected_powers_are_made_by_many_tasks(spark, own_limits_shuffled, name):
    counts = [r["count"] for r in QUERIES[name](spark, own_limits_shuffled.sf_dir).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert len(counts) > 3 and max(counts) < sum(counts) / 2


@pytest.mark.parametrize("step", ["limited", "corrected"])
def test_powers_meet_their_limits_where_they_were_dealt(own_limits_shuffled, step):
    """What e19, e20, e22, e23 and e24 filter or add up: all points of an equipment in one task, a few equipments a task."""
    made = getattr(mapped, step)(own_limits_shuffled).withColumn("task", F.spark_partition_id())
    found = made.groupBy("id").agg(F.count_distinct("task").alias("tasks"), F.min("task").alias("task"), F.count("*").alias("rows")).collect()
    total = collections.Counter()
    for r in found:
        total[r.task] += r.rows
    assert {r.tasks for r in found} == {1} and max(total.values()) < sum(total.values()) / 4
