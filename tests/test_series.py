import gzip
import glob
import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions.expressions import calculate, const, series
from gridloom.operators import checks, network, stats, tables
from gridloom.plans import spread
from gridloom.plans.graph import connected_components
from gridloom.sources import series as src
from gridloom.streaming.append import append_result_chunks


def ts(spark, rows):
    return spark.createDataFrame(rows, "name string, version int, point int, value double").withColumn("instant", F.timestamp_seconds(F.col("point") * 3600)).select("name", "version", "point", "instant", "value")


def test_read_csv(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("Time;Version;SE_L1;SO_G1;outages\n2020-01-01T00:00:00Z;1;960;0;x\n2020-01-01T01:00:00Z;1;960;960;\n")
    b.write_text("Time;Version;SO_G1\n2020-01-01T00:00:00Z;1;5\n2020-01-01T01:00:00Z;1;6\n")
    doubles, strings = src.read_ts_csv(spark, [str(a), str(b)])
    assert sorted((r.name, r.point, r.value) for r in doubles.collect()) == [("SE_L1", 0, 960.0), ("SE_L1", 1, 960.0), ("SO_G1", 0, 5.0), ("SO_G1", 1, 6.0)]
    assert sorted((r.name, r.point, r.value) for r in strings.collect()) == [("outages", 0, "x"), ("outages", 1, None)]


def test_read_json(spark, tmp_path):
    index = {"startTime": 0, "endTime": 7_200_000, "spacing": 3_600_000}
    rows = [
        {"metadata": {"name": "ts1", "dataType": "double", "tags": [{"a": "b"}], "regularIndex": index}, "chunks": [{"offset": 0, "values": [1.0, 2.0]}, {"offset": 2, "values": [3.0]}]},
        {"metadata": {"name": "ts2", "dataType": "double", "tags": [], "regularIndex": index}, "chunks": [{"offset": 0, "uncompressedLength": 3, "stepValues": [300.0, 5.0], "stepLengths": [2, 1]}]},
    ]
    path = tmp_path / "ts.json"
    path.write_text(json.dumps(rows))
    found = src.read_ts_json(spark, str(path))
    assert sorted((r.name, r.point, float(r.value), r.instant.hour) for r in found.collect()) == [("ts1", 0, 1.0, 0), ("ts1", 1, 2.0, 1), ("ts1", 2, 3.0, 2), ("ts2", 0, 300.0, 0), ("ts2", 1, 300.0, 1), ("ts2", 2, 5.0, 2)]
    assert src.one_series(found, "ts1", "string").count() == 0 and src.one_series(found, "ts1", "double").count() == 3


@pytest.mark.parametrize("ranges,expected", [([], []), ([(1, 2)], [2, 3]), ([(-5, 1)], [1, 2]), ([(0, 1), (3, 4)], [1, 2, 4, 5]), ([(1, 3), (2, 5)], [2, 3, 4, 5, 6]), ([(8, 10)], [])])
def test_filter_by_ranges(spark, ranges, expected):
    rows = ts(spark, [("a", 1, k, float(k + 1)) for k in range(6)])
    assert sorted(r.value for r in src.filter_by_ranges(rows, ranges).collect()) == expected


@pytest.mark.parametrize("ranges", [[(-2, 3)], [(3, 2)], [(0, 3), (3, 5)]])
def test_bad_ranges(ranges):
    with pytest.raises(ValueError):
        src.check_ranges(ranges)


def test_append(spark):
    stored, later = ts(spark, [("a", 1, 0, 1.0), ("a", 1, 1, 2.0)]), ts(spark, [("a", 1, 2, 3.0)])
    assert [(r.point, r.value) for r in src.append_ts(stored, later, src.APPEND).orderBy("point").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]
    with pytest.raises(ValueError):
        src.append_ts(stored, later, src.THROW)
    with pytest.raises(ValueError):
        src.append_ts(stored, ts(spark, [("a", 1, 1, 3.0)]), src.APPEND)
    with pytest.raises(ValueError):
        src.append_ts(stored, later.withColumn("instant", F.lit(None).cast("timestamp")), src.APPEND)
    assert [r.value for r in src.append_ts(stored, later, src.OVERWRITE).collect()] == [3.0]
    assert src.append_ts(stored, ts(spark, [("a", 2, 0, 1.0), ("b", 1, 0, 1.0)]), src.THROW).count() == 4


def test_export(spark, tmp_path):
    rows = ts(spark, [("ts1", 1, 0, 1.0), ("ts1", 1, 1, 2.0), ("ts2", 1, 0, 1.0), ("ts2", 1, 1, 3.0), ("ts1", 2, 0, 7.0), ("ts1", 2, 1, 8.0)])
    wide = src.export_wide(rows, ["ts1", "ts2"])
    assert sorted((r.Version, r.ts1, r.ts2) for r in wide.collect()) == [(1, 1.0, 1.0), (1, 2.0, 3.0), (2, 7.0, None), (2, 8.0, None)]
    src.write_wide(wide.coalesce(1), str(tmp_path / "out"), gzip=True)
    text = gzip.open(glob.glob(str(tmp_path / "out/*.gz"))[0], "rt").read().splitlines()
    assert text[0] == "Time;Version;ts1;ts2" and len(text) == 5
    with pytest.raises(ValueError):
        src.export_wide(rows.union(ts(spark, [("ts3", 1, 5, 1.0)])), ["ts1", "ts3"])


def test_expressions_with_nan_and_zero(spark):
    nan, inf = float("nan"), float("inf")
    rows = ts(spark, [("a", 1, 0, 1.0), ("a", 1, 1, nan), ("a", 1, 2, -1.0), ("a", 1, 3, 0.0), ("z", 1, 0, 0.0), ("z", 1, 1, 1.0), ("z", 1, 2, 0.0), ("z", 1, 3, 0.0)])
    a, z = series("a"), series("z")
    got = {(r.name, r.point): r.value for r in calculate(rows, {"q": a / z, "g": a > 0, "m": a.min(0.5)}).collect()}
    assert [got["q", k] for k in (0, 2)] == [inf, -inf] and got["q", 3] != got["q", 3] and got["q", 1] != got["q", 1]
    assert [got["g", k] for k in range(4)] == [1.0, 0.0, 0.0, 0.0] and got["m", 0] == 0.5 and got["m", 1] != got["m", 1]
    with pytest.raises(ValueError):
        calculate(rows, {"x": series("unknown")})
    with pytest.raises(ValueError):
        calculate(rows, {"x": const(1)})


def test_statistics_with_nan(spark):
    rows = ts(spark, [("a", 1, 0, 1.0), ("a", 1, 1, float("nan")), ("b", 1, 0, 1.0), ("b", 1, 1, 3.0), ("b", 2, 0, 8.0), ("b", 2, 1, 8.0)])
    got = {r.name: r for r in stats.series_stats(rows).collect()}
    assert got["a"]["min"] != got["a"]["min"] and got["a"]["max"] != got["a"]["max"]
    assert (got["b"]["sum"], got["b"]["min"], got["b"]["max"], got["b"]["avg"], got["b"]["median"]) == (20.0, 1.0, 8.0, 5.0, 8.0)


def test_result_limit(spark):
    m = spark.createDataFrame([("b1", "MONITORED", "MONITORED"), ("b2", "RESULT", "NO")], "branch string, mode_n string, mode_nk string")
    assert stats.estimate_results(m, 5, True, False).first().n_results == 14
    assert stats.estimate_results(m, 5, True, True).first().n_results == 4
    with pytest.raises(ValueError):
        stats.check_result_limit(m, 10, n_threats=5, pre_curative=True, overload_only=False)


def test_data_tables(spark):
    t = tables.create(spark, ["a", "b"], [["x", "1"], ["X", "2"], [None, "3"]])
    assert [r.b for r in tables.filter_rows(t, ["b"], {"a": ["x", None]}).collect()] == ["1", "2"]
    assert tables.search_first_value(t, "b", {"a": ["X"]}).first().b == "1"
    assert tables.search_first_value(t, "b", {"a": ["y"]}).count() == 0
    assert [r.b for r in tables.remove_lines(t, {"a": ["x"]}).collect()] == ["3"]
    assert [(r.row_id, r.a) for r in tables.add_lines(t, tables.create(spark, ["b", "a"], [["9", "z"]])).collect()][-1] == (3, "z")
    for bad in (lambda: tables.create(spark, ["a", "a"], []), lambda: tables.create(spark, ["a"], [["1", "2"]]), lambda: tables.data(t, "c"), lambda: tables.replace_values(t, ["a"], {}, []), lambda: tables.add_lines(t, tables.create(spark, ["a"], []))):
        with pytest.raises(ValueError):
            bad()


def test_stream_of_chunks(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")

    def run():
        append_result_chunks(spark, source, store, str(tmp_path / "checkpoint"), str(tmp_path / "refused")).awaitTermination()

    ts(spark, [("a", 1, 2, 3.0), ("a", 1, 3, 4.0)]).coalesce(1).write.mode("append").parquet(source)
    run()
    ts(spark, [("a", 1, 0, 1.0), ("a", 1, 2, 99.0)]).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    # the chunk with point 2 is refused as a whole
    assert sorted((r.point, r.value) for r in spark.read.parquet(store).collect()) == [(2, 3.0), (3, 4.0)]
    assert sorted((r.point, r.value) for r in spark.read.parquet(str(tmp_path / "refused")).collect()) == [(0, 1.0), (2, 99.0)]


def test_stream_of_chunks_in_one_batch(spark, tmp_path):
    """Of two files with a point in common the first by path is stored; other series of the second are chunks of their own."""
    source = tmp_path / "in"
    for name, rows in (("a", [("x", 1, 0, 1.0), ("x", 1, 1, 2.0)]), ("b", [("x", 1, 1, 9.0), ("x", 1, 2, 9.0), ("y", 1, 1, 5.0), ("z", 1, 0, 1.0), ("z", 1, 0, 2.0)])):
        ts(spark, rows).coalesce(1).write.parquet(str(source / name))
    args = [str(tmp_path / n) for n in ("store", "checkpoint", "refused")]
    append_result_chunks(spark, f"{source}/*", *args).awaitTermination()
    key = lambda path: sorted((r.name, r.point, r.value) for r in spark.read.parquet(path).collect())
    assert key(args[0]) == [("x", 0, 1.0), ("x", 1, 2.0), ("y", 1, 5.0)]
    assert key(args[2]) == [("x", 1, 9.0), ("x", 2, 9.0), ("z", 0, 1.0), ("z", 0, 2.0)]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [float("nan"), 1.0, float("nan")], [5.0] * 900 + [1.0] * 100, [((k * 7919) % 10_007) / 8 for k in range(10_007)], [((k * 31) % 5_000) / 3 for k in range(5_000)]])
def test_upper_median(spark, values):
    rows = ts(spark, [("a", 1, k, v) for k, v in enumerate(values)] + [("b", 1, 0, 7.0)])
    got = {r.name: r.median for r in stats.upper_median(rows).collect()}
    want = sorted(values, key=lambda v: (v != v, v))[len(values) // 2]
    assert got["b"] == 7.0 and (got["a"] == want or want != want and got["a"] != got["a"])


def test_lines_of_several_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {k}\n" for k in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            found = checks.read_lines(spark, str(path))
            assert sorted((r.line_no, r.value) for r in found.collect()) == [(k, f"line {k}") for k in range(1, 2001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_threats_by_flow(spark):
    flows = spark.createDataFrame([("b", c, 1, 0, f) for c, f in (("c1", 10.0004), ("c2", -10.0006), ("c3", 10.0006), ("c4", 9.0))], "branch string, contingency string, version int, point int, flow double")
    assert [(r["rank"], r.contingency) for r in network.top_threats(flows, 3).orderBy("rank").collect()] == [(1, "c1"), (2, "c2"), (3, "c3")]
    assert [(r.contingency, r.flow) for r in network.max_threat(flows).collect()] == [("c1", 10.0004)]  # no other is larger by a thousandth


def test_table_from_rows(spark):
    rows = spark.createDataFrame([(0, ["x", "1"]), (1, [None, "2"])], "row_id long, cells array<string>")
    assert [(r.row_id, r.a, r.b) for r in tables.create_from(rows, ["a", "b"]).orderBy("row_id").collect()] == [(0, "x", "1"), (1, None, "2")]
    with pytest.raises(ValueError):
        tables.create_from(rows, ["a", "a"])
    with pytest.raises(Exception, match="row size differs"):
        tables.create_from(rows, ["a", "b", "c"]).collect()


@pytest.mark.parametrize("rows", [2, 256])
def test_spread_join(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(spread, "SPREAD_ROWS", rows)
    left = spark.createDataFrame([("hot" if k % 3 else f"k{k % 5}", k) for k in range(300)] + [(None, 1)], "k string, n int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4), (None, 5)], "k string, v int")
    got = sorted(map(tuple, spread.spread_join(left, right, ["k"], "n").collect()))
    assert got == sorted(map(tuple, left.join(right, ["k"]).collect())) and len(got) > 200
    edges = spark.createDataFrame([(0, k) for k in range(1, 30)] + [(k, k + 1) for k in range(40, 60)], "src int, dst int")
    plain = sorted(map(tuple, connected_components(edges).collect()))
    assert sorted(map(tuple, connected_components(edges, spread=True).collect())) == plain
