"""Stores on disk and from streams, ranges, references, threats."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.operators import network
from gridloom.sources import series as src
from gridloom.sources.store import SeriesStore
from gridloom.streaming import append

DAY = "timestamp'2020-01-01' + make_interval(0, 0, 0, CAST(id AS INT))"


def rows(spark, name, version, points, value=1.0):
    df = spark.range(0, 0) if not points else spark.createDataFrame([(p,) for p in points], "id long")
    return df.selectExpr(f"'{name}' AS name", f"CAST({version} AS INT) AS version", "CAST(id AS INT) AS point", f"{DAY} AS instant", f"CAST({value} AS DOUBLE) AS value")


def held(store):
    return sorted((r.name, r.version, r.point, r.value) for r in store.read().collect())


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_store_appends_overwrites_and_refuses(spark, tmp_path):
    store = SeriesStore(spark, str(tmp_path / "store"), buckets=3)
    assert held(store) == [] and store.append(rows(spark, "a", 1, [])) == -1
    names = [f"s{k}" for k in range(6)]
    for k, name in enumerate(names):
        assert store.append(rows(spark, name, k % 2, range(4))) == k
    before = held(store)
    assert len(before) == 24
    for bad, policy in ((rows(spark, "s1", 1, [7]), src.THROW), (rows(spark, "s1", 1, [2, 3, 4]).unionByName(rows(spark, "new", 1, [1])), src.APPEND), (rows(spark, "s1", 1, [9]), "OTHER")):
        with pytest.raises(ValueError):
            store.append(bad, policy)
        assert held(store) == before  # refused as a whole
    old = files(tmp_path / "store" / "data")
    commit = store.append(rows(spark, "s1", 1, [4, 5]), src.APPEND)
    new = set(files(tmp_path / "store" / "data")) - set(old)
    assert {f.parent.parent.name for f in new} == {"version=1"} and len({f.parent for f in new}) == 1  # one part, in a folder of the commit
    assert {k: v for k, v in files(tmp_path / "store" / "data").items() if k in old} == old
    assert [p for n, v, p, _ in held(store) if n == "s1"] == list(range(6))
    store.append(rows(spark, "s1", 1, range(2), 5.0), src.OVERWRITE)
    assert [(p, x) for n, v, p, x in held(store) if n == "s1"] == [(0, 5.0), (1, 5.0)] and len(held(store)) == 22
    assert commit == 6


def test_a_commit_that_was_not_finished_does_not_count(spark, tmp_path):
    store = SeriesStore(spark, str(tmp_path / "store"), buckets=2)
    store.append(rows(spark, "a", 0, range(3)))
    before = held(store)
    shutil.copytree(tmp_path / "store" / "data" / "commit=0", tmp_path / "store" / "data" / "commit=1")  # data, but nothing that names it
    assert held(store) == before
    with pytest.raises(Exception, match="(?i)exist"):
        store.append(rows(spark, "b", 0, range(3)))  # another writer is at it
    assert held(store) == before


class Streams:
    def __init__(self, spark, folder):
        self.spark, self.at = spark, {x: str(folder / x) for x in ("source", "store", "checkpoint", "refused")}

    def run(self, *chunks, **options):
        for c in chunks:
            c.coalesce(1).write.mode("append").parquet(self.at["source"])
        query = append.append_result_chunks(self.spark, self.at["source"], self.at["store"], self.at["checkpoint"], self.at["refused"], **options)
        query.awaitTermination()
        return query

    def read(self, which):
        return sorted((r.name, r.version, r.point) for r in self.spark.read.parquet(self.at[which]).collect())


def test_chunks_out_of_order_over_restarts(spark, tmp_path):
    s = Streams(spark, tmp_path)
    s.run(rows(spark, "a", 1, range(20, 30)))
    s.run(rows(spark, "a", 1, range(0, 10)).unionByName(rows(spark, "b", 1, range(5))), rows(spark, "a", 2, range(20, 30)))
    s.run(rows(spark, "a", 1, range(9, 12)), rows(spark, "b", 1, [7, 7]), rows(spark, "b", 1, range(5, 8)))
    s.run(rows(spark, "a", 1, range(10, 20)).unionByName(rows(spark, "b", 1, [6])))
    assert s.read("store") == sorted([("a", 1, p) for p in range(30)] + [("a", 2, p) for p in range(20, 30)] + [("b", 1, p) for p in range(8)])
    assert s.read("refused") == sorted([("a", 1, p) for p in (9, 10, 11)] + [("b", 1, 6), ("b", 1, 7), ("b", 1, 7)])


def test_batches_know_what_is_stored_without_reading_it(spark, tmp_path):
    """What earlier batches wrote can be gone: the state, not the store, tells what is there. Rows read are those of new files."""
    s = Streams(spark, tmp_path)
    for k in range(3):
        s.run(rows(spark, "a", 1, range(10 * k, 10 * k + 10)))
    for part in Path(s.at["store"]).iterdir():
        shutil.rmtree(part) if part.is_dir() else part.unlink()
    query = s.run(rows(spark, "a", 1, range(5)), rows(spark, "a", 1, range(30, 33)), files_per_batch=1)
    assert s.read("store") == [("a", 1, p) for p in range(30, 33)] and s.read("refused") == [("a", 1, p) for p in range(5)]
    assert sorted(p["numInputRows"] for p in query.recentProgress if p["numInputRows"]) == [3, 5]


def test_intervals():
    assert append.cover([(0, 3), (8, 9)], [4, 6, 7]) == [(0, 4), (6, 9)]
    assert append.cover([], []) == [] and append.covered_by([(2, 4)], [5, 4]) and not append.covered_by([(2, 4)], [1, 5])


def test_export_once_all_chunks_are_there(spark, tmp_path):
    s = Streams(spark, tmp_path)
    expected = spark.createDataFrame([("a", 1, 6), ("b", 1, 6)], "name string, version int, n_points int")
    s.run(rows(spark, "a", 1, range(6)), rows(spark, "b", 1, range(3)))
    assert not append.export_when_complete(spark, s.at["store"], expected, str(tmp_path / "out")) and not (tmp_path / "out").exists()
    s.run(rows(spark, "b", 1, range(3, 6), 2.0))
    assert append.export_when_complete(spark, s.at["store"], expected, str(tmp_path / "out"))
    got = src.read_ts_csv(spark, [str(tmp_path / "out")])[0]
    assert sorted((r.name, r.point, r.value) for r in got.collect()) == [("a", p, 1.0) for p in range(6)] + [("b", p, 1.0 + (p > 2)) for p in range(6)]


# ---- ranges, references, threats -------------------------------------------------------------------------------------


def test_many_ranges_are_joined_by_bins(spark):
    rng = random.Random(5)
    ranges = []
    for k in range(100_000):
        low = rng.randrange(0, 3_000_000)
        ranges.append((f"s{k % 5}", k % 2, low, low + (rng.randrange(3) if k % 50 else rng.randrange(4_000))))
    table = spark.createDataFrame([*ranges, ("s0", 0, 9, 3), ("s0", 0, None, 3)], "name string, version int, low int, high int")
    points = [(f"s{k % 5}", k % 2, rng.randrange(0, 3_000_000), float(k)) for k in range(4000)]
    ts = spark.createDataFrame(points, "name string, version int, point int, value double")
    got = src.filter_by_range_table(ts, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and got.columns == ts.columns
    by = {}
    for n, v, a, b in ranges:
        by.setdefault((n, v), []).append((a, b))
    want = sorted(p for p in points if any(a <= p[2] <= b for a, b in by[p[0], p[1]]))
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < len(points)
    assert src.filter_by_range_table(ts, table.limit(0)).count() == 0


def test_long_lists_of_ranges(spark):
    ts = spark.range(1000).selectExpr("'a' AS name", "0 AS version", "CAST(id AS INT) AS point", "1.0D AS value")
    ranges = [(5 * k, 5 * k + 1) for k in range(100)]
    assert sorted(r.point for r in src.filter_by_ranges(ts, ranges).collect()) == sorted(5 * k + j for k in range(100) for j in (0, 1))
    assert sorted(r.point for r in src.filter_by_ranges(ts, [(1, 3), (2, 5), (-9, -2), (8, 7)]).collect()) == [1, 2, 3, 4, 5]


def test_series_behind_calculations(spark):
    edges = [("c1", "c2"), ("c1", "x"), ("c2", "c3"), ("c3", "y"), ("c3", "z"), ("d", "c3"), ("unused", "unused")]
    dependencies = spark.createDataFrame(edges, "name string, needs string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert sorted(r.name for r in src.stored_names(names("c1", "w", "w"), dependencies).collect()) == ["w", "x", "y", "z"]
    assert sorted(r.name for r in src.stored_names(names("y"), dependencies).collect()) == ["y"]
    ring = dependencies.unionByName(spark.createDataFrame([("c3", "c1")], dependencies.schema))
    with pytest.raises(ValueError, match="read themselves: c1, c2, c3"):
        src.stored_names(names("d", "w"), ring)
    assert src.stored_names(names("x"), ring).count() == 1  # not asked for


def fold(flows, n):
    """The solver's set of threats, entry by entry."""
    kept = []
    for i, (name, flow) in enumerate(flows):
        x = (abs(flow), i, name, flow)
        if len(kept) == n:
            if x[0] - kept[0][0] <= 1e-3:
                continue
            kept.pop(0)
        before = [e for e in kept if (e[1] > x[1] if abs(e[0] - x[0]) < 1e-3 else e[0] < x[0])]
        kept = before + [x] + [e for e in kept if e not in before]
    return [(e[2], e[3]) for e in reversed(kept)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_threats_nearer_than_a_thousandth(spark, n):
    rng = random.Random(n)
    rows = [(f"b{b}", 0, p, f"c{c:02d}", rng.choice([-1, 1]) * (rng.randrange(4) + rng.randrange(6) * 0.0004)) for b in range(4) for p in range(6) for c in range(12)]
    flows = spark.createDataFrame(rows, "branch string, version int, point int, contingency string, flow double")
    place = {f"c{c:02d}": k for k, c in enumerate(rng.sample(range(12), 12))}
    order = spark.createDataFrame(list(place.items()), "contingency string, place int")
    for given, key in ((None, lambda c: c), (order, place.get)):
        got = {}
        for r in network.top_threats(flows, n, order=given).collect():
            got.setdefault((r.branch, r.point), {})[r["rank"]] = (r.contingency, r.flow)
        for b in range(4):
            for p in range(6):
                own = sorted(((c, f) for x, _, q, c, f in rows if (x, q) == (f"b{b}", p)), key=lambda x: key(x[0]))
                assert [v for _, v in sorted(got[f"b{b}", p].items())] == fold(own, n)
    assert network.max_threat(flows.filter(F.lit(False))).count() == 0
