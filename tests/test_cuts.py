"""Bridges, pairs that part a graph, and running totals in blocks, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import network
from gridloom.plans import scan
from gridloom.plans.cuts import cut_labels


def components(nodes, edges):
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return out


def pockets(branches, contingencies, power):
    nodes = {n for _, a, b, _ in branches for n in (a, b)}
    want = {}
    if not nodes:
        return want
    for name, cut in contingencies.items():
        found = components(nodes, [(a, b) for i, a, b, closed in branches if closed and i not in cut])
        main = min(found, key=lambda c: (-len(found[c]), c))
        gone = [n for c, members in found.items() if c != main for n in members]
        if gone:
            want[name] = (len(gone), float(sum(power.get(n, (0, 0))[0] for n in gone)), float(sum(power.get(n, (0, 0))[1] for n in gone)))
    return want


def check(spark, branches, contingencies, power):
    rows = [(name, b) for name, cut in contingencies.items() for b in cut]
    got = network.lost_pockets(
        spark.createDataFrame(branches, "id string, node1 int, node2 int, closed boolean"), spark.createDataFrame(rows, "contingency string, branch string"),
        spark.createDataFrame([(n, float(g), float(v)) for n, (g, v) in power.items()], "node int, generation double, load double"),
    )
    assert {r.contingency: (r.n_nodes, r.lost_generation, r.lost_load) for r in got.collect()} == pockets(branches, contingencies, power)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pockets_of_all_single_and_double_outages(spark, seed):
    """Sparse graphs with bridges, pairs, parallel branches, loops of one node, islands, open branches."""
    rng = random.Random(seed)
    n = 22
    branches = [(f"b{k}", k, k + 1 if rng.random() < 0.8 else rng.randrange(n), rng.random() < 0.93) for k in range(n - 1)]
    branches += [(f"c{k}", rng.randrange(n), rng.randrange(n), True) for k in range(7)] + [("d0", 3, 4, True), ("d1", 5, 5, True), ("e0", 40, 41, True), ("e1", 41, 42, True), ("e2", 42, 40, True)]
    ids = [b[0] for b in branches]
    power = {k: (k * 3, k + 1) for k in range(0, 45, 1) if k % 7}
    every = {f"{a}": [a] for a in ids} | {f"{a}+{b}": [a, b] for a, b in itertools.combinations(ids, 2)}
    every |= {f"more{k}": rng.sample(ids, 3 + k % 3) for k in range(12)} | {"unknown": ["zz"], "half known": ["zz", ids[2]]}
    check(spark, branches, every, power)


def test_pockets_of_a_long_line_and_a_ring(spark):
    line = [(f"l{k}", k, k + 1, True) for k in range(300)]
    ring = [(f"r{k}", 1000 + k, 1000 + (k + 1) % 120, True) for k in range(120)]
    cuts = {f"l{k}": [f"l{k}"] for k in (0, 7, 149, 299)} | {f"p{k}": [f"l{k}", f"l{k + 40}"] for k in (3, 100, 250)} | {f"q{k}": [f"r{k}", f"r{k + 30}"] for k in (0, 60)} | {"both": ["l9", "r9"]}
    check(spark, line + ring, cuts, {k: (1, 2) for k in range(0, 1200, 3)})


def test_no_branches_or_contingencies(spark):
    check(spark, [("a", 1, 2, True)], {}, {1: (1, 1)})
    check(spark, [("a", 1, 2, False)], {"x": ["a"]}, {1: (1, 1), 2: (3, 5)})
    check(spark, [], {"x": ["a"]}, {})


def test_outages_of_one_and_two_dont_copy_the_graph(spark, monkeypatch):
    asked = []
    solve = network._solved_pockets
    monkeypatch.setattr(network, "_solved_pockets", lambda branches, some, power: asked.append(some.select("contingency").distinct().count()) or solve(branches, some, power))
    line = [(f"l{k}", k, k + 1, True) for k in range(60)]
    check(spark, line, {f"x{k}": [f"l{k}", f"l{k + 1}"] for k in range(0, 59, 2)} | {"more": ["l1", "l2", "l9"]}, {3: (1, 1)})
    assert asked == [1]


def test_labels_of_a_tree_and_its_sums(spark):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 3, 1), (3, 3, 4)], "e long, a int, b int")
    found, whole = cut_labels(edges, spark.createDataFrame([(n, float(n)) for n in (1, 2, 3, 4, 9)], "node int, w double"), ["w"])
    found = {r.e: r for r in found.collect()}
    assert found[3].label == 0 and found[3].n in (1, 3) and found[3].w in (4.0, 6.0)
    assert found[0].label == found[1].label == found[2].label != 0
    assert sorted((r.n, r.w) for r in whole.collect()) == [(1, 9.0), (4, 10.0)]


def test_running_totals_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(k, p, rng.randrange(-50, 50) if rng.random() < 0.9 else None, rng.getrandbits(40)) for k in ("a", "b") for p in range(200) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, p long, v long, m long")
    got = scan.running(df, ["k"], "p", {"total": ("v", "sum"), "top": ("v", "max"), "low": ("v", "min"), "x": ("m", "bit_xor")})
    assert got.columns == ["k", "p", "v", "m", "total", "top", "low", "x"]
    by = {(r.k, r.p): r for r in got.collect()}
    assert len(by) == len(rows)
    for k in ("a", "b"):
        seen, x = [], 0
        for _, p, v, m in sorted(r for r in rows if r[0] == k):
            seen, x = seen + [v] * (v is not None), x ^ m
            r = by[k, p]
            assert (r.top, r.low, r.x) == (max(seen, default=None), min(seen, default=None), x) and (r.total or 0) == sum(seen)
    assert got.filter(F.col("k") == "zz").count() == 0
