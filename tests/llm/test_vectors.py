"""Operators on vectors and the audit of filters, against brute-force versions."""

from itertools import permutations

import numpy as np
import pytest

from gridloom.llm import embedding_dedup, filter_audit, whitening
from gridloom.llm.queries import QUERIES

KINDS = "vec_id long, embedding array<float>, label int, id string, x int, n long"


def frame(spark, vectors, ids=None):
    rows = [(k if ids is None else ids[k], None if v is None else [None if c is None else float(c) for c in v], 1, "i", 2, 3) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KINDS)


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def partners(rng, base, cosines):
    """Vectors with the given cosines to those of ``base``."""
    other = unit(rng, *base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = np.asarray(cosines)[:, None]
    return c * base + np.sqrt(1 - c * c) * other


def linked(vectors, cosine=0.9):
    """(number of links, smallest reachable row) by all pairs."""
    x = np.array(vectors, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= cosine
    np.fill_diagonal(link, True)
    component = np.arange(len(x))
    while True:
        least = np.array([component[row].min() for row in link])
        if (least == component).all():
            return link.sum(axis=1) - 1, component
        component = least


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = unit(rng, 900, 32)
    near = partners(rng, base[:400], rng.uniform(0.88, 0.97, 400))
    tight = base[:1] + 0.02 * rng.normal(size=(500, 32))  # one ball
    loose = base[1:2] + 0.07 * rng.normal(size=(200, 32))  # many balls that link in part
    vectors = np.vstack([base, near, tight, loose, tight[:60]])
    got = {r["id"]: r for r in embedding_dedup.near_vectors(frame(spark, vectors)).collect()}
    links, component = linked(vectors)
    assert len(got) == len(vectors)
    found = np.array([got[k]["n_links"] for k in range(len(vectors))])
    assert (found <= links).all()
    assert found.sum() >= 0.98 * links.sum()
    rest = np.r_[0:1300]
    assert found[rest].sum() >= 0.98 * links[rest].sum()
    assert np.mean([got[k]["component_id"] == component[k] for k in range(len(vectors))]) >= 0.99
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got.values())


def test_a_group_of_near_copies_passes_on_no_pairs(spark, monkeypatch):
    """3,000 vectors that all link: rows that the search hands on grow with the vectors, not with their pairs."""
    held = []
    write = embedding_dedup.written
    monkeypatch.setattr(embedding_dedup, "written", lambda df, label, *a: held.append((label, write(df, label, *a))) or held[-1][1])
    monkeypatch.setattr(embedding_dedup, "CHUNK", 256)
    rng = np.random.default_rng(6)
    for spread in (0.01, 0.028):  # balls, and single vectors around a centre that is none of them
        vectors = unit(rng, 1, 64) + spread * rng.normal(size=(1500, 64))
        held.clear()
        got = embedding_dedup.near_vectors(frame(spark, vectors)).collect()
        found = next(df for label, df in held if label == "found")
        assert found.selectExpr("coalesce(sum(size(edges) + size(mixed)), 0)").first()[0] <= 20 * len(vectors)
        links, _ = linked(vectors)
        assert sum(r["n_links"] for r in got) >= 0.99 * links.sum()
        assert {r["component_id"] for r in got} == {0}


def test_near_vectors_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0], [2.0, 0.0], [1e-30, 0.0], [1e30, 1e20], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0, 0.0], [-0.0, 1.0]]
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(frame(spark, vectors)).collect())
    group = [6, 7, 8, 9, 10]
    want = [(k, 4, 6, k == 6) if k in group else (k, 1, 11, k == 11) if k in (11, 13) else (k, 0, k, True) for k in range(len(vectors))]
    assert got == want
    ids = [None, 5, 5, None]
    got = embedding_dedup.near_vectors(frame(spark, [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], ids)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True)], key=str)
    assert embedding_dedup.near_vectors(frame(spark, [])).collect() == []


def test_embedding_dedup_query(spark, sf_dir):
    got = QUERIES["op11_embedding_dedup"](spark, sf_dir).collect()
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    links, component = linked([r["embedding"] for r in rows])
    ids = [r["vec_id"] for r in rows]
    want = sorted((i, int(n), ids[c], i == ids[c]) for i, n, c in zip(ids, links, component))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


# ---- whitening -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["normal", "graded", "rank", "equal", "blocks", "hadamard", "small"])
def test_the_solver_against_the_svd(kind):
    rng = np.random.default_rng(7)
    eye = np.eye(16)
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    a = {
        "normal": rng.normal(size=(400, 24)), "graded": rng.normal(size=(400, 24)) * np.logspace(0, -6, 24), "rank": rng.normal(size=(10, 24)), "equal": np.vstack([eye, -eye]),
        "blocks": np.vstack([3 * eye, -3 * eye, eye[:8], -eye[:8]]), "hadamard": np.vstack([h, -h]) * np.r_[np.ones(14), 1 + 1e-9, 1 - 1e-9], "small": rng.integers(0, 2, size=(7, 3)).astype(float),
    }[kind]
    a = a - a.mean(axis=0)
    n, d = a.shape
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    directions, values, trace = whitening.whitening_directions(r, n, d)
    want = np.linalg.svd(a / np.sqrt(n), compute_uv=False) ** 2
    k = len(values)
    assert k == np.linalg.matrix_rank(a)
    assert np.allclose(values, want[:k], rtol=1e-11)
    assert abs(directions.T @ directions - np.eye(k)).max() < 1e-10
    assert abs(a.T @ a / n @ directions - directions * values).max() < 1e-12 * max(1.0, want[0])
    assert np.isclose(trace, want.sum())


def whitened_by_numpy(rows, most=16):
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(np.float64)) + 1e6 for _, v in rows])
    fit = np.unique(x, axis=0)
    values, directions = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, directions = values[::-1][:most], directions[:, ::-1][:, :most]
    return len(fit), x, fit, values, (x - fit.mean(axis=0)) @ directions / np.sqrt(values), np.cov(fit.T, bias=True).trace()


def test_whitening_query(spark, sf_dir):
    got = QUERIES["op12_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    n, x, fit, values, want, trace = whitened_by_numpy(rows)
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert set(got["n"]) == {n} and len(got) == 16 * len(rows)
    y = got["whitened"].to_numpy().reshape(-1, 16)
    signs = np.sign((y * want).sum(axis=0))
    assert np.allclose(y * signs, want, atol=1e-7)
    assert np.allclose(got["explained"].to_numpy()[:16], values / trace, rtol=1e-9)
    sums = [int(s) for s in fit.astype(np.int64).sum(axis=0)]
    for k in (0, len(rows) // 2):
        assert got["deviation"].to_numpy()[16 * k] == sum((n * int(c) - s) ** 2 for c, s in zip(x[k], sums))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_whitening_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(8)
    good = [list(v) for v in rng.normal(size=(50, 3))]
    bad = [None, [], [nan, 1, 2], [inf, 1, 2], [None, 1, 2], [1.0, 2.0]]
    plain = whitening.whiten(frame(spark, good)).collect()
    assert len(plain) == 150 and {r["component"] for r in plain} == {1, 2, 3}
    got = whitening.whiten(frame(spark, good + bad + good[:5], [*range(50), *range(100, 106), None, None, 1, 1, 2])).collect()
    assert len(got) == 165 and {r["n"] for r in got} == {50}  # repeated rows are whitened, too, but count once in the fit
    assert sum(r["id"] is None for r in got) == 6
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, bad[:5])).collect() == []
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 4)).collect() == []  # no variance, nothing to divide by
    line = whitening.whiten(frame(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(frame(spark, [[1e30, 1.0], [2.0, 1e30], [5.0, 7.0]])).collect()


def test_partial_results_meet_in_groups(spark, monkeypatch):
    """Triangles of many tasks, two at a time."""
    monkeypatch.setattr(whitening, "MERGE_BYTES", 1)
    rng = np.random.default_rng(9)
    rows = [(k, list(v)) for k, v in enumerate(rng.normal(size=(300, 5)))]
    got = whitening.whiten(frame(spark, [v for _, v in rows]).repartition(13)).toPandas().sort_values(["id", "component"])
    want = whitened_by_numpy(rows)[4]
    y = got["whitened"].to_numpy().reshape(-1, 5)
    assert np.allclose(y * np.sign((y * want).sum(axis=0)), want, atol=1e-8)


# ---- filters ---------------------------------------------------------------------------------------------------------


def test_lehmer_ranks_and_intervals():
    for m in (1, 2, 3, 5):
        orders = list(permutations(range(m)))
        assert [filter_audit.lehmer_rank(p, m) for p in orders] == list(range(len(orders)))
        held = {}
        for mask, k, kind, low, high in filter_audit.intervals(m):
            for r in range(low, high):
                assert (mask, k, r) not in held
                held[mask, k, r] = kind
        for mask in range(1 << m):
            for r, p in enumerate(orders):
                gone = False
                for k, x in enumerate(p, 1):
                    fails = bool(mask >> x & 1)
                    want = "redundant" if fails and gone else "removed" if fails else None if gone else "kept"
                    gone = gone or fails
                    assert held.get((mask, k, r)) == want


def audit_by_hand(docs, labels):
    """Every document through every order."""
    import re

    good, toxic = ({i for i, *v in labels if i is not None and v[c] == 1} for c in (0, 1))
    rows, texts = [], {}
    for i, text, source in docs:
        texts.setdefault(text or "", []).append(i)
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(x is not None and x < i for x in texts[t]),
        }
        rows.append((i, source or "", fails))
    out = {}
    for part in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                removed = [r for r in left if r[2][x]]
                left, redundant = [r for r in left if not r[2][x]], sum(r[2][x] for r in gone)
                gone = gone + removed
                shapley[x] += len(removed)
                unique = sum(r[2][x] and sum(r[2].values()) == 1 for r in own)
                out[part, order, step] = [len(left), len(removed), redundant, unique, sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_against_every_order(spark):
    long = " ".join(f"word{k}" for k in range(250))
    docs = [
        (1, long, "s1"), (2, long, "s2"), (3, None, None), (4, "", ""), (5, "  \n", "s1"), (None, long, "s1"), (None, None, None), (6, long + " 5%", "s1"), (7, "AB " * 300, "s2"),
        (8, "word " * 300, "s2"), (9, long.upper(), "s1"), (9, long.upper(), "s1"), (10, "äÖ 😀 $", "s2"), (11, long, "s1"), (12, (long + " ") * 400, "s3"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (9, 1, None), (11, None, 1), (11, 1, 0), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, source string, mask int, part string, step int")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, digest string")
    got = {tuple(r) for r in filter_audit.audit_filters(df, marks).collect()}
    assert got == audit_by_hand(docs, labels)
    assert filter_audit.audit_filters(df.limit(0), marks).collect() == []
    assert filter_audit.audit_filters(df, marks.limit(0)).count() == 600 * 4
