"""Whitening of embeddings by a bidiagonal qd solver (operator 12).

1. Vectors become whole numbers; the fit list holds each distinct one once (partial aggregation, so a vector that a third
   of all rows have is one row per task). Counts and sums are exact.
2. Every task reduces its centred rows, block by block, to an upper triangle R by QR; triangles are stacked and reduced
   again in groups of bounded size until one is left. RᵀR is n times the covariance, which is never formed itself.
3. R, as large as the dimension squared whatever the number of rows, is reduced to a bidiagonal B by Householder reflections.
   dqds with shifts that never exceed the smallest eigenvalue (from the trace of the inverse) finds the squares of B's singular
   values to high relative accuracy; twisted factorisations of BᵀB - λ give their vectors, those of close ones orthogonalised.
4. One more pass over the fit list measures the covariance of what was whitened; the last pass emits all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 8192
MERGE_BYTES = 32 << 20  # of partial results in one task
EPS = float(np.finfo(np.float64).eps)
PART = "slot long, body binary"
LIMIT = float(1 << 62)


# ---- the bidiagonal solver -------------------------------------------------------------------------------------------


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, P): r = Q B Pᵀ with B upper bidiagonal; Q isn't kept."""
    a, d = r.astype(np.float64).copy(), r.shape[0]
    p = np.eye(d)

    def reflector(x: np.ndarray):
        size = np.abs(x).max(initial=0.0)
        if size == 0.0 or not np.any(x[1:]):
            return None
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < d - 2 and (v := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ v, v)
            p[:, k + 1 :] -= 2.0 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds(q: list[float], e: list[float], shift: float):
    """One transformation: (q, e, the auxiliary d's), or None as soon as a value turns negative."""
    n, d = len(q), q[0] - shift
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [d] + [0.0] * (n - 1)
    for k in range(n - 1):
        if d < 0.0 or not (top := d + e[k]) > 0.0:
            return None
        new_q[k] = top
        ratio = q[k + 1] / top
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
        ds[k + 1] = d
    if d < 0.0:
        return None
    new_q[-1] = d
    return new_q, new_e, ds


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of the singular values of an upper bidiagonal matrix, falling."""
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if largest == 0.0:
        return np.zeros(len(diagonal))
    least = (EPS * 1e-3) ** 2  # what is smaller than that, of 1, can't be told from zero; exact zeros would divide by zero
    q = np.maximum((diagonal / largest) ** 2, least).tolist()
    e = ((above / largest) ** 2).tolist()
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while q:
            n = len(q)
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1])) or e[k] < least * EPS), None)
            if n == 1 or cut == n - 2:
                found.append(moved + q[-1])
                q, e = q[:-1], e[: max(0, n - 2)]
                continue
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            plain = _dqds(q, e, 0.0)
            if plain is None or not all(x > 0.0 for x in plain[2]):
                q = [max(x, least) for x in q]
                plain = _dqds(q, e, 0.0)
            shift = (1.0 - 4.0 * n * EPS) / sum(1.0 / x for x in plain[2])  # 1 / d's: the diagonal of the inverse
            # A shift that is lost in what was moved before can't change the result any more.
            step = _dqds(q, e, shift) if shift > EPS * moved / 8 else None
            q, e, moved = (*step[:2], moved + shift) if step else (*plain[:2], moved)
    return np.sort(np.array(found))[::-1] * largest * largest


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float):
    """gamma, and the multipliers of the stationary and of the progressive factorisation of BᵀB - value."""
    n = len(diagonal)
    d = diagonal * diagonal
    low = above / diagonal[:-1]
    tiny = EPS * EPS * d.max()
    safe = lambda x: x if abs(x) > tiny else tiny
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
    s[0] = -value
    for k in range(n - 1):
        down[k] = d[k] * low[k] / safe(s[k] + d[k])
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        after = safe(p[k + 1])
        t = d[k] / safe(d[k] * low[k] * low[k] + after)
        up[k] = low[k] * t
        p[k] = after * t - value
    return s + p + value, down, up


def _vector(gamma_at: int, down: np.ndarray, up: np.ndarray) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[gamma_at] = 1.0
    for k in range(gamma_at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
        if abs(z[k]) > 1e150:
            z /= abs(z[k])
    for k in range(gamma_at, len(down)):
        z[k + 1] = -up[k] * z[k]
        if abs(z[k + 1]) > 1e150:
            z /= abs(z[k + 1])
    return z / np.linalg.norm(z)


def singular_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors, as columns, of the largest ``values`` (falling squares). Where neighbours are so close that
    a twisted factorisation alone can't tell them apart, other twists are tried until one adds a direction of its own."""
    largest = np.abs(diagonal).max()
    diagonal = np.where(np.abs(diagonal) < EPS * 1e-3 * largest, EPS * 1e-3 * largest, diagonal)
    found: list[np.ndarray] = []
    start = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * values[k - 1]:
            start = k
        gamma, down, up = _twisted(diagonal, above, value)
        near, best, left = found[start:], None, -1.0
        for at in np.argsort(np.abs(gamma)):
            z = _vector(int(at), down, up)
            for _ in range(2):
                for y in near:
                    z = z - (y @ z) * y
            size = float(np.linalg.norm(z))
            if size > left:
                best, left = z / size if size else z, size
            if left > 0.3:
                break
        for y in near:
            best = best - (y @ best) * y
        found.append(best / np.linalg.norm(best))
    return np.array(found).T.reshape(len(diagonal), len(values))


def whitening_directions(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions as columns, eigenvalues, trace) of the covariance rᵀr / n: ``most`` at most, only those that differ from zero.
    The largest entry of a direction is positive."""
    diagonal, above, p = bidiagonalise(r)
    values = squared_singular_values(diagonal, above)
    trace = float((r * r).sum()) / n
    k = min(most, int((values > len(values) * EPS * EPS * 16 * values[0]).sum())) if values[0] > 0 else 0
    directions = p @ singular_vectors(diagonal, above, values[:k]) if k else np.zeros((len(p), 0))
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(k)]) if k else np.ones(0)
    return directions * signs, values[:k] / n, trace


# ---- partial results -------------------------------------------------------------------------------------------------


def _merged(rows: DataFrame, reduce, merge, n_bytes: int) -> bytes | None:
    """``reduce`` makes one body of a task's batches, ``merge`` one of several, in groups of MERGE_BYTES at most, until one is left."""

    def partial(batches):
        body = reduce(batches)
        if body is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([body], pa.binary())], names=["slot", "body"])

    fan = max(2, MERGE_BYTES // max(1, n_bytes))

    def together(group: pa.Table) -> pa.Table:
        slot = group.column("slot")[0].as_py() // fan
        order = np.argsort(group.column("slot").to_numpy())
        bodies = group.column("body")
        return pa.table([pa.array([slot], pa.int64()), pa.array([merge([bodies[int(k)].as_py() for k in order])], pa.binary())], names=["slot", "body"])

    parts = written(rows.mapInArrow(partial, PART), "partial")
    while parts.count() > 1:
        parts = written(parts.groupBy((F.col("slot") / fan).cast("long").alias("of")).applyInArrow(together, PART), "partial")
    last = parts.select("body").first()
    return bytes(last[0]) if last else None


def _blocks(batches, d: int, at: int = 0):
    """Vectors as whole numbers, BLOCK_ROWS at most at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.column(at).slice(k, BLOCK_ROWS).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    if float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0)) > LIMIT:
        raise OverflowError("n * x - S doesn't fit in 64 bits")
    return n * x - sums


def _squares(deviations: np.ndarray) -> np.ndarray:
    if (deviations.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) > LIMIT:
        raise OverflowError("a deviation doesn't fit in 64 bits")
    return (deviations * deviations).sum(axis=1)


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def reduce(batches):
        total = np.zeros(d + 1, np.int64)
        for x in _blocks(batches, d):
            total[0] += len(x)
            total[1:] += x.sum(axis=0)
        return total.tobytes() if total[0] else None

    body = _merged(fit, reduce, lambda bodies: sum(np.frombuffer(b, np.int64) for b in bodies).tobytes(), 8 * d)
    total = np.frombuffer(body, np.int64) if body else np.zeros(d + 1, np.int64)
    return int(total[0]), total[1:]


def _triangle(fit: DataFrame, d: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, d by d."""

    def square(r):
        return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r

    def reduce(batches):
        r = None
        for x in _blocks(batches, d):
            rows = _deviations(x, n, sums) / n
            r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        return None if r is None else square(r).tobytes()

    def merge(bodies):
        return square(np.linalg.qr(np.vstack([np.frombuffer(b).reshape(d, d) for b in bodies]), mode="r")).tobytes()

    return np.frombuffer(_merged(fit, reduce, merge, 8 * d * d)).reshape(d, d)


def _identity_error(fit: DataFrame, d: int, project, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""

    def merge_two(a, b):
        if a is None:
            return b
        (n, mean, m2), (n_b, mean_b, m2_b) = a, b
        step = mean_b - mean
        return n + n_b, mean + step * (n_b / (n + n_b)), m2 + m2_b + np.outer(step, step) * (n * n_b / (n + n_b))

    pack = lambda s: np.concatenate([[s[0]], s[1], s[2].ravel()]).tobytes()

    def load(body):
        flat = np.frombuffer(body)
        return flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def reduce(batches):
        held = None
        for x in _blocks(batches, d):
            y = project(x)[1]
            mean = y.mean(axis=0)
            held = merge_two(held, (float(len(y)), mean, (y - mean).T @ (y - mean)))
        return None if held is None else pack(held)

    def merge(bodies):
        held = None
        for b in bodies:
            held = merge_two(held, load(b))
        return pack(held)

    n, _, m2 = load(_merged(fit, reduce, merge, 8 * (1 + k + k * k)))
    return float(np.abs(m2 / n - np.eye(k)).max())


# ---- the operator ----------------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null, not empty, and all entries finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def whiten(vectors: DataFrame, id_col="vec_id", vector_col="embedding", most: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    Vectors that are null, empty, or hold null or non-finite entries are left out; so are those of another dimension than most
    rows (the larger of equals). Entries become floor(64 c) + 1000000; each distinct vector counts once in the fit, all rows are
    whitened. Components that have no variance can't be whitened and are left out: there are fewer than ``most`` if the
    dimension or the rank is smaller, and no rows at all if the table is empty or all vectors are alike. Where eigenvalues are
    equal, any basis of their space is taken, the same for all rows. Null or repeated ids are rows like any others. Sums that
    don't fit in 64 bits raise an error instead of wrapping round. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = lambda: spark.createDataFrame([], schema)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return empty()
    d = common["d"]
    small = lambda c: F.abs(c.cast("double")) * SCALE < LIMIT
    whole = F.transform("v", lambda c: F.when(small(c), F.floor(c.cast("double") * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry doesn't fit in 64 bits")).cast("long")))
    rows = rows.filter(F.size("v") == d).select("id", whole.alias("x"))
    fit = written(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit, d)
    directions, values, trace = whitening_directions(_triangle(fit, d, n, sums), n, most)
    k = len(values)
    if k == 0:
        return empty()
    weights = directions / np.sqrt(values)

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        deviations = _deviations(x, n, sums)
        return deviations, (deviations / n) @ weights

    error = _identity_error(fit, d, project, k)

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                deviations, y = project(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_squares(deviations)), lists], names=["id", "deviation", "y"])

    found = rows.mapInArrow(emit, f"id {id_type}, deviation long, y array<double>")
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    found = found.select("id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return found.select("id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
