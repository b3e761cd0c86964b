"""Near-duplicates of embeddings by product quantisation (operator 11).

1. Equal vectors become one, with a count (partial aggregation). Coarse centroids and, for their residuals, one codebook for
   every four dimensions are fitted on a bounded sample; every vector is assigned to the inverted list of its nearest centroid.
2. Inside a list, chunks of bounded size are cut into balls: vectors within half of the largest linking angle around one of
   them. By the triangle inequality all members of a ball link, so that a group of near copies, be it a third of all
   rows, becomes one ball for each of its chunks, and its pairs are counted, never made. Most balls hold one vector.
3. Centres are coded: list, residual codes, and the length of what the code leaves over. A query reads the lists that its
   neighbours may be in: the distance to the plane between two centroids decides, see PROBE_WIDTH. In a list, distances come
   from tables per query and codebook. A code's own error is added to the limit, so in the lists read no link is lost.
4. Candidates meet their exact vectors there: cosine in double precision. Two balls link wholly, not at all, or, if angles leave that
   open, member by member in a task of its own. A task passes on counts and a spanning forest of what it linked, no pairs.
5. Counts are added up over balls; components of balls are found by joins. Nothing but the model's sample, widest balls
   of lists and counts reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from .common import spread_join, table, written
from .whitening import usable

FIT_BYTES = 32 << 20  # of the sample that centroids and codebooks are fitted on, as float32
FIT_PER_LIST = 32  # rows of that sample, for each list
MAX_LISTS = 8192
CODES, CODE_DIMS = 256, 4
CHUNK, QUERIES = 2048, 8192  # rows of a list and queries to it in one task
LEAST_BALL = 8  # members, and half of what its centre links with: other balls would leave more pairs open than they settle
SLICE = 1 << 16  # candidates that meet their vectors at once
#: A query reads the list of another centroid if the plane between that one and its own is no farther than this many standard
#: deviations of a linking difference of random direction; with the root of the dimension no list with a link would be left out.
PROBE_WIDTH = 3.0
SLACK = 1e-7


def picked(x: np.ndarray, k: int) -> np.ndarray:
    """k different rows of x (fewer if it has fewer), by a fixed seed."""
    distinct = np.unique(x, axis=0) if len(x) <= 4 * k else x
    return distinct[np.sort(np.random.default_rng(7).choice(len(distinct), min(k, len(distinct)), replace=False))]


def thinned(x: np.ndarray, apart: float) -> np.ndarray:
    """Rows of x, in order, that are ``apart`` or more from all that were kept before."""
    kept, n = np.empty_like(x), 0
    for row in x:
        if not n or ((kept[:n] - row) ** 2).sum(axis=1).min() >= apart * apart:
            kept[n], n = row, n + 1
    return kept[:n]


def lloyd(x: np.ndarray, start: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Centroids of x from the ones to start with."""
    x, centres = np.ascontiguousarray(x, np.float32), start.astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        order = np.argsort(own, kind="stable")
        lists, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order].astype(np.float64), starts, axis=0)
        centres[lists] = sums / np.diff(np.r_[starts, len(own)])[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, and the squared distance to it without the square of x."""
    own, score = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    squares = (centres * centres).sum(axis=1)
    for at in range(0, len(x), rows):
        s = squares - 2 * (x[at : at + rows] @ centres.T)
        own[at : at + rows] = s.argmin(axis=1)
        score[at : at + rows] = s.min(axis=1)
    return own, score


class Model:
    """Coarse centroids, and codebooks of the residuals, each for CODE_DIMS dimensions; the last ones padded by zeros."""

    def __init__(self, sample: np.ndarray, n_lists: int, apart: float):
        """Centroids are ``apart`` at least, so that a group of near copies lies in a few lists, not in a third of them."""
        self.d = sample.shape[1]
        start = thinned(picked(sample, 2 * n_lists), apart)[:n_lists]
        self.centres = thinned(lloyd(sample, start), apart)
        residuals = self.split(sample - self.centres[nearest(sample, self.centres)[0]])
        books = [lloyd(residuals[:, s], picked(residuals[:, s], CODES)) for s in range(residuals.shape[1])]
        self.books = np.stack([np.vstack([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in books])

    def split(self, x: np.ndarray) -> np.ndarray:
        parts = -(-self.d // CODE_DIMS)
        return np.pad(x.astype(np.float32), ((0, 0), (0, parts * CODE_DIMS - self.d))).reshape(len(x), parts, CODE_DIMS)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what they leave over)"""
        residuals = self.split(x - self.centres[own])
        codes = np.stack([nearest(residuals[:, s], b)[0] for s, b in enumerate(self.books)], axis=1).astype(np.uint8)
        left = residuals - np.stack([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt((left.astype(np.float64) ** 2).sum(axis=(1, 2)))

    def probes(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray, width: float) -> list[np.ndarray]:
        """The lists that each row reads: its own, and those whose plane is within ``reach`` (a distance per row and list) times
        width / sqrt(d)."""
        squares = (self.centres**2).sum(axis=1)
        out = []
        for at in range(0, len(x), 256):
            q, mine = x[at : at + 256].astype(np.float32), own[at : at + 256]
            score = squares - 2 * (q @ self.centres.T)
            between = np.sqrt(np.maximum(squares + squares[mine][:, None] - 2 * (self.centres[mine] @ self.centres.T), 1e-12))
            rows = np.arange(len(q))
            plane = (score - score[rows, mine][:, None]) / (2 * between)
            plane[rows, mine] = -np.inf
            near = plane <= reach[at : at + 256] * width / math.sqrt(self.d)
            out += [np.flatnonzero(r) for r in near]
        return out

    def distances(self, q: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded rows of a list, summed from a table per query and codebook."""
        residuals = self.split(q - self.centres[centre])
        out = np.zeros((len(q), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            own = residuals[:, s]
            lookup = (own * own).sum(axis=1)[:, None] - 2 * (own @ book.T) + (book * book).sum(axis=1)
            out += lookup[:, codes[:, s]]
        return out


def unit_rows(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of length 1 in double precision; the largest entry is divided out first, so that nothing over- or underflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _chord(angle):
    return 2 * np.sin(np.minimum(angle, math.pi) / 2)


def _dealt(rows: DataFrame, sizes: DataFrame, own: str, rows_each: int, other: str, other_each: int, mine: str, theirs: str) -> DataFrame:
    """``rows`` of lists with the number of their part, repeated for all parts of the other side."""
    parts = lambda c, each: F.ceil(F.greatest(F.col(c), F.lit(1)) / each).cast("int")
    met = rows.join(F.broadcast(sizes), "list")  # one row per list, MAX_LISTS at most
    met = met.withColumn(mine, F.pmod(F.xxhash64("unit"), parts(own, rows_each)).cast("int"))
    met = met.withColumn(theirs, F.explode(F.sequence(F.lit(0), parts(other, other_each) - 1))).drop(own, other)
    return met.toDF(*met.columns)  # columns of its own, for both sides come from one table


def _balls(vectors: DataFrame, d: int, cosine: float) -> DataFrame:
    """Written (list, at, m, least, v, unit, centre, radius): members of balls; ``unit`` is the centre's ``at``, radius the largest
    angle to the centre, for centres only."""
    half = math.cos(math.acos(cosine) / 2 - SLACK)
    sizes = vectors.groupBy("list").agg(F.count("*").alias("rows"))
    part = F.pmod(F.xxhash64("at"), F.ceil(F.col("rows") / CHUNK)).cast("int")
    dealt = vectors.join(F.broadcast(sizes), "list").withColumn("part", part).drop("rows")

    def cut(group: pa.Table) -> pa.Table:
        x = unit_rows(group.column("v"), d)
        at = group.column("at").to_numpy()
        cosines = x @ x.T
        close, link = cosines >= half, cosines >= cosine
        unit, radius = np.arange(len(x)), np.zeros(len(x))
        crowded = close.sum(axis=1)
        free = np.ones(len(x), bool)
        for k in np.lexsort((at, -crowded)):
            if crowded[k] < LEAST_BALL:
                break
            own = np.flatnonzero(close[k] & free)
            if free[k] and len(own) >= max(LEAST_BALL, (link[k] & free).sum() / 2):
                unit[own] = k
                free[own] = False
                radius[k] = np.arccos(np.clip(x[own] @ x[k], -1.0, 1.0)).max()
        centre = unit == np.arange(len(x))
        names = ["list", "at", "m", "least", "v"]
        return pa.table([*[group.column(c) for c in names], pa.array(at[unit]), pa.array(centre), pa.array(radius)], names=[*names, "unit", "centre", "radius"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"list int, at long, m long, least {kinds['least']}, v {kinds['v']}, unit long, centre boolean, radius double"
    return written(dealt.groupBy("list", "part").applyInArrow(cut, schema), "balls")


class Forest:
    """Which of a task's rows queries have connected so far; says which links connect more, so that a task passes on no more
    links than it has rows and queries."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def new(self, rows: np.ndarray) -> np.ndarray:
        """Of the rows that one query links with, one of each component; these become one."""
        labels, first = np.unique(self.label[rows], return_index=True)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return rows[first]


def _cosines(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs (i, j), sorted by i. Where a fifth of a block's pairs are asked for, a product of the block costs less."""
    if len(i) and 5 * len(i) > (i[-1] - i[0] + 1) * len(x):
        return (q[i[0] : i[-1] + 1] @ x.T)[i - i[0], j]
    return np.concatenate([np.empty(0), *(np.einsum("kd,kd->k", q[i[k : k + SLICE]], x[j[k : k + SLICE]]) for k in range(0, len(i), SLICE))])


def _search(coded: DataFrame, model, d: int, cosine: float) -> DataFrame:
    """Written (unit, n, edges, mixed): to how many rows of other balls all members of a ball link, links that connect it, and the
    balls with which only some members may link. A ball's rows come from as many tasks as it has asked."""
    theta = math.acos(cosine)
    queries = coded.select(F.explode("probes").alias("list"), "unit", "radius", "v")
    data = coded.select("list", "unit", "radius", "m", "v", "codes", "error")
    sizes = written(data.groupBy("list").agg(F.count("*").alias("n_data")).join(queries.groupBy("list").agg(F.count("*").alias("n_queries")), "list"), "lists")
    data = _dealt(data, sizes, "n_data", CHUNK, "n_queries", QUERIES, "dp", "qp")
    queries = _dealt(queries, sizes, "n_queries", QUERIES, "n_data", CHUNK, "qp", "dp")
    key = ["list", "dp", "qp"]
    longs = pa.list_(pa.int64())

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            m, column = model.value, lambda t, c: t.column(c).to_numpy()
            x, q = unit_rows(rows.column("v"), d), unit_rows(asked.column("v"), d)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            unit, radius, count, error = (column(rows, c) for c in ("unit", "radius", "m", "error"))
            q_unit, q_radius = (column(asked, c) for c in ("unit", "radius"))
            centre, forest = rows.column("list")[0].as_py(), Forest(len(x))
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                limit = _chord(theta + radius + q_radius[part][:, None]) + error + 1e-4
                i, j = np.nonzero(m.distances(q[part], centre, codes) <= limit * limit)
                i += at
                keep = q_unit[i] != unit[j]
                i, j = i[keep], j[keep]
                cos = _cosines(q, x, i, j)
                both = q_radius[i] + radius[j]
                angle = np.arccos(np.clip(cos, -1.0, 1.0))
                every = np.where(both == 0, cos >= cosine, angle + both <= theta - SLACK)
                some = (both > 0) & ~every & (angle - both <= theta + SLACK)
                for k in np.unique(i[every | some]):
                    own = slice(*np.searchsorted(i, [k, k + 1]))
                    whole, open_ = j[own][every[own]], j[own][some[own]]
                    out.append((q_unit[k], count[whole].sum(), unit[forest.new(whole)], unit[open_]))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), longs, longs))], names=["unit", "n", "edges", "mixed"])

    found = data.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(meet, "unit long, n long, edges array<bigint>, mixed array<bigint>")
    return written(found, "found")


def _member_links(mixed: DataFrame, members: DataFrame, d: int, cosine: float) -> DataFrame:
    """Written (a, b, at, n): for pairs of balls that link in part, the members with links across, and to how many rows."""
    ends = mixed.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    packed = members.join(ends, "unit").groupBy("unit").agg(F.collect_list(F.struct("at", "m", "v")).alias("rows"))  # CHUNK at most
    packed = written(packed, "packed")
    side = lambda c: packed.select(F.col("unit").alias(c), F.col("rows").alias(f"rows_{c}"))
    met = spread_join(written(spread_join(mixed.select("a", "b"), side("a"), ["a"], "b"), "halves"), side("b"), ["b"], "a")

    def compare(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k] for c in ("a", "b", "rows_a", "rows_b")}
                rows = [one[c].values for c in ("rows_a", "rows_b")]
                x, y = (unit_rows(r.field("v"), d) for r in rows)
                link = x @ y.T >= cosine
                for own, other, hit in ((*rows, link), (*rows[::-1], link.T)):
                    n = hit @ other.field("m").to_numpy()
                    some = n > 0
                    for c, v in zip(out, (np.full(some.sum(), one["a"].as_py()), np.full(some.sum(), one["b"].as_py()), own.field("at").to_numpy()[some], n[some])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["a", "b", "at", "n"])

    return written(met.select("a", "b", "rows_a", "rows_b").mapInArrow(compare, "a long, b long, at long, n long"), "across")


def _classes(vectors: DataFrame, d: int, cosine: float, width: float) -> DataFrame:
    """(v, n_links, component) per distinct vector of ``vectors`` (at, v, m, least), all of dimension d."""
    spark = vectors.sparkSession
    n = vectors.count()
    n_lists = max(1, min(MAX_LISTS, int(2 * math.sqrt(n)), FIT_BYTES // (4 * d * FIT_PER_LIST)))
    share = min(1.0, n_lists * FIT_PER_LIST / n)
    sample = vectors.filter(F.pmod(F.xxhash64(F.lit(5), "at"), F.lit(1 << 52)) < int(share * (1 << 52)) + 1).select("v").toArrow()
    if not sample.num_rows:
        sample = vectors.select("v").limit(1).toArrow()
    model = spark.sparkContext.broadcast(Model(unit_rows(sample.column("v"), d).astype(np.float32), n_lists, float(_chord(math.acos(cosine)))))
    v_type, id_type = vectors.schema["v"].dataType.simpleString(), vectors.schema["least"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            own = nearest(unit_rows(batch.column("v"), d).astype(np.float32), model.value.centres)[0]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names=["list", *batch.schema.names])

    listed = written(vectors.select("at", "v", "m", "least").mapInArrow(assign, f"list int, at long, v {v_type}, m long, least {id_type}"), "listed")
    members = _balls(listed, d, cosine)
    totals = written(members.groupBy("unit").agg(F.sum("m").alias("m"), F.min("least").alias("least")), "totals")
    centres = members.filter("centre").select("list", "unit", "radius", "v").join(totals.select("unit", "m"), "unit")
    theta, widest = math.acos(cosine), np.zeros(len(model.value.centres))
    for r in members.filter("radius > 0").groupBy("list").agg(F.max("radius").alias("radius")).collect():  # MAX_LISTS at most
        widest[r["list"]] = r["radius"]

    def encode(batches):
        for batch in batches:
            x = unit_rows(batch.column("v"), d)
            own, radius = batch.column("list").to_numpy().astype(np.int64), batch.column("radius").to_numpy()
            codes, error = model.value.encode(x, own)
            lists = model.value.probes(x, own, _chord(theta + radius[:, None] + widest), width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "codes", "error", "probes"],
            )

    coded = centres.select("list", "unit", "radius", "m", "v").mapInArrow(encode, f"list int, unit long, radius double, m long, v {v_type}, codes binary, error double, probes array<int>")
    asked = _search(written(coded, "coded"), model, d, cosine)
    mixed = asked.select("unit", F.explode("mixed").alias("other"))
    mixed = written(mixed.select(F.least("unit", "other").alias("a"), F.greatest("unit", "other").alias("b")).distinct(), "mixed")
    across = _member_links(mixed, members, d, cosine) if mixed.limit(1).count() else None
    edges = asked.select(F.col("unit").alias("a"), F.explode("edges").alias("b"))
    if across is not None:
        edges = edges.union(across.select("a", "b").distinct())
    labels = connected_components(edges, "a", "b", spread=True).select(F.col("node").alias("unit"), "component")
    other = asked.groupBy("unit").agg(F.sum("n").alias("others"))
    units = totals.join(labels, "unit", "left").join(other, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    units = written(units, "units")
    least = units.groupBy("component").agg(F.min("least").alias("component_id"))
    units = spread_join(units, least, ["component"], "unit").select("unit", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("own_links"), "component_id")
    found = spread_join(members.select("unit", "at", "v"), units, ["unit"], "at")
    if across is None:
        return found.select("v", F.col("own_links").alias("n_links"), "component_id")
    found = found.join(across.groupBy("at").agg(F.sum("n").alias("n")), "at", "left")
    return found.select("v", (F.col("own_links") + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")


def near_vectors(vectors: DataFrame, id_col="vec_id", vector_col="embedding", cosine: float = 0.9, width: float = PROBE_WIDTH) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``: rows link when their cosine, in double precision, is ``cosine`` at
    least; n_links counts all linked rows, copies too; component_id is the smallest id reachable by links, its own included.

    Vectors that are null, empty, zero, or hold null or non-finite entries link with nothing, and so do vectors of different
    dimensions; both are their own component. Repeated rows link with each other. Null ids are rows like any others: a component of
    null ids only has a null component_id, and a null id is kept if its component's is null, too. Centroids and codebooks are
    fitted on a sample (FIT_PER_LIST rows a list, FIT_BYTES at most), all rows are indexed and searched. ``width`` sets
    which lists are read (PROBE_WIDTH); tests measure the recall. An empty table gives no rows. Other columns are left out.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    fine = F.coalesce(usable(F.col("v")), F.lit(False)) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    distinct = rows.filter(fine).groupBy("v").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    distinct = written(distinct.withColumn("at", F.monotonically_increasing_id()), "vectors")
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    out = rows.filter(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for d in sorted(r["d"] for r in distinct.select(F.size("v").alias("d")).distinct().collect()):
        classes = _classes(distinct.filter(F.size("v") == d), d, cosine, width)
        found = spread_join(rows.filter(fine & (F.size("v") == d)), written(classes, "classes"), ["v"], "id")
        out = out.unionByName(found.select("id", "n_links", "component_id", kept))
    return out


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
