"""Mixing sources to target weights (operator 3).

Every source gets a share of all words by its weight; a source can be repeated ``max_repeats`` times at most, and
what it can't take goes to the others by weight. A document of a source with repetition rate r is emitted floor(r)
times plus one Bernoulli copy, seeded by the hash of its id, with probability r - floor(r), so reruns agree.

A source of few documents, of which one holds a good part of its words, can't come near its target by draws that know
nothing of each other. The few documents that hold more than 1 / LARGE of their source (less than LARGE, whatever its size) are
therefore drawn first, the largest first, and what a draw gave too much or too little is made up for by the fraction of those that
follow. All other documents are drawn with the fraction that is open after these.

Each document's probability is exactly the source's fraction f. If a document of s words of the w that are left is drawn with the open
fraction p, the next one is q0 where it wasn't taken and q1 where it was. q0 = p w / (w - s) would make up for it wholly; q0 is
held to 1, and to p / (1 - p), and q1 is (p - (1 - p) q0) / p, which is then between 0 and 1. So p q1 + (1 - p) q0 = p: on average
the open fraction never changes, however few documents a source has and however large one of them is.

Plan: one scan of the texts writes (id, size, source) without texts, aggregated by source with partial sums. Source
totals are one row per source; the water level is found by aggregates over them, never on the driver row by row. What
a row needs to know of its source is broadcast; texts aren't shuffled, also not to be emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table, unpacked, whole_row, written

WORD = r"[^\x20\x09-\x0D]+"
LARGE = 512
BROADCAST_SOURCES = 2_000  # rows of a source's totals and draws of large documents: some 30 MB at most


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) in order of code points, null last, without sorting all in one task."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = written(parts, "sources")
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}  # one row per partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before)]
        before += sizes[p]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("rank", (F.element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0)) + within).drop("part")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeats: float = 3.0) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, size). Weights repeat over the sources in order of code points,
    null last. Targets add up to all words; none is over max_repeats times its source's size."""
    totals = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    totals = written(totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))), "weights")
    # Raise the level until no source that is below its cap gets over it. Each round fixes some sources at their caps.
    level = 0.0
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        r = totals.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("used"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        if not r["all"] or not r["open"]:
            break
        rise = (r["all"] - (r["used"] or 0.0)) / r["open"]
        if rise <= level * (1 + 1e-12):
            break
        level = rise
    return totals.select("source", "source_size", "n_rows", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Written (id, source, size)."""
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")), "sizes")


def _chance(column: Column, seed: int) -> Column:
    """Between 0 and 1, by the hash of an id."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _plan(sizes: DataFrame, weights, max_repeats: float, seed: int) -> DataFrame:
    """Written (source, n_rows, plan): a source's size, target, whole copies, draws of its large documents, and the fraction by
    which the others are drawn."""
    targets = written(source_targets(sizes, weights, max_repeats), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(float(max_repeats)))).otherwise(F.lit(1.0))
    targets = targets.withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate"))
    large = _with_source(sizes, targets.select("source", "n_rows", F.struct("source_size").alias("plan")), F.col("source")).filter(F.col("size") * LARGE > F.col("__plan.source_size"))
    large = large.groupBy("source", "id", "size").agg(F.count("*").alias("m")).select("source", F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed + 1), "id").alias("tie"), _chance(F.col("id"), seed).alias("u"), "id", "size", (F.col("size") * F.col("m")).alias("s")).alias("x"))
    large = large.groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list("x")).alias("large"))  # less than LARGE of a source
    both = targets.join(large, F.col("source").eqNullSafe(F.col("of")), "left")
    id_type = sizes.schema["id"].dataType.simpleString()
    missed = "coalesce(least(a.p * a.w / nullif(a.w - x.s, 0), 1D, a.p / nullif(1 - a.p, 0)), a.p)"  # the open fraction where x isn't taken
    taken = f"coalesce((a.p - (1 - a.p) * {missed}) / nullif(a.p, 0), a.p)"
    drawn = f"""aggregate(large, named_struct('p', double(fraction), 'w', double(source_size), 'drawn', cast(array() as array<struct<id:{id_type},size:bigint,drawn:boolean>>)),
        (a, x) -> named_struct('p', greatest(0D, least(1D, if(x.u < a.p, {taken}, {missed}))), 'w', a.w - x.s,
                               'drawn', concat(a.drawn, array(named_struct('id', x.id, 'size', x.size, 'drawn', x.u < a.p)))))"""
    both = both.withColumn("d", F.expr(drawn))
    plan = F.struct("source_size", "target", F.floor("rate").alias("whole"), F.coalesce("d.p", "fraction").alias("rest"), F.col("d.drawn").alias("large"))
    return written(both.select("source", "n_rows", plan.alias("plan")), "plan")


def _with_source(rows: DataFrame, plan: DataFrame, source: Column) -> DataFrame:
    """``rows`` with the column __plan of their source; ``rows`` are this module's own, with columns of its choice. Plans of the sources with most rows are broadcast, BROADCAST_SOURCES at most; so
    no source that is left to a shuffle has more than that part of all rows."""
    p = plan.select(F.col("source").alias("__source"), "n_rows", F.col("plan").alias("__plan"))
    n, total = p.agg(F.count("*"), F.sum("n_rows")).first()
    on = source.eqNullSafe(F.col("__source"))
    join = lambda left, own: left.join(own.drop("n_rows"), on).drop("__source")
    if n <= BROADCAST_SOURCES:
        return join(rows, F.broadcast(p))
    many = F.broadcast(p.filter(F.col("n_rows") > total / BROADCAST_SOURCES))
    return join(rows, many).unionByName(join(rows.join(many, on, "left_anti"), p))


def _copies(id_column: Column, size: Column, seed: int) -> Column:
    own = F.filter("__plan.large", lambda x: x["id"].eqNullSafe(id_column) & (x["size"] == size))
    large = F.when(size * LARGE > F.col("__plan.source_size"), F.get(own, F.lit(0))["drawn"])
    return F.col("__plan.whole") + F.coalesce(large, _chance(id_column, seed) < F.col("__plan.rest")).cast("long")


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), max_repeats=3.0, seed=17) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each document.

    Null or empty texts have size 0 and may be emitted as any other; texts may be of any length. A null source is a source of
    its own, last in order. Rows of a source with equal ids and sizes (null ids too) are taken alike; ties in size are
    drawn in order of another hash. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    joined = _with_source(sizes, _plan(sizes, weights, max_repeats, seed), F.col("source"))
    return joined.select("id", "source", "size", "__plan.source_size", "__plan.target", _copies(F.col("id"), F.col("size"), seed).alias("copies"))


def take_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), max_repeats=3.0, seed=17) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as mix_sources says, with all their columns, whatever their names;
    repeated rows are emitted for each. Nulls, empty and long texts, ties and empty tables are as mix_sources says."""
    plan = _plan(_sizes(docs, id_col, text_col, source_col), weights, max_repeats, seed)
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    copies = _copies(F.col("id"), F.col("size"), seed).cast("int")
    mixed = _with_source(rows, plan, F.col("source")).select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
    return unpacked(mixed, docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))
