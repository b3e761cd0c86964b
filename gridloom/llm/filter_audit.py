"""Audit of interacting filters by Lehmer ranks and difference arrays (operator 13).

What a filter removes depends on the filters before it. Documents are first reduced to counts per part and mask, the
set of filters that they fail. In lexicographic order of all orders of the filters, those that begin with the same k letters
stand next to each other: the Lehmer code of the beginning gives their first rank, and there are (m - k)! of them. So all
orders in which a mask is kept by, removed by, or redundant at the k-th filter are a few intervals of ranks. A mask's counts are
added where such an interval begins and subtracted where it ends; one running sum over the ranks gives all totals.

Plan: one scan makes (doc_id, digest, part, mask) without texts; rows with one id meet their labels; copies are counted
per digest, part and mask before they meet the least id of their digest, so that a text that a third of all documents have
is a few rows. From then on there are at most 2^m rows per part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table, written

LETTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"
MEASURES = ["docs", "good", "toxic"]


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that needs no other text: too short, too repetitive, too many capitals, symbols."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": distinct * 100 < n * 50, "C": capitals * 100 > F.length(text) * 2, "D": text.rlike(r"[#$%&*|]")}


def lehmer_rank(beginning: tuple[int, ...], m: int) -> int:
    """The least lexicographic rank of the orders of 0..m-1 with this beginning."""
    rank, left = 0, list(range(m))
    for k, x in enumerate(beginning):
        rank += left.index(x) * factorial(m - 1 - k)
        left.remove(x)
    return rank


def intervals(m: int) -> list[tuple[int, int, str, int, int]]:
    """(mask, step, kind, low, high): the orders of ranks low to high - 1 in which documents of the mask are of that kind at
    the step: kept (fail none of the first), removed (fail this one only), redundant (fail this one and one before it).
    Neighbours are joined, so a kind of a step has fewest intervals."""
    out = []
    for k in range(1, m + 1):
        for beginning in permutations(range(m), k):
            low = lehmer_rank(beginning, m)
            for mask in range(1 << m):
                fails = [mask >> x & 1 for x in beginning]
                kind = "removed" if fails[-1] and not any(fails[:-1]) else "redundant" if fails[-1] else None if any(fails) else "kept"
                if kind:
                    out.append((mask, k, kind, low, low + factorial(m - k)))
    out.sort(key=lambda r: (*r[:3], r[3]))
    joined = out[:1]
    for r in out[1:]:
        if r[:3] == joined[-1][:3] and r[3] == joined[-1][4]:
            joined[-1] = (*joined[-1][:4], r[4])
        else:
            joined.append(r)
    return joined


def mask_counts(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """Written (part, mask, docs, good, toxic): long counts of documents by the set of filters that they fail, bit k for the
    k-th letter. The last filter fails for a text that a smaller id has, too (by SHA-256 of the whole text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(c, 1 << LETTERS.index(x)).otherwise(0) for x, c in conditions(F.col("text")).items()]
    rows = rows.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col(id_col).alias("id"), "quality", "toxic").filter("id IS NOT NULL").groupBy("id").agg(flag("quality"), flag("toxic"))
    met = rows.join(known, "id", "left").select("id", "part", "mask", "digest", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")])
    key = ["digest", "part", "mask", "quality", "toxic"]
    once = met.groupBy("id", *key).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    groups = once.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("no_id"), first)
    groups = written(groups, "copies")
    least = groups.groupBy("digest").agg(F.min("first.id").alias("least"))
    met = groups.join(least, "digest")
    original = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0) + F.coalesce("no_id", F.lit(0))
    both = F.array(F.struct("mask", original.alias("n")), F.struct((F.col("mask") + (1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - original).alias("n")))
    met = met.select("part", "quality", "toxic", F.explode(both).alias("x")).filter("x.n > 0")
    n = F.col("x.n")
    sums = [F.sum(n).alias("docs"), F.sum(F.when(F.col("quality"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")]
    return written(met.groupBy("part", F.col("x.mask").alias("mask")).agg(*sums), "masks")


def _orders(spark: SparkSession) -> list[tuple[int, str, int, int]]:
    """(rank, order, step, bit of the step's filter)"""
    ranked = [(r, "".join(LETTERS[x] for x in p), p) for r, p in enumerate(permutations(range(len(LETTERS))))]
    return [(r, name, k + 1, 1 << x) for r, name, p in ranked for k, x in enumerate(p)]


def audit_filters(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, each of
    the 120 orders of filters A to E, and each of its five steps; all counts are long, zeros included.

    A null text counts as empty (it fails A), a null part as the empty one. E fails where a smaller id has the same whole
    text, wherever it is: null ids are not smaller than others and never fail it; rows that repeat id and text don't fail it for each
    other. A document is good or toxic if any of its rows in ``labels`` says 1; null ids have no labels. Texts may be of any
    length. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    masks = mask_counts(docs, labels, id_col, text_col, part_col)
    ends = spark.createDataFrame([(mask, k, kind, r, s) for mask, k, kind, low, high in intervals(len(LETTERS)) for r, s in ((low, 1), (high, -1))], "mask int, step int, kind string, rank int, sign int")
    orders = spark.createDataFrame(_orders(spark), "rank int, filter_order string, step int, bit int")
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col("sign") * F.col(c)).otherwise(0))
    change = masks.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(  # some 3,000 rows for any table
        of("kept", "docs").alias("kept"), of("removed", "docs").alias("removed"), of("redundant", "docs").alias("redundant"),
        of("removed", "good").alias("good_lost"), of("removed", "toxic").alias("toxic_lost"),
    )
    counts = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
    bits = [1 << k for k in range(len(LETTERS))]
    unique = [F.coalesce(F.sum(F.when(F.col("mask") == b, F.col("docs"))), F.lit(0)).alias(f"only_{b}") for b in bits]
    parts = masks.groupBy("part").agg(*unique)
    alone = F.element_at(F.create_map(*[x for b in bits for x in (F.lit(b), F.col(f"only_{b}"))]), F.col("bit")).alias("unique_fails")
    every = F.array(*[F.lit(k) for k in range(1, len(LETTERS) + 1)])
    grid = parts.withColumn("step", F.explode(every)).join(F.broadcast(orders), "step").select("part", "step", "rank", "filter_order", "bit", alone)
    running = Window.partitionBy("part", "step").orderBy("rank")
    total = grid.join(change, ["part", "step", "rank"], "left").select("part", "filter_order", "step", "bit", "unique_fails", *[F.sum(F.coalesce(c, F.lit(0))).over(running).alias(c) for c in counts])
    total = written(total, "totals")
    shapley = total.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return total.join(shapley, ["part", "bit"]).select("part", "filter_order", "step", *counts[:3], "unique_fails", *counts[3:], "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document under every order, without masks or intervals.
ORACLE_SQL = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS quality, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT d.doc_id, part, coalesce(quality, false) AS quality, coalesce(toxic, false) AS toxic,
                 map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
                      'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, false)} AS fails
          FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
    o(filter_order) AS (
        SELECT '' UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, x)),
    s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE length(filter_order) = 5),
    p AS (
        SELECT part, filter_order, step, filter_order[step] AS letter, quality, toxic, fails[filter_order[step]] AS now,
               len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND fails[x])) > 0 AS gone,
               len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) AS n_fails
        FROM f, s),
    c AS (
        SELECT part, filter_order, step, letter, count(*) FILTER (NOT now AND NOT gone) AS kept, count(*) FILTER (now AND NOT gone) AS removed,
               count(*) FILTER (now AND gone) AS redundant, count(*) FILTER (now AND n_fails = 1) AS unique_fails,
               count(*) FILTER (now AND NOT gone AND quality) AS good_lost, count(*) FILTER (now AND NOT gone AND toxic) AS toxic_lost
        FROM p GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM c"""
