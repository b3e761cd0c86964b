"""Running totals over keys of any size: a window per block of rows, and one over the blocks' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

BLOCK = 65_536

#: How a total before the block joins the one inside of it.
JOIN = {
    "sum": lambda before, own: F.coalesce(before + own, before, own),
    "bit_xor": lambda before, own: F.coalesce(before.bitwiseXOR(own), before, own),
    "max": lambda before, own: F.greatest(before, own),  # nulls are skipped
    "min": lambda before, own: F.least(before, own),
}


def running(rows: DataFrame, keys: list[str], order: str, totals: dict[str, tuple[str, str]], block: Column | None = None, before: bool = False) -> DataFrame:
    """``rows`` with running totals, each name of ``totals`` from (column, one of JOIN), up to and with the row (or, if ``before``, without
    it: null where there is nothing before), by ``keys`` in rising ``order``. Rows are dealt to tasks by ``block``, which must rise with the order; by default ``order``, a whole number from 0
    on, in steps of BLOCK. So a key isn't one task, whatever its size; only blocks' totals are, one row for each."""
    rows = rows.withColumn("scan_block", F.floor(F.col(order) / BLOCK) if block is None else block)
    of = lambda kind, c: getattr(F, kind)(c)
    within = Window.partitionBy(*keys, "scan_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("scan_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "scan_block").agg(*[of(kind, c).alias(f"scan_{name}") for name, (c, kind) in totals.items()])
    sums = sums.select(*keys, "scan_block", *[of(kind, f"scan_{name}").over(earlier).alias(f"scan_{name}") for name, (_, kind) in totals.items()])
    own = rows.select("*", *[of(kind, c).over(within).alias(name) for name, (c, kind) in totals.items()])
    met = own.join(sums, [*keys, "scan_block"])
    return met.select(*[c for c in rows.columns if c != "scan_block"], *[JOIN[kind](F.col(f"scan_{name}"), F.col(name)).alias(name) for name, (_, kind) in totals.items()])


def numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with their number (``name``, a long from 0 on) in rising ``order`` within ``keys``: dealt to tasks by ranges of keys and order, numbered
    there, and moved on by the rows of the key that earlier ranges hold. Sizes of ranges are a row for each key and range."""
    ranged = written(rows.repartitionByRange(*keys, order).withColumn("scan_block", F.spark_partition_id()), "ranges")
    return running(ranged.withColumn("scan_one", F.lit(1).cast("long")), keys, order, {name: ("scan_one", "sum")}, F.col("scan_block"), before=True).withColumn(name, F.coalesce(name, F.lit(0).cast("long"))).drop("scan_one")
