"""Joins whose keys may hold a large share of all rows, and small tables that make many rows of each of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD_ROWS = 256  # of one key in one task, where keys have more
BROADCAST_BYTES = 32 << 20
MADE_ROWS = 1 << 18  # by one task of a small table


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join of ``left``, a written table, to ``right`` with one row per key. A key that more than SPREAD_ROWS rows of
    ``left`` have is dealt to several tasks, by a hash of the column ``by``: the row of ``right`` is repeated for each. Keys that
    are dealt are broadcast; of R rows, not more than R / SPREAD_ROWS are, and where these could exceed BROADCAST_BYTES
    only larger keys are dealt. Rows with a null key drop out."""
    total = left.count()
    rows = max(SPREAD_ROWS, total * 64 // BROADCAST_BYTES)
    if total <= rows:
        return left.join(right, keys)
    counts = left.groupBy(*keys).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > rows)
    dealt = F.broadcast(counts.select(*keys, F.ceil(F.col("__rows") / rows).cast("int").alias("__parts")))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))
    left = left.join(dealt, keys, "left").withColumn("__part", part).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    right = right.join(dealt, keys, "left").withColumn("__part", copies).drop("__parts")
    return left.join(right, [*keys, "__part"]).drop("__part")


def dealt(df: DataFrame, times: int, *by: str) -> DataFrame:
    """``df`` before each of its rows becomes ``times`` rows: dealt by a hash of ``by`` to as many tasks as make MADE_ROWS rows each.
    The files of a small table, or the few partitions that Spark makes of it, would make all rows in one task."""
    rows = df.count()
    tasks = -(-rows * max(times, 1) // MADE_ROWS)
    return df.repartition(min(tasks, rows), *by) if tasks > 1 else df


def beside(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows for a join with a dealt table: broadcast if small, lest Spark broadcast the dealt one, if that is
    smaller still, and make all rows in the tasks of ``df``."""
    return F.broadcast(df) if rows * 64 <= BROADCAST_BYTES else df
