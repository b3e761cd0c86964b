"""Statistics over versions and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import nan
from ..sources.series import computation_range

OVERLOAD_SHARE = 0.3  # fixed value: assumed share of branches in overload


def series_stats(ts: DataFrame, names: list[str] | None = None, ranges=None, versions=None) -> DataFrame:
    """(name, sum, min, max, avg, median) over the chosen versions and point ranges; all if None.

    min and max are NaN if any value is; avg is the mean of the versions' means, each counting once; median is the value
    at place n div 2 (from 0) of all values in order. Per version first, so each shuffle carries one row per version.
    """
    rows = computation_range(ts, versions, ranges)
    if names is not None:
        rows = rows.filter(F.col("name").isin(names))
    spoiled = F.max(F.isnan("value"))
    per = rows.groupBy("name", "version").agg(
        F.sum("value").alias("s"), F.when(spoiled, nan()).otherwise(F.min("value")).alias("lo"), F.when(spoiled, nan()).otherwise(F.max("value")).alias("hi"), F.avg("value").alias("m"))
    spoiled = F.max(F.isnan("lo"))
    total = per.groupBy("name").agg(
        F.sum("s").alias("sum"), F.when(spoiled, nan()).otherwise(F.min("lo")).alias("min"), F.when(spoiled, nan()).otherwise(F.max("hi")).alias("max"), F.avg("m").alias("avg"))
    return total.join(upper_median(rows), "name")


def upper_median(rows: DataFrame) -> DataFrame:
    """(name, median). A first pass finds two values between which the median must be: those at some ranks before and
    behind it, by a sketch whose error in ranks is bounded by a part of that distance. The second counts what is below
    and orders only the distinct values in between, some 1 / 250 of a name's rows."""
    finite = F.nanvl("value", F.lit(float("inf")))  # NaN is larger than any other value, which sketches don't know
    bounds = rows.groupBy("name").agg(F.percentile_approx(finite, [0.498, 0.502], 2_000).alias("b"), F.count("*").alias("n"))
    near = rows.join(bounds, "name").filter(finite <= F.col("b")[1])
    below = F.when(finite < F.col("b")[0], F.lit(None)).otherwise(F.col("value"))
    counts = near.groupBy("name", "n", below.alias("value")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("name").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("name").agg(F.min("value").alias("median"))


def sum_or_zero(ts: DataFrame, names: DataFrame, ranges=None, versions=None) -> DataFrame:
    """(name, sum): 0 where the ranges leave nothing."""
    s = computation_range(ts, versions, ranges).groupBy("name").agg(F.sum("value").alias("s"))
    return names.select("name").distinct().join(s, "name", "left").select("name", F.coalesce("s", F.lit(0.0)).alias("sum"))


def split_constant(ts: DataFrame, mapping: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(version, series, variable, is_constant) of mapped series: constant if the population deviation is under eps.
    Target powers, set points and whatever maps to loads always count as variable."""
    spread = ts.groupBy(F.col("name").alias("series"), "version").agg(F.stddev_pop("value").alias("deviation"))
    used = mapping.select("series", "variable", "type").distinct()
    never = F.col("variable").isin("targetP", "activePowerSetpoint") | (F.col("type") == "LOAD")
    rows = spread.join(used, "series").select("version", "series", "variable", (~never & (F.col("deviation") < eps)).alias("is_constant"))
    return rows.groupBy("version", "series", "variable").agg(F.min("is_constant").alias("is_constant"))


def estimate_results(monitoring: DataFrame, n_threats: int, pre_curative: bool, overload_only: bool) -> DataFrame:
    """(n_results): least number of result series: one per branch with results in N, two per threat and branch with
    results in N-k, and two more with pre-curative results; a share of it if only overloads are kept."""
    n = F.count_if(F.col("mode_n") != "NO")
    nk = F.count_if(F.col("mode_nk") != "NO")
    total = n + 2 * n_threats * nk + (2 * nk if pre_curative else F.lit(0))
    return monitoring.agg((F.round(total * OVERLOAD_SHARE) if overload_only else total).cast("long").alias("n_results"))


def check_result_limit(monitoring: DataFrame, limit: int = 10_000, **params) -> None:
    n = estimate_results(monitoring, **params).first()["n_results"]
    if n > limit:
        raise ValueError(f"some {n} result series, more than the limit of {limit}")
