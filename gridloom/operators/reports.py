"""Reports on a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import VARIABLES, base_values
from .stats import series_stats


def mapping_synthesis(status: DataFrame, matches: DataFrame, ignored: DataFrame, types: list[str]) -> DataFrame:
    """Synthesis and one count per type: mapped by default variables, unmapped, mapped more than once, left out on purpose,
    disconnected, out of the main component."""
    default = F.col("variable").isin([v[0] for v in VARIABLES.values()])
    mapped = matches.filter(default).select("type", "id", F.lit("Mapped").alias("Synthesis")).distinct()
    multi = matches.filter(default).groupBy("type", "id", "variable").count().filter("count > 1").select("type", "id", F.lit("Multi-mapped").alias("Synthesis")).distinct()
    left = ignored.select("type", "id", F.lit("Ignored unmapped").alias("Synthesis"))
    other = status.filter("status <> 'unmapped'").select("type", "id", F.when(F.col("status") == "disconnected", "Disconnected").otherwise("Out of main cc").alias("Synthesis"))
    unmapped = status.filter("status = 'unmapped'").join(matches.filter(default).select("id").distinct(), "id", "left_anti").join(ignored.select("id"), "id", "left_anti").select("type", "id", F.lit("Unmapped").alias("Synthesis"))
    rows = mapped.unionByName(unmapped).unionByName(multi).unionByName(left).unionByName(other)
    return rows.groupBy("Synthesis").agg(*[F.count_if(F.col("type") == t).alias(t) for t in types])


def series_report(mapping: DataFrame, ts: DataFrame, equipment: DataFrame) -> DataFrame:
    """(series, type, variable, min_power, max_power, average_power, network_power, equipment)."""
    base = base_values(equipment).select("id", "variable", "base")
    rows = mapping.join(base, ["id", "variable"], "left").groupBy("series", "type", "variable").agg(F.sum("base").alias("network_power"), F.concat_ws(",", F.array_sort(F.collect_list("id"))).alias("equipment"))
    stats = series_stats(ts).select(F.col("name").alias("series"), F.col("min").alias("min_power"), F.col("max").alias("max_power"), F.col("avg").alias("average_power"))
    return rows.join(stats, "series").select("series", "type", "variable", "min_power", "max_power", "average_power", "network_power", "equipment")


def equipment_report(matches: DataFrame, equipment: DataFrame) -> DataFrame:
    """(id, variable, status, applied, unused, network_power) from last_rule_wins: network_power is that of all equipment of
    the applied series."""
    of = matches.groupBy("id", "type", "variable").agg(F.max(F.when(F.col("applied"), F.col("series"))).alias("applied"), F.array_sort(F.collect_list(F.when(~F.col("applied"), F.struct("rule_id", "series")))).alias("u"), F.count("*").alias("n"))
    power = matches.filter("applied").join(base_values(equipment).select("id", "variable", "base"), ["id", "variable"], "left").groupBy(F.col("series").alias("applied"), "type", "variable").agg(F.sum("base").alias("network_power"))
    return of.join(power, ["applied", "type", "variable"]).select("id", "variable", F.when(F.col("n") > 1, "Multi-mapped").otherwise("Mapped").alias("status"), "applied", F.concat_ws(",", F.transform("u", lambda x: x["series"])).alias("unused"), "network_power")


def status_sets(status: DataFrame, equipment: DataFrame, mapping: DataFrame, ignored: DataFrame) -> DataFrame:
    """(status, type, id, target_p, min_p, max_p, p0) of equipment that isn't mapped, less what is left out on purpose."""
    rows = status.join(mapping.select("id").distinct(), "id", "left_anti").join(ignored.select("id"), "id", "left_anti")
    return rows.join(equipment.select("id", "target_p", "min_p", "max_p", "p0"), "id").select("status", "type", "id", "target_p", "min_p", "max_p", "p0")


def source_series(mapping: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(series, type, variable, source): the stored series behind mapped ones and key series."""
    keys = mapping.filter("key_series IS NOT NULL").select(F.col("key_series").alias("series"), "type", F.concat("variable", F.lit(" key")).alias("variable"))
    rows = mapping.select("series", "type", "variable").unionByName(keys).distinct()
    return rows.join(dependencies.withColumnRenamed("name", "series"), "series", "left").select("series", "type", "variable", F.coalesce("needs", "series").alias("source"))
