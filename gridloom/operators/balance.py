"""Network at a point and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import base_values

OFF_TOLERANCE = 1e-5


def network_at(values: DataFrame, equipment: DataFrame, version: int, point: int) -> DataFrame:
    """The equipment table as of a point: mapped values in place of its own. A mapped p0 is all variable load; p0 is the
    sum of both parts; 0/1 values open and close."""
    pick = lambda v: F.max(F.when(F.col("variable") == v, F.col("value"))).alias(f"m_{v}")
    mapped = values.filter((F.col("version") == version) & (F.col("point") == point)).groupBy("id").agg(*map(pick, ("targetP", "minP", "maxP", "p0", "fixedActivePower", "variableActivePower", "disconnected")))
    rows = equipment.join(mapped, "id", "left")
    has_p0 = F.col("m_p0").isNotNull()
    fixed = F.when(has_p0, F.lit(0.0)).otherwise(F.coalesce("m_fixedActivePower", "fixed_p"))
    variable = F.when(has_p0, F.col("m_p0")).otherwise(F.coalesce("m_variableActivePower", "variable_p"))
    closed = F.when(F.col("m_disconnected").isNotNull(), F.abs("m_disconnected") > OFF_TOLERANCE).otherwise(F.col("connected"))
    return rows.select("id", "type", closed.alias("connected"), F.coalesce("m_targetP", "target_p").alias("target_p"), F.coalesce("m_minP", "min_p").alias("min_p"), F.coalesce("m_maxP", "max_p").alias("max_p"), (fixed + variable).alias("p0"), fixed.alias("fixed_p"), variable.alias("variable_p"))


def hvdc_mode(setpoints: DataFrame) -> DataFrame:
    """(version, point, id, setpoint, mode): the sign of a line's power is the converters' mode."""
    mode = F.when(F.col("value") >= 0, "SIDE_1_RECTIFIER_SIDE_2_INVERTER").otherwise("SIDE_1_INVERTER_SIDE_2_RECTIFIER")
    return setpoints.select("version", "point", "id", F.abs("value").alias("setpoint"), mode.alias("mode"))


def _sign():
    return F.when(F.col("type") == "GENERATOR", F.lit(1.0)).when(F.col("type").isin("LOAD", "BOUNDARY_LINE"), F.lit(-1.0)).otherwise(F.lit(0.0))


def constant_balance(equipment: DataFrame, mapping: DataFrame) -> DataFrame:
    """(constant): what unmapped generators, loads (parts that aren't mapped) and boundary lines add."""
    used = mapping.filter(F.col("variable").isin("targetP", "p0", "fixedActivePower", "variableActivePower")).groupBy("id").agg(F.collect_set("variable").alias("v"))
    rows = equipment.filter("connected AND in_main_cc").join(used, "id", "left").withColumn("v", F.coalesce("v", F.array().cast("array<string>")))
    has = lambda n: F.array_contains("v", n)
    generator = F.when((F.col("type") == "GENERATOR") & ~has("targetP"), F.col("target_p"))
    line = F.when((F.col("type") == "BOUNDARY_LINE") & ~has("p0"), -F.col("p0"))
    whole = F.size("v") == 0
    load = F.when((F.col("type") == "LOAD") & whole, -F.col("p0")).when((F.col("type") == "LOAD") & ~has("p0"), -(F.when(has("fixedActivePower"), 0.0).otherwise(F.col("fixed_p")) + F.when(has("variableActivePower"), 0.0).otherwise(F.col("variable_p"))))
    return rows.agg(F.coalesce(F.sum(F.coalesce(generator, line, load, F.lit(0.0))), F.lit(0.0)).alias("constant"))


def balance(values: DataFrame, equipment: DataFrame, mapping: DataFrame) -> DataFrame:
    """(version, point, balance): generation less load and boundary lines of mapped values (NaN counts as the equipment's own)
    plus the constant part. HVDC lines and batteries don't count. Partial sums leave one row per point."""
    own = base_values(equipment, ("targetP", "p0", "fixedActivePower", "variableActivePower")).select("id", "variable", "base")
    power = values.filter(F.col("variable").isin("targetP", "p0", "fixedActivePower", "variableActivePower"))
    rows = power.join(own, ["id", "variable"], "left").withColumn("v", F.when(F.isnan("value"), F.col("base")).otherwise(F.col("value")))
    sums = rows.groupBy("version", "point").agg(F.sum(_sign() * F.col("v")).alias("mapped"))
    return sums.crossJoin(F.broadcast(constant_balance(equipment, mapping))).select("version", "point", (F.col("mapped") + F.col("constant")).alias("balance"))  # constant is one row


def balance_stats(balances: DataFrame) -> DataFrame:
    return balances.groupBy("version").agg(F.min("balance").alias("min"), F.max("balance").alias("max"), F.sum("balance").alias("sum"), F.avg("balance").alias("mean"))


def balance_table(balances: DataFrame, index: DataFrame, versions: list[int]) -> DataFrame:
    """Time and one column per version, in order of time."""
    wide = balances.join(index.select("point", "instant"), "point").groupBy(F.col("instant").alias("Time")).pivot("version", versions).agg(F.first("balance"))
    return wide.select("Time", *[F.col(str(v)).alias(f"Version {v}") for v in versions]).orderBy("Time")
