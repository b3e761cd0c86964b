"""Correction of mapped powers against limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import running

TOLERANCE = 1e-4


def _outcome(value, change=None, violation=None):
    text = lambda x: F.lit(x).cast("string") if not hasattr(x, "cast") else x.cast("string")
    return F.struct(value.cast("double").alias("corrected"), text(change).alias("change"), text(violation).alias("violation"))


def with_limits(merged: DataFrame, equipment: DataFrame) -> DataFrame:
    """Rows of merge_power with the limits in force (mapped, else the equipment's), and its own power for unmapped ones."""
    own = equipment.select("id", F.col("min_p").alias("base_min"), F.col("max_p").alias("base_max"), F.col("target_p").alias("base_p"))
    rows = merged.join(own, "id")
    return rows.withColumn("min_p", F.coalesce("min_p_mapped", "base_min")).withColumn("max_p", F.coalesce("max_p_mapped", "base_max"))


def invalid_limits(rows: DataFrame) -> DataFrame:
    """(version, point, id, min_p, max_p) where the limits contradict each other: an error in a mapping run."""
    return rows.filter("min_p > max_p").select("version", "point", "id", "min_p", "max_p")


def correct_limits(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Generators and batteries: ``rows`` (see with_limits) with corrected, change and violation.

    A mapped power within tolerance of a limit it keeps is set tolerance inside it; then what is over goes to the
    maximum, what is under a minimum that isn't positive to the minimum, what is negative under a positive minimum to 0;
    a positive power under a positive minimum stays and is a violation. With ignored limits an equipment's own limits
    give way to the power, mapped ones don't. An unmapped power is corrected by the same limits (E19). One projection.
    """
    is_mapped = F.col("p").isNotNull()
    asked = F.coalesce("p", "base_p")
    low, high, tol = F.col("min_p"), F.col("max_p"), F.lit(tolerance)
    ok_max, ok_min = asked <= high + tol, asked >= low - tol
    snapped = F.when(~F.col("ignore_limits") & is_mapped & ok_max & (asked >= high - tol), high - tol).when(~F.col("ignore_limits") & is_mapped & ok_min & (asked <= low + tol), low + tol).otherwise(asked)
    m_max, m_min, zero = F.col("max_p_mapped").isNotNull(), F.col("min_p_mapped").isNotNull(), F.lit(0.0)
    side = lambda mapped, a, b: F.when(mapped, a).otherwise(b)
    unmapped = F.when(~ok_max, _outcome(high, "UNMAPPED_TO_MAXP")).when(~ok_min & (low <= 0), _outcome(low, "UNMAPPED_TO_MINP")).when(~ok_min & (asked < 0), _outcome(zero, "UNMAPPED_TO_ZERO")).when(~ok_min, _outcome(asked, None, "MINP_BY_UNMAPPED_P")).otherwise(_outcome(asked))
    enforced = (
        F.when(~ok_max, _outcome(high, side(m_max, "MAPPED_MAXP", "BASE_CASE_MAXP")))
        .when(~ok_min & (low <= 0), _outcome(low, side(m_min, "MAPPED_MINP", "BASE_CASE_MINP")))
        .when(~ok_min & (asked < 0), _outcome(zero, "ZERO"))
        .when(~ok_min, _outcome(snapped, None, side(m_min, "MAPPED_MINP_BY_TARGETP", "BASE_CASE_MINP_BY_TARGETP")))
        .otherwise(_outcome(snapped))
    )
    ignored = (
        F.when(~ok_max & ~m_max, _outcome(asked, None, "MAXP_BY_TARGETP"))
        .when(~ok_max, _outcome(high, "MAPPED_MAXP_DISABLED"))
        .when(~ok_min & (low <= 0) & ~m_min, _outcome(asked, None, "MINP_BY_TARGETP"))
        .when(~ok_min & (low <= 0), _outcome(low, "MAPPED_MINP_DISABLED"))
        .when(~ok_min & (asked < 0), _outcome(zero, "ZERO_DISABLED"))
        .otherwise(enforced)
    )
    done = F.when(~is_mapped, unmapped).when(F.col("ignore_limits"), ignored).otherwise(enforced)
    return rows.withColumn("done", done).select(*rows.columns, asked.alias("asked"), "done.corrected", "done.change", "done.violation")


def hvdc_limits(hvdc: DataFrame) -> DataFrame:
    """(id, base_min, base_max, base_p, has_range): the operator's range where given, else the maximum both ways."""
    has = F.col("range_cs12").isNotNull() & F.col("range_cs21").isNotNull()
    return hvdc.select("id", F.when(has, -F.col("range_cs21")).otherwise(-F.col("max_p")).alias("base_min"), F.when(has, F.col("range_cs12")).otherwise(F.col("max_p")).alias("base_max"), F.col("setpoint").alias("base_p"), has.alias("has_range"))


def correct_hvdc(merged: DataFrame, hvdc: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """HVDC lines: as correct_limits, but a minimum binds whatever its sign, and codes tell ranges from maxima."""
    rows = merged.join(hvdc_limits(hvdc), "id").withColumn("min_p", F.coalesce("min_p_mapped", "base_min")).withColumn("max_p", F.coalesce("max_p_mapped", "base_max"))
    is_mapped, asked = F.col("p").isNotNull(), F.coalesce("p", "base_p")
    low, high, tol = F.col("min_p"), F.col("max_p"), F.lit(tolerance)
    ok_max, ok_min = asked <= high + tol, asked >= low - tol
    snapped = F.when(~F.col("ignore_limits") & is_mapped & ok_max & (asked >= high - tol), high - tol).when(~F.col("ignore_limits") & is_mapped & ok_min & (asked <= low + tol), low + tol).otherwise(asked)
    m_max, m_min, ranged = F.col("max_p_mapped").isNotNull(), F.col("min_p_mapped").isNotNull(), F.col("has_range")
    either = lambda c, a, b: F.when(c, a).otherwise(b)
    unmapped = F.when(~ok_max, _outcome(high, "UNMAPPED_TO_MAXP")).when(~ok_min, _outcome(low, "UNMAPPED_TO_MINP")).otherwise(_outcome(asked))
    enforced = (
        F.when(~ok_max, _outcome(high, F.when(m_max, "MAPPED_MAXP").otherwise(either(ranged, "BASE_CASE_CS1TOCS2", "BASE_CASE_MAXP"))))
        .when(~ok_min, _outcome(low, F.when(m_min, "MAPPED_MINP").otherwise(either(ranged, "BASE_CASE_CS2TOCS1", "BASE_CASE_MINUS_MAXP"))))
        .otherwise(_outcome(snapped))
    )
    ignored = (
        F.when(~ok_max & ~m_max, _outcome(asked, None, either(ranged, "CS1TOCS2_BY_ACTIVEPOWER", "MAXP_BY_ACTIVEPOWER")))
        .when(~ok_max, _outcome(high, "MAPPED_MAXP_DISABLED"))
        .when(~ok_min & ~m_min, _outcome(asked, None, either(ranged, "CS2TOCS1_BY_ACTIVEPOWER", "MINP_BY_ACTIVEPOWER")))
        .when(~ok_min, _outcome(low, "MAPPED_MINP_DISABLED"))
        .otherwise(_outcome(asked))
    )
    done = F.when(~is_mapped, unmapped).when(F.col("ignore_limits"), ignored).otherwise(enforced)
    return rows.withColumn("done", done).select(*rows.columns, asked.alias("asked"), "done.corrected", "done.change", "done.violation")


def extend_limits(rows: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """((version, point, id, min_limit, max_limit), (version, id, side, base_limit, limit, n_violations)) where limits are ignored: an equipment's own limits grow
    to the largest and smallest power so far; at the point itself they are the next whole number beyond it."""
    own = rows.filter("ignore_limits AND p IS NOT NULL")
    open_max, open_min = F.col("max_p_mapped").isNull(), F.col("min_p_mapped").isNull() & (F.col("base_min") <= 0)
    own = own.withColumn("up_p", F.when(open_max, F.col("p"))).withColumn("down_p", F.when(open_min, F.col("p")))
    own = running(own, ["version", "id"], "point", {"most": ("up_p", "max"), "least": ("down_p", "min")}, before=True)
    own = own.withColumn("high", F.greatest("base_max", F.coalesce("most", "base_max"))).withColumn("low", F.least("base_min", F.coalesce("least", "base_min")))
    at = own.select(
        "version", "point", "id",
        F.when(open_min & (F.col("p") < F.col("low") - tolerance), F.floor(F.col("p") - 0.5).cast("double")).otherwise(F.col("low")).alias("min_limit"),
        F.when(open_max & (F.col("p") > F.col("high") + tolerance), F.floor(F.col("p") + 1.0).cast("double")).otherwise(F.col("high")).alias("max_limit"))
    up = own.filter(open_max).groupBy("version", "id").agg(F.lit("max").alias("side"), F.first("base_max").alias("base_limit"), F.max("p").alias("limit"), F.count_if(F.col("p") > F.col("base_max")).alias("n_violations")).filter(F.col("limit") > F.col("base_limit") + tolerance)
    down = own.filter(open_min).groupBy("version", "id").agg(F.lit("min").alias("side"), F.first("base_min").alias("base_limit"), F.min("p").alias("limit"), F.count_if(F.col("p") < F.col("base_min")).alias("n_violations")).filter(F.col("limit") < F.col("base_limit") - tolerance)
    return at, up.unionByName(down)


def ignore_scope(mapping: DataFrame, series: list[str] | None) -> DataFrame:
    """The mapping with ignore_limits for all power variables of the named series, or of all if None."""
    power = F.col("variable").isin("targetP", "activePowerSetpoint", "p0")
    return mapping.withColumn("ignore_limits", F.col("ignore_limits") | (power & (F.lit(series is None) | F.col("series").isin(series or []))))


def scaling_log(corrected: DataFrame, scaled_ts: DataFrame) -> DataFrame:
    """(version, point, series, change, asked, applied): per change of a series at a point its value and the sum applied."""
    per = corrected.filter("series IS NOT NULL").groupBy("version", "point", "series").agg(F.sum("corrected").alias("applied"), F.collect_set("change").alias("changes")).filter("size(changes) > 0")
    asked = scaled_ts.select(F.col("name").alias("series"), "version", "point", F.col("value").alias("asked"))
    return per.join(asked, ["series", "version", "point"]).select("version", "point", "series", F.explode("changes").alias("change"), "asked", "applied")


def scaling_synthesis(corrected: DataFrame) -> DataFrame:
    """(version, series, kind, code), each once."""
    changes = corrected.filter("change IS NOT NULL").select("version", "series", F.lit("change").alias("kind"), F.col("change").alias("code"))
    return changes.unionByName(corrected.filter("violation IS NOT NULL").select("version", "series", F.lit("violation").alias("kind"), F.col("violation").alias("code"))).distinct()


def log_synthesis(log: DataFrame) -> DataFrame:
    return log.groupBy("label").agg(F.count("*").alias("n"))


# fixed values: labels and levels of the mapping log
LABELS = {"UNMAPPED": "mapping range problem", "CHANGE": "scaling down problem", "VIOLATION": "limit change"}


def log_rows(corrected: DataFrame) -> DataFrame:
    """(level, label, version, point, message) of changes and violations."""
    label = F.when(F.col("change").startswith("UNMAPPED"), LABELS["UNMAPPED"]).when(F.col("change").isNotNull(), LABELS["CHANGE"]).otherwise(LABELS["VIOLATION"])
    label = F.when(F.col("change").endswith("_DISABLED"), F.concat(label, F.lit(" IL disabled"))).otherwise(label)
    level = F.when(F.col("change").isNotNull(), "WARNING").otherwise("INFO")
    message = F.format_string("power of %s %.1f not kept, %s", "id", "asked", F.coalesce("change", "violation"))
    return corrected.filter("change IS NOT NULL OR violation IS NOT NULL").select(level.alias("level"), label.alias("label"), "version", "point", message.alias("message"))


def log_table(log: DataFrame, index: DataFrame) -> DataFrame:
    """Type;Label;Time;Variant;Version;Message: variants count from 1, are 'all' for constant rows (point -1) and blank
    for rows of a whole version (no point)."""
    rows = log.join(index.select("point", "instant"), "point", "left")
    variant = F.when(F.col("point") == -1, "all").when(F.col("point").isNull(), "").otherwise((F.col("point") + 1).cast("string"))
    time = F.coalesce(F.date_format("instant", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return rows.select(F.col("level").alias("Type"), F.col("label").alias("Label"), time.alias("Time"), variant.alias("Variant"), F.col("version").cast("string").alias("Version"), F.col("message").alias("Message"))


def correct_base_case(equipment: DataFrame, mapped: DataFrame, ignore: bool = False) -> DataFrame:
    """(id, target_p, min_p, max_p, problem) of generators and batteries whose power isn't mapped: the power gives way to
    limits that aren't mapped either, or with ``ignore`` those limits to it. ``mapped`` is (id, variable)."""
    has = mapped.groupBy("id").agg(F.max(F.col("variable") == "targetP").alias("m_p"), F.max(F.col("variable") == "minP").alias("m_min"), F.max(F.col("variable") == "maxP").alias("m_max"))
    rows = equipment.filter("type IN ('GENERATOR', 'BATTERY')").join(has, "id", "left").fillna(False, ["m_p", "m_min", "m_max"]).filter("NOT m_p")
    p, low, high = F.col("target_p"), F.col("min_p"), F.col("max_p")
    over, under = (p > high) & ~F.col("m_max"), ~(p > high) & (p < low) & ~F.col("m_min")
    row = lambda a, b, c, why: F.struct(a.alias("p"), b.alias("lo"), c.alias("hi"), F.lit(why).cast("string").alias("problem"))
    zero = F.lit(0.0)
    if ignore:
        done = F.when(over, row(p, low, p, "MAXP_EXTENDED")).when(under & (low <= 0), row(p, p, high, "MINP_EXTENDED"))
    else:
        done = F.when(over, row(high, low, high, "TO_MAXP")).when(under & (low <= 0), row(low, low, high, "TO_MINP"))
    done = done.when(under & (p < 0), row(zero, low, high, "TO_ZERO")).when(under, row(p, low, high, "MINP_VIOLATED")).otherwise(row(p, low, high, None))
    return rows.select("id", done.alias("d")).select("id", F.col("d.p").alias("target_p"), F.col("d.lo").alias("min_p"), F.col("d.hi").alias("max_p"), "d.problem")


def correct_base_case_hvdc(hvdc: DataFrame, ignore: bool = False) -> DataFrame:
    """(id, setpoint, min_p, max_p, problem): an operator's range can't exceed the maximum, then the set point gives way to
    the limits, or with ``ignore`` the limits to it."""
    base = hvdc_limits(hvdc).join(hvdc.select("id", F.col("max_p").alias("physical")), "id")
    low, high = F.greatest("base_min", -F.col("physical")), F.least("base_max", "physical")
    cut = (F.col("base_min") < -F.col("physical")) | (F.col("base_max") > F.col("physical"))
    rows = base.withColumn("lo", low).withColumn("hi", high).withColumn("cut", cut)
    p, lo, hi = F.col("base_p"), F.col("lo"), F.col("hi")
    problem = F.when(p > hi, "TO_MAX" if not ignore else "MAX_EXTENDED").when(p < lo, "TO_MIN" if not ignore else "MIN_EXTENDED").when(F.col("cut"), "RANGE_CUT")
    if ignore:
        return rows.select("id", p.alias("setpoint"), F.least(lo, p).alias("min_p"), F.greatest(hi, p).alias("max_p"), problem.alias("problem"))
    return rows.select("id", F.greatest(lo, F.least(hi, p)).alias("setpoint"), lo.alias("min_p"), hi.alias("max_p"), problem.alias("problem"))
