"""Mapping rules: equipment, distribution, provided series."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from ..plans.spread import beside, dealt

# The variables of each equipment type, the default one first.
VARIABLES = {
    "GENERATOR": ["targetP", "targetQ", "minP", "maxP", "voltageRegulatorOn", "targetV", "disconnected"],
    "BATTERY": ["targetP", "targetQ", "minP", "maxP"],
    "LOAD": ["p0", "fixedActivePower", "variableActivePower", "q0", "fixedReactivePower", "variableReactivePower"],
    "BOUNDARY_LINE": ["p0", "q0"],
    "HVDC_LINE": ["activePowerSetpoint", "minP", "maxP", "nominalV"],
    "TWO_WINDINGS_TRANSFORMER": ["disconnected"],
    "LINE": ["disconnected"],
    "PST": ["currentTap", "regulationMode", "phaseTapPosition", "targetV"],
    "RATIO_TAP_CHANGER": ["ratioTapPosition", "loadTapChangingCapabilities"],
    "LCC_CONVERTER": ["powerFactor"],
    "VSC_CONVERTER": ["voltageRegulatorOn", "voltageSetpoint", "reactivePowerSetpoint"],
    "SWITCH": ["open"],
}
INJECTIONS = ("GENERATOR", "BATTERY", "LOAD", "BOUNDARY_LINE")
OUTAGE_TYPES = ("TWO_WINDINGS_TRANSFORMER", "LINE", "GENERATOR")


@dataclass(frozen=True)
class Rule:
    """Maps a series to equipment. ``where`` and ``key`` are SQL over the equipment's columns, or Columns; ``key_series``
    names a series instead; without either all keys are 1. Without ``variables`` the type's default is mapped."""

    type: str
    series: str
    variables: tuple[str, ...] = ()
    where: str | Column | None = None
    key: str | Column | float | None = None
    key_series: str | None = None
    ignore_limits: bool = False
    ignore_empty: bool = False
    names: tuple[str, ...] = field(default=(), repr=False)

    def __post_init__(self):
        if self.type not in VARIABLES:
            raise ValueError(f"unknown equipment type {self.type}")
        bad = [v for v in self.variables if v not in VARIABLES[self.type]]
        if bad:
            raise ValueError(f"variables {bad} don't exist for {self.type}")
        if self.key is not None and self.key_series is not None:
            raise ValueError("a rule has a key or a key series, not both")

    @property
    def mapped(self) -> tuple[str, ...]:
        return self.variables or (VARIABLES[self.type][0],)


def _column(x, default: Column) -> Column:
    return default if x is None else x if isinstance(x, Column) else F.expr(x) if isinstance(x, str) else F.lit(float(x))


def classify_equipment(equipment: DataFrame) -> DataFrame:
    """(id, type, status): disconnected, out_of_main_cc or unmapped, the latter meaning to be mapped; HVDC lines always are."""
    status = F.when(F.col("type") == "HVDC_LINE", "unmapped").when(~F.col("connected"), "disconnected").when(~F.col("in_main_cc"), "out_of_main_cc").otherwise("unmapped")
    return equipment.select("id", "type", status.alias("status"))


def select_equipment(equipment: DataFrame, type: str, where: str | Column | None = None) -> DataFrame:
    """Equipment of a type that meets the condition; injections must be in the main component."""
    found = equipment.filter((F.col("type") == type) & _column(where, F.lit(True)))
    return found.filter("connected AND in_main_cc") if type in INJECTIONS else found


def _text(i: int, r: Rule) -> str | None:
    """A rule's match as SQL, if its condition and key are text or numbers: one call to Spark instead of dozens."""
    if isinstance(r.where, Column) or isinstance(r.key, Column):
        return None
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    hit = f"type = '{r.type}' AND coalesce(({r.where or 'true'}), false)" + " AND connected AND in_main_cc" * (r.type in INJECTIONS)
    key = "NULL" if r.key_series is not None else "1.0" if r.key is None else r.key if isinstance(r.key, str) else repr(float(r.key))
    return (
        f"CASE WHEN {hit} THEN named_struct('rule_id', {i}, 'series', {quote(r.series)}, 'variables', array({', '.join(map(quote, r.mapped))}), 'key_number', CAST({key} AS DOUBLE), "
        f"'key_series', CAST({quote(r.key_series) if r.key_series is not None else 'NULL'} AS STRING), 'ignore_limits', {str(r.ignore_limits).lower()}) END"
    )


EQUALITY = re.compile(r"\s*(\w+)\s*=\s*('[^'\\]*'|-?\d+)\s*(?:AND\b|$)", re.I)
MATCH = "rule_id int, series string, variables array<string>, key_number double, key_series string, ignore_limits boolean"
INDEXED_FROM, FEW_KEYS = 32, 64  # rules on the same attributes; different key expressions of these


def _equalities(r: Rule, kinds: dict[str, str]) -> dict[str, str] | None:
    """A condition's attributes and values if it is nothing but equalities of an attribute to a value of its own kind."""
    if not isinstance(r.where, str) or isinstance(r.key, Column):
        return None
    found, at = {}, 0
    while at < len(r.where):
        m = EQUALITY.match(r.where, at)
        quoted = m is not None and m[2].startswith("'")
        if m is None or m[1] in found or kinds.get(m[1]) not in (("string",) if quoted else ("int", "bigint", "double")):
            return None
        found[m[1]], at = m[2].strip("'"), m.end()
    return found or None


def _indexed(rules: dict[int, Rule], equipment: DataFrame, attributes: tuple[str, ...], values: dict[int, dict[str, str]]) -> DataFrame:
    """Matches of rules that compare the same attributes with values: a join by type and these, so that equipment meets only the
    rules that hold for it."""
    spark, kinds = equipment.sparkSession, dict(equipment.dtypes)
    texts = sorted({r.key for r in rules.values() if isinstance(r.key, str)})
    rows = [
        (r.type, *[values[i][a] for a in attributes], i, r.series, list(r.mapped), None if r.key_series is not None or isinstance(r.key, str) else 1.0 if r.key is None else float(r.key),
         r.key_series, r.ignore_limits, texts.index(r.key) if isinstance(r.key, str) else None)
        for i, r in rules.items()
    ]
    index = spark.createDataFrame(rows, ", ".join(["rule_type string", *[f"value_{k} string" for k in range(len(attributes))], MATCH, "key_at int"]))
    on = [F.col("type") == F.col("rule_type")] + [F.col(a) == F.col(f"value_{k}").cast(kinds[a]) for k, a in enumerate(attributes)]
    met = equipment.join(index, reduce(lambda x, y: x & y, on))
    met = met.filter(~F.col("type").isin(*INJECTIONS) | (F.col("connected") & F.col("in_main_cc")))
    key = F.coalesce(F.col("key_number"), F.get(F.array(*[F.expr(t).cast("double") for t in texts]), F.col("key_at"))) if texts else F.col("key_number")
    return met.select("rule_id", "type", F.explode("variables").alias("variable"), "series", "id", key.alias("key_number"), "key_series", "ignore_limits")


def rule_matches(rules: list[Rule], equipment: DataFrame) -> DataFrame:
    """(rule_id, type, variable, series, id, key_number, key_series, ignore_limits): every match. Where INDEXED_FROM rules or more
    compare the same attributes of a kind of equipment with values, these are an index of (attribute, value) that equipment is
    joined to; all other rules are evaluated in one scan of the equipment, however many there are."""
    kinds = dict(equipment.dtypes)
    groups: dict[tuple[str, ...], dict[int, dict[str, str]]] = {}
    for i, r in enumerate(rules):
        if (found := _equalities(r, kinds)) is not None:
            groups.setdefault(tuple(sorted(found)), {})[i] = found
    groups = {a: v for a, v in groups.items() if len(v) >= INDEXED_FROM and len({rules[i].key for i in v}) <= FEW_KEYS}
    parts = [_indexed({i: rules[i] for i in v}, equipment, a, v) for a, v in groups.items()]
    held = {i for v in groups.values() for i in v}
    rest = [(i, r) for i, r in enumerate(rules) if i not in held]
    if not rules:
        return _indexed({}, equipment, (), {})
    if rest:
        parts.append(_scanned(rest, equipment))
    return reduce(DataFrame.unionByName, parts)


def _scanned(rules: list[tuple[int, Rule]], equipment: DataFrame) -> DataFrame:
    """Matches by evaluating every rule on all equipment."""

    def one(i: int, r: Rule) -> Column:
        hit = (F.col("type") == r.type) & F.coalesce(_column(r.where, F.lit(True)), F.lit(False))
        if r.type in INJECTIONS:
            hit = hit & F.col("connected") & F.col("in_main_cc")
        return F.when(hit, F.struct(
            F.lit(i).alias("rule_id"), F.lit(r.series).alias("series"), F.array(*map(F.lit, r.mapped)).alias("variables"),
            F.when(F.lit(r.key_series is None), _column(r.key, F.lit(1.0)).cast("double")).alias("key_number"), F.lit(r.key_series).cast("string").alias("key_series"), F.lit(r.ignore_limits).alias("ignore_limits")))

    texts = [_text(i, r) for i, r in rules]
    if all(t is not None for t in texts):
        hits = F.expr(f"filter(array({', '.join(texts)}), x -> x IS NOT NULL)")
    else:
        hits = F.filter(F.array(*[one(i, r) if t is None else F.expr(t) for (i, r), t in zip(rules, texts)]), lambda x: x.isNotNull())
    matched = equipment.select("id", "type", F.explode(hits).alias("m"))
    return matched.select("m.rule_id", "type", F.explode("m.variables").alias("variable"), "m.series", "id", "m.key_number", "m.key_series", "m.ignore_limits")


def last_rule_wins(matches: DataFrame) -> DataFrame:
    """The matches with ``applied``: of all rules for a (variable, equipment) the last one."""
    w = Window.partitionBy("variable", "id").orderBy(F.desc("rule_id"))
    return matches.withColumn("applied", F.row_number().over(w) == 1)


def build_mapping(rules: list[Rule], equipment: DataFrame) -> DataFrame:
    return last_rule_wins(rule_matches(rules, equipment)).filter("applied").drop("applied")


def unused_series(rules: list[Rule], equipment: DataFrame) -> DataFrame:
    """(variable, id, unused): series of earlier rules, in order of their rules."""
    lost = last_rule_wins(rule_matches(rules, equipment)).filter("NOT applied").groupBy("variable", "id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "series"))).alias("x"))
    return lost.select("variable", "id", F.transform("x", lambda r: r["series"]).alias("unused"))


def empty_rules(rules: list[Rule], equipment: DataFrame, ts: DataFrame) -> DataFrame:
    """(rule_id, series, version, point, value, level): values other than 0 of rules without equipment; level is INFO for rules
    that may be empty, else ERROR."""
    rows = equipment.sparkSession.createDataFrame([(i, r.series, r.ignore_empty) for i, r in enumerate(rules)], "rule_id int, series string, ignore_empty boolean")
    empty = rows.join(rule_matches(rules, equipment).select("rule_id").distinct(), "rule_id", "left_anti")
    found = ts.withColumnRenamed("name", "series").join(F.broadcast(empty), "series").filter("value <> 0")  # as many rows as rules
    return found.select("rule_id", "series", "version", "point", "value", F.when(F.col("ignore_empty"), "INFO").otherwise("ERROR").alias("level"))


def bad_values(ts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(name, version, point, instant, value) of mapped series that are NaN or infinite."""
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    return ts.filter(odd).join(mapping.select(F.col("series").alias("name")).distinct(), "name", "left_semi").select("name", "version", "point", "instant", "value")


def scale_down(mapping: DataFrame, ts: DataFrame, distribute: bool = True) -> DataFrame:
    """(version, point, type, variable, series, id, value, ignore_limits, uniform): each series' value shared by keys among
    its equipment, all rules of one variable and series together. Keys that add up to 0 share alike (``uniform``) unless the
    value is 0. Series keys count by their absolute value. ``distribute`` False gives everyone the whole value.

    Sums of keys are taken from the mapping: of numbers once per group, of series keys from how many of a group have each, so that
    rows of equipment and points meet in no window. The mapping is dealt by equipment before it makes a row of each point.
    """
    group = ["type", "variable", "series"]
    values = ts.select(F.col("name").alias("series"), "version", "point", "value")
    total, times = ts.groupBy("name").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    mapping = dealt(mapping, times, "id")
    numbers = mapping.filter("key_series IS NULL").select(*group, "id", F.col("key_number").alias("key"), "ignore_limits")
    keys = ts.select(F.col("name").alias("key_series"), "version", "point", F.abs("value").alias("series_key"))
    mixed = F.broadcast(mapping.filter("key_series IS NOT NULL").select(*group).distinct())  # as many rows as rules, at most
    plain = numbers.join(mixed, group, "left_anti")
    sums = plain.groupBy(*group).agg(F.sum("key").alias("all"), F.count("*").alias("n"))
    fixed = plain.join(F.broadcast(sums), group).join(beside(values, total), "series")
    moving = mapping.join(mixed, group, "left_semi")
    kinds = moving.groupBy(*group, "key_series").agg(F.sum(F.coalesce("key_number", F.lit(0.0))).alias("own"), F.count("*").alias("members"))
    kinds = kinds.join(values.drop("value"), "series").join(keys, ["key_series", "version", "point"], "left")
    sums = kinds.groupBy(*group, "version", "point").agg(F.sum(F.coalesce(F.col("series_key") * F.col("members"), "own")).alias("all"), F.sum("members").alias("n"))
    moving = moving.join(beside(values, total), "series").join(beside(keys, total), ["key_series", "version", "point"], "left")
    moving = moving.withColumn("key", F.coalesce("series_key", "key_number", F.lit(0.0))).join(written(sums, "sums"), [*group, "version", "point"])
    names = ["version", "point", *group, "id", "key", "all", "n", "value", "ignore_limits"]
    rows = fixed.select(*names).unionByName(moving.select(*names))
    if not distribute:
        return rows.select("version", "point", *group, "id", "value", "ignore_limits", F.lit(False).alias("uniform"))
    uniform = (F.col("all") == 0) & (F.col("value") != 0)
    share = F.when(F.col("value") == 0, F.lit(0.0)).when(uniform, F.col("value") / F.col("n")).otherwise(F.col("value") * F.col("key") / F.nullif("all", F.lit(0.0)))
    return rows.select("version", "point", *group, "id", share.alias("value"), "ignore_limits", uniform.alias("uniform"))


def zero_key_log(scaled: DataFrame) -> DataFrame:
    """(version, point, series, variable, n_equipment) where keys added up to 0."""
    return scaled.filter("uniform").groupBy("version", "point", "series", "variable").agg(F.count("*").alias("n_equipment"))


def check_hvdc_sign(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values that may be mapped, log): negative maxP and positive minP of HVDC lines aren't."""
    bad = (F.col("type") == "HVDC_LINE") & (((F.col("variable") == "maxP") & (F.col("value") < 0)) | ((F.col("variable") == "minP") & (F.col("value") > 0)))
    return values.filter(~bad), values.filter(bad).select("version", "point", "series", "id", "variable", "value")


def clamp_tap(values: DataFrame, pst: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((version, point, id, tap), log): taps outside of [low_tap, high_tap] go to the nearest bound; the whole part counts."""
    rows = values.join(pst.select("id", "low_tap", "high_tap"), "id").withColumn("asked", F.col("value").cast("int"))
    tap = F.greatest("low_tap", F.least("high_tap", "asked"))
    log = rows.filter(tap != F.col("asked")).select("version", "point", "id", "asked", tap.alias("tap"))
    return rows.select("version", "point", "id", tap.alias("tap")), log


def merge_power(scaled: DataFrame, power: str = "targetP", constants: DataFrame | None = None) -> DataFrame:
    """(version, point, id, type, p, min_p_mapped, max_p_mapped, series, ignore_limits): what is mapped to an equipment at
    a point. ``constants`` (id, variable, value) are limits that hold at every point unless mapped there."""
    pick = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c)))
    rows = scaled.filter(F.col("variable").isin(power, "minP", "maxP"))
    out = rows.groupBy("version", "point", "id", "type").agg(
        pick(power, "value").alias("p"), pick("minP", "value").alias("min_p_mapped"), pick("maxP", "value").alias("max_p_mapped"), pick(power, "series").alias("series"),
        F.coalesce(pick(power, "ignore_limits"), F.lit(False)).alias("ignore_limits"))
    if constants is None:
        return out
    fixed = constants.groupBy("id").agg(pick("minP", "value").alias("c_min"), pick("maxP", "value").alias("c_max"))
    out = out.join(fixed, "id", "left")
    return out.withColumn("min_p_mapped", F.coalesce("min_p_mapped", "c_min")).withColumn("max_p_mapped", F.coalesce("max_p_mapped", "c_max")).drop("c_min", "c_max")


def planned_outages(texts: DataFrame, separator: str = ",") -> DataFrame:
    """(name, version, point, id, value) of string series with lists of ids: a series ``<name>_<id>`` per id found in any
    version, 0 where it is listed, else 1; null lists nothing."""
    listed = texts.select("name", "version", "point", F.explode(F.split(F.coalesce("value", F.lit("")), separator)).alias("id")).withColumn("id", F.trim("id")).filter("id <> ''").distinct()
    ids = listed.select("name", "id").distinct()
    grid = texts.select("name", "version", "point").distinct().join(ids, "name")
    hit = grid.join(listed.withColumn("out", F.lit(0.0)), ["name", "version", "point", "id"], "left")
    return hit.select(F.concat_ws("_", "name", "id").alias("name"), "version", "point", "id", F.coalesce("out", F.lit(1.0)).alias("value"))


def map_outages(outages: DataFrame, equipment: DataFrame) -> DataFrame:
    """(series, id, type, variable): outage series of equipment that can be disconnected."""
    ids = outages.select(F.col("name").alias("series"), "id").distinct()
    return ids.join(equipment.select("id", "type"), "id").filter(F.col("type").isin(*OUTAGE_TYPES)).select("series", "id", "type", F.lit("disconnected").alias("variable"))


def declare_unmapped(equipment: DataFrame, declarations: list[tuple[str, str | Column | None]]) -> DataFrame:
    """(id, type) of equipment that is left unmapped on purpose, by (type, condition)."""
    return reduce(DataFrame.unionByName, [select_equipment(equipment, t, w).select("id", "type") for t, w in declarations]).distinct()


def check_mapping(mapping: DataFrame, ignored: DataFrame) -> DataFrame:
    """(id, problem): loads with p0 (q0) and parts of it mapped, equipment mapped and declared unmapped."""
    used = mapping.groupBy("id", "type").agg(F.collect_set("variable").alias("v"))
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains("v", n) for n in names])
    p = used.filter((F.col("type") == "LOAD") & has("p0") & has("fixedActivePower", "variableActivePower")).select("id", F.lit("p0").alias("problem"))
    q = used.filter((F.col("type") == "LOAD") & has("q0") & has("fixedReactivePower", "variableReactivePower")).select("id", F.lit("q0").alias("problem"))
    both = used.join(ignored, ["id", "type"], "left_semi").select("id", F.lit("mapped and declared unmapped").alias("problem"))
    return p.unionByName(q).unionByName(both)


def incomplete(status: DataFrame, mapping: DataFrame, ignored: DataFrame) -> DataFrame:
    """(id, type) still to be mapped; the mapping is complete if there is none."""
    return status.filter("status = 'unmapped'").join(mapping.select("id"), "id", "left_anti").join(ignored.select("id"), "id", "left_anti").select("id", "type")


def direct_series(assignments: DataFrame, ts: DataFrame) -> DataFrame:
    """(version, point, variable, id, value) of series given to equipment as they are. ``assignments`` is (row_id, variable, id,
    series, number, removed): the last row of a (variable, id) counts, numbers hold at every point."""
    w = Window.partitionBy("variable", "id").orderBy(F.desc("row_id"))
    last = assignments.withColumn("n", F.row_number().over(w)).filter("n = 1 AND NOT removed")
    named = last.filter("series IS NOT NULL").join(ts.withColumnRenamed("name", "series"), "series").select("version", "point", "variable", "id", "value")
    points = ts.select("version", "point").distinct()
    fixed = last.filter("series IS NULL").select("variable", "id", F.col("number").alias("value"))
    return named.unionByName(points.join(fixed).select("version", "point", "variable", "id", "value"))


BASE_COLUMNS = {"targetP": "target_p", "minP": "min_p", "maxP": "max_p", "p0": "p0", "fixedActivePower": "fixed_p", "variableActivePower": "variable_p"}


def base_values(equipment: DataFrame, variables=tuple(BASE_COLUMNS)) -> DataFrame:
    """(id, type, variable, base) of equipment's own values."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(BASE_COLUMNS[v]).alias("base")) for v in variables])
    return equipment.select("id", "type", F.explode(pairs).alias("x")).select("id", "type", "x.variable", "x.base")


def equipment_series(values: DataFrame, requests: DataFrame, equipment: DataFrame, points: DataFrame) -> DataFrame:
    """(name, version, point, id, variable, value) of requested (id, variable): mapped values, else the equipment's own at
    every point."""
    asked = requests.join(base_values(equipment), ["id", "variable"])
    grid = asked.join(points.select("version", "point").distinct())
    out = grid.join(values.select("version", "point", "id", "variable", "value"), ["version", "point", "id", "variable"], "left")
    return out.select(F.concat_ws("_", "id", "variable").alias("name"), "version", "point", "id", "variable", F.coalesce("value", "base").alias("value"))


def group_series(values: DataFrame, equipment: DataFrame, type: str, group_by: str | Column, points: DataFrame, name: str | None = None, power_type: str | Column | None = None) -> DataFrame:
    """(name, version, point, value): sums over groups of generators (targetP) or loads (variable part of p0), mapped
    values and the own ones of unmapped equipment. ``group_by`` and ``power_type`` are columns or expressions."""
    variable = "targetP" if type == "GENERATOR" else "variableActivePower"
    members = select_equipment(equipment, type).withColumn("group", group_by if isinstance(group_by, Column) else F.col(group_by))
    own = F.col("target_p") if type == "GENERATOR" else F.col("p0")
    parts = [F.col("group"), *([power_type if isinstance(power_type, Column) else F.col(power_type)] if power_type is not None else []), *([F.lit(name)] if name else []), F.lit(variable)]
    members = members.select("id", F.concat_ws("_", *parts).alias("name"), own.alias("own"))
    mapped = values.filter(F.col("variable").isin("targetP") if type == "GENERATOR" else F.col("variable").isin("p0", "variableActivePower"))
    mapped = mapped.join(members, "id")
    base = members.join(mapped.select("id").distinct(), "id", "left_anti").groupBy("name").agg(F.sum("own").alias("base"))
    sums = mapped.groupBy("name", "version", "point").agg(F.sum("value").alias("value"))
    grid = members.select("name").distinct().join(points.select("version", "point").distinct())
    out = grid.join(sums, ["name", "version", "point"], "left").join(base, "name", "left")
    return out.select("name", "version", "point", (F.coalesce("value", F.lit(0.0)) + F.coalesce("base", F.lit(0.0))).alias("value"))


def observe(values: DataFrame, *observers) -> list[DataFrame]:
    """Results of functions of the mapped values (U4)."""
    return [f(values) for f in observers]
