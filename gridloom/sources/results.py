"""Solver results as series, and variants as deltas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA = 1e-3

# What each tag of a result line holds. A row: tag, marker of its header line, and its values as
# (kind of series, name's prefix, place of the id, place of the outage, place of the value, whether an empty cell is skipped).
# An outage's place with # is its number in the file's dictionary, 0 being the base case; without # it is its name.
RECORDS = [
    ("C1 ", "COMPTE RENDU", [("double", "ERROR_CODE", None, None, 2, False)]),
    ("C2 ", "NON CONNEXITE", [("double", "LOST_GEN_", 2, None, 4, True), ("double", "LOST_LOAD_", 2, None, 5, True)]),
    ("C2B ", "NON CONNEXITE", [("double", "LOST_LOAD_", 3, "2", 4, True)]),
    ("C5 ", "ZONE SYNC", [("double", "INIT_BAL_AREA_", 2, None, 3, False)]),
    ("R1 ", "PAR CONSO", [("double", "INIT_BAL_LOAD_", 2, None, 4, True), ("double", "LOAD_", 2, None, 5, True)]),
    ("R1B ", "INCIDENT", [("double", "LOAD_CUR_", 2, "#1", 3, False)]),
    ("R1C ", "NOM REGROUPEMENT", [("double", "LOAD_", 1, None, 2, False)]),
    ("R2 ", "PAR GROUPE", [("double", "INIT_BAL_GEN_", 2, None, 5, True), ("double", "GEN_", 2, None, 6, True)]),
    ("R2B ", "INCIDENT", [("double", "GEN_CUR_", 2, "#1", 3, False)]),
    ("R2C ", "NOM REGROUPEMENT", [("double", "GEN_", 1, None, 2, False)]),
    ("R2D ", "INCIDENT", [("double", "BAT_CUR_", 2, "#1", 3, False)]),
    ("R3 ", "PAR LIGNE", [("double", "FLOW_", 2, None, 3, False)]),
    ("R3C ", "PAR LIGNE", [("double", "FLOW_", 2, "#3", 4, False)]),
    ("R4 ", "VAR. MARGINALES", [("double", "MV_", 2, "#3", 4, False)]),
    ("R5 ", "PAR TD", [("double", "PST_", 2, None, 3, False), ("double", "PST_TAP_", 2, None, 4, False)]),
    ("R5B ", "INCIDENT", [("double", "PST_CUR_", 2, "#1", 3, False), ("double", "PST_CUR_TAP_", 2, "#1", 4, False)]),
    ("R6 ", " PAR LCC", [("double", "HVDC_", 2, None, 3, False), ("double", "MV_", 2, None, 4, True)]),
    ("R6B ", "INCIDENT", [("double", "HVDC_CUR_", 2, "#1", 3, False)]),
    ("R8 ", "PERTES", [("double", "LOSSES", None, None, 2, False)]),
    ("R8B ", "PERTES", [("double", "LOSSES_", 2, None, 3, False)]),
    ("R9 ", "FCT OBJECTIF", [("double", name, None, None, 2 + k, k > 4) for k, name in enumerate(("GEN_COST", "BAT_COST", "LOAD_COST", "OVERLOAD_OUTAGES", "OVERLOAD_BASECASE", "GEN_CUR_COST", "BAT_CUR_COST", "LOAD_CUR_COST"))]),
    ("R10", "INCIDENT", [("string", "TOPOLOGY_", 2, None, 4, True)]),
]
VOLUMES = [("VOL_DOWN_", 3), ("VOL_UP_", 4), ("CUR_VOL_DOWN_", 5), ("CUR_VOL_UP_", 6)]
HEADERS = {tag: marker for tag, marker, _ in RECORDS} | {"C4 ": "INCIDENTS", "R3B ": "PAR LIGNE", "R4B ": "VAR. MARGINALES", "R7 ": "PAR FILIERE"}


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, variant, line): variant is the number at the end of the file's name."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return rows.select("file", F.expr(r"try_cast(regexp_extract(file, '(-?\\d+)$', 1) AS int)").alias("variant"), "line")


def _cell(place: int) -> Column:
    return F.get("c", F.lit(place))


def ingest_result_records(lines: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(variant, name, kind, value as string) of result lines ``TAG;...``.

    Header lines are skipped; an empty cell gives no value where cells may be empty; numbers of outages are resolved by
    the file's own C4 lines (a join on file and number); an unknown one spoils the file: it gives ERROR_CODE 1 only, as
    does an expected variant (``expected`` has column variant) without a file.
    """
    rows = lines.withColumn("c", F.split("line", ";")).withColumn("tag", F.col("c")[0])
    known = F.lit(False)
    for tag, marker in HEADERS.items():
        known = known | ((F.col("tag") == tag) & (_cell(1).isNull() | (_cell(1) != marker)))
    rows = rows.filter(known).select("file", "variant", "tag", "c")
    names = rows.filter("tag = 'C4 '").select("file", F.expr("try_cast(trim(c[2]) AS int)").alias("number"), F.get("c", F.lit(4)).alias("outage"))
    entry = lambda kind, prefix, ident, number, outage, value, late: F.struct(
        F.lit(kind).alias("kind"), prefix.alias("prefix") if isinstance(prefix, Column) else F.lit(prefix).alias("prefix"), F.coalesce(ident, F.lit("")).alias("id"),
        F.expr("CAST(NULL AS int)").alias("number") if number is None else F.expr(f"try_cast(trim(c[{number}]) AS int)").alias("number"), outage.cast("string").alias("outage"), value.alias("value"), late.cast("string").alias("suffix"))
    none = F.lit(None)
    found = F.lit(None)
    cases = []
    for tag, _, values in RECORDS:
        parts = []
        for kind, prefix, ident, outage, value, optional in values:
            e = entry(kind, prefix, none.cast("string") if ident is None else _cell(ident), outage[1:] if outage and outage[0] == "#" else None, _cell(int(outage)) if outage and outage[0] != "#" else none, _cell(value), none)
            parts.append(F.when(F.coalesce(_cell(value), F.lit("")) != "", e) if optional else e)
        cases.append((tag, F.array(*parts)))
    prefix = lambda p: F.concat(F.when(_cell(2) == "BATTERY", "BAT_").otherwise("GEN_"), F.lit(p))
    cases.append(("R7 ", F.array(*[F.when(F.coalesce(_cell(k), F.lit("")) != "", entry("double", prefix(p), _cell(2), None, none, _cell(k), none)) for p, k in VOLUMES])))
    cases.append(("R4B ", F.array(entry("double", "MV_POW_", _cell(2), 3, none, _cell(6), _cell(5)), entry("double", "MV_COST_", _cell(2), 3, none, _cell(7), _cell(5)))))
    tmp = F.when(F.coalesce(_cell(3), F.lit("")) != "", F.array(entry("name", "MAX_TMP_THREAT_NAME_", _cell(2), 3, none, _cell(3), none), entry("double", "MAX_TMP_THREAT_FLOW_", _cell(2), None, none, _cell(4), none))).otherwise(F.array().cast("array<struct<kind:string,prefix:string,id:string,number:int,outage:string,value:string,suffix:string>>"))
    ranks = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.size("c") - 4) / 2).cast("int"))), lambda i: F.coalesce(F.get("c", 3 + 2 * i), F.lit("")) != "")
    threat = lambda i, what, at, kind: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("MAX_THREAT_"), i.cast("string"), F.lit(what)).alias("prefix"), _cell(2).alias("id"), (F.get("c", 3 + 2 * i).cast("int") if kind == "name" else F.lit(None).cast("int")).alias("number"), F.lit(None).cast("string").alias("outage"), F.get("c", at + 2 * i).alias("value"), F.lit(None).cast("string").alias("suffix"))
    cases.append(("R3B ", F.concat(tmp, F.flatten(F.transform(ranks, lambda i: F.array(threat(i, "_NAME_", 3, "name"), threat(i, "_FLOW_", 4, "double")))))))
    for tag, array in cases:
        found = F.when(F.col("tag") == tag, array) if tag == cases[0][0] else found.when(F.col("tag") == tag, array)
    cells = rows.filter("tag <> 'C4 '").select("file", "variant", F.explode(found).alias("x")).filter("x IS NOT NULL").select("file", "variant", "x.*")
    resolved = cells.join(names.withColumnRenamed("outage", "listed"), ["file", "number"], "left")
    base = F.col("number") == 0
    resolved = resolved.withColumn("bad", F.col("number").isNotNull() & ~base & F.col("listed").isNull())
    spoiled = resolved.filter("bad").select("file", "variant").distinct()
    outage = F.coalesce("outage", F.when(base | (F.col("kind") == "name"), F.lit(None)).otherwise(F.col("listed")))
    name = F.concat(F.col("prefix"), F.concat_ws("_", F.nullif("id", F.lit("")), outage, "suffix"))
    good = resolved.join(spoiled.select("file"), "file", "left_anti")
    values = good.select("variant", name.alias("name"), F.when(F.col("kind") == "double", "double").otherwise("string").alias("kind"), F.when(F.col("kind") == "name", F.col("listed")).otherwise(F.col("value")).alias("value"))
    failed = spoiled.select("variant")
    if expected is not None:
        failed = failed.union(expected.select("variant").join(lines.select("variant").distinct(), "variant", "left_anti")).distinct()
    return values.unionByName(failed.select("variant", F.lit("ERROR_CODE").alias("name"), F.lit("double").alias("kind"), F.lit("1").alias("value")))


def variant_changes(values: DataFrame, base: DataFrame, outage: str = "disconnected") -> DataFrame:
    """(version, point, key, id, value): per point and variable the equipment whose value differs from the base case by more than
    DELTA, one row each; loads' parts are summed first; switched-off equipment comes under OUTAGES, without a value."""
    load = F.col("variable").isin("fixedActivePower", "variableActivePower")
    rows = values.withColumn("variable", F.when(load, "p0").otherwise(F.col("variable"))).groupBy("version", "point", "variable", "id").agg(F.sum("value").alias("value"))
    joined = rows.join(base.select("id", "variable", "base"), ["id", "variable"], "left")
    off = (F.col("variable") == outage) & (F.col("value") == 0)
    changed = joined.filter(off | ((F.col("variable") != outage) & (F.abs(F.col("value") - F.coalesce("base", F.lit(0.0))) > DELTA)))
    key = F.when(F.col("variable") == outage, "OUTAGES").otherwise(F.col("variable"))
    return changed.select("version", "point", key.alias("key"), "id", F.when(F.col("variable") != outage, F.round("value", 3)).alias("value"))


def variant_deltas(values: DataFrame, base: DataFrame, points: DataFrame, outage: str = "disconnected") -> DataFrame:
    """(version, point, key, n, items): how many changes a point has of each key, and these as 'id;value;...' (of OUTAGES 'id;...') by id; a
    point without changes has one row without a key. Rows, one for each item, are dealt by point and key and sorted; a task joins them as they come."""
    changes = variant_changes(values, base, outage)
    item = F.concat_ws(";", "id", F.col("value").cast("string"))
    rows = changes.select("version", "point", "key", "id", item.alias("item")).repartition("version", "point", "key").sortWithinPartitions("version", "point", "key", "id")
    lists = rows.select("version", "point", "key", "item").mapInArrow(_listed_items, "version int, point int, key string, n bigint, items string")
    return points.select("version", "point").distinct().join(lists, ["version", "point"], "left")


def _listed_items(batches):
    """Items of sorted (version, point, key, item) as one row for each (version, point, key), handed on as soon as the next one begins."""
    schema = pa.schema([("version", pa.int32()), ("point", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("items", pa.string())])
    held, items = None, []
    row = lambda: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, len(items), ";".join(items)), schema)], schema=schema)
    for batch in batches:
        for *group, item in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if items and group != held:
                yield row()
                items = []
            held = group
            items.append(item)
    if items:
        yield row()


def write_variants(changes: DataFrame, points: DataFrame, version: int, path: str) -> None:
    """The changes of a version as the solver's text: ``NT;<points>;``, then by point and key a line
    ``point;key;count;id;value;...;``, or ``point;`` for a point without changes.

    Rows, one for each item, are dealt to files by ranges of (point, key) and sorted in each; a task joins a line's items as it
    writes, so that no row of a shuffle or group grows with the equipment, only the line itself. The files, in the order of their names, are the text."""
    own = changes.filter(F.col("version") == version).select("point", "key", "id", "value")
    every = points.filter(F.col("version") == version).select("point").distinct()
    value = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    items = own.select("point", "key", "id", F.concat(F.concat_ws(";", "id", value), F.lit(";")).alias("item"))
    counts = own.groupBy("point", "key").agg(F.count("*").alias("n"))
    heads = counts.select("point", "key", F.lit("").alias("id"), F.concat_ws(";", "point", "key", "n", F.lit("")).alias("item"))
    bare = every.join(counts, "point", "left_anti").select("point", F.lit("").alias("key"), F.lit("").alias("id"), F.concat(F.col("point").cast("string"), F.lit(";")).alias("item"))
    first = every.agg(F.count("*").alias("n")).select(F.lit(-1).alias("point"), F.lit("").alias("key"), F.lit("").alias("id"), F.format_string("NT;%d;", "n").alias("item"))
    rows = items.unionByName(heads).unionByName(bare).unionByName(first)
    rows.repartitionByRange("point", "key").sortWithinPartitions("point", "key", "id").select("point", "key", "item").mapInArrow(_joined_lines, "value string").write.text(path)


def _joined_lines(batches):
    """Items of sorted (point, key, item) as one text for each (point, key), handed on as soon as the next one begins."""
    held, parts = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3)]
        for point, key, item in zip(*columns):
            if parts and (point, key) != held:
                yield pa.RecordBatch.from_arrays([pa.array(["".join(parts)])], names=["value"])
                parts = []
            held = point, key
            parts.append(item)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(["".join(parts)])], names=["value"])
