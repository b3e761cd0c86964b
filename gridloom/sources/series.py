"""Time series in and out: files, versions, indexes, ranges, catalogue."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scan import numbered
from ..plans.scratch import written, written_and_found

KEYS = ("Time", "Version")
TS = "name string, version int, point int, instant timestamp, value double"


# ---- reading ---------------------------------------------------------------------------------------------------


def read_ts_csv(spark: SparkSession, paths: list[str], sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """(double series, string series) of files ``Time;Version;<series...>``. A column is double if all its non-empty cells
    are numbers. Of a series in several files the last file's counts.

    A file is scanned once, its columns become rows. Only headers are read beforehand, so what is text, and the points of
    an index, are aggregates over these rows; a version's index is numbered over its distinct instants.
    """
    last: dict[str, int] = {}
    raws = [spark.read.csv(path, sep=sep, header=True) for path in paths]
    for k, raw in enumerate(raws):
        last |= {c: k for c in raw.columns if c not in KEYS}
    empty = spark.createDataFrame([], "file int, instant timestamp, version int, name string, cell string")
    cells = empty
    for k, raw in enumerate(raws):
        own = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("cell")) for c in raw.columns if last.get(c) == k]
        if own:
            rows = raw.select(F.lit(k).alias("file"), F.to_timestamp("Time").alias("instant"), F.col("Version").cast("int").alias("version"), F.explode(F.array(*own)).alias("x"))
            cells = cells.union(rows.select("file", "instant", "version", "x.name", "x.cell"))
    number = F.expr("try_cast(cell AS double)")
    kinds = cells.groupBy("name").agg(F.max(F.col("cell").isNotNull() & number.isNull()).alias("is_text"))
    index = cells.select("file", "version", "instant").distinct()
    index = index.withColumn("point", (F.row_number().over(Window.partitionBy("file", "version").orderBy("instant")) - 1).cast("int"))
    rows = cells.join(index, ["file", "version", "instant"]).join(kinds, "name")
    columns = ["name", "version", "point", "instant"]
    return rows.filter("NOT is_text").select(*columns, number.alias("value")), rows.filter("is_text").select(*columns, F.col("cell").alias("value"))


# The fields of the series format.
JSON = """metadata struct<name:string,dataType:string,tags:array<map<string,string>>,
          regularIndex:struct<startTime:bigint,endTime:bigint,spacing:bigint>,irregularIndex:array<bigint>>,
          chunks array<struct<offset:int,length:int,uncompressedLength:int,values:array<string>,stepValues:array<string>,stepLengths:array<int>>>"""


def expand_rle(values: Column, lengths: Column) -> Column:
    """Step-compressed values as one value per point."""
    return F.flatten(F.transform(F.arrays_zip(values.alias("v"), lengths.alias("n")), lambda x: F.array_repeat(x["v"], x["n"])))


def compress_rle(ts: DataFrame) -> DataFrame:
    """(name, version, offset, length, value): maximal runs of one value at consecutive points."""
    w = Window.partitionBy("name", "version").orderBy("point")
    step = (~F.col("value").eqNullSafe(F.lag("value").over(w)) | (F.lag("point").over(w) != F.col("point") - 1) | F.lag("point").over(w).isNull()).cast("int")
    runs = ts.withColumn("step", step).withColumn("run", F.sum("step").over(w))
    return runs.groupBy("name", "version", "run").agg(F.min("point").alias("offset"), F.count("*").cast("int").alias("length"), F.first("value").alias("value")).drop("run")


def read_ts_json(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(name, version, point, instant, value as string, data_type, tags) of a JSON file of metadata and chunks."""
    rows = spark.read.schema(JSON).json(path, multiLine=True).select("metadata", F.explode("chunks").alias("c"))
    values = F.coalesce(F.col("c.values"), expand_rle(F.col("c.stepValues"), F.col("c.stepLengths")))
    rows = rows.select("metadata", F.col("c.offset").alias("offset"), F.posexplode(values).alias("pos", "value"))
    point = F.col("offset") + F.col("pos")
    millis = F.coalesce(F.col("metadata.regularIndex.startTime") + point * F.col("metadata.regularIndex.spacing"), F.get(F.col("metadata.irregularIndex"), point))
    return rows.select(F.col("metadata.name").alias("name"), F.lit(version).alias("version"), point.alias("point"), F.timestamp_millis(millis).alias("instant"), "value", F.col("metadata.dataType").alias("data_type"), F.col("metadata.tags").alias("tags"))


def one_series(rows: DataFrame, name: str, data_type: str) -> DataFrame:
    """The series of that name and type; none of that type gives no rows, two series of one name are an error."""
    found = rows.filter(F.col("name") == name)
    twice = found.groupBy("version", "point").count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"more than one time series {name}")
    kind = "double" if data_type == "double" else "string"
    return found.filter(F.col("data_type") == data_type).withColumn("value", F.col("value").cast(kind))


# ---- versions --------------------------------------------------------------------------------------------------


def resolve_version(ts: DataFrame, versions: list[int]) -> DataFrame:
    """The series as seen from each requested version: series that have version -1 only hold for every version."""
    free = ts.groupBy("name").agg((F.max("version") == -1).alias("free")).filter("free")
    exact = ts.filter(F.col("version").isin(versions) & (F.col("version") >= 0))
    shared = ts.join(free.select("name"), "name", "left_semi").drop("version").withColumn("version", F.explode(F.array(*[F.lit(int(v)) for v in versions])))
    return exact.unionByName(shared.select(*exact.columns))


def undefined_versions(ts: DataFrame, versions: list[int]) -> DataFrame:
    """(name, version): requested versions that a versioned series lacks."""
    names = ts.groupBy("name").agg(F.max("version").alias("v")).filter("v >= 0")
    asked = names.select("name", F.explode(F.array(*[F.lit(int(v)) for v in versions])).alias("version"))
    return asked.join(ts.select("name", "version").distinct(), ["name", "version"], "left_anti")


def catalog(ts: DataFrame) -> DataFrame:
    """(name, versions, n_points, first_instant, last_instant)."""
    return ts.groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.count("*").alias("n_points"), F.min("instant").alias("first_instant"), F.max("instant").alias("last_instant"))


def exists(ts: DataFrame, names: DataFrame) -> DataFrame:
    return names.join(ts.select("name").distinct(), "name", "left_semi")


# ---- append ----------------------------------------------------------------------------------------------------

# Names of the policies.
THROW, OVERWRITE, APPEND = "THROW_EXCEPTION", "OVERWRITE", "APPEND"


def overlapping(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(name, version) whose new instants are stored already or lie within the stored range."""
    span = lambda d, p: d.groupBy("name", "version").agg(F.min("instant").alias(f"{p}_first"), F.max("instant").alias(f"{p}_last"))
    met = span(stored, "a").join(span(new, "b"), ["name", "version"])
    apart = (F.col("a_last") < F.col("b_first")) | (F.col("b_last") < F.col("a_first"))
    shared = stored.join(new.select("name", "version", "instant"), ["name", "version", "instant"], "left_semi").select("name", "version").distinct()
    crossing = met.filter(~apart).select("name", "version")
    return shared.union(crossing).distinct()


def renumber(ts: DataFrame) -> DataFrame:
    """Points anew, in order of instants; a series may be any number of tasks."""
    found = numbered(ts, ["name", "version"], "instant", "new_point")
    return found.select(*[F.col("new_point").cast("int").alias("point") if c == "point" else F.col(c) for c in ts.columns])


def append_ts(stored: DataFrame, new: DataFrame, policy: str = THROW) -> DataFrame:
    """The store after adding ``new``. THROW_EXCEPTION refuses series and versions that are stored, OVERWRITE replaces
    them, APPEND joins ranges that don't meet and renumbers points; series without an index can't be appended."""
    keys = new.select("name", "version").distinct()
    if policy == OVERWRITE:
        return stored.join(keys, ["name", "version"], "left_anti").unionByName(new)
    if policy == THROW:
        bad = stored.join(keys, ["name", "version"], "left_semi").select("name", "version").distinct()
    elif policy == APPEND:
        if new.filter("instant IS NULL").limit(1).count():
            raise ValueError("series without instants have no end to append at")
        bad = overlapping(stored, new)
    else:
        raise ValueError(f"unknown policy {policy}")
    first = bad.limit(5).collect()
    if first:
        raise ValueError("already stored: " + ", ".join(f"{r['name']} (version {r['version']})" for r in first))
    return renumber(stored.unionByName(new)) if policy == APPEND else stored.unionByName(new)


def merge_index(instants: DataFrame) -> DataFrame:
    """(name, version, regular, spacing_seconds): an index stays regular if all its steps are equal."""
    w = Window.partitionBy("name", "version").orderBy("instant")
    steps = instants.withColumn("step", F.lead("instant").over(w).cast("double") - F.col("instant").cast("double"))
    regular = F.count_distinct("step") <= 1
    return steps.groupBy("name", "version").agg(regular.alias("regular"), F.when(regular, F.max("step")).alias("spacing_seconds"))


# ---- export ----------------------------------------------------------------------------------------------------


def check_index_unicity(ts: DataFrame) -> DataFrame:
    """(n_indexes, unique): distinct indexes among series that have one; compared by size, ends and hashes of instants."""
    of = ts.filter("instant IS NOT NULL").groupBy("name", "version").agg(F.count("*").alias("n"), F.min("instant").alias("a"), F.max("instant").alias("b"), F.bit_xor(F.xxhash64("instant")).alias("h"))
    return of.agg(F.count_distinct("n", "a", "b", "h").alias("n_indexes")).select("n_indexes", (F.col("n_indexes") <= 1).alias("unique"))


def export_wide(ts: DataFrame, names: list[str], versions: list[int] | None = None, check: bool = True) -> DataFrame:
    """Time, Version and one column per name; a series that a version lacks is null there."""
    rows = ts.filter(F.col("name").isin(names))
    if versions is not None:
        rows = rows.filter(F.col("version").isin(versions))
    if check and not check_index_unicity(rows).first()["unique"]:
        raise ValueError("the series to export differ in their instants")
    return rows.groupBy(F.col("instant").alias("Time"), F.col("version").alias("Version")).pivot("name", names).agg(F.first("value"))


def write_wide_series(ts: DataFrame, path: str, sep: str = ";", gzip: bool = False, check: bool = True) -> None:
    """All series of ``ts`` as a wide text table, Time;Version;<names>, in order of names, for any number of series: names are
    ranked, an instant's values meet in one row as (rank, text) and become a line in its task. The plan has as many columns for 20,000
    series as for two; only the header, a line of text, goes through the driver. Files are ranges of instants, each with its
    header."""
    if check and not check_index_unicity(ts).first()["unique"]:
        raise ValueError("the series to export differ in their instants")
    names = ts.select("name").distinct().withColumn("all", F.lit(0))
    ranked = written(numbered(names, ["all"], "name", "rank").select("name", "rank"), "names")
    header = sep.join(["Time", "Version", *[r["name"] for r in ranked.orderBy("rank").select("name").toLocalIterator()]])
    n = ranked.count()
    cells = ts.groupBy("name", "version", "instant").agg(F.first("value").cast("string").alias("text")).join(ranked, "name")
    rows = cells.groupBy("instant", "version").agg(F.collect_list(F.struct("rank", "text")).alias("cells"))
    time = F.date_format("instant", "yyyy-MM-dd'T'HH:mm:ssXXX")
    rows = rows.repartitionByRange("version", "instant").sortWithinPartitions("version", "instant").select(F.concat_ws(sep, time, "version").alias("head"), "cells")

    def lines(batches):
        first = True
        for batch in batches:
            out = [header] if first and batch.num_rows else []
            first = first and not out
            for k in range(batch.num_rows):
                cells = batch.column(1)[k].values
                line = [""] * n
                for rank, text in zip(cells.field("rank").to_pylist(), cells.field("text").to_pylist()):
                    line[rank] = text or ""
                out.append(sep.join([batch.column(0)[k].as_py(), *line]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(lines, "value string").write.option("compression", "gzip" if gzip else "none").text(path)


def write_wide(wide: DataFrame, path: str, sep: str = ";", gzip: bool = False) -> None:
    rows = wide.withColumn("Time", F.date_format("Time", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    rows.write.option("compression", "gzip" if gzip else "none").csv(path, sep=sep, header=True, emptyValue="", nullValue="")


# ---- ranges ----------------------------------------------------------------------------------------------------


def check_ranges(ranges: list[tuple[int, int]], n_points: int | None = None) -> list[tuple[int, int]]:
    """Sorted closed ranges; a first -1 means 0, a last -1 the end. Bad or overlapping ones are errors."""
    fixed = []
    for low, high in ranges or [(-1, -1)]:
        low = 0 if low == -1 else low
        high = (n_points - 1 if n_points else 2**31 - 1) if high == -1 else high
        if low < 0 or high < low:
            raise ValueError(f"bad point range [{low}, {high}]")
        fixed.append((low, high))
    fixed.sort()
    for (_, a), (b, _) in zip(fixed, fixed[1:]):
        if b <= a:
            raise ValueError("overlapping point ranges")
    return fixed


def computation_range(ts: DataFrame, versions: list[int] | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """The rows in the chosen versions (default: all) and point ranges (default: all)."""
    if versions is not None:
        ts = ts.filter(F.col("version").isin(versions))
    return filter_by_ranges(ts, check_ranges(ranges)) if ranges is not None else ts


FEW_RANGES = 64  # as conditions of a filter; more are joined


def filter_by_ranges(ts: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Points in any of the closed ranges, once each; no ranges give no rows. Ranges that meet are one. A few are a filter that
    reaches the scan, more a table of ranges."""
    joined: list[list[int]] = []
    for low, high in sorted((a, b) for a, b in ranges if a <= b):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    if len(joined) > FEW_RANGES:
        return filter_by_range_table(ts, ts.sparkSession.createDataFrame([tuple(r) for r in joined], "low long, high long"), [])
    condition = F.lit(False)
    for low, high in joined:
        condition = condition | F.col("point").between(low, high)
    return ts.filter(condition)


def filter_by_range_table(ts: DataFrame, ranges: DataFrame, keys: list[str] = ["name", "version"]) -> DataFrame:  # noqa: B006
    """Rows of ``ts`` with a point in any of the closed ranges (*keys, low, high) of their keys, once each, by an index of bins: a
    range of some 2^k points lies in three bins of that width at most, so it is that many rows; a point has one bin for each width
    in use, some 30 at most. Bins are joined by equality, the ends compared after that; nothing is compared with all ranges.
    Bounds that are null or the wrong way round hold nothing."""
    ranges = ranges.select(*keys, F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).filter("low <= high").distinct()
    width = F.length(F.bin(F.col("high") - F.col("low")))
    bins = ranges.withColumn("level", width).withColumn("bin", F.explode(F.sequence(F.expr("shiftright(low, level)"), F.expr("shiftright(high, level)"))))
    levels = sorted(r["level"] for r in bins.select("level").distinct().collect())  # bit lengths: 64 at most
    if not levels:
        return ts.limit(0)
    level = F.explode(F.array(*[F.lit(k) for k in levels]))
    points = ts.select(*keys, F.col("point").cast("long").alias("point")).distinct().withColumn("level", level).withColumn("bin", F.expr("shiftright(point, level)"))
    held = points.join(bins, [*keys, "level", "bin"]).filter("point BETWEEN low AND high").select(*keys, "point").distinct()
    return ts.join(held, [*keys, "point"], "left_semi")


def slice_points(ts: DataFrame, low: int, high: int) -> DataFrame:
    return ts.filter(F.col("point").between(low, high))


# ---- names -----------------------------------------------------------------------------------------------------


def used_series(mapping: DataFrame, direct: DataFrame, outages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name) of stored series to load: mapped ones, direct ones, planned outages, distribution keys; a calculated one
    stands for those it reads, which may be calculated themselves. ``dependencies`` is (name, needs)."""
    names = mapping.select(F.col("series").alias("name")).union(mapping.select("key_series").filter("key_series IS NOT NULL")).union(direct.select("series")).union(outages.select("series")).distinct()
    return stored_names(names, dependencies)


def stored_names(names: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name) of the stored series behind ``names``, through any number of calculations: each round follows what the round before
    has reached first, so there are as many as the longest chain. A calculation that reads itself, directly or not, is an error."""
    edges = written(dependencies.select("name", "needs").filter("name IS NOT NULL AND needs IS NOT NULL").distinct(), "dependencies")
    seen = written(names.select("name").filter("name IS NOT NULL").distinct(), "names")
    reached, more = seen, True
    while more:
        next_ = reached.join(edges, "name").select(F.col("needs").alias("name")).distinct().join(seen, "name", "left_anti")
        reached, more = written_and_found(next_, "names", F.lit(True))
        seen = seen.unionByName(reached)
    seen = written(seen, "names")
    open_, more = written_and_found(edges.join(seen, "name", "left_semi"), "open", F.lit(True))
    n = open_.count()
    while more:  # what needs only stored or settled series is settled
        waiting = open_.join(open_.select(F.col("name").alias("needs")).distinct(), "needs", "left_semi").select("name").distinct()
        open_, more = written_and_found(open_.join(waiting, "name", "left_semi"), "open", F.lit(True))
        before, n = n, open_.count()
        if more and n == before:
            some = ", ".join(sorted(r["name"] for r in open_.select("name").distinct().limit(5).collect()))
            raise ValueError(f"series that read themselves: {some}")
    return seen.join(edges.select("name").distinct(), "name", "left_anti")


def mapping_status(ts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(name, mapped) of every known series."""
    mapped = mapping.select(F.col("series").alias("name")).distinct().withColumn("hit", F.lit(True))
    return ts.select("name").distinct().join(mapped, "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("mapped"))


def tag(tags: DataFrame, known: DataFrame) -> DataFrame:
    """(name, tag, parameter): of several values of a tag the first counts; tags of unknown names are left out.
    ``tags`` is (row_id, name, tag, parameter)."""
    first = F.row_number().over(Window.partitionBy("name", "tag").orderBy("row_id"))
    return tags.join(known.select("name").distinct(), "name", "left_semi").withColumn("n", first).filter("n = 1").select("name", "tag", "parameter")


def merged_tags(own: DataFrame, dependencies: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, tag, parameter) of calculated series: their own and those of the series that they read."""
    read = dependencies.join(stored.withColumnRenamed("name", "needs"), "needs").select("name", "tag", "parameter")
    return own.unionByName(read).distinct()


def with_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Series with their users' metadata (name and any columns of strings, numbers or booleans); none gives nulls."""
    return rows.join(metadata, "name", "left")
