"""Round trips through files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.scratch import shared_dir
from ..sources import series as src
from ..sources.store import SeriesStore
from ..streaming.append import append_result_chunks, export_when_complete
from .registry import query

ALL = "SELECT name, version, instant, value FROM ts"


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _exported(t, gzip: bool) -> str:
    path = _folder(t, "csv")
    src.write_wide_series(t.kept_ts, path, gzip=gzip)
    return path


@query(
    "a1_read_csv",
    f"""
    SELECT name, version, CAST(dense_rank() OVER (PARTITION BY version
    ORDER BY instant) - 1 AS INT) AS point, instant, value FROM ({ALL})""",
    "ts",
)
def a1(t):
    return src.read_ts_csv(t.spark, [_exported(t, False)])[0]


@query("a8_export_gzip", f"SELECT name, version, instant, value FROM ({ALL})", "ts")
def a8(t):
    return src.read_ts_csv(t.spark, [_exported(t, True)])[0].select("name", "version", "instant", "value")


@query("a2_read_json", "SELECT name, CAST(1 AS INT) AS version, point, value FROM ts WHERE version = 1", "ts")
def a2(t):
    """Half of each series as values, half as steps of length one; one file per series, on an hourly index."""
    path = _folder(t, "json")
    values = F.transform(F.array_sort(F.collect_list(F.struct("point", "value"))), lambda x: x["value"])
    rows = t.ts.filter("version = 1").groupBy("name").agg(values.alias("v"))
    half = F.floor(F.size("v") / 2).cast("int")
    index = F.struct(F.lit(0).alias("startTime"), ((F.size("v") - 1) * 3_600_000).alias("endTime"), F.lit(3_600_000).alias("spacing"))
    plain = F.struct(F.lit(0).alias("offset"), F.slice("v", F.lit(1), half).alias("values"), F.lit(None).cast("array<double>").alias("stepValues"), F.lit(None).cast("array<int>").alias("stepLengths"))
    rest = F.slice("v", half + 1, F.size("v"))
    steps = F.struct(half.alias("offset"), F.lit(None).cast("array<double>").alias("values"), rest.alias("stepValues"), F.transform(rest, lambda _: F.lit(1)).alias("stepLengths"))
    metadata = F.struct(F.col("name"), F.lit("double").alias("dataType"), index.alias("regularIndex"))
    rows.select(F.to_json(F.struct(metadata.alias("metadata"), F.array(plain, steps).alias("chunks"))).alias("value"), F.col("name").alias("file")).write.partitionBy("file").text(path)
    return src.read_ts_json(t.spark, f"{path}/*").select("name", "version", "point", F.col("value").cast("double").alias("value"))


@query("a5_store", """
    SELECT name, version, CAST(row_number() OVER (PARTITION BY name, version ORDER BY instant) - 1 AS INT) AS point, instant,
           CASE WHEN name = 'ts_3' AND version = 1 THEN value + 1 ELSE value END AS value FROM ts""", "ts")
def a5_store(t):
    """Two halves appended, a third time refused as a whole, one series overwritten, on disk."""
    store = SeriesStore(t.spark, _folder(t, "series"), buckets=4)
    store.append(t.kept_ts.filter("point < 40"))
    later = t.kept_ts.filter("point >= 40")
    store.append(later, src.APPEND)
    for bad in (later, t.kept_ts.filter("point < 3")):
        try:
            store.append(bad, src.APPEND)
        except ValueError:
            continue
        raise AssertionError("stored twice")
    store.append(t.kept_ts.filter("name = 'ts_3' AND version = 1").withColumn("value", F.col("value") + 1), src.OVERWRITE)
    return store.read()


def _streamed(t) -> str:
    """Two chunks in the wrong order and one that is stored already, through the stream; the store's folder."""
    source, store, checkpoint, refused = (_folder(t, x) for x in ("chunks", "store", "checkpoint", "refused"))
    for part in (t.kept_ts.filter("point >= 50"), t.kept_ts.filter("point < 50"), t.kept_ts.filter("point < 10")):
        part.write.mode("append").parquet(source)
        append_result_chunks(t.spark, source, store, checkpoint, refused).awaitTermination()
    return store


@query("r1_append_result_chunks", "SELECT name, version, point, instant, value FROM ts", "ts")
def r1(t):
    return t.spark.read.parquet(_streamed(t)).select("name", "version", "point", "instant", "value")


@query("r1_final_export", "SELECT name, version, instant, value FROM ts", "ts")
def r1_export(t):
    """The stream's result as the file that is written once all chunks are there."""
    path = _folder(t, "export")
    expected = t.kept_ts.groupBy("name", "version").agg(F.count("*").alias("n_points"))
    if not export_when_complete(t.spark, _streamed(t), expected, path):
        raise AssertionError("chunks are missing")
    return src.read_ts_csv(t.spark, [path])[0].select("name", "version", "instant", "value")


@query(
    "u5_metadata",
    """
    SELECT DISTINCT t.name, n.n_name AS unit, n.n_regionkey = 0 AS kept
    FROM ts t LEFT JOIN nation n ON t.name = concat('ts_', CAST(n.n_nationkey AS STRING)) AND n.n_nationkey < 20""",
    "ts",
)
def u5(t):
    metadata = t.nation.filter("n_nationkey < 20").select(F.concat(F.lit("ts_"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("unit"), (F.col("n_regionkey") == 0).alias("kept"))
    return src.with_metadata(t.ts.select("name").distinct(), metadata)
