"""Result chunks appended as they arrive, and their export when all are there."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.series import TS, write_wide_series

CHUNK = ["file", "name", "version"]
OUT = f"{TS}, file string, refused boolean"


def covered_by(intervals: list[tuple[int, int]], points: list[int]) -> bool:
    return any(low <= p <= high for p in points for low, high in intervals)


def cover(intervals: list[tuple[int, int]], points: list[int]) -> list[tuple[int, int]]:
    """Closed intervals, sorted and apart, with ``points`` added."""
    out: list[list[int]] = []
    for low, high in sorted([*intervals, *((p, p) for p in points)]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def _judge(key: tuple, parts: Iterable[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
    """A series and version: its chunks in order of their files, each against what is covered so far. The state is that as text,
    so it grows with gaps, not with points."""
    text = state.get[0] if state.exists else ""
    held = [tuple(map(int, x.split(":"))) for x in text.split(",") if x]
    rows = pd.concat(list(parts), ignore_index=True)
    for _, chunk in rows.groupby("file", sort=True):
        points = chunk["point"].tolist()
        bad = len(set(points)) < len(points) or covered_by(held, points)
        if not bad:
            held = cover(held, points)
        yield chunk.assign(refused=bad)
    state.update((",".join(f"{low}:{high}" for low, high in held),))


def append_result_chunks(spark: SparkSession, source: str, store: str, checkpoint: str, refused: str, files_per_batch: int | None = None):
    """Appends chunks to the Parquet ``store``, once per file whatever order they come in. A chunk is what a file in ``source`` of
    TS rows holds of a series and version. One with a point that is stored already, or that it or a file before it (by
    path) of the same batch holds too, goes to ``refused`` as a whole. Returns the query; it ends when all files are read.

    What is stored is known from a keyed state, the covered intervals of each series and version, kept with the checkpoint: a
    batch reads its own files only, however much is stored. A batch that is run again starts from the state before it and
    overwrites its own part."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, bad in ((store, False), (refused, True)):
            batch.filter(F.col("refused") == bad).drop("file", "refused").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    stream = spark.readStream.schema(TS)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    rows = stream.parquet(source).withColumn("file", F.col("_metadata.file_path"))
    judged = rows.groupBy("name", "version").applyInPandasWithState(_judge, OUT, "covered string", "append", "NoTimeout")
    return judged.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing_points(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, version, n_missing) of ``expected`` (name, version, n_points), as far as points are missing."""
    n = stored.groupBy("name", "version").agg(F.count_distinct("point").alias("n"))
    both = expected.join(n, ["name", "version"], "left").select("name", "version", (F.col("n_points") - F.coalesce("n", F.lit(0))).alias("n_missing"))
    return both.filter("n_missing > 0")


def export_when_complete(spark: SparkSession, store: str, expected: DataFrame, path: str, gzip: bool = True) -> bool:
    """Once a run has ended: if the store has all points of ``expected`` (name, version, n_points), writes its series as a wide
    table to ``path``, as compressed text. Returns whether it did; as long as chunks are missing nothing is written. The
    whole store is read once, here and in no batch."""
    stored = spark.read.schema(f"{TS}, batch long").parquet(store).drop("batch")
    if missing_points(stored, expected).limit(1).count():
        return False
    asked = stored.join(expected.select("name", "version"), ["name", "version"], "left_semi")
    write_wide_series(asked, path, gzip=gzip, check=False)
    return True
