"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


OWN: dict[str, str] = {}  # folders by application, where the cluster names none


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, the warehouse, or a temporary folder if Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app in OWN:
        return OWN[app]
    if master.startswith("local") and not master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix="gridloom-")
    else:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/gridloom-checkpoints"
    OWN[app] = path
    return path


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes ``df`` to a new folder in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_found(df: DataFrame, label: str, condition: Column) -> tuple[DataFrame, bool]:
    """As ``written``, and whether any row meets the condition, observed as rows are written: no second job."""
    seen = Observation()
    table = written(df.observe(seen, F.count("*").alias("rows"), F.count_if(condition).alias("n")), label)
    return table, bool(seen.get["n"])
