"""Data tables: ordered rows of strings with a ``row_id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "row_id"


def create(spark: SparkSession, header: list[str], rows: list[list[str]]) -> DataFrame:
    """A table of the rows; a header with duplicates or a row of another width is an error."""
    if len(set(header)) != len(header):
        raise ValueError("duplicate header names")
    if any(len(r) != len(header) for r in rows):
        raise ValueError("row size differs from header size")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, " + ", ".join(f"`{h}` string" for h in header))


def create_from(rows: DataFrame, header: list[str], cells="cells", order=ROW) -> DataFrame:
    """As ``create``, of a table of rows: ``cells`` is an array of strings, ``order`` the row's number. A row of another width
    fails when the table is read."""
    if len(set(header)) != len(header):
        raise ValueError("duplicate header names")
    wrong = F.raise_error(F.concat(F.lit("row size differs from header size in row "), F.col(order).cast("string")))
    fits = F.when(F.size(cells) == len(header), F.col(cells)).otherwise(wrong)
    found = rows.select(F.col(order).cast("long").alias(ROW), fits.alias("c"))
    return found.select(ROW, *[F.col("c")[k].alias(h) for k, h in enumerate(header)])


def names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c != ROW]


def _known(table: DataFrame, columns) -> None:
    unknown = [c for c in columns if c not in names(table)]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")


def condition(table: DataFrame, where: dict[str, list[str]]) -> Column:
    """All columns must hold one of their values, compared without case; null never does."""
    _known(table, where)
    parts = [F.lower(F.col(c)).isin([v.lower() for v in values if v is not None]) for c, values in where.items()]
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(True))


def data(table: DataFrame, column: str | None = None) -> DataFrame:
    if column is None:
        return table.select(*names(table))
    _known(table, [column])
    return table.select(column)


def get(table: DataFrame, column: str | None = None) -> DataFrame:
    """The values as ``column:value``."""
    own = data(table, column)
    return own.select(*[F.concat(F.lit(f"{c}:"), F.col(c)).alias(c) for c in own.columns])


def lines(table: DataFrame) -> DataFrame:
    """(row_id, line): rows as maps from column to value."""
    pairs = [x for c in names(table) for x in (F.lit(c), F.col(c))]
    return table.select(ROW, F.create_map(*pairs).alias("line"))


def filter_rows(table: DataFrame, select: list[str], where: dict[str, list[str]]) -> DataFrame:
    _known(table, select)
    return table.filter(condition(table, where)).select(*select)


def search_first_value(table: DataFrame, column: str, where: dict[str, list[str]]) -> DataFrame:
    """One row or none: the value in the first matching row."""
    _known(table, [column])
    return table.filter(condition(table, where)).orderBy(ROW).limit(1).select(column)


def search_value_list(table: DataFrame, column: str, where: dict[str, list[str]]) -> DataFrame:
    return filter_rows(table, [column], where)


def remove_lines(table: DataFrame, where: dict[str, list[str]]) -> DataFrame:
    return table.filter(~condition(table, where))


def add_lines(table: DataFrame, other: DataFrame) -> DataFrame:
    """Other rows after the table's; the columns must be the same, in any order."""
    if set(names(table)) != set(names(other)):
        raise ValueError("columns differ")
    last = table.agg(F.coalesce(F.max(ROW), F.lit(-1)).alias("__last"))
    moved = other.crossJoin(F.broadcast(last)).withColumn(ROW, F.col(ROW) + F.col("__last") + 1).drop("__last")  # one row
    return table.unionByName(moved)


def replace_values(table: DataFrame, columns: list[str], where: dict[str, list[str]], values: list[str]) -> DataFrame:
    if len(columns) != len(values):
        raise ValueError("as many values as columns are needed")
    _known(table, columns)
    hit = condition(table, where)
    return table.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in zip(columns, values)})
