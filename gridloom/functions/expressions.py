"""Calculated series: operators on series that build columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import divide, gt, indicator, lt


@dataclass(frozen=True, eq=False)
class Series:
    """An expression over named series of one (version, point). ``names`` are the stored series that it reads."""

    build: object  # function of {name: Column} -> Column
    names: frozenset

    def _with(self, other, f) -> Series:
        o = other if isinstance(other, Series) else const(other)
        return Series(lambda c: f(self.build(c), o.build(c)), self.names | o.names)

    def _map(self, f) -> Series:
        return Series(lambda c: f(self.build(c)), self.names)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __radd__(self, o):
        return const(o) + self

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return const(o) - self

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return const(o) * self

    def __truediv__(self, o):
        return self._with(o, divide)

    def __rtruediv__(self, o):
        return const(o) / self

    def __gt__(self, o):
        return self._with(o, lambda a, b: indicator(gt(a, b)))

    def __lt__(self, o):
        return self._with(o, lambda a, b: indicator(lt(a, b)))

    def __ge__(self, o):
        return self._with(o, lambda a, b: indicator(gt(a, b) | ((a == b) & ~F.isnan(a))))

    def __le__(self, o):
        return self._with(o, lambda a, b: indicator(lt(a, b) | ((a == b) & ~F.isnan(a))))

    def __neg__(self):
        return self._map(lambda a: -a)

    def abs(self):
        return self._map(F.abs)

    def min(self, k: float):
        """Values above k become k."""
        return self._map(lambda a: F.when(F.isnan(a), a).otherwise(F.least(a, F.lit(float(k)))))

    def max(self, k: float):
        """Values below k become k."""
        return self._map(lambda a: F.when(F.isnan(a), a).otherwise(F.greatest(a, F.lit(float(k)))))

    def time(self):
        """The instant of each point in seconds since 1970; only the index counts, not the values."""
        return Series(lambda c: c["__instant"].cast("double"), self.names)


def const(value: float) -> Series:
    """A number: a series without an index of its own, with the same value at every point."""
    return Series(lambda c: F.lit(float(value)), frozenset())


def series(name: str) -> Series:
    return Series(lambda c: c[name], frozenset([name]))


def calculate(ts: DataFrame, wanted: dict[str, Series], index: DataFrame | None = None, versions=None) -> DataFrame:
    """(name, version, point, instant, value) of calculated series.

    All stored series that are read come into one row per (version, point) by one pivot; expressions, nested ones too,
    are columns of that row, and one unpivot gives the long table. Versions are those of the inputs; series without any
    input need ``index`` (version, point, instant). A name that isn't stored is an error.
    """
    names = sorted(reduce(lambda a, b: a | b, (s.names for s in wanted.values()), frozenset()))
    if versions is not None:
        ts = ts.filter(F.col("version").isin(list(versions)))
    if names:
        missing = set(names) - {r["name"] for r in ts.filter(F.col("name").isin(names)).select("name").distinct().collect()}
        if missing:
            raise ValueError(f"time series not found: {', '.join(sorted(missing))}")
        aggregates = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"s{k}") for k, n in enumerate(names)]
        wide = ts.filter(F.col("name").isin(names)).groupBy("version", "point", "instant").agg(*aggregates)
    elif index is None:
        raise ValueError("constant series need an index")
    else:
        wide = index.select("version", "point", "instant").distinct()
    columns: dict[str, Column] = {n: F.col(f"s{k}") for k, n in enumerate(names)} | {"__instant": F.col("instant")}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), s.build(columns).cast("double").alias("value")) for n, s in wanted.items()])
    return wide.select("version", "point", "instant", F.explode(pairs).alias("e")).select("e.name", "version", "point", "instant", "e.value")
