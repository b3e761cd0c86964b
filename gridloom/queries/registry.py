"""Queries by name."""

from __future__ import annotations

from ..plans.scratch import written
from ..plans.spread import dealt
from ..sources.bindings import BINDINGS, bind, with_bindings

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The bindings of one data folder: ``t.ts`` is the DataFrame of binding ts, ``t.kept_ts`` the same as a written table,
    for queries that read it in several branches."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self._kept = spark, sf_dir, {}

    def __getattr__(self, name):
        if name not in self._kept:
            kept = name.startswith("kept_")
            df = bind(self.spark, self.sf_dir, name.removeprefix("kept_"))
            self._kept[name] = written(df, name) if kept else df
        return self._kept[name]

    def points(self) -> int:
        return self.kept_ts.select("version", "point").distinct().count()

    def redispatch_for(self, times: int):
        """The binding redispatch, of equipment that is dealt to tasks before it makes ``times`` rows of each point."""
        return self.spark.sql(BINDINGS["redispatch"], equipment=dealt(self.equipment, self.points() * times, "id"), ts=self.kept_ts)

    @property
    def redispatch(self):
        if "redispatch" not in self._kept:
            self._kept["redispatch"] = self.redispatch_for(1)
        return self._kept["redispatch"]

    def once(self, name: str, build):
        """The table that ``build`` gives, written when first asked for."""
        if name not in self._kept:
            self._kept[name] = written(build(), name)
        return self._kept[name]


def query(name: str, sql: str | None = None, *names: str, **extra: str):
    """Registers a function of Tables; ``sql`` is its twin over the named bindings and extra clauses."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_bindings(sql, *names, **extra)
        return f

    return register
