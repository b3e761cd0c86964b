"""The registered queries of the library, each over the bindings of a data folder, with their twins in SQL."""

from . import files, mapping, network, results, series
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "mapping", "network", "results", "series"]
