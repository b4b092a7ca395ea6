"""Where queries are registered, and plug-ins are looked up by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class PluginNotFoundError(LookupError):
    pass


class Plugins:
    """Sources of records, searches in databases, aligners and tree samplers: functions that return DataFrames, by kind and name."""

    KINDS = ("records", "database", "alignment", "assignment")

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Callable] = {}

    def add(self, kind: str, name: str, function: Callable) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"no such kind of plug-in: {kind}")
        self._known[kind, name.lower()] = function

    def find(self, kind: str, name: str) -> Callable:
        try:
            return self._known[kind, name.lower()]
        except KeyError:
            raise PluginNotFoundError(f"{kind}: {name}") from None
