"""Registered queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def register(name: str, sql: str | None = None, digits: int | None = 6):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out if digits is None else rounded(out, digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    """Import every module of registered queries once."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"orbtable.catalog.{mod}")


MODULES = ["fields", "meshes", "places", "surfaces", "supersteps", "clouds", "ingest", "streams"]
