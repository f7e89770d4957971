"""Where queries register: name, function (spark, sf_dir) and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["relational", "series", "profiles", "features", "models", "records", "flights"]


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidewater.plans.{m}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; timestamps without a zone are read as instants in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})
