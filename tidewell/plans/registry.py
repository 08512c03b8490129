"""All registered queries of the general operators, with their oracle SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = ["sources", "cleaning", "features", "validation", "aggregation", "ordering", "statistics", "drift", "regulatory", "governance", "learning", "streams", "metadata", "advisors"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, with DuckDB SQL for the same rows where there is some."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables of ``sf_dir`` that ``text`` names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidewell.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
