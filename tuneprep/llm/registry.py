"""The queries of this package and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

ROWS_PER_BATCH = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of at most ROWS_PER_BATCH, unless the session says otherwise.

    Ten thousand rows, the default, are much memory where texts are long.
    """
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(ROWS_PER_BATCH))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
