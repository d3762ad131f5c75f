"""Named queries over the star-schema tables, each with its SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# fixed values of the bundled tables
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

SIGNAL_CTE = """s AS (SELECT user_id AS entity, event_type AS channel, event_id AS sample,
    (epoch_us(ts) - 1704067200000000) / 1000000.0 AS t, value AS v FROM events)"""


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as long samples: entity, channel, sample id, t in seconds, v."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("channel"), F.col("event_id").alias("sample"),
        (us / 1000000.0).alias("t"), F.col("value").alias("v"),
    )


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Round every DOUBLE column as the SQL does: the scaled value to the next whole number, halves away from zero.

    Spark's own ROUND goes by the decimal digits of the value instead, so the two may differ where these end in 5.
    """
    def scaled(c: str):
        by = float(10 ** by_column.get(c, digits))
        return (F.round(F.col(c) * by) / by).alias(c)

    return df.select(*[scaled(c) if t == "double" else F.col(c) for c, t in df.dtypes])
