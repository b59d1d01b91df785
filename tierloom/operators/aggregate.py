"""Aggregations: grouped sum (O11) and the post-load row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.schema import ROW_COUNT, TOTAL_SALES
from tierloom.sources.layers import quote_name


def grouped_sum(
    df: DataFrame,
    key: str = "customer_id",
    value: str = "amount",
    alias: str = TOTAL_SALES,
) -> DataFrame:
    """``SUM(value)`` per ``key``.

    A NULL key is a group of its own; NULL values are skipped; a group
    whose values are all NULL sums to NULL. Spark adds up each map task's
    rows per key before the shuffle, so the shuffle carries one partial
    sum per key per task: a customer with a third of all rows costs no
    more to move than any other.
    """
    return df.groupBy(key).agg(F.sum(value).alias(alias))


def row_count(spark: SparkSession, table: str) -> DataFrame:
    """``SELECT COUNT(*) AS rows FROM <table>`` (O7): one ``bigint`` column.

    Each task counts its split and one row per task crosses to a single
    final count; on Parquet no column is decoded.
    """
    return spark.sql(f"SELECT COUNT(*) AS {ROW_COUNT} FROM {quote_name(table)}")
