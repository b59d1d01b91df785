"""Gold: total sales per customer."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from tierloom.operators.aggregate import grouped_sum
from tierloom.schema import TOTAL_SALES
from tierloom.sources.layers import read_layer, write_layer

log = logging.getLogger(__name__)


def customer_sales(silver: DataFrame) -> DataFrame:
    """``customer_id, SUM(amount) AS total_sales``.

    Reads two columns of silver; a partial sum per map task means the
    shuffle moves one row per customer per task, however skewed the
    customers are.
    """
    return grouped_sum(silver, key="customer_id", value="amount", alias=TOTAL_SALES)


def run_gold(
    spark: SparkSession,
    silver_path: str,
    gold_path: str,
    fmt: str | None = None,
    overwrite_schema: bool = False,
) -> str:
    """Replace the gold mart with the totals over the silver layer."""
    totals = customer_sales(read_layer(spark, silver_path, fmt=fmt))
    write_layer(totals, gold_path, fmt=fmt, overwrite_schema=overwrite_schema)
    log.info("wrote gold layer %s from %s", gold_path, silver_path)
    return gold_path
