"""Silver: deduplicate and type the bronze rows."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from tierloom.functions.cleaning import amount_as_double, order_date_as_date
from tierloom.operators.dedup import dedup_rows
from tierloom.sources.layers import read_layer, read_table, write_layer

log = logging.getLogger(__name__)


def clean(bronze: DataFrame, strict: bool = False) -> DataFrame:
    """Full-row dedup on the raw values, then ``amount`` to double and
    ``order_date`` to date, each in place (O10 → O8 → O9).

    The order matters: deduplicating first keeps rows whose text differs
    but whose typed values would be equal (``"120"`` / ``"120.0"``). One
    shuffle, on the hash of all columns; the casts run in the same
    codegen stage as the final dedup aggregate.
    """
    return dedup_rows(bronze).withColumns(
        {
            "amount": amount_as_double("amount", strict=strict),
            "order_date": order_date_as_date("order_date", strict=strict),
        }
    )


def run_silver(
    spark: SparkSession,
    bronze: str,
    silver_path: str,
    fmt: str | None = None,
    strict: bool = False,
    from_path: bool = False,
    overwrite_schema: bool = False,
) -> str:
    """Replace the silver layer with the cleaned bronze.

    ``bronze`` is a table name, or with ``from_path`` a table path (O5).
    """
    rows = read_layer(spark, bronze, fmt=fmt) if from_path else read_table(spark, bronze)
    write_layer(clean(rows, strict=strict), silver_path, fmt=fmt, overwrite_schema=overwrite_schema)
    log.info("wrote silver layer %s from %s", silver_path, bronze)
    return silver_path
