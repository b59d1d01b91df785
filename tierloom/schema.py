"""Schemas of the one entity, ``sales``, as it moves through the layers.

Bronze comes in two modes: every column a string (no inference) or the
types Spark infers from the CSV text. ``SALES_TYPED`` is the explicit
schema to pass instead of inference when the landing zone is large:
inference costs one extra full read of the input.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# The names the reference gives the sales columns (in file
# order), the gold total and the post-load count. Results must carry them.
SALES_COLUMNS = ("order_id", "customer_id", "product", "amount", "order_date")
TOTAL_SALES = "total_sales"
ROW_COUNT = "rows"

# Bronze, typed mode, declared instead of inferred. Customer ids stay text
# because the landed files may carry ids such as "C001".
SALES_TYPED = StructType(
    [
        StructField("order_id", LongType(), True),
        StructField("customer_id", StringType(), True),
        StructField("product", StringType(), True),
        StructField("amount", DoubleType(), True),
        StructField("order_date", DateType(), True),
    ]
)
