"""tierloom: a Spark-native bronze → silver → gold sales engine.

Every transform is a plain ``DataFrame → DataFrame`` function that
Catalyst plans; only ``tierloom.sources`` touches storage.
"""

from tierloom.functions import amount_as_double, order_date_as_date
from tierloom.operators import dedup_rows, grouped_sum, row_count
from tierloom.plans import Layers, clean, customer_sales, ingest, run_gold, run_medallion, run_silver
from tierloom.sources import (
    EmptyLandingError,
    NotALayerError,
    SchemaMismatchError,
    read_layer,
    read_raw,
    read_table,
    write_layer,
    write_table,
)

__all__ = [
    "EmptyLandingError",
    "Layers",
    "NotALayerError",
    "SchemaMismatchError",
    "amount_as_double",
    "clean",
    "customer_sales",
    "dedup_rows",
    "grouped_sum",
    "ingest",
    "order_date_as_date",
    "read_layer",
    "read_raw",
    "read_table",
    "row_count",
    "run_gold",
    "run_medallion",
    "run_silver",
    "write_layer",
    "write_table",
]
