"""Relational operators over DataFrames."""

from tierloom.operators.aggregate import grouped_sum, row_count
from tierloom.operators.dedup import dedup_rows

__all__ = ["dedup_rows", "grouped_sum", "row_count"]
