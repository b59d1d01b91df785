"""Scalar column functions."""

from tierloom.functions.cleaning import amount_as_double, order_date_as_date

__all__ = ["amount_as_double", "order_date_as_date"]
