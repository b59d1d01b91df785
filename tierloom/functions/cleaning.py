"""Column expressions that type bronze text in place.

Spark 4 runs in ANSI mode by default, where ``cast('x' as double)`` and
``to_date('x')`` fail the whole job. The tolerant forms (the default)
turn a malformed value into NULL instead, which is what the plain forms
give with ANSI off, so one bad row cannot stop a batch. ``strict=True``
gives the plain forms and follows the session's ANSI setting.

Both stay JVM-side expressions inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount_as_double(column: str | Column = "amount", strict: bool = False) -> Column:
    """The value as ``double`` (O8); NULL where the text is not a number."""
    col = F.col(column) if isinstance(column, str) else column
    return col.cast("double") if strict else col.try_cast("double")


def order_date_as_date(column: str | Column = "order_date", strict: bool = False) -> Column:
    """The value as ``date`` (O9) by Spark's default ``yyyy-MM-dd`` rules.

    A date passes through unchanged; a timestamp keeps its date part;
    unparseable text gives NULL.
    """
    col = F.col(column) if isinstance(column, str) else column
    return F.to_date(col) if strict else F.try_to_date(col)
