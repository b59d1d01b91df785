"""Full-row deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedup_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of rows equal in every column; NULLs are equal.

    Values are compared as they are, so in an all-string bronze ``"120"``
    and ``"120.0"`` are different rows: run this before any cast.

    Catalyst plans it as an aggregate keyed on every column: a partial
    aggregate in each map task collapses copies before the shuffle, so
    even a row copied into a third of the input reaches its reducer at
    most once per map task. The shuffle hashes all columns, so a hot
    customer or product does not land in one partition.
    """
    return df.dropDuplicates()
