"""Bronze: landed CSV into a managed table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tierloom.sources.landing import read_raw
from tierloom.sources.layers import read_table, write_table

log = logging.getLogger(__name__)


def ingest(
    spark: SparkSession,
    raw_path: str,
    table: str,
    infer: bool = False,
    schema: StructType | str | None = None,
    fmt: str | None = None,
    overwrite_schema: bool = False,
    check_headers: bool = False,
    csv_options: dict[str, str] | None = None,
) -> DataFrame:
    """Replace bronze table ``table`` with the CSV files under ``raw_path``.

    All-string by default (O1 → O4); ``infer=True`` for inferred types
    (O2 → O4), or an explicit ``schema`` to skip the inference pass. A
    missing ``raw_path``, or one without files, fails before the table is
    touched (O3). The copy is a narrow scan-to-write: no shuffle, one output
    file per input split. ``check_headers`` and ``csv_options`` go to
    ``read_raw``; a header that does not match fails the write and leaves
    the old table. Returns the bronze table; count it with ``row_count``
    (O7).
    """
    raw = read_raw(spark, raw_path, infer=infer, schema=schema, check_headers=check_headers, **(csv_options or {}))
    write_table(raw, table, fmt=fmt, overwrite_schema=overwrite_schema)
    log.info("wrote bronze table %s from %s", table, raw_path)
    return read_table(spark, table)
