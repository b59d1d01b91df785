"""Landing-zone scan: headered CSV files into a DataFrame (O1, O2, O3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class EmptyLandingError(FileNotFoundError):
    """The landing path exists but holds no file to take columns from."""


def read_raw(
    spark: SparkSession,
    path: str,
    infer: bool = False,
    schema: StructType | str | None = None,
    check_headers: bool = False,
    **csv_options: str,
) -> DataFrame:
    """Read landed CSV whose first line is a header.

    ``infer=False`` (O1) gives every column as ``string``; the only work
    before the first action is reading the header line. ``infer=True``
    (O2) lets Spark infer types, which is one extra full pass over the
    input before anything is written; at scale pass ``schema=`` (for
    example ``SALES_TYPED``) instead and no pass is made. The CSV option
    ``samplingRatio`` infers from a sample, but then a later value that
    does not fit the sampled type becomes NULL (PERMISSIVE mode).

    Spark takes the names from one file and maps every other file by
    position. ``check_headers=True`` compares each file's header with the
    names as the file is read (``enforceSchema=false``), so that a drop with
    one reordered file fails instead of being read silently wrong. The check
    is part of the scan of a file's columns: it adds no job, and a bare
    ``count()``, which reads no column, does not make it. It also refuses
    blank and repeated header cells, which Spark otherwise renames (``_c1``,
    ``a0``), and is therefore off by default.

    Defaults otherwise are Spark's: comma separator, ``"`` quote,
    PERMISSIVE mode. A missing path raises ``AnalysisException``
    ``[PATH_NOT_FOUND]`` here, while the plan is built, so a job fails
    before it writes anything (O3). A path with no data files gives Spark
    no header and an empty schema rather than an error (and overwriting a
    table with that drops the table, then fails), so that raises
    ``EmptyLandingError`` here too; with a declared schema an empty drop
    is simply zero rows.
    """
    reader = spark.read.format("csv").option("header", "true")
    if check_headers:
        reader = reader.option("enforceSchema", "false")
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", "true")
    if csv_options:
        reader = reader.options(**csv_options)
    df = reader.load(path)
    if not df.schema.fields:
        raise EmptyLandingError(f"no CSV files with a header under {path}")
    return df
