"""Columnar layer storage: managed tables and table paths.

Every sink is a full refresh (``mode("overwrite")``). The format is a
parameter: ``"delta"`` where the Delta jars are installed, ``"parquet"``
otherwise. The session setting ``spark.tierloom.format`` picks the default.

Delta keeps the old table when an overwrite fails, and refuses one that
changes the schema unless told otherwise. For other formats the sinks do
both themselves: the new contents are written beside the target first, in
the target's own file system or database, and take its place only when the
whole job has succeeded. Until then the target is untouched, so a job that
fails, or that reads the layer it replaces, loses nothing.

What is not atomic is the exchange itself, two renames: a reader between
them finds no target, and if the driver dies there, the old contents are
left beside it (``.<name>.old-*``, or table ``<name>__old_*``). An object
store renames by copying, which makes that moment longer; use Delta there.
A rename of a layer that fails, by its answer or by an exception, puts the
old layer back and leaves the new contents beside it; ``ExchangeError`` says
where.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tierloom.session import hadoop_path

FORMAT_CONF = "spark.tierloom.format"
DEFAULT_FORMAT = "parquet"


class SchemaMismatchError(ValueError):
    """An overwrite would change the schema of an existing table or layer."""


class NotALayerError(ValueError):
    """An overwrite would replace a folder that holds other folders."""


class ExchangeError(OSError):
    """The new contents are written, but could not take the target's place."""


def table_format(spark: SparkSession, fmt: str | None = None) -> str:
    return fmt or spark.conf.get(FORMAT_CONF, None) or DEFAULT_FORMAT


def _columns(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name.lower(), f.dataType.simpleString()) for f in schema.fields]


def _check_schema(existing: StructType | None, incoming: StructType, target: str) -> None:
    if existing is not None and _columns(existing) != _columns(incoming):
        raise SchemaMismatchError(
            f"overwrite of {target} would change its schema from "
            f"{existing.simpleString()} to {incoming.simpleString()}; "
            "pass overwrite_schema=True to replace it"
        )


def _existing_layer_schema(spark: SparkSession, path: str, fmt: str) -> StructType | None:
    try:
        return spark.read.format(fmt).load(path).schema
    except AnalysisException as err:
        # Absent or empty target: nothing to protect.
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_layer(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Load a layer by path (O5); schema comes from the files.

    Columnar: a later projection or filter reaches the scan as
    ``ReadSchema`` / ``PushedFilters``.
    """
    return spark.read.format(table_format(spark, fmt)).load(path)


def write_layer(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    overwrite_schema: bool = False,
) -> str:
    """Replace the layer at ``path`` with ``df``.

    ``df`` may read the layer that it replaces. A target that holds folders
    is refused: layers have none, so it is a parent of layers, and replacing
    it would delete them.
    """
    spark = df.sparkSession
    fmt = table_format(spark, fmt)
    if fmt == "delta":
        _delta(df, overwrite_schema).save(path)
        return path
    fs, target = hadoop_path(spark, path)
    there = fs.exists(target)
    if there:
        if fs.getContentSummary(target).getDirectoryCount() > 1:
            raise NotALayerError(f"{path} holds other folders; a layer's folder has none")
        if not overwrite_schema:
            _check_schema(_existing_layer_schema(spark, path, fmt), df.schema, path)
    beside = lambda kind: target.suffix(f".{kind}-{uuid.uuid4().hex}")
    staging, old = (_hidden(spark, beside(kind)) for kind in ("staging", "old"))
    try:
        df.write.format(fmt).save(staging.toString())
    except BaseException:
        fs.delete(staging, True)
        raise
    _exchange(fs, staging, target, old, there)
    if there:
        fs.delete(old, True)
        spark.catalog.refreshByPath(path)
    return path


def _extent(fs, path) -> tuple[int, int] | None:
    """Bytes and files of a folder; None if there is none."""
    if not fs.exists(path):
        return None
    found = fs.getContentSummary(path)
    return found.getLength(), found.getFileCount()


def _exchange(fs, staging, target, old, there: bool) -> None:
    """Move the target aside and ``staging`` to its place.

    A rename that copies may fail halfway and leave two folders. So what is
    whole is found by its extent, and nothing is deleted but what is whole
    elsewhere.
    """
    new, was = _extent(fs, staging), _extent(fs, target)

    def move(source, to) -> None:
        if not fs.rename(source, to):
            raise OSError(f"{source.toString()} could not be moved to {to.toString()}")

    try:
        if there:
            move(target, old)
        move(staging, target)
    except Exception as err:
        whole = _extent(fs, staging) == new
        kept = f"the new contents are in {staging.toString()}"
        if there and _extent(fs, old) == was and whole:
            fs.delete(target, True)
            move(old, target)
        elif there and _extent(fs, target) == was and whole:
            fs.delete(old, True)
        elif not there and whole:
            fs.delete(target, True)
        else:
            kept = f"see also {old.toString()} and {staging.toString()}"
        raise ExchangeError(f"{target.toString()} could not be replaced ({err}); {kept}") from err


def _hidden(spark: SparkSession, path):
    """The same path with a dot before its name: scans pass over it."""
    return spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}")


def _delta(df: DataFrame, overwrite_schema: bool):
    writer = df.write.format("delta").mode("overwrite")
    return writer.option("overwriteSchema", "true") if overwrite_schema else writer


def write_table(
    df: DataFrame,
    name: str,
    fmt: str | None = None,
    overwrite_schema: bool = False,
) -> str:
    """Replace the contents of managed table ``name`` with ``df``.

    ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    fmt = table_format(spark, fmt)
    if fmt == "delta":
        _delta(df, overwrite_schema).saveAsTable(name)
        return name
    there = spark.catalog.tableExists(name)
    if there and not overwrite_schema:
        _check_schema(spark.table(name).schema, df.schema, name)
    mark = uuid.uuid4().hex[:16]
    staging, old = f"{name}__staging_{mark}", f"{name}__old_{mark}"

    def rename(source: str, target: str) -> None:
        spark.sql(f"ALTER TABLE {quote_name(source)} RENAME TO {quote_name(target)}")

    try:
        df.write.format(fmt).saveAsTable(staging)
        if there:
            rename(name, old)
        try:
            rename(staging, name)
        except Exception:
            if there:
                rename(old, name)
            raise
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {quote_name(staging)}")
    if there:
        spark.sql(f"DROP TABLE IF EXISTS {quote_name(old)}")
    return name


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Load a managed table by name."""
    return spark.table(name)


def quote_name(name: str) -> str:
    """Quote each part of ``db.table`` with backticks, for SQL text."""
    return ".".join(f"`{part.strip('`')}`" for part in name.split("."))


def table_bytes(spark: SparkSession, name: str) -> int:
    """Size of table ``name`` on storage, from catalog metadata only.

    ``ANALYZE … NOSCAN`` sums the sizes of the table's files without
    reading them (no Spark job) and records the figure in the catalog,
    where Catalyst's size estimates also pick it up. Delta reports its
    size in ``DESCRIBE DETAIL``.
    """
    quoted = quote_name(name)

    def details() -> dict[str, str]:  # a few dozen rows of table metadata
        return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted}").collect()}

    if details().get("Provider", "").lower() == "delta":
        return int(spark.sql(f"DESCRIBE DETAIL {quoted}").first()["sizeInBytes"])
    spark.sql(f"ANALYZE TABLE {quoted} COMPUTE STATISTICS NOSCAN")
    return int(details()["Statistics"].split(" bytes")[0])


def layer_bytes(spark: SparkSession, path: str) -> int:
    """Size of the layer at ``path`` on storage, from file metadata only."""
    fs, found = hadoop_path(spark, path)
    return int(fs.getContentSummary(found).getLength())
