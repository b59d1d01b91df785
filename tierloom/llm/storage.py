"""Written intermediate tables and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.session import delete_path, scratch_path

#: White space of every word and line rule here: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"

#: A word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_PASSING: list[list[str]] = []


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared work folder.

    Cuts the lineage: a lost executor costs a reread of these files, never
    the work before them. A ``lasting`` table outlives ``passing_tables``.
    """
    path = scratch_path(df.sparkSession, name)
    if _PASSING and not lasting:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for lasting ones:
    write what is needed later as such."""
    paths: list[str] = []
    _PASSING.append(paths)
    try:
        yield
    finally:
        _PASSING.remove(paths)
        for path in paths:
            delete_path(spark, path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def text_key(text: Column) -> Column:
    """64-bit hash of a text, to tell rows of one ``doc_id`` apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
