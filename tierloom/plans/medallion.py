"""The whole run, raw → bronze → silver → gold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tierloom.plans.bronze import ingest
from tierloom.plans.gold import run_gold
from tierloom.plans.silver import run_silver
from tierloom.session import hadoop_path
from tierloom.sources.layers import read_layer


@dataclass(frozen=True)
class Layers:
    """Where each layer lives; every job gets the same mapping.

    ``raw`` is the landing folder of CSV files, ``bronze`` a managed table
    name, ``silver`` and ``gold`` table paths. All four must be distinct.
    """

    raw: str
    bronze: str
    silver: str
    gold: str

    def check(self, spark: SparkSession) -> None:
        """Refuse equal locations, and paths nested in one another: a nested
        layer would be deleted by the outer one's overwrite, or read as
        part of it. Paths are compared as the file system qualifies them,
        so other spellings of one place are found."""
        if self.bronze in (self.raw, self.silver, self.gold):
            raise ValueError(f"layers must be distinct: {self}")
        named = {p: hadoop_path(spark, p)[1].toString().rstrip("/") + "/" for p in (self.raw, self.silver, self.gold)}
        if len(set(named.values())) != 3:
            raise ValueError(f"layers must be distinct: {self}")
        for outer in named.values():
            for inner in named.values():
                if outer != inner and inner.startswith(outer):
                    raise ValueError(f"layer {inner} lies inside layer {outer}")

    @classmethod
    def under(cls, base: str, raw: str, bronze_table: str) -> Layers:
        base = base.rstrip("/")
        return cls(raw=raw, bronze=bronze_table, silver=f"{base}/silver/sales", gold=f"{base}/gold/customer_sales")


def run_medallion(
    spark: SparkSession,
    layers: Layers,
    infer: bool = False,
    schema: StructType | str | None = None,
    fmt: str | None = None,
    strict: bool = False,
    overwrite_schema: bool = False,
    check_headers: bool = False,
    csv_options: dict[str, str] | None = None,
) -> DataFrame:
    """Run bronze, silver and gold in order and return the gold mart.

    The options are those of ``ingest``, ``run_silver`` and ``run_gold``;
    ``overwrite_schema`` allows each layer's schema to change.

    ``strict=True`` makes silver use the plain casts, which under ANSI mode
    fail the run on the first malformed amount or date.

    Each layer is written before the next one reads it, so every job
    starts from files: lineage is cut at each layer, a lost executor
    costs a recompute from the last written layer only, and gold's scan
    reads just the two columns it needs.
    """
    layers.check(spark)
    ingest(
        spark, layers.raw, layers.bronze, infer=infer, schema=schema, fmt=fmt,
        overwrite_schema=overwrite_schema, check_headers=check_headers, csv_options=csv_options,
    )
    run_silver(spark, layers.bronze, layers.silver, fmt=fmt, strict=strict, overwrite_schema=overwrite_schema)
    run_gold(spark, layers.silver, layers.gold, fmt=fmt, overwrite_schema=overwrite_schema)
    return read_layer(spark, layers.gold, fmt=fmt)
