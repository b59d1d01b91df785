"""Registered queries, one per operator or job, and their DuckDB oracles.

Every query builds the ``sales`` entity from the whole of the driver's
``lineitem``, ``orders`` and ``part`` tables (``sources.fixtures``), then
runs one operator or job on it. Queries that test a sink write to a fresh
folder under the shared work folder and read the result back.

Double sums depend on the order of addition, so the registered forms of
the gold totals round to cents on both sides; the library functions
return the plain sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.functions.cleaning import amount_as_double, order_date_as_date
from tierloom.operators.aggregate import grouped_sum, row_count
from tierloom.operators.dedup import dedup_rows
from tierloom.plans.bronze import ingest
from tierloom.plans.gold import customer_sales, run_gold
from tierloom.plans.medallion import Layers, run_medallion
from tierloom.plans.silver import clean, run_silver
from tierloom.session import scratch_database, scratch_path
from tierloom.sources.fixtures import (
    AMOUNT_PLACEHOLDER,
    DATE_PLACEHOLDER,
    REDELIVERED_FLAG,
    land_csv,
    sales_raw,
    sales_typed,
)
from tierloom.sources.landing import read_raw
from tierloom.sources.layers import read_layer, read_table, write_layer, write_table

QueryFn = Callable[[SparkSession, str], DataFrame]


def _landed(spark: SparkSession, sf_dir: str, dirty: bool = True) -> str:
    """Land ``sales`` as CSV files in a fresh folder; returns the folder."""
    return land_csv(sales_raw(spark, sf_dir, dirty=dirty), scratch_path(spark, "landing"))


def _cents(df: DataFrame) -> DataFrame:
    return df.withColumn("total_sales", F.round("total_sales", 2))


def q_ingest_csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, _landed(spark, sf_dir))


def q_ingest_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, _landed(spark, sf_dir, dirty=False), infer=True)


def q_bronze_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(spark, _landed(spark, sf_dir), f"{scratch_database(spark)}.raw_sales")


def q_bronze_ingest_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{scratch_database(spark)}.bronze_sales"
    return ingest(spark, _landed(spark, sf_dir, dirty=False), name, infer=True)


def q_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = write_table(sales_raw(spark, sf_dir), f"{scratch_database(spark)}.sales")
    return read_table(spark, name)


def q_layer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_layer(sales_raw(spark, sf_dir), scratch_path(spark, "bronze_sales"))
    return read_layer(spark, path)


def q_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{scratch_database(spark)}.bronze_sales"
    ingest(spark, _landed(spark, sf_dir, dirty=False), name, infer=True)
    return row_count(spark, name)


def q_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_rows(sales_raw(spark, sf_dir))


def q_cast_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_raw(spark, sf_dir).withColumn("amount", amount_as_double("amount"))


def q_parse_order_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_raw(spark, sf_dir).withColumn("order_date", order_date_as_date("order_date"))


def q_silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(sales_raw(spark, sf_dir))


def q_silver_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = f"{scratch_database(spark)}.raw_sales"
    ingest(spark, _landed(spark, sf_dir), bronze)
    return read_layer(spark, run_silver(spark, bronze, scratch_path(spark, "silver/sales")))


def q_silver_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = write_layer(sales_raw(spark, sf_dir), scratch_path(spark, "bronze/sales"))
    return read_layer(spark, run_silver(spark, bronze, scratch_path(spark, "silver/sales"), from_path=True))


def q_table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty rows, replaced by the plain ones."""
    name = write_table(sales_raw(spark, sf_dir), f"{scratch_database(spark)}.sales")
    return read_table(spark, write_table(sales_raw(spark, sf_dir, dirty=False), name))


def q_layer_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty rows, replaced by the plain ones."""
    path = write_layer(sales_raw(spark, sf_dir), scratch_path(spark, "bronze_sales"))
    return read_layer(spark, write_layer(sales_raw(spark, sf_dir, dirty=False), path))


def q_missing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest of a missing path fails and leaves the table (O3)."""
    name = f"{scratch_database(spark)}.raw_sales"
    ingest(spark, _landed(spark, sf_dir), name)
    try:
        ingest(spark, scratch_path(spark, "absent"), name)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        raise AssertionError("a missing landing path was accepted")
    return read_table(spark, name)


def q_gold_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = write_layer(clean(sales_raw(spark, sf_dir)), scratch_path(spark, "silver/sales"))
    return _cents(read_layer(spark, run_gold(spark, silver, scratch_path(spark, "gold/customer_sales"))))


def q_customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cents(grouped_sum(sales_typed(spark, sf_dir), "customer_id", "amount", "total_sales"))


def q_gold_customer_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cents(customer_sales(clean(sales_raw(spark, sf_dir))))


def q_medallion_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = Layers.under(
        scratch_path(spark, "lake"),
        raw=_landed(spark, sf_dir),
        bronze_table=f"{scratch_database(spark)}.raw_sales",
    )
    return _cents(run_medallion(spark, layers))


QUERIES: dict[str, QueryFn] = {
    "ingest_csv_strings": q_ingest_csv_strings,
    "ingest_csv_inferred": q_ingest_csv_inferred,
    "bronze_ingest": q_bronze_ingest,
    "bronze_ingest_inferred": q_bronze_ingest_inferred,
    "table_roundtrip": q_table_roundtrip,
    "layer_roundtrip": q_layer_roundtrip,
    "row_count": q_row_count,
    "dedup_rows": q_dedup_rows,
    "cast_amount": q_cast_amount,
    "parse_order_date": q_parse_order_date,
    "silver_clean": q_silver_clean,
    "silver_job": q_silver_job,
    "silver_from_path": q_silver_from_path,
    "table_overwrite": q_table_overwrite,
    "layer_overwrite": q_layer_overwrite,
    "missing_input": q_missing_input,
    "customer_totals": q_customer_totals,
    "gold_customer_sales": q_gold_customer_sales,
    "gold_job": q_gold_job,
    "medallion_run": q_medallion_run,
}

FLAGSHIP = "gold_customer_sales"


# ---------------------------------------------------------------- oracle SQL
# The same ``sales`` rows in DuckDB SQL over the pre-registered views.

_LINES = """
lines AS (
  SELECT l.l_orderkey, o.o_custkey, p.p_name, l.l_extendedprice,
         l.l_discount, l.l_tax, l.l_returnflag, o.o_orderdate
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
copies AS (
  SELECT * FROM lines
  UNION ALL
  SELECT * FROM lines WHERE l_returnflag = '{flag}'
)""".format(flag=REDELIVERED_FLAG)

_PRICE_TEXT = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)"
_DATE_TEXT = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"

_SALES_RAW = f"""
sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         p_name AS product,
         CASE WHEN l_discount = 0 THEN '{AMOUNT_PLACEHOLDER}' ELSE {_PRICE_TEXT} END AS amount,
         CASE WHEN l_tax = 0 THEN '{DATE_PLACEHOLDER}' ELSE {_DATE_TEXT} END AS order_date
  FROM copies
)"""

_SALES_PLAIN = f"""
sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         p_name AS product,
         {_PRICE_TEXT} AS amount,
         {_DATE_TEXT} AS order_date
  FROM copies
)"""

_SALES_TYPED = f"""
sales AS (
  SELECT l_orderkey AS order_id,
         o_custkey AS customer_id,
         p_name AS product,
         CASE WHEN l_discount = 0 THEN NULL ELSE CAST({_PRICE_TEXT} AS DOUBLE) END AS amount,
         CASE WHEN l_tax = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date
  FROM copies
)"""

_SILVER = """
silver AS (
  SELECT order_id, customer_id, product,
         TRY_CAST(amount AS DOUBLE) AS amount,
         TRY_CAST(order_date AS DATE) AS order_date
  FROM (SELECT DISTINCT * FROM sales)
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# Inference gives INTEGER ids only while they fit 32 bits (as at the given
# scales); beyond, Spark infers BIGINT and this cast fails. That follows from
# type inference itself.
_INFERRED = _with(_LINES, _SALES_PLAIN) + """
SELECT CAST(order_id AS INTEGER) AS order_id,
       CAST(customer_id AS INTEGER) AS customer_id,
       product,
       CAST(amount AS DOUBLE) AS amount,
       CAST(order_date AS DATE) AS order_date
FROM sales"""

_GOLD = _with(_LINES, _SALES_RAW, _SILVER) + """
SELECT customer_id, ROUND(SUM(amount), 2) AS total_sales
FROM silver GROUP BY customer_id"""


ORACLE_SQL: dict[str, str] = {
    "ingest_csv_strings": _with(_LINES, _SALES_RAW) + "\nSELECT * FROM sales",
    "ingest_csv_inferred": _INFERRED,
    "bronze_ingest": _with(_LINES, _SALES_RAW) + "\nSELECT * FROM sales",
    "bronze_ingest_inferred": _INFERRED,
    "table_roundtrip": _with(_LINES, _SALES_RAW) + "\nSELECT * FROM sales",
    "layer_roundtrip": _with(_LINES, _SALES_RAW) + "\nSELECT * FROM sales",
    "row_count": _with(_LINES, _SALES_PLAIN) + '\nSELECT COUNT(*) AS "rows" FROM sales',
    "dedup_rows": _with(_LINES, _SALES_RAW) + "\nSELECT DISTINCT * FROM sales",
    "cast_amount": _with(_LINES, _SALES_RAW)
    + """
SELECT order_id, customer_id, product, TRY_CAST(amount AS DOUBLE) AS amount, order_date
FROM sales""",
    "parse_order_date": _with(_LINES, _SALES_RAW)
    + """
SELECT order_id, customer_id, product, amount, TRY_CAST(order_date AS DATE) AS order_date
FROM sales""",
    "silver_clean": _with(_LINES, _SALES_RAW, _SILVER) + "\nSELECT * FROM silver",
    "silver_job": _with(_LINES, _SALES_RAW, _SILVER) + "\nSELECT * FROM silver",
    "silver_from_path": _with(_LINES, _SALES_RAW, _SILVER) + "\nSELECT * FROM silver",
    "table_overwrite": _with(_LINES, _SALES_PLAIN) + "\nSELECT * FROM sales",
    "layer_overwrite": _with(_LINES, _SALES_PLAIN) + "\nSELECT * FROM sales",
    "missing_input": _with(_LINES, _SALES_RAW) + "\nSELECT * FROM sales",
    "customer_totals": _with(_LINES, _SALES_TYPED)
    + """
SELECT customer_id, ROUND(SUM(amount), 2) AS total_sales
FROM sales GROUP BY customer_id""",
    "gold_customer_sales": _GOLD,
    "gold_job": _GOLD,
    "medallion_run": _GOLD,
}
