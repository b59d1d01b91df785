"""The ``sales`` entity at scale, derived by Spark from the driver's tables.

The reference ships a four-row CSV. To exercise the same jobs on real
volumes, ``sales`` is derived from ``lineitem ⋈ orders ⋈ part``: one sale
per line item, over the whole of every table. The joins build the input;
they are not an engine operator.

The raw form is dirty on purpose, by fixed rules that depend only on the
row itself, so that every cleaning step has work to do:

- lines with ``l_discount = 0`` carry the amount placeholder ``'n/a'``;
- lines with ``l_tax = 0`` carry the date placeholder ``'bad-date'``;
- lines with ``l_returnflag = 'R'`` were delivered twice, so the landing
  data holds an exact second copy of each (about a third of the lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture; the oracle SQL uses the same ones.
AMOUNT_PLACEHOLDER = "n/a"
DATE_PLACEHOLDER = "bad-date"
REDELIVERED_FLAG = "R"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, with its order's customer/date and part name.

    Each copy of a re-delivered line is emitted by a generator on the
    joined row rather than by a second scan and join, so the plan reads
    and joins each table once. Only the columns used are read.
    """
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    copies = F.when(F.col("l_returnflag") == REDELIVERED_FLAG, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return joined.withColumn("copy", F.explode(copies))


def _price_text() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)").cast("string")


def _date_text() -> Column:
    return F.col("o_orderdate").cast("date").cast("string")


def sales_raw(spark: SparkSession, sf_dir: str, dirty: bool = True) -> DataFrame:
    """``sales`` as all-string bronze rows (the landed CSV, read as text).

    ``dirty=False`` leaves out the placeholders, giving text that type
    inference reads as int / string / double / date.
    """
    lines = sales_lines(spark, sf_dir)
    amount = _price_text()
    order_date = _date_text()
    if dirty:
        amount = F.when(F.col("l_discount") == 0, F.lit(AMOUNT_PLACEHOLDER)).otherwise(amount)
        order_date = F.when(F.col("l_tax") == 0, F.lit(DATE_PLACEHOLDER)).otherwise(order_date)
    return lines.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("p_name").alias("product"),
        amount.alias("amount"),
        order_date.alias("order_date"),
    )


def sales_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales`` already typed, copies kept: the placeholders become NULL."""
    lines = sales_lines(spark, sf_dir)
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("p_name").alias("product"),
        F.when(F.col("l_discount") == 0, F.lit(None)).otherwise(_price_text().cast("double")).alias("amount"),
        F.when(F.col("l_tax") == 0, F.lit(None)).otherwise(F.col("o_orderdate").cast("date")).alias("order_date"),
    )


def land_csv(df: DataFrame, path: str) -> str:
    """Stage ``df`` as headered CSV files at ``path``: a landing drop for
    the ingest to read. One file per task, no shuffle. Test input only; the
    reference has no CSV sink.
    """
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path
