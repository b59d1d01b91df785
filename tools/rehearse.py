"""Run J4 at a larger scale, optionally skewed or short of memory, and
check the gold mart against DuckDB over the very same landed files.

    python tools/rehearse.py [--sf-dir DIR] [--copies N] [--memory 2g] [--skew]

Lands ``copies`` copies of the ``sales`` rows (copy k's order ids get the
suffix ``-k``, so copies never deduplicate against each other) and runs
raw → bronze → silver → gold in a local[8] session with the given driver
memory and 8 shuffle partitions. With a small driver the dedup aggregate
must spill and fall back to sort-based aggregation.

``--skew`` then gives a third of the rows to one customer (``HOT``) and
adds copies of one of its rows making up another third of the input: the
two cases the plans are built to absorb by map-side combining.

``--compare-plans`` also times silver+gold as one plan over the written
bronze two ways (median of 3, no sink): the chosen plan, which shuffles on
all columns and then on partial sums, and the rejected single shuffle on
``customer_id``, which a hot customer turns into one long task.

Prints one JSON line: rows, seconds, whether gold matches, plan timings.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tierloom.plans.gold import customer_sales  # noqa: E402
from tierloom.plans.medallion import Layers, run_medallion  # noqa: E402
from tierloom.plans.silver import clean  # noqa: E402
from tierloom.session import BASE_CONF, scratch_database, scratch_path  # noqa: E402
from tierloom.sources.fixtures import land_csv, sales_raw  # noqa: E402


def landing_rows(spark, sf_dir, copies, skew):
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("k")
    rows = (
        sales_raw(spark, sf_dir)
        .select("*", copy)
        .withColumn("order_id", F.concat_ws("-", "order_id", F.col("k").cast("string")))
        .drop("k")
    )
    if not skew:
        return rows
    hot = rows.withColumn(
        "customer_id",
        F.when(F.crc32("order_id") < F.lit(2**32 // 3), F.lit("HOT")).otherwise(F.col("customer_id")),
    )
    n = sales_raw(spark, sf_dir).count() * copies
    one = hot.filter(F.col("customer_id") == "HOT").limit(1)
    repeated = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(n // 2))).alias("k")).drop("k")
    return hot.unionByName(repeated)


def compare_plans(bronze) -> dict:
    def median_seconds(df):
        times = []
        for _ in range(4):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return round(statistics.median(times[1:]), 2)

    return {
        "all_columns_then_partial_sums": median_seconds(customer_sales(clean(bronze))),
        "single_shuffle_on_customer": median_seconds(customer_sales(clean(bronze.repartition("customer_id")))),
    }


def duckdb_gold(raw: str) -> dict:
    con = duckdb.connect()
    con.execute("SET threads=8")
    return dict(
        con.execute(
            f"""SELECT customer_id, SUM(TRY_CAST(amount AS DOUBLE))
                FROM (SELECT DISTINCT * FROM read_csv('{raw}/*.csv', header=true, all_varchar=true))
                GROUP BY customer_id"""
        ).fetchall()
    )


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    parser.add_argument("--copies", type=int, default=10)
    parser.add_argument("--memory", default="2g")
    parser.add_argument("--skew", action="store_true")
    parser.add_argument("--compare-plans", action="store_true")
    args = parser.parse_args()

    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tierloom-rehearse")
        .config("spark.driver.memory", args.memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
    )
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")

    raw = land_csv(landing_rows(spark, args.sf_dir.rstrip("/"), args.copies, args.skew), scratch_path(spark, "landing"))
    layers = Layers.under(scratch_path(spark, "lake"), raw=raw, bronze_table=f"{scratch_database(spark)}.raw_sales")

    spark.sparkContext.setLogLevel("INFO")  # spills are logged at INFO ("spilling ... to disk")
    start = time.perf_counter()
    gold = {r.customer_id: r.total_sales for r in run_medallion(spark, layers).collect()}
    seconds = time.perf_counter() - start
    spark.sparkContext.setLogLevel("WARN")
    bronze_rows = spark.table(layers.bronze).count()
    plans = compare_plans(spark.table(layers.bronze)) if args.compare_plans else None
    spark.stop()

    expected = duckdb_gold(raw)
    worst = max(
        (abs(gold[c] - v) for c, v in expected.items() if v is not None and gold.get(c) is not None),
        default=0.0,
    )
    nulls_agree = all((gold.get(c) is None) == (v is None) for c, v in expected.items())
    # Sums of ~10^11 differ in the last bits with addition order: compare relatively.
    largest = max((abs(v) for v in expected.values() if v is not None), default=1.0)
    ok = gold.keys() == expected.keys() and nulls_agree and worst <= 1e-12 * max(1.0, largest)
    print(
        json.dumps(
            {
                "copies": args.copies,
                "skew": args.skew,
                "bronze_rows": bronze_rows,
                "driver_memory": args.memory,
                "seconds": round(seconds, 2),
                "customers": len(gold),
                "hot_total": gold.get("HOT"),
                "max_abs_diff": worst,
                "ok": ok,
                "plans_sec": plans,
            }
        )
    )


if __name__ == "__main__":
    main()
