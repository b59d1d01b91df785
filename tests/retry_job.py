"""Run silver with injected task failures; print one JSON line.

Started by ``test_retries.py`` in its own process, because only a fresh
session can allow retries in local mode (``local[4,3]``: 3 attempts).
A test-only UDF fails the first attempt of one task before each job's
shuffle (silver's dedup, gold's partial sums), of one task in the final
stage that writes each layer, and of one task of the bronze table write.
"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tierloom import clean, customer_sales, read_layer, read_raw, write_layer, write_table  # noqa: E402
from tierloom.session import scratch_database, scratch_path  # noqa: E402
from tierloom.sources.fixtures import land_csv, sales_raw  # noqa: E402


def fail_first_attempt(partition: int):
    def check(_value):
        context = TaskContext.get()
        if context.partitionId() == partition and context.attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        return True

    return F.udf(check, "boolean").asNondeterministic()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def main() -> None:
    spark = (
        SparkSession.builder.master("local[4,3]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    bronze = write_layer(sales_raw(spark, sys.argv[1]), scratch_path(spark, "bronze"))
    expected = rows(clean(read_layer(spark, bronze)))

    spark.sparkContext.setJobGroup("flaky", "silver with injected failures")
    flaky_bronze = read_layer(spark, bronze).filter(fail_first_attempt(0)(F.col("order_id")))
    silver = clean(flaky_bronze).filter(fail_first_attempt(0)(F.col("order_id")))
    path = write_layer(silver, scratch_path(spark, "silver"))
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("flaky") for s in tracker.getJobInfo(j).stageIds}
    failed = sum(tracker.getStageInfo(s).numFailedTasks for s in stages if tracker.getStageInfo(s))
    got = rows(read_layer(spark, path))

    expected_gold = rows(customer_sales(read_layer(spark, path)))
    spark.sparkContext.setJobGroup("flaky_gold", "gold with injected failures")
    flaky_silver = read_layer(spark, path).filter(fail_first_attempt(0)(F.col("customer_id")))
    gold = customer_sales(flaky_silver).filter(fail_first_attempt(0)(F.col("customer_id")))
    gold_path = write_layer(gold, scratch_path(spark, "gold"))
    gold_stages = {s for j in tracker.getJobIdsForGroup("flaky_gold") for s in tracker.getJobInfo(j).stageIds}
    gold_failed = sum(tracker.getStageInfo(s).numFailedTasks for s in gold_stages if tracker.getStageInfo(s))
    got_gold = rows(read_layer(spark, gold_path))
    landing = land_csv(sales_raw(spark, sys.argv[1]), scratch_path(spark, "landing"))
    table = f"{scratch_database(spark)}.raw_sales"
    spark.sparkContext.setJobGroup("flaky_bronze", "bronze with an injected failure")
    write_table(read_raw(spark, landing).filter(fail_first_attempt(0)(F.col("order_id"))), table)
    bronze_stages = {s for j in tracker.getJobIdsForGroup("flaky_bronze") for s in tracker.getJobInfo(j).stageIds}
    bronze_failed = sum(tracker.getStageInfo(s).numFailedTasks for s in bronze_stages if tracker.getStageInfo(s))
    bronze_same = rows(spark.table(table)) == rows(read_raw(spark, landing))

    print(
        json.dumps(
            {
                "bronze_failed_attempts": bronze_failed,
                "bronze_same": bronze_same,
                "failed_attempts": failed,
                "rows": len(got),
                "same": got == expected,
                "gold_failed_attempts": gold_failed,
                "gold_rows": len(got_gold),
                "gold_same": got_gold == expected_gold,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
