"""Times the medallion jobs at one scale factor; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1),
``BENCH_CPUS`` (default 8), ``BENCH_REPEAT`` (default 5).

Untimed setup lands the ``sales`` rows as CSV (the input of bronze) and
builds one bronze table and one silver layer, so each job can also be
timed on its own input. Every job overwrites its own fixed target, as a
scheduled full-refresh rerun does (so staging and exchange are timed too). Each query warms up until a run is
no longer 5% faster than the one before (8 runs at most), then runs
``BENCH_REPEAT`` times; the median is reported. ``value`` is the sum of
the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tierloom import clean, customer_sales, ingest, read_table, row_count  # noqa: E402
from tierloom.plans.gold import run_gold  # noqa: E402
from tierloom.plans.medallion import Layers, run_medallion  # noqa: E402
from tierloom.plans.silver import run_silver  # noqa: E402
from tierloom.registry import QUERIES  # noqa: E402
from tierloom.schema import SALES_TYPED  # noqa: E402
from tierloom.session import clear_scratch, local_session, scratch_database, scratch_path  # noqa: E402
from tierloom.sources.fixtures import land_csv, sales_raw  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus, app="tierloom-bench")

    raw_csv = land_csv(sales_raw(spark, sf_dir), scratch_path(spark, "landing/raw"))
    plain_csv = land_csv(sales_raw(spark, sf_dir, dirty=False), scratch_path(spark, "landing/plain"))
    db = scratch_database(spark)
    bronze = f"{db}.raw_sales"
    ingest(spark, raw_csv, bronze)
    silver = scratch_path(spark, "silver/sales")
    run_silver(spark, bronze, silver)
    silver_rerun = scratch_path(spark, "silver_rerun/sales")
    gold = scratch_path(spark, "gold/customer_sales")
    lake = scratch_path(spark, "lake")

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def ingest_inferred_and_count():
        table = f"{db}.bench_bronze_sales"
        ingest(spark, plain_csv, table, infer=True)
        return row_count(spark, table).collect()

    jobs = {
        # J1, all-string: CSV landing -> bronze table.
        "bronze_ingest": lambda: ingest(spark, raw_csv, f"{db}.bench_raw_sales"),
        # J1, inferred: inference pass + write + post-load count.
        "bronze_ingest_inferred": ingest_inferred_and_count,
        # J1, declared types: what replaces inference at scale (no extra pass).
        "bronze_ingest_typed": lambda: ingest(spark, plain_csv, f"{db}.bench_typed_sales", schema=SALES_TYPED),
        # Bronze table -> silver layer.
        "silver_clean": lambda: run_silver(spark, bronze, silver_rerun),
        # Silver layer -> gold layer.
        "gold_customer_sales": lambda: run_gold(spark, silver, gold),
        # J2+J3 fused into one plan over bronze.
        "silver_gold_fused": lambda: noop(customer_sales(clean(read_table(spark, bronze)))),
        # CSV landing -> bronze -> silver -> gold, each layer written.
        "medallion_run": lambda: run_medallion(
            spark, Layers.under(lake, raw=raw_csv, bronze_table=f"{db}.run_raw_sales")
        ).collect(),
        # Flagship registered query from the driver's tables (join included).
        "flagship_from_tables": lambda: noop(QUERIES["gold_customer_sales"](spark, sf_dir)),
    }

    medians = {}
    for name, job in jobs.items():
        last = float("inf")
        for _ in range(8):
            start = time.perf_counter()
            job()
            took = time.perf_counter() - start
            if took > 0.95 * last:
                break
            last = took
        times = []
        for _ in range(repeat):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        medians[name] = round(statistics.median(times), 3)
        print(f"{name}: {medians[name]}s {times}", file=sys.stderr, flush=True)

    rows = spark.read.csv(raw_csv, header=True).count()
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "medallion_jobs_total",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "rows": rows,
                "medallion_rows_per_sec": round(rows / medians["medallion_run"]),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
