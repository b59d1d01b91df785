"""J4 as a Spark application: raw CSV → bronze → silver → gold.

    spark-submit --py-files tierloom.zip tierloom/__main__.py \\
        --raw s3a://lake/landing/sales/ --bronze bronze.raw_sales \\
        --silver s3a://lake/silver/sales --gold s3a://lake/gold/customer_sales

The session comes from the cluster's configuration, and every setting that
was submitted stays as it is. What was not is set by the job: AQE and 1 GiB
input splits at the start, and before silver and gold the shuffle for the
size of that job's own input, read from catalog or file metadata (no data is
read). ``--bronze-bytes`` overrides the measured size of bronze,
``--reduce-mb`` the shuffle data per reduce partition.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from tierloom.operators.aggregate import row_count
from tierloom.plans.bronze import ingest
from tierloom.plans.gold import run_gold
from tierloom.plans.medallion import Layers
from tierloom.plans.silver import run_silver
from tierloom.schema import SALES_TYPED
from tierloom.session import BASE_CONF, GOLD_RATIO, REDUCE_BYTES, SCAN_CONF, apply_conf, cluster_conf, submitted_keys
from tierloom.sources.layers import layer_bytes, read_layer, table_bytes

STEPS = ("bronze", "silver", "gold")


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tierloom", description=__doc__.splitlines()[0])
    parser.add_argument("--raw", required=True, help="landing folder of headered CSV files")
    parser.add_argument("--bronze", required=True, help="bronze managed table name")
    parser.add_argument("--silver", required=True, help="silver table path")
    parser.add_argument("--gold", required=True, help="gold table path")
    parser.add_argument("--format", dest="fmt", default=None, help="table format (default: parquet)")
    mode = parser.add_mutually_exclusive_group()
    mode.add_argument("--infer", action="store_true", help="infer bronze types (one extra pass)")
    mode.add_argument("--typed", action="store_true", help="read bronze with the declared typed schema")
    parser.add_argument("--strict", action="store_true", help="plain casts: fail on malformed values under ANSI")
    parser.add_argument("--check-headers", action="store_true", help="fail on landing files whose header differs")
    parser.add_argument("--overwrite-schema", action="store_true", help="allow the layers' schemas to change")
    parser.add_argument(
        "--csv-option",
        action="append",
        default=[],
        metavar="KEY=VALUE",
        help="option of the CSV reader, may be repeated (sep=;)",
    )
    parser.add_argument(
        "--start",
        choices=STEPS,
        default="bronze",
        help="first layer to rebuild; the layers before it are read as they are",
    )
    parser.add_argument("--bronze-bytes", type=int, default=None, help="size hint for silver's shuffle")
    parser.add_argument(
        "--reduce-mb", type=int, default=REDUCE_BYTES >> 20, help="shuffle data per reduce partition"
    )
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    log = logging.getLogger("tierloom")
    spark = SparkSession.builder.appName("tierloom").getOrCreate()
    layers = Layers(raw=args.raw, bronze=args.bronze, silver=args.silver, gold=args.gold)
    layers.check(spark)
    submitted = submitted_keys(spark)

    def size_for(step: str, input_bytes: int, **ratio: float) -> None:
        settings = cluster_conf(input_bytes, reduce_bytes=args.reduce_mb << 20, **ratio)
        apply_conf(spark, settings, keep=submitted)
        used = spark.conf.get("spark.sql.shuffle.partitions")
        log.info("%s reads %d bytes: %s shuffle partitions", step, input_bytes, used)

    # Each step fully replaces its own layer from the one before, so a run
    # that died part-way is repaired by starting again at the failed step.
    steps = STEPS[STEPS.index(args.start):]
    apply_conf(spark, {**BASE_CONF, **SCAN_CONF}, keep=submitted)
    if "bronze" in steps:
        ingest(
            spark,
            layers.raw,
            layers.bronze,
            infer=args.infer,
            schema=SALES_TYPED if args.typed else None,
            fmt=args.fmt,
            overwrite_schema=args.overwrite_schema,
            check_headers=args.check_headers,
            csv_options=dict(option.split("=", 1) for option in args.csv_option),
        )
    if "silver" in steps:
        size_for("silver", args.bronze_bytes or table_bytes(spark, layers.bronze))
        run_silver(
            spark, layers.bronze, layers.silver, fmt=args.fmt, strict=args.strict, overwrite_schema=args.overwrite_schema
        )
        log.info("bronze rows %d", row_count(spark, layers.bronze).first()["rows"])
    size_for("gold", layer_bytes(spark, layers.silver), shuffle_ratio=GOLD_RATIO)
    run_gold(spark, layers.silver, layers.gold, fmt=args.fmt, overwrite_schema=args.overwrite_schema)
    log.info("gold customers %d", read_layer(spark, layers.gold, fmt=args.fmt).count())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
