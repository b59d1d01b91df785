"""The physical plans the jobs are designed to get.

Shuffles are counted because at 100 TB each one is the cost: silver may
shuffle once (the dedup), gold once (partial sums only), the fused plan
twice, and ingest never.
"""

import re

from conftest import SF001
from plan_text import physical_plan
from tierloom import clean, customer_sales, read_layer, read_raw, write_layer
from tierloom.registry import QUERIES, _landed
from tierloom.session import scratch_path
from tierloom.sources.fixtures import land_csv, sales_raw

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def shuffles(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_fused_plan_shuffles_twice_with_partial_aggregates(spark):
    plan = physical_plan(QUERIES["gold_customer_sales"](spark, SF001))
    keys = shuffles(plan)
    assert len(keys) == 2
    dedup_keys, gold_keys = sorted(keys, key=len, reverse=True)
    assert all(c in dedup_keys for c in ("order_id", "customer_id", "product", "amount", "order_date"))
    assert gold_keys.startswith("customer_id")
    # The dedup aggregates on both sides of its shuffle (map-side first),
    # and gold sums partially before its own.
    assert plan.count("functions=[]") == 2
    assert "partial_sum" in plan
    assert not any(node in plan for node in PYTHON_NODES)


def test_silver_layer_plan_has_one_shuffle(spark):
    path = write_layer(sales_raw(spark, SF001), scratch_path(spark, "bronze"))
    silver = clean(read_layer(spark, path))
    assert len(shuffles(physical_plan(silver))) == 1
    # The casts are evaluated in the final dedup aggregate, no extra node.
    formatted = physical_plan(silver, "formatted")
    assert "try_cast(amount" in formatted and "cast(order_date" in formatted


def test_gold_reads_two_columns_of_silver(spark):
    path = write_layer(clean(sales_raw(spark, SF001)), scratch_path(spark, "silver"))
    plan = physical_plan(customer_sales(read_layer(spark, path)))
    assert "ReadSchema: struct<customer_id:string,amount:double>" in plan
    assert len(shuffles(plan)) == 1
    assert "partial_sum" in plan


def test_ingest_is_a_narrow_scan(spark):
    plan = physical_plan(read_raw(spark, _landed(spark, SF001)))
    assert "Exchange" not in plan
    assert "FileScan csv" in plan


def test_fixture_scans_are_pruned(spark):
    plan = physical_plan(sales_raw(spark, SF001))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    # Copies come from a generator on the joined row, not a second join.
    assert plan.count("FileScan parquet") == 3
    assert "Generate explode" in plan


def test_registered_queries_stay_jvm_side(spark):
    for name in ("dedup_rows", "cast_amount", "parse_order_date", "silver_clean", "customer_totals"):
        df = QUERIES[name](spark, SF001)
        df.collect()  # run it, so explain shows AQE's final plan with codegen stages
        plan = physical_plan(df)
        assert "isFinalPlan=true" in plan, name
        assert not any(node in plan for node in PYTHON_NODES), name
        assert re.search(r"\*\(\d+\) (HashAggregate|Project)", plan), name


def test_plans_do_not_depend_on_splits_or_cores(spark):
    """The same plan for one split as for many (no conditional shuffle)."""
    wide = physical_plan(QUERIES["gold_customer_sales"](spark, SF001))
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        narrow = physical_plan(QUERIES["gold_customer_sales"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    nodes = lambda plan: re.findall(r"(\w+(?:Exchange|Join|Aggregate|Scan)|Exchange \w+)", plan)
    assert nodes(wide) == nodes(narrow)
    assert "RoundRobin" not in wide + narrow


def test_cluster_conf_runs_and_coalesces(spark):
    from tierloom.session import cluster_conf

    settings = cluster_conf(4 << 40)  # 4 TiB of bronze: ~3k initial partitions
    assert int(settings["spark.sql.shuffle.partitions"]) > 3000
    previous = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = QUERIES["gold_customer_sales"](spark, SF001)
        rows = df.collect()
        assert len(rows) == 150
        plan = physical_plan(df)
        assert "AQEShuffleRead coalesced" in plan
        # Tiny shuffles are merged into one partition, not thousands.
        assert df.rdd.getNumPartitions() == 1
    finally:
        for key, value in previous.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_large_split_setting_keeps_small_inputs_parallel(spark):
    from tierloom.session import SCAN_CONF

    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN_CONF["spark.sql.files.maxPartitionBytes"])
        landed = land_csv(sales_raw(spark, SF001).repartition(8), scratch_path(spark, "landing"))
        # A few files of some 40 KB each are not packed into one task.
        assert read_raw(spark, landed).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_read_layer_pushes_filters_and_prunes_columns(spark):
    path = write_layer(clean(sales_raw(spark, SF001)), scratch_path(spark, "silver"))
    plan = physical_plan(read_layer(spark, path).filter("customer_id = '7'").select("amount"))
    assert "PushedFilters: [IsNotNull(customer_id), EqualTo(customer_id,7)]" in plan
    # The filter column is read too (pushdown skips row groups; Spark still
    # checks each row); the other three columns are pruned.
    assert "ReadSchema: struct<customer_id:string,amount:double>" in plan


def test_silver_write_does_not_explode_into_small_files(spark):
    from tierloom.plans.silver import run_silver
    from tierloom.session import scratch_database
    from tierloom.plans.bronze import ingest

    bronze = f"{scratch_database(spark)}.raw_sales"
    ingest(spark, _landed(spark, SF001), bronze)
    silver = run_silver(spark, bronze, scratch_path(spark, "silver"))
    files = [f for f in read_layer(spark, silver).inputFiles() if f.endswith(".parquet")]
    # At most one file per shuffle partition; AQE may merge them further.
    assert 1 <= len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_table_bytes_reads_catalog_statistics(spark):
    from tierloom.session import scratch_database
    from tierloom.sources.layers import table_bytes, write_table

    name = f"{scratch_database(spark)}.t"
    write_table(spark.range(50000).selectExpr("id", "CAST(id AS STRING) AS s"), name)
    size = table_bytes(spark, name)
    files = spark.table(name).inputFiles()
    assert size > 10000 and len(files) >= 1


def test_row_count_decodes_no_column(spark):
    from tierloom import row_count
    from tierloom.plans.bronze import ingest
    from tierloom.session import scratch_database

    table = f"{scratch_database(spark)}.raw_sales"
    ingest(spark, _landed(spark, SF001), table)
    plan = physical_plan(row_count(spark, table))
    assert "ReadSchema: struct<>" in plan
    assert "partial_count" in plan


def test_ingest_writes_one_file_per_input_split(spark):
    from tierloom.plans.bronze import ingest
    from tierloom.session import scratch_database

    landed = _landed(spark, SF001)
    splits = read_raw(spark, landed).rdd.getNumPartitions()
    bronze = ingest(spark, landed, f"{scratch_database(spark)}.raw_sales")
    files = [f for f in bronze.inputFiles() if f.endswith(".parquet")]
    assert 1 <= len(files) <= splits
