"""Hand-made edge rows (FIXTURES.md §3)."""

import datetime

import pytest
from pyspark.errors import AnalysisException

from tierloom import Layers, dedup_rows, grouped_sum, ingest, run_medallion
from tierloom.functions import amount_as_double, order_date_as_date
from tierloom.plans.gold import customer_sales
from tierloom.plans.silver import clean
from tierloom.sources.landing import EmptyLandingError
from tierloom.session import scratch_database, scratch_path

from conftest import SALES_TEXT
from test_golden import land_sample


def raw(spark, rows):
    return spark.createDataFrame(rows, SALES_TEXT)


def totals(df):
    return {r.customer_id: r.total_sales for r in df.collect()}


def test_exact_duplicate_becomes_one_row(spark):
    row = ("1", "C1", "p", "10", "2024-01-01")
    assert dedup_rows(raw(spark, [row, row])).count() == 1


def test_same_number_other_spelling_both_kept(spark):
    rows = [("1", "C1", "p", "120", "2024-01-01"), ("1", "C1", "p", "120.0", "2024-01-01")]
    silver = clean(raw(spark, rows))
    assert silver.count() == 2
    assert totals(customer_sales(silver)) == {"C1": 240.0}


def test_all_null_rows_are_equal(spark):
    assert dedup_rows(raw(spark, [(None,) * 5, (None,) * 5])).count() == 1


def test_malformed_values_become_null_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    silver = clean(raw(spark, [("1", "C1", "p", "x", "x"), ("2", "C1", "p", "5", "2024-02-30")]))
    got = sorted((r.order_id, r.amount, r.order_date) for r in silver.collect())
    assert got == [("1", None, None), ("2", 5.0, None)]


def test_strict_mode_follows_ansi(spark):
    df = raw(spark, [("1", "C1", "p", "x", "2024-01-01")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(amount_as_double("amount", strict=True)).collect()


def test_date_parsing_rules(spark):
    df = spark.createDataFrame(
        [("2024-01-15",), ("2024-1-5",), ("2024-01-15 10:11:12",), ("2024-01-15T10:11",), ("15/01/2024",), (None,)],
        "d string",
    )
    got = [r[0] for r in df.select(order_date_as_date("d")).collect()]
    assert got == [
        datetime.date(2024, 1, 15),
        datetime.date(2024, 1, 5),
        datetime.date(2024, 1, 15),
        datetime.date(2024, 1, 15),
        None,
        None,
    ]


def test_date_and_timestamp_pass_through(spark):
    df = spark.sql("SELECT DATE'2024-03-01' AS d, TIMESTAMP'2024-03-02 23:59:59' AS ts")
    got = df.select(order_date_as_date("d"), order_date_as_date("ts")).collect()[0]
    assert tuple(got) == (datetime.date(2024, 3, 1), datetime.date(2024, 3, 2))


def test_all_null_amount_group_sums_to_null(spark):
    rows = [("1", "C1", "p", None, "2024-01-01"), ("2", "C1", "p", "n/a", "2024-01-01"), ("3", "C2", "p", "4", "2024-01-01")]
    assert totals(customer_sales(clean(raw(spark, rows)))) == {"C1": None, "C2": 4.0}


def test_null_customer_is_its_own_group(spark):
    rows = [("1", None, "p", "1", "2024-01-01"), ("2", None, "q", "2", "2024-01-01"), ("3", "C1", "p", "4", "2024-01-01")]
    assert totals(customer_sales(clean(raw(spark, rows)))) == {None: 3.0, "C1": 4.0}


def test_dedup_runs_before_cast(spark):
    rows = [
        ("1", "C1", "p", "120", "2024-01-01"),
        ("1", "C1", "p", "120.0", "2024-01-01"),
        ("1", "C1", "p", "120.00", "2024-01-01"),
        ("1", "C1", "p", "120", "2024-01-01"),
        ("2", "C1", "p", "x", "bad"),
    ]
    assert clean(raw(spark, rows)).count() == 4
    cast_first = raw(spark, rows).withColumn("amount", amount_as_double()).dropDuplicates()
    assert cast_first.count() == 2


def test_grouped_sum_is_generic(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    got = {r.k: r.s for r in grouped_sum(df, "k", "v", "s").collect()}
    assert got == {"a": 3.0, "b": None}


def test_missing_input_fails_before_write(spark):
    table = f"{scratch_database(spark)}.raw_sales"
    ingest(spark, land_sample(spark), table)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        ingest(spark, scratch_path(spark, "absent"), table)
    assert spark.table(table).count() == 4


def test_missing_input_fails_with_inference_and_schema(spark):
    table = f"{scratch_database(spark)}.t"
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        ingest(spark, scratch_path(spark, "absent"), table, infer=True)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        ingest(spark, scratch_path(spark, "absent"), table, schema=SALES_TEXT)
    assert not spark.catalog.tableExists(table)


def test_rerun_gives_same_tables(spark):
    layers = Layers.under(
        scratch_path(spark, "lake"),
        raw=land_sample(spark),
        bronze_table=f"{scratch_database(spark)}.raw_sales",
    )
    first = sorted(tuple(r) for r in run_medallion(spark, layers).collect())
    second = sorted(tuple(r) for r in run_medallion(spark, layers).collect())
    assert first == second
    assert spark.table(layers.bronze).count() == 4


def test_strict_run_fails_on_malformed_amount(spark):
    bad = "order_id,customer_id,product,amount,order_date\n1,C1,p,x,2024-01-01\n"
    layers = Layers.under(
        scratch_path(spark, "lake"),
        raw=land_sample(spark, bad),
        bronze_table=f"{scratch_database(spark)}.raw_sales",
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run_medallion(spark, layers, strict=True)
    assert run_medallion(spark, layers).collect()[0].total_sales is None


def test_header_only_drop_gives_empty_layers(spark):
    empty = "order_id,customer_id,product,amount,order_date\n"
    layers = Layers.under(
        scratch_path(spark, "lake"),
        raw=land_sample(spark, empty),
        bronze_table=f"{scratch_database(spark)}.raw_sales",
    )
    gold = run_medallion(spark, layers)
    assert gold.count() == 0
    assert spark.table(layers.bronze).columns == ["order_id", "customer_id", "product", "amount", "order_date"]


def test_empty_landing_folder_fails_before_write(spark):
    table = f"{scratch_database(spark)}.raw_sales"
    ingest(spark, land_sample(spark), table)
    empty = scratch_path(spark, "empty")
    spark.createDataFrame([], "value string").write.text(empty)  # folder with only _SUCCESS
    with pytest.raises(EmptyLandingError):
        ingest(spark, empty, table)
    assert spark.table(table).count() == 4
    first = f"{scratch_database(spark)}.raw_sales"
    with pytest.raises(EmptyLandingError):
        ingest(spark, empty, first, infer=True)
    assert not spark.catalog.tableExists(first)
    # A declared schema makes an empty drop a valid, empty bronze.
    assert ingest(spark, empty, first, schema=SALES_TEXT).count() == 0
