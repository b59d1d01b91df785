"""CSV landing semantics kept from Spark's defaults, and inference drift."""

import pytest

from conftest import SF001, SF01
from tierloom import SchemaMismatchError, ingest, read_raw
from tierloom.session import scratch_database, scratch_path
from tierloom.sources.fixtures import sales_raw, sales_typed

from test_golden import land_sample


def test_quoted_comma_and_permissive_rows(spark):
    text = (
        "order_id,customer_id,product,amount,order_date\n"
        '1,C1,"Widget, large",10,2024-01-01\n'
        "2,C2,Short row\n"
        "3,C3,Long,5,2024-01-03,extra\n"
    )
    rows = {r.order_id: tuple(r) for r in read_raw(spark, land_sample(spark, text)).collect()}
    assert rows["1"] == ("1", "C1", "Widget, large", "10", "2024-01-01")
    assert rows["2"] == ("2", "C2", "Short row", None, None)
    assert rows["3"] == ("3", "C3", "Long", "5", "2024-01-03")


def test_many_files_share_one_header_rule(spark):
    folder = scratch_path(spark, "raw")
    for i, body in enumerate(["1,C1,p,1,2024-01-01\n", "2,C2,p,2,2024-01-02\n"]):
        text = "order_id,customer_id,product,amount,order_date\n" + body
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/part{i}")
    assert read_raw(spark, f"{folder}/*").count() == 2


def test_inference_drift_is_refused_on_overwrite(spark):
    table = f"{scratch_database(spark)}.bronze_sales"
    ingest(spark, land_sample(spark), table, infer=True)  # order_id infers as int
    wide = "order_id,customer_id,product,amount,order_date\n5000000000,C1,p,1.5,2024-01-01\n"
    with pytest.raises(SchemaMismatchError):
        ingest(spark, land_sample(spark, wide), table, infer=True)  # bigint, double
    assert spark.table(table).count() == 4


@pytest.mark.parametrize(
    "sf_dir, counts",
    [(SF001, (7968, 6000, 386, 485, 150)), (SF01, (80046, 59994, 3947, 5069, 1500))],
)
def test_fixture_counts_match_fixtures_md(spark, sf_dir, counts):
    raw = sales_raw(spark, sf_dir)
    got = (
        raw.count(),
        raw.dropDuplicates().count(),
        raw.filter("amount = 'n/a'").count(),
        raw.filter("order_date = 'bad-date'").count(),
        raw.select("customer_id").distinct().count(),
    )
    assert got == counts
    assert sales_typed(spark, sf_dir).count() == counts[0]


def test_single_file_path(spark):
    folder = land_sample(spark)
    (csv_file,) = [f for f in spark.read.text(folder).inputFiles() if f.endswith(".txt")]
    assert read_raw(spark, csv_file).count() == 4


def test_declared_schema_checks_each_header(spark):
    from conftest import SALES_TEXT
    from tierloom.schema import SALES_TYPED

    assert read_raw(spark, land_sample(spark), schema=SALES_TEXT).count() == 4
    typed = read_raw(spark, land_sample(spark), schema=SALES_TYPED)
    assert sorted(r.order_id for r in typed.collect()) == [1001, 1002, 1003, 1004]
    swapped = "customer_id,order_id,product,amount,order_date\nC1,1,p,1,2024-01-01\n"
    with pytest.raises(Exception, match="(?i)header"):
        read_raw(spark, land_sample(spark, swapped), schema=SALES_TEXT, check_headers=True).collect()


def test_one_file_read_in_many_splits(spark):
    header = "order_id,customer_id,product,amount,order_date\n"
    body = "".join(f"{i},C{i % 7},p,{i}.5,2024-01-01\n" for i in range(2000))
    folder = land_sample(spark, header + body)
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_raw(spark, folder)
        assert df.rdd.getNumPartitions() > 5
        assert df.count() == 2000
        assert df.filter("order_id = 'order_id'").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


@pytest.mark.parametrize("infer", [False, True])
def test_reordered_file_in_a_drop_fails(spark, infer):
    folder = scratch_path(spark, "raw")
    texts = [
        "order_id,customer_id,product,amount,order_date\n1,C1,p,1,2024-01-01\n",
        "customer_id,order_id,product,amount,order_date\nC2,2,p,2,2024-01-02\n",
    ]
    for i, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/part{i}")
    with pytest.raises(Exception, match="(?i)header"):
        read_raw(spark, f"{folder}/*", infer=infer, check_headers=True).collect()


def land_files(spark, texts):
    folder = scratch_path(spark, "raw")
    for i, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/part{i}")
    return f"{folder}/*"


@pytest.mark.parametrize(
    "texts",
    [
        ["a,,c\n1,2,3\n"],
        ["a,a,c\n1,2,3\n"],
        ["a,b ,c\n1,2,3\n"],
        ["a,b,c\n1,2,3\n", "a,b,c,d\n4,5,6,7\n"],
        ["a,b,c\n1,2,3\n", "a,b\n4,5\n"],
        ["a,b,c\n1,2,3\n", "b,a,c\n4,5,6\n"],
    ],
)
@pytest.mark.parametrize("infer", [False, True])
def test_odd_headers_load_as_plain_spark_loads_them(spark, texts, infer):
    path = land_files(spark, texts)
    plain = spark.read.format("csv").option("header", "true").option("inferSchema", str(infer).lower()).load(path)
    got = read_raw(spark, path, infer=infer)
    assert got.schema == plain.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    table = ingest(spark, path, f"{scratch_database(spark)}.t", infer=infer)
    assert table.count() == plain.count()


def test_failed_header_check_keeps_the_old_bronze(spark):
    table = f"{scratch_database(spark)}.t"
    ingest(spark, land_files(spark, ["a,b\n1,2\n"]), table)
    for texts in (["a,b\n1,2\n", "b,a\n4,5\n"], ["a,\n1,2\n"]):
        with pytest.raises(Exception, match="(?i)header"):
            ingest(spark, land_files(spark, texts), table, check_headers=True, schema="a string, b string")
        assert spark.table(table).collect() == [("1", "2")]
    assert [t.name for t in spark.catalog.listTables(table.split(".")[0])] == ["t"]


def test_csv_options_reach_the_reader(spark):
    path = land_files(spark, ["a;b\n1;'x;y'\n"])
    got = ingest(spark, path, f"{scratch_database(spark)}.t", csv_options={"sep": ";", "quote": "'"})
    assert got.collect() == [("1", "x;y")]
