"""A customer with a third of all rows, and a row copied into a third of
all rows: results stay whole and exact, and the plan pre-aggregates both
before shuffling. Checked against a brute-force model on a small fixture.
"""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from conftest import SF001
from plan_text import physical_plan
from tierloom import clean, customer_sales
from tierloom.sources.fixtures import sales_raw


def skewed_sales(spark):
    base = sales_raw(spark, SF001)
    hot = base.withColumn(
        "customer_id",
        F.when(F.crc32("order_id") < F.lit(2**32 // 3), F.lit("HOT")).otherwise(F.col("customer_id")),
    )
    n = base.count()
    copied = hot.filter(F.col("customer_id") == "HOT").limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n // 2)))).drop("k")
    return hot.unionByName(copied)


def model_totals(rows):
    seen = set(rows)
    totals, has_value = defaultdict(float), defaultdict(bool)
    for order_id, customer, product, amount, order_date in seen:
        try:
            value = float(amount)
        except (TypeError, ValueError):
            value = None
        totals[customer] += value or 0.0
        has_value[customer] |= value is not None
    return {c: (round(totals[c], 2) if has_value[c] else None) for c in totals}


def test_hot_customer_and_hot_copies_match_brute_force(spark):
    df = skewed_sales(spark)
    rows = [tuple(r) for r in df.collect()]
    hot_share = sum(1 for r in rows if r[1] == "HOT") / len(rows)
    copy_share = max(rows.count(r) for r in set(rows)) / len(rows)
    assert hot_share > 1 / 3 and copy_share > 0.3
    result = customer_sales(clean(df)).withColumn("total_sales", F.round("total_sales", 2))
    got = {r.customer_id: r.total_sales for r in result.collect()}
    expected = model_totals(rows)
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert (got[key] is None) == (value is None)
        if value is not None:
            assert math.isclose(got[key], value, abs_tol=0.011), key
    assert clean(df).count() == len(set(rows))


def test_skewed_plan_combines_map_side(spark):
    plan = physical_plan(customer_sales(clean(skewed_sales(spark))))
    assert plan.count("partial_sum") == 1
    # The dedup aggregate appears on both sides of its shuffle.
    assert plan.count("functions=[]") >= 2
