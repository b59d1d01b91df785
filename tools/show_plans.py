"""Print the final (after AQE) physical plan of each layer job.

    python tools/show_plans.py [sf_dir]

Builds landing CSV, a bronze table and a silver layer in fresh folders
under the work folder, runs each job's DataFrame once and prints the plan
Spark actually executed. A development aid for small scale factors: it
brings the results to the driver to run them.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tierloom import clean, customer_sales, ingest, read_layer, read_raw, read_table, row_count, write_layer  # noqa: E402
from tierloom.registry import QUERIES  # noqa: E402
from tierloom.session import clear_scratch, local_session, scratch_database, scratch_path  # noqa: E402
from tierloom.sources.fixtures import land_csv, sales_raw  # noqa: E402


def final_plan(df) -> str:
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    text = re.sub(r"#\d+L?", "", text)  # expression ids only add noise
    text = re.sub(r"file:[^,\]\s]*/tierloom/(?:[0-9a-f]{32}/){2}", "<work>/", text)
    return text.strip()


def main() -> None:
    sf_dir = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01").rstrip("/")
    spark = local_session()
    raw_csv = land_csv(sales_raw(spark, sf_dir), scratch_path(spark, "landing"))
    bronze = f"{scratch_database(spark)}.raw_sales"
    ingest(spark, raw_csv, bronze)
    silver = write_layer(clean(read_table(spark, bronze)), scratch_path(spark, "silver"))
    jobs = {
        "J1 bronze ingest (CSV scan feeding the table write)": read_raw(spark, raw_csv),
        "O7 row count": row_count(spark, bronze),
        "J2 silver clean (bronze table feeding the silver write)": clean(read_table(spark, bronze)),
        "J3 gold customer sales (silver layer feeding the gold write)": customer_sales(read_layer(spark, silver)),
        "J2+J3 fused over bronze": customer_sales(clean(read_table(spark, bronze))),
        "flagship query from the driver tables": QUERIES["gold_customer_sales"](spark, sf_dir),
    }
    for title, df in jobs.items():
        print(f"### {title}\n\n```\n{final_plan(df)}\n```\n")
    # At 100 TB orders and part fail the broadcast size check; this shows
    # the plan Spark then makes.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    title = "flagship with broadcast off (the join shape at 100 TB)"
    print(f"### {title}\n\n```\n{final_plan(QUERIES['gold_customer_sales'](spark, sf_dir))}\n```\n")
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
