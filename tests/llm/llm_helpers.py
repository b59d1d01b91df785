"""Shared by the tests of the training-data operators."""

import datetime
import re

from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

# Names that the operators use inside, or return.
CLASHING = "key hash n kept shard node component bucket size target base doc spans order tie finish epoch drops host".split()


def make_docs(spark, rows, partitions=3):
    """Documents from ``(doc_id, text[, source[, lang]])`` with extra columns
    of clashing names."""
    full = []
    for row in rows:
        doc_id, text, source, lang = (*row, *[None] * (4 - len(row)))
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(full, DOCUMENT).repartition(partitions)
    df = df.withColumns({name: F.lit(7) for name in CLASHING})
    return df.withColumn("a b.c", F.lit(datetime.date(2020, 1, 1)))


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, sf_dir=SF001):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
