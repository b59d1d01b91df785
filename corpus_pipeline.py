"""A corpus pipeline of the training-data operators.

``STAGES`` lists ``(name, function)``. Each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame; each stage's rows are written as Parquet
and read again as the next one's ``docs``. All but the last return the
columns of ``docs``; where a stage changes ``text``, it sets ``n_chars``.

1. ``quality_rules``: rejected documents go, and boilerplate lines of the
   others.
2. ``line_dedup``: lines found in many documents go, in every document.
   Near copies of each other count as one document there: they do not empty
   each other, one whole text is for the next stage to choose.
3. ``near_dedup``: one document of each group of near copies stays.
4. ``decontamination``: documents that leak a benchmark item go.
5. ``mixing``: the documents in mixed order, one row per time that the mix
   takes a document (``epoch`` 0 or 1), with ``mix_position``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.decontamination import decontaminate
from tierloom.llm.line_dedup import dedup_lines
from tierloom.llm.mixing import mixed_documents
from tierloom.llm.near_dedup import drop_near_duplicates, near_copy_classes
from tierloom.llm.quality_rules import apply_rules
from tierloom.llm.storage import table, written

#: No SQL for the stages that compare by similarity or alignment; tested
#: against a brute-force version.
ORACLE_SQL = None


def _with_text(cleaned: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in ``doc`` with ``kept_text`` as their text."""
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cleaned.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(apply_rules(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(dedup_lines(docs, classes=near_copy_classes(docs)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
