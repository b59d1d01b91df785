"""Ranked lexical search, reversed: documents stream past the items.

The items' terms form an inverted index (term to the items that hold it, and
how often), which every task gets. Each document is read once where it
lies: its term counts go through the index, which adds to the scores of the
items that share a term, and each item's heap of the best documents is
updated. What leaves a task is a heap per item, not a score per document;
heaps are merged in two rounds, first some tasks' heaps, then all, so that
no task gathers one entry per document or per task of the whole run.

The weights need counts over all documents first: how many have a term, all
their terms, and for each of the items' terms the documents that hold it.
Those are sums per task, and no larger than the items' vocabulary.

The items are a stated query set. They are cut into blocks of about
``BLOCK_CHARS`` characters and at most ``BLOCK_ITEMS`` items, so that index
and heaps have a bounded size; all documents are searched for each block.

Scores are sums of integers. They are added as doubles where no score can
reach 2⁵³, which is exact, and else as 64-bit integers.

Defined cases: null, empty or wordless texts have no terms, and such an item
no list; equal scores go by id, null ids last; repeated rows of documents
are ranked each, repeated rows of items have a list each (a null item id,
too); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierloom.llm.storage import table, text_key
from tierloom.llm.vectors import ranked_within

# Fixed values of op13's rule.
TOP = 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BLOCK_CHARS = 4_000_000
BLOCK_ITEMS = 20_000
#: Scores that are held at once, of some documents with all items of a block.
_SCORES = 1 << 21
#: Heaps of how many tasks are merged in the first round.
_MERGED = 64

# Bytes of UTF-8: ASCII letters and digits and all beyond ASCII are terms'.
_FOLDED = bytes(c if c > 127 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLDED).split()


class ItemIndex:
    """Terms of a block of items, with the items that hold each."""

    def __init__(self, texts: list[bytes | None]):
        held: dict[bytes, dict[int, int]] = {}
        self.longest = 0
        for item, text in enumerate(texts):
            terms = terms_of(text)
            self.longest = max(self.longest, len(terms))
            for term in terms:
                of_term = held.setdefault(term, {})
                of_term[item] = of_term.get(item, 0) + 1
        self.items = len(texts)
        self.number = {term: n for n, term in enumerate(held)}
        self.starts = np.cumsum([0, *(len(x) for x in held.values())])
        self.item = np.array([item for x in held.values() for item in x], np.int64)
        self.times = np.array([n for x in held.values() for n in x.values()], np.int64)

    def counts(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """All terms of a document, and the known ones with their counts."""
        terms = terms_of(text)
        known = [self.number[t] for t in terms if t in self.number]
        return len(terms), *np.unique(np.array(known, np.int64), return_counts=True)


def weight(documents: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * with_term + 1)))


class Scorer:
    """Scores of documents, and the heap of each item of a block."""

    def __init__(self, index: ItemIndex, documents: int, all_terms: int, with_term: np.ndarray, top: int):
        self.index, self.documents, self.all_terms, self.top = index, documents, all_terms, top
        self.weights = np.array([weight(documents, int(n)) for n in with_term], np.int64)
        largest = int(self.weights.max(initial=0)) * 1_000_000 * index.longest
        self.kind = np.float64 if largest < 1 << 53 else np.int64
        self.slice = max(1, _SCORES // max(1, index.items))
        n = np.empty(0, np.int64)
        self.heap = (n, n, n.astype(bool), n)  # item, score, unknown, doc_id
        self.least = np.ones(index.items, np.int64)  # only scores above 0

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """A row per text, a column per item."""
        counted = [self.index.counts(t) for t in texts]
        m = [75 + 25 * n * self.documents // max(1, self.all_terms) for n, _, _ in counted]
        doc = np.repeat(np.arange(len(texts)), [len(known) for _, known, _ in counted])
        term = np.concatenate([np.empty(0, np.int64), *(known for _, known, _ in counted)])
        tf = np.concatenate([np.empty(0, np.int64), *(times for _, _, times in counted)])
        part = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.array(m, np.int64)[doc]))
        first, n = self.index.starts[term], self.index.starts[term + 1] - self.index.starts[term]
        flat = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(doc, n) * self.index.items + self.index.item[flat]
        value = np.repeat(part, n) * self.index.times[flat]
        size = len(texts) * self.index.items
        if self.kind is np.float64:
            total = np.bincount(at, value, size).astype(np.int64)
        else:
            total = np.zeros(size, np.int64)
            np.add.at(total, at, value)
        return total.reshape(len(texts), self.index.items)

    def add(self, texts: list[bytes | None], ids: np.ndarray, unknown: np.ndarray) -> None:
        if not self.index.items:
            return
        for at in range(0, len(texts), self.slice):
            some = slice(at, at + self.slice)
            scores = self.scores(texts[some])
            least = self.least
            if len(scores) > self.top:
                least = np.maximum(least, np.partition(scores, -self.top, axis=0)[-self.top])
            doc, item = np.nonzero(scores >= least)
            new = (item, scores[doc, item], unknown[some][doc], ids[some][doc])
            item, score, no_id, doc_id = (np.concatenate(x) for x in zip(self.heap, new, strict=True))
            order, place = ranked_within(item, -score, no_id, doc_id)
            order, place = order[place < self.top], place[place < self.top]
            self.heap = (item[order], score[order], no_id[order], doc_id[order])
            full = place == self.top - 1
            self.least[item[order][full]] = np.maximum(1, score[order][full])


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size, one on the driver at a time."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    whole = rows.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(-(-(whole["chars"] or 0) // BLOCK_CHARS), -(-whole["n"] // BLOCK_ITEMS))
    for block in range(blocks):
        part = rows.where(F.pmod(text_key(F.col("text").cast("string")), F.lit(blocks)) == block).collect()
        yield [(row["item_id"], bytes(row["text"])) for row in part]


def _counted(texts: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and documents with each item term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value)
        with_term = np.zeros(len(index.number) + 2, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n, known, _ = index.counts(text)
                with_term[known] += 1
                with_term[-2:] += (n > 0, n)
        some = np.flatnonzero(with_term)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(with_term[some])], ["term", "n"])

    rows = texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    with_term = np.zeros(len(ItemIndex(shared.value).number) + 2, np.int64)
    for row in rows:
        with_term[row["term"]] = row["n"]
    return int(with_term[-2]), int(with_term[-1]), with_term[:-2]


def _best(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each
    item, of those with a score above 0."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def ranked(block: list[tuple[object, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast([text for _, text in block])
        total, all_terms, with_term = _counted(texts, shared)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(ItemIndex(shared.value), total, all_terms, with_term, top)
            for batch in batches:
                ids = batch.column("doc_id")
                scorer.add(batch.column("text").to_pylist(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
            item, found, unknown, doc_id = scorer.heap
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id, mask=unknown), pa.array(found)], ["item", "doc_id", "score"])

        heaps = texts.mapInArrow(score, "item long, doc_id long, score long").withColumn("some", (F.spark_partition_id() / _MERGED).cast("int"))
        best = _best(_best(heaps, top, "item", "some").drop("rank"), top, "item")
        schema = StructType([items.schema["item_id"]]).add("item", "long")
        names = spark.createDataFrame([(item_id, n) for n, (item_id, _) in enumerate(block)], schema)
        return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    parts = [ranked(block) for block in _blocks(items)]
    empty = StructType([items.schema["item_id"]]).add("rank", "integer").add("doc_id", "long").add("score", "long")
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank_documents(documents, table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, whole GROUP BY term, docs
), parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // all_terms)))) AS part
  FROM counts JOIN lengths USING (doc_id) JOIN weights USING (term), whole
), wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
