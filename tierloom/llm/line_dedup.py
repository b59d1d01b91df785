"""Line dedup: lines found in many documents go, in every document.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased; keys are handled as 64-bit hashes. (Two different lines share
a hash with odds of about n^2 / 2^65 over n distinct lines.)

1. Each document gives its distinct keys; counts per key are summed per
   batch in the task, per task by Spark, and then over the shuffle.
2. The distinct keys are cut into shards of some thousand keys. Each shard
   becomes a minimal perfect hash with a fingerprint and a small saturating
   count per key (about 6 bytes a key).
3. The documents' keys are sent to the shards and probe the arrays there,
   one shard in memory at a time. Lines are never joined with lines. What
   comes back is only the keys to drop, one short list per document.
4. One shuffle brings documents and lists together, and the lines go.

Keys so common that they hold over 1 / ``HOT_SHARE`` of all lines would all
meet in one shard. There are at most ``HOT_SHARE`` of them whatever the
input, so they get a small index of their own that every task has, and are
never sent. No other key can outweigh a shard.

With ``classes`` a line counts once per class of documents instead of once per
document. Near copies as one class (``near_dedup``) do not make each other's
lines common, so a family of them keeps its text, however large it is, while
boilerplate of unlike documents goes. Pairs of line and class are made
distinct over a shuffle that spreads a hot line over its classes.

Defined cases: each row is a document, so a repeated row counts once per
row (with ``classes``: once per class); null text is one empty line; a text
that loses all lines becomes empty; null ids and other columns are kept as
they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierloom.llm.perfect_hash import CountIndex
from tierloom.llm.storage import columns_of, table, text_key, written

# Fixed values of op1's rule.
MIN_DOCS = 10
MIN_CHARS = 1

#: Distinct keys of a shard, on average.
SHARD_KEYS = 1 << 13
#: A key with over one in so many lines is hot; so many are hot at most.
HOT_SHARE = 1 << 16

_NO_LINE = np.empty(0, np.uint64)


def line_keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of a text, and key hashes of those that have a key: with
    the lines' numbers."""
    lines = (text or b"").split(b"\n")
    # bytes.strip and bytes.lower know only ASCII: exactly the rule.
    keys = [line.strip().lower() for line in lines]
    if min_chars == 1:
        at = [n for n, key in enumerate(keys) if key]
    else:
        at = [n for n, key in enumerate(keys) if len(key.decode("utf-8", "replace")) >= min_chars]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(keys[n]) for n in at), np.uint64, len(at))
    return lines, hashes, np.array(at, np.int64)


def _document_keys(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, one after the other, and their number."""
    each = [np.unique(line_keys(t.as_py(), min_chars)[1]) for t in texts]
    return np.concatenate([_NO_LINE, *each]), np.array([len(x) for x in each], np.int64)


def document_key(documents: DataFrame) -> Column:
    """64-bit key of a row by id and text; equal rows share it."""
    return F.xxhash64(*([F.col("doc_id")] if "doc_id" in documents.columns else []), text_key(F.col("text")))


def _key_rows(documents: DataFrame, min_chars: int, known: Broadcast | None = None) -> DataFrame:
    """``key, hash``: the distinct line keys of each document, without those
    of the ``known`` index."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CountIndex.from_bytes(known.value) if known else None
        for batch in batches:
            hashes, n = _document_keys(batch.column(0), min_chars)
            keys = np.repeat(batch.column(1).to_numpy(), n)
            if index:
                here = index.lookup(hashes) == 0
                hashes, keys = hashes[here], keys[here]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes.view(np.int64))], ["key", "hash"])

    rows = documents.select(F.col("text").cast("binary"), document_key(documents).alias("key"))
    return rows.mapInArrow(spread, "key long, hash long")


def count_keys(documents: DataFrame, min_chars: int, classes: DataFrame | None = None) -> DataFrame:
    """``hash, n``: the number of documents that hold each key, or of
    ``classes`` (``key, class``; a document that is not there is its own)."""
    if classes is not None:
        pairs = _key_rows(documents, min_chars).join(classes.dropDuplicates(["key"]), "key", "left")
        pairs = pairs.select("hash", F.coalesce("class", "key").alias("class"), F.col("class").isNull().alias("alone")).distinct()
        return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n = np.unique(_document_keys(batch.column(0), min_chars)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    texts = documents.select(F.col("text").cast("binary"))
    return texts.mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """``shard, index``: the perfect hash of each shard's keys, in bytes."""
    small = np.min_scalar_type(min_docs)

    def build(rows: pa.Table) -> pa.Table:
        keys = rows["hash"].to_numpy().view(np.uint64)
        n = np.minimum(rows["n"].to_numpy(), min_docs).astype(small)
        index = CountIndex.build(keys, n).to_bytes()
        return pa.table({"shard": rows["shard"][:1], "index": pa.array([index], pa.binary())})

    sharded = counts.select("hash", "n", F.pmod("hash", F.lit(shards)).alias("shard"))
    return sharded.groupBy("shard").applyInArrow(build, "shard long, index binary")


def probe_shards(probes: DataFrame, shards: DataFrame, min_docs: int) -> DataFrame:
    """``key, hash`` of the probes whose count reaches ``min_docs``.

    ``probes`` has ``shard, key, hash``. Index and probes of a shard go to
    one partition, the index first, so that a task streams through them.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        for batch in batches:
            at = batch.column("shard").to_numpy()
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            for start, end in zip(starts, [*starts[1:], len(at)], strict=True):
                part = batch.slice(start, end - start)
                if part.column("index")[0].is_valid:
                    shard, index = at[start], CountIndex.from_bytes(part.column("index")[0].as_py())
                    part = part.slice(1)
                assert shard == at[start], "a shard's index comes before its probes"
                hashes = part.column("hash").to_numpy().view(np.uint64)
                yield part.select(["key", "hash"]).filter(pa.array(index.lookup(hashes) >= min_docs))

    both = shards.select("shard", "index", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("hash"))
    both = both.unionByName(probes.withColumn("index", F.lit(None).cast("binary")))
    placed = both.repartition("shard").sortWithinPartitions("shard", F.col("index").isNull())
    return placed.mapInArrow(probe, "key long, hash long")


def dedup_lines(
    documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, classes: DataFrame | None = None
) -> DataFrame:
    """``doc, kept_text, n_lines, n_dropped``, one row per document.

    ``doc`` is the input row as a struct (so no name can clash). ``classes``
    gives documents (by ``document_key``) the class that they count as.
    """
    counts = written(count_keys(documents, min_chars, classes), "line_counts")
    total = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("lines")).first()
    if not total["keys"]:
        hot = _NO_LINE
    else:
        rows = counts.where((F.col("n") >= min_docs) & (F.col("n") * HOT_SHARE > total["lines"])).select("hash")
        hot = np.sort(rows.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))  # HOT_SHARE at most
    hot_index = CountIndex.build(hot, np.ones(len(hot), np.uint8)).to_bytes()
    hot_index = documents.sparkSession.sparkContext.broadcast(hot_index)
    shards = total["keys"] // SHARD_KEYS + 1

    # A key need not be unique: whatever comes back is dropped everywhere.
    probes = _key_rows(documents, min_chars, hot_index).withColumn("shard", F.pmod("hash", F.lit(shards)))
    drops = probe_shards(probes, build_shards(counts, shards, min_docs), min_docs)
    drops = drops.groupBy("key").agg(F.collect_set("hash").alias("drops"))
    rows = documents.select(F.struct(*columns_of(documents)).alias("doc"), document_key(documents).alias("key")).join(drops, "key", "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = CountIndex.from_bytes(hot_index.value)
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(1), batch.column(2), strict=True):
                lines, hashes, at = line_keys(text.as_py(), min_chars)
                gone = known.lookup(hashes) > 0
                if drops.is_valid:
                    gone |= np.isin(hashes, drops.values.to_numpy().view(np.uint64))
                dropped = set(at[gone].tolist())
                kept.append(b"\n".join([x for n, x in enumerate(lines) if n not in dropped]) if dropped else text.as_py() or b"")
                n_lines.append(len(lines))
                n_dropped.append(len(dropped))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["doc", "kept", "n_lines", "n_dropped"],
            )

    plain = rows.select("doc", F.col("doc.text").cast("binary").alias("text"), "drops")
    schema = StructType([rows.schema["doc"]]).add("kept", "binary").add("n_lines", "long").add("n_dropped", "long")
    return plain.mapInArrow(clean, schema).select(
        "doc", F.col("kept").cast("string").alias("kept_text"), "n_lines", "n_dropped"
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(documents).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, line, place,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, unnest(cut) AS line, generate_subscripts(cut, 1) AS place
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents)
  )
),
common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE key NOT IN (SELECT key FROM common)), ''))
    AS kept_sha256
FROM lines GROUP BY doc_id
"""
