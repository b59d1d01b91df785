"""Quality rules: repetition, length, and cross-document line frequency.

Lines that many documents of a host (``source``) share are its boilerplate.
Normalised lines are hashed, the distinct documents of each (host, line)
are counted, and lines above the host's limit are removed; a document that
the removal leaves with too little of its own is rejected.

- A line is normalised by stripping, collapsing white space and lower-casing
  A-Z. Lines without a word are never counted.
- Documents of equal text are one document: copying a clean page does not
  make boilerplate of its lines (copies are the business of dedup).
- The limit is ``MAX_DOCS`` distinct documents of the host, however large the
  host is; a line must be above it.
- One document keeps its copy of each line: the one with the smallest
  ``doc_id``. So of a group of close copies at least one stays whole.
- A document is depleted if less than ``KEEP_PERCENT`` of its words are left.

The text is read once. What is shuffled are 64-bit hashes of distinct (host,
line, text), counted before the shuffle to (host, line) so that neither a
hot host nor a hot line meets in one task; the frequent lines come back by a
join that Spark may split on skew. No text is shuffled for the verdicts.

Defined cases: null text has no words (and fails the base rules); a null
host is a host of its own; repeated rows get equal verdicts, as the verdict
hangs only on host and text; null ids are kept as they are (they come last
when a line's own document is chosen); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tierloom.llm.storage import columns_of, table, text_key, written

# Fixed values of op6's base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3

MAX_DOCS = 10
KEEP_PERCENT = 30

_PROFILE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_hash(words: list[bytes]) -> int:
    """Of a normalised line, given by its lower-cased words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    windows = each[:n]
    for k in range(1, REPEAT_WINDOW):
        windows = (windows ^ (windows >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    _, which, found = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(found[which] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(REPEAT_WINDOW):
        covered[starts + k] = True
    return int(covered.sum())


def profile(text: bytes) -> tuple[int, int, int, int, int]:
    """The base figures of one whole text."""
    words = text.split()  # bytes.split knows only ASCII white space: exactly the rule
    blanks = sum(text.count(x) for x in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - blanks,
        sum(text.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS))),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def line_words(text: bytes) -> dict[int, int]:
    """Words by line hash, over the distinct normalised lines of a text."""
    out: dict[int, int] = {}
    for line in text.lower().split(b"\n"):
        if words := line.split():
            key = line_hash(words)
            out[key] = out.get(key, 0) + len(words)
    return out


def _host(documents: DataFrame) -> F.Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit("")))


def document_profiles(documents: DataFrame) -> DataFrame:
    """``doc_id, host, key``, the base figures, and the lines' hashes and
    words, one row per document."""
    schema = StructType([documents.schema["doc_id"]])
    for name in ("host", "key", *_PROFILE):
        schema = schema.add(name, LongType())
    schema = schema.add("hashes", ArrayType(LongType())).add("words", ArrayType(LongType()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text")]
            figures = np.array([profile(t) for t in texts], np.int64).reshape(len(texts), 5)
            lines = [line_words(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "host", "key")),
                    *(pa.array(figures[:, k]) for k in range(5)),
                    pa.array([list(x) for x in lines], pa.list_(pa.int64())),
                    pa.array([list(x.values()) for x in lines], pa.list_(pa.int64())),
                ],
                names=schema.names,
            )

    rows = documents.select(
        "doc_id", _host(documents).alias("host"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(read, schema)


def frequent_lines(profiles: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``host, key, removed_words, removed_lines``: what each distinct text
    of a host loses to lines above the host's limit."""
    lines = profiles.select("doc_id", "host", "key", F.explode(F.arrays_zip("hashes", "words")).alias("line"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id"))
    texts = lines.groupBy("host", "line.hashes", "key").agg(first.alias("first"), F.first("line.words").alias("words"))
    texts = written(texts.withColumnRenamed("hashes", "hash"), "rule_lines")
    counts = texts.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("first", "key")).alias("own"))
    above = counts.where(F.col("docs") > max_docs).select("host", "hash", F.col("own.key").alias("own"))
    lost = texts.join(above, ["host", "hash"]).where("key != own")
    return lost.groupBy("host", "key").agg(
        F.sum("words").alias("removed_words"), F.collect_list("hash").alias("removed_lines")
    )


def judge(documents: DataFrame, max_docs: int = MAX_DOCS, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """``doc_id, host, key``, base figures, ``base_failed, removed_words,
    removed_lines, depleted, kept``, one row per document."""
    profiles = written(document_profiles(documents), "rule_profiles")
    lost = frequent_lines(profiles, max_docs)
    removed = F.coalesce("removed_words", F.lit(0))
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (
        profiles.drop("hashes", "words")
        .join(lost, ["host", "key"], "left")
        .withColumn("removed_words", removed)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeats)
        .withColumn("depleted", 100 * (F.col("n_words") - F.col("removed_words")) < keep_percent * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def apply_rules(documents: DataFrame, **limits) -> DataFrame:
    """``doc, kept_text``: the documents that the rules keep, each as a
    struct of its row, and its text without the lines above the limits."""
    verdicts = judge(documents, **limits).where("kept").groupBy("host", "key").agg(F.first("removed_lines").alias("drops"))
    rows = documents.select(
        F.struct(*columns_of(documents)).alias("doc"),
        _host(documents).alias("host"),
        text_key(F.col("text")).alias("key"),
    ).join(verdicts, ["host", "key"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, drops in zip(batch.column("text"), batch.column("drops"), strict=True):
                text = text.as_py() or b""
                if drops.is_valid:
                    gone = set(drops.as_py())
                    lines = ((line, line.lower().split()) for line in text.split(b"\n"))
                    text = b"\n".join(line for line, words in lines if not words or line_hash(words) not in gone)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.binary())], ["doc", "kept"])

    plain = rows.select("doc", F.col("doc.text").cast("binary").alias("text"), "drops")
    out = plain.mapInArrow(clean, StructType([rows.schema["doc"]]).add("kept", "binary"))
    return out.select("doc", F.col("kept").cast("string").alias("kept_text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS body FROM documents
),
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place
  FROM (SELECT doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM docs)
),
windows AS (
  SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (
    SELECT doc_id, place, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY place)
  ) WHERE c IS NOT NULL
),
repeats AS (
  SELECT doc_id, count(DISTINCT place + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
),
counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id
),
lines AS (
  SELECT doc_id, source, body, line, place,
    translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (
    SELECT doc_id, source, body, unnest(cut) AS line, generate_subscripts(cut, 1) AS place
    FROM (SELECT *, string_split(body, chr(10)) AS cut FROM docs)
  )
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
),
common AS (
  SELECT source, norm, arg_min(body, doc_id) AS own FROM lines GROUP BY source, norm HAVING count(DISTINCT body) > 10
),
lost AS (
  SELECT l.doc_id, sum(l.words) AS removed_words
  FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm
  WHERE l.body <> c.own GROUP BY l.doc_id
),
joined AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM docs d LEFT JOIN counted USING (doc_id) LEFT JOIN repeats USING (doc_id)
    LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= 30 * n_words AS kept
FROM joined
"""
