"""Quality classifier: perplexity under a modified Kneser-Ney model.

An interpolated modified Kneser-Ney model over character 4-grams is trained
per language on trusted text (labelled good and not toxic) and gives each
document a perplexity per character. A document is kept if it is no more
surprising than held-out trusted text of its language: up to the
``QUANTILE`` of its perplexities, plus ``MARGIN``, plus ``SPREAD`` over the
square root of its length, as the mean over few characters scatters more.

All counts come from all trusted documents, and every document is scored on
its whole text.

The shape of the job:

1. Documents are packed into chunks, a compressed block of texts and the
   distinct 4-grams of the chunk (per language). Written once, bucketed by
   the chunk's number, so that no later join by chunk shuffles a text.
2. Chunks with trusted documents give 4-gram counts, summed over a shuffle
   by (language, 4-gram). The lower orders' continuation counts, contexts
   and discounts follow from that table by grouping.
3. Each distinct 4-gram of all chunks is joined with the count tables of
   the four orders, sharded by (language, n-gram), and gets its
   probability.
4. A second join sends the probabilities back to the chunks that asked, and
   each chunk scores its documents. So what the joins carry is distinct
   4-grams of chunks, a small part of the text; no model is broadcast, and
   none must fit in a task: a task holds one chunk and its own 4-grams.

4-grams are four 16-bit character codes in a long (characters beyond 16 bits
share the 2,048 codes of surrogates), so orders and contexts are shifts and
masks.

Defined cases: a null or blank text has no perplexity and is not kept; a
null language is a language of its own; a language whose trusted text is not
held out anywhere has the threshold of all languages together; a language
without trusted text has none, nothing is known of it and its documents are
kept; repeated rows are scored
each; null ids are kept as they are and never labelled; a ``doc_id`` with
several labels is trusted if one of them says so and none says otherwise;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tierloom.llm.storage import table, text_key, written
from tierloom.session import scratch_database

ORDER = 4
BITS = 16
QUANTILE = 0.995
MARGIN = 0.1  # nats per character
SPREAD = 3.0
#: One trusted document in so many is held out for the threshold.
HELD_OUT = 5
#: Characters of a chunk, and of what is counted at once in one.
CHUNK_CHARS = 12_000_000
PIECE_CHARS = 1_000_000
#: The probability of a character that is new to a language.
UNIFORM = 1.0 / (1 << BITS)
COST_BITS = 28

_START = 2  # a code before each text
_BEYOND, _BEYOND_CODES = 0xD800, 0x800


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A code per character of the texts, one after the other (it and the
    three before it), and the number of each text's characters."""
    sizes = np.array([len(t) for t in texts], np.int64)
    start = chr(_START) * (ORDER - 1)
    codes = np.frombuffer("".join(start + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # No character has a surrogate's code: those stand for what is beyond 16 bits.
    codes = np.where(codes >> BITS, _BEYOND + codes % _BEYOND_CODES, codes).astype(np.int64)
    if len(codes) < ORDER:
        return np.empty(0, np.int64), sizes
    grams = codes[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        grams |= codes[ORDER - 1 - k : len(codes) - k] << (BITS * k)
    # Not the grams that end in a start code of the next text.
    ends = np.cumsum(sizes + ORDER - 1)[:-1]
    keep = np.ones(len(grams), bool)
    for k in range(ORDER - 1):
        keep[ends - (ORDER - 1) + k] = False
    return grams[keep], sizes


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """Groups of texts of about ``PIECE_CHARS`` together."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > PIECE_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _by_language(langs: list[str | None], texts: list[str]) -> dict[str | None, list[int]]:
    out: dict[str | None, list[int]] = {}
    for n, lang in enumerate(langs):
        if texts[n]:
            out.setdefault(lang, []).append(n)
    return out


def _pack(texts: list[str]) -> bytes:
    # No character of a normalised text is a line feed.
    return zstandard.ZstdCompressor(level=3).compress("\n".join(texts).encode("utf-8", "surrogatepass"))


def _unpack(blob: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass").split("\n")


def pack_chunks(documents: DataFrame) -> DataFrame:
    """``chunk, blob, docs, grams``: see the module's text."""
    doc = StructType([documents.schema["doc_id"], StructField("key", LongType()), StructField("lang", documents.schema["lang"].dataType)])
    of_lang = StructType([doc["lang"], StructField("codes", ArrayType(LongType()))])
    schema = StructType().add("chunk", "long").add("blob", "binary").add("docs", ArrayType(doc)).add("grams", ArrayType(of_lang))

    def chunk_row(parts: list[pa.RecordBatch], texts: list[str]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        langs, codes = [], []
        for lang, which in _by_language(rows["lang"].to_pylist(), texts).items():
            found = [np.unique(gram_codes(group)[0]) for group in _pieces([texts[n] for n in which])]
            langs.append(lang)
            codes.append(np.unique(np.concatenate(found)))
        docs = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("doc_id", "key", "lang")], names=doc.names)
        flat = pa.array(np.concatenate([np.empty(0, np.int64), *codes]))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), flat)
        grams = pa.StructArray.from_arrays([pa.array(langs, docs.type.field("lang").type), lists], names=of_lang.names)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        number = pa.array([uuid.uuid4().int & ((1 << 63) - 1)], pa.int64())
        return pa.RecordBatch.from_arrays([number, pa.array([_pack(texts)], pa.binary()), one(docs), one(grams)], names=schema.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, size = [], [], 0
        for batch in batches:
            at = 0
            cut = [normalised(t) for t in batch.column("text").to_pylist()]
            for n, text in enumerate(cut):
                size += len(text)
                if size >= CHUNK_CHARS:
                    parts.append(batch.slice(at, n + 1 - at).select(doc.names))
                    yield chunk_row(parts, texts + cut[at : n + 1])
                    parts, texts, size, at = [], [], 0, n + 1
            if at < batch.num_rows:
                parts.append(batch.slice(at).select(doc.names))
                texts += cut[at:]
        if texts:
            yield chunk_row(parts, texts)

    rows = documents.select("doc_id", text_key(F.col("text")).alias("key"), "lang", "text")
    return rows.mapInArrow(pack, schema)


def written_chunks(documents: DataFrame) -> DataFrame:
    """The chunks as a table bucketed by number: a join by chunk then moves
    only the other side."""
    spark = documents.sparkSession
    name = f"{scratch_database(spark)}.chunks"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pack_chunks(documents).write.bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def count_trusted(chunks: DataFrame, trusted: DataFrame) -> DataFrame:
    """``lang, gram, n`` over the texts of the ``trusted`` documents."""
    docs = chunks.select("chunk", F.posexplode("docs").alias("place", "doc")).select("chunk", "place", F.col("doc.doc_id").alias("doc_id"))
    wanted = docs.join(trusted.select("doc_id"), "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("places"))
    lang = chunks.schema["docs"].dataType.elementType["lang"]
    schema = StructType([lang]).add("gram", "long").add("n", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = _unpack(batch.column("blob")[row].as_py())
                langs = batch.column("langs")[row].as_py()
                wanted = set(batch.column("places")[row].as_py())
                for lang_, which in _by_language(langs, texts).items():
                    for group in _pieces([texts[n] for n in which if n in wanted]):
                        grams, n = np.unique(gram_codes(group)[0], return_counts=True)
                        names = pa.array([lang_] * len(grams), batch.column("langs").type.value_type)
                        yield pa.RecordBatch.from_arrays([names, pa.array(grams), pa.array(n)], names=schema.names)

    rows = chunks.select("chunk", "blob", F.col("docs.lang").alias("langs")).join(wanted, "chunk")
    return rows.select("blob", "langs", "places").mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(gram: Column, order: int) -> Column:
    """The last ``order`` characters of a gram."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def kneser_ney(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """``lang, gram, log_p`` for each row of ``grams`` (``lang, gram``).

    p_k(w | h) = max(c(hw) - D(c), 0) / c(h) + g(h) p_k-1(w | h'), where c
    counts at the highest order and continuations below, D is one of three
    discounts by count, and g(h) gives away what they save. The lowest order
    falls back to equal chances.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        longer = tables[order + 1]
        tables[order] = written(longer.groupBy("lang", _tail(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"kn_counts_{order}")
    out = grams.withColumn("p", F.lit(UNIFORM))
    for order in range(1, ORDER + 1):
        seen, contexts = _discounted(tables[order])
        tail = _tail(F.col("gram"), order)
        asked = out.withColumn("tail", tail).withColumn("context", F.shiftrightunsigned(tail, BITS))
        seen = seen.select(F.col("lang").alias("l1"), F.col("gram").alias("g1"), "direct")
        contexts = contexts.select(F.col("lang").alias("l2"), F.col("context").alias("c2"), "given")
        asked = asked.join(seen, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("tail") == F.col("g1")), "left")
        asked = asked.join(contexts, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("context") == F.col("c2")), "left")
        p = F.coalesce("direct", F.lit(0.0)) + F.coalesce("given", F.lit(1.0)) * F.col("p")
        out = asked.select("lang", "gram", p.alias("p"))
    return out.select("lang", "gram", F.log("p").alias("log_p"))


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, gram, direct`` and ``lang, context, given`` of one order."""
    of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    by_lang = counts.groupBy("lang").agg(*of).withColumn("y", F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")))
    # Where a count of counts is zero the usual values stand in.
    discounts = [
        F.greatest(F.least(F.coalesce(F.lit(float(k)) - (k + 1) * F.col("y") * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(usual)), F.lit(float(k))), F.lit(0.05)).alias(f"d{k}")
        for k, usual in ((1, 0.5), (2, 1.0), (3, 1.5))
    ]
    by_lang = by_lang.select(F.col("lang").alias("dl"), *discounts)
    joined = counts.join(by_lang, F.col("lang").eqNullSafe(F.col("dl"))).withColumn("context", F.shiftrightunsigned("gram", BITS))
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    joined = joined.withColumn("off", F.least(off, F.col("n").cast("double")))
    totals = joined.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("saved"))
    totals = totals.select(F.col("lang").alias("tl"), F.col("context").alias("tc"), "total", (F.col("saved") / F.col("total")).alias("given"))
    seen = joined.join(totals, F.col("lang").eqNullSafe(F.col("tl")) & (F.col("context") == F.col("tc")))
    direct = (F.col("n") - F.col("off")) / F.col("total")
    return seen.select("lang", "gram", direct.alias("direct")), totals.select(F.col("tl").alias("lang"), F.col("tc").alias("context"), "given")


def score_chunks(chunks: DataFrame, probabilities: DataFrame) -> DataFrame:
    """``doc_id, key, lang, chars, log_perplexity``, one row per document."""
    # An answer is the place of the 4-gram in its chunk's list and -log p in
    # millionths (below 2^28), in one long.
    lists = chunks.select("chunk", F.posexplode("grams").alias("list", "g"))
    asked = lists.select("chunk", "list", "g.lang", F.posexplode("g.codes").alias("place", "gram"))
    known = probabilities.select(F.col("lang").alias("l"), F.col("gram").alias("g"), (-F.round(F.col("log_p") * 1e6)).cast("long").alias("cost"))
    answers = asked.join(known, F.col("lang").eqNullSafe(F.col("l")) & (F.col("gram") == F.col("g")))
    answer = F.shiftleft(F.col("place").cast("long"), COST_BITS) + F.col("cost")
    answers = answers.groupBy("chunk", "list").agg(F.collect_list(answer).alias("answers"))
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("list", "answers")).alias("model"))
    doc = chunks.schema["docs"].dataType.elementType
    schema = StructType([*doc.fields]).add("chars", "long").add("log_perplexity", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = _unpack(batch.column("blob")[row].as_py())
                docs = batch.column("docs")[row].values
                chars = np.array([len(t) for t in texts], np.int64)
                total = np.full(len(texts), np.nan)
                model = batch.column("model")[row]
                grams = batch.column("grams")[row].values
                tables = {}
                for n in range(len(model.values) if model.is_valid else 0):
                    asked = grams[model.values[n]["list"].as_py()]
                    answers = model.values[n]["answers"].values.to_numpy()
                    log_p = np.empty(len(answers))
                    log_p[answers >> COST_BITS] = (answers & ((1 << COST_BITS) - 1)) * -1e-6
                    tables[asked["lang"].as_py()] = asked["codes"].values.to_numpy(), log_p
                for lang, which in _by_language(docs.field("lang").to_pylist(), texts).items():
                    codes, log_p = tables[lang]
                    done = 0
                    for group in _pieces([texts[n] for n in which]):
                        found, sizes = gram_codes(group)
                        each = log_p[np.searchsorted(codes, found)]
                        firsts = np.cumsum(sizes) - sizes
                        total[which[done : done + len(group)]] = np.add.reduceat(each, firsts)
                        done += len(group)
                with np.errstate(invalid="ignore"):
                    perplexity = pa.array(np.round(-total / np.maximum(chars, 1), 6), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(chars), perplexity], names=schema.names)

    rows = chunks.select("chunk", "blob", "docs", "grams").join(answers, "chunk", "left")
    return rows.select("blob", "docs", "grams", "model").mapInArrow(score, schema)


def classify(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``doc_id, key, lang, chars, log_perplexity, threshold, kept``."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
    trusted = trusted.where("good").withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    chunks = written_chunks(documents)
    counts = written(count_trusted(chunks, trusted.where("not held_out")), "classifier_counts")
    grams = chunks.select(F.explode("grams").alias("g")).select("g.lang", F.explode("g.codes").alias("gram")).distinct()
    scores = written(score_chunks(chunks, written(kneser_ney(counts, grams), "classifier_model")), "classifier_scores")
    held = scores.join(trusted.where("held_out").select("doc_id"), "doc_id", "left_semi").where("log_perplexity is not null")
    limits = held.groupBy(F.col("lang").alias("limit_lang")).agg(
        (F.percentile(F.round("log_perplexity", 3), F.lit(quantile)) + margin).alias("threshold")
    )
    whole = held.agg(F.percentile(F.round("log_perplexity", 3), F.lit(quantile)).alias("q")).first()["q"]  # one number
    pooled = F.lit(None if whole is None else whole + margin).cast("double")
    languages = counts.select(F.col("lang").alias("model_lang")).distinct()  # a row each
    limits = languages.join(limits, F.col("model_lang").eqNullSafe(F.col("limit_lang")), "left")
    limits = limits.select("model_lang", F.coalesce("threshold", pooled).alias("threshold"))
    judged = scores.join(limits, F.col("lang").eqNullSafe(F.col("model_lang")), "left").drop("model_lang")
    allowed = F.col("threshold") + F.lit(SPREAD) / F.sqrt(F.greatest("chars", F.lit(1)))
    fine = F.col("threshold").isNull() | (F.col("log_perplexity") <= allowed)
    return judged.withColumn("kept", F.col("log_perplexity").isNotNull() & fine)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = classify(documents, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return judged.select("doc_id", "lang", "chars", "log_perplexity", "threshold", "kept")
