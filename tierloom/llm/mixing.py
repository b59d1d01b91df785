"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of the document), laid one
after the other, twice over where a target needs it, and given a virtual
finish time: the source's words up to and with the document, divided by
the source's target. One global sort by finish time and a cut at the total
budget gives the mix: each source drains in step with its target.

Running totals never pass through one task. Documents are counted in
buckets, which are slices of the shuffled order small enough for a task;
the totals of buckets (not of documents) are added up first, and then each
bucket adds up its own documents. The cut works the same way over slices of
finish time: the slice in which the budget runs out is found from slice
totals, and only that slice is sorted row by row. A source with a third of
all rows is thus spread over a third of all buckets.

Defined cases: null text has size 0; a null source is a source of its own
and comes last; the shuffled order hashes id and text, so rows without an id,
or of one id, spread like others, and rows equal in both are interchangeable
copies with one place in line; a document of size 0 takes nothing; where all sizes are 0, every target is 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierloom.llm.storage import WORD, columns_of, table, text_key, written

# Fixed values of op8's mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2

#: Slices of finish time for each bucket of documents.
SLICES = 16
SEED = "mix-1"


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``source, source_size, target``: one row per source.

    Weights repeat over the sources in code point order (null last). The
    targets share ``share`` of all sizes by weight; none passes
    ``max_epochs`` times its source, and what is cut off goes to the others
    by weight until none is above. That fixed point is a water level:
    in order of ``cap / weight``, a source is full if its cap stays below
    the level that the rest would reach. One window over the sources, of
    which there are few (one row each).
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * float(max_epochs)
    budget = F.least(F.sum("source_size").over(everything) * float(share), F.sum(cap).over(everything))
    level = (F.col("budget") - F.col("full_before")) / F.col("weight_left")
    leveled = (
        sources.withColumn("budget", budget)
        .withColumn("full_before", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("open_level", F.when(cap > level * F.col("weight"), level))
        # The first source that is not full sets the level of all after it.
        .withColumn("level", F.first("open_level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def document_sizes(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, order, tie``: the words of every text, and the
    document's place in the shuffled order. No text is kept."""
    return documents.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))).alias("order"),
        text_key(F.col("text")).alias("tie"),
    )


def fair_queue(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """The mix: one row per document and epoch that it takes.

    ``sized`` as ``document_sizes`` gives it, written (it is read several
    times). Adds ``epoch, finish, source_size, target, taken``; ``taken``
    tells whether the row is in the mix, and sorting those by ``finish,
    order, tie, epoch`` gives the mixed sequence.
    """
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()  # two numbers
    # As many buckets as a bucket has rows: neither the totals of one source
    # nor the rows of one bucket outgrow a task (10 billion rows: 100,000).
    buckets = math.isqrt(totals["n"]) + 1
    slices = buckets * SLICES
    # 12 hex digits of the shuffled order, cut into equal ranges.
    bucket = F.floor(F.conv(F.substring("order", 1, 12), 16, 10).cast("double") / float(1 << 48) * buckets)
    placed = sized.withColumn("bucket", bucket)
    targets = source_targets(sized, weights, share, max_epochs)
    steps = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_start = (
        placed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(steps), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select("s", "b", "start", "source_size", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("order", "tie")
    running = F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = (
        placed.join(bucket_start, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("running", running)
        .drop("s", "b", "start", "bucket")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn(
            "finish",
            F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("running")) / F.col("target")),
        )
        .drop("running")
    )
    return _cut(written(queued, "mix_queue"), int((totals["words"] or 0) * share), slices)


def _cut(queued: DataFrame, budget: int, slices: int) -> DataFrame:
    """Mark the rows that fit the budget in order of finish time.

    Finish times run up to ``max_epochs`` times source over target; all of
    the budget lies close to 1, so slices are of equal width below 2 and
    one slice takes the rest.
    """
    piece = F.coalesce(F.floor(F.least(F.col("finish"), F.lit(2.0)) * slices), F.lit(2 * slices + 1))
    sliced = queued.withColumn("slice", piece)
    up_to = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("slice")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    )
    # The one slice in which the budget runs out.
    edge = starts.where((F.col("before") <= budget) & (F.col("before") + F.col("words") > budget)).first()
    if edge is None:  # all of it fits
        return sliced.withColumn("taken", F.col("finish").isNotNull()).drop("slice")
    inside = Window.orderBy("finish", "order", "tie", "epoch", "doc_id")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_edge = sliced.where(F.col("slice") == edge["slice"]).withColumn(
        "taken", running + F.lit(edge["before"]) <= budget
    )
    rest = sliced.where(F.col("slice") != edge["slice"]).withColumn("taken", F.col("slice") < edge["slice"])
    return rest.unionByName(at_edge).drop("slice")


def mix_counts(sized: DataFrame, **mix) -> DataFrame:
    """``doc_id, source, tie, size, source_size, target, copies``: how often
    the mix takes each row of ``sized``."""
    return (
        fair_queue(sized, **mix)
        .withColumn("once", F.when(F.col("epoch") == 0, 1).otherwise(0))
        .groupBy("doc_id", "source", "tie", "size", "source_size", "target")
        .agg(F.sum(F.col("taken").cast("long")).alias("copies"), F.sum("once").alias("rows"))
    )


def mixed_documents(documents: DataFrame, **mix) -> DataFrame:
    """The mix itself: the documents with all their columns in mixed order,
    one row per epoch that is taken, and ``epoch`` and ``mix_position``
    (the finish time). Clashing columns of the input are replaced."""
    sized = written(document_sizes(documents), "mix_sizes")
    queue = fair_queue(sized, **mix).where("taken").groupBy("doc_id", "source", "tie", "epoch")
    # Repeated rows have one place in line together, and come out as often.
    queue = queue.agg(F.min("finish").alias("mix_position"), F.min("order").alias("order"))
    place = F.struct("doc_id", "source", "tie", "epoch", "mix_position", "order").alias("place")
    queue = queue.select(place, F.col("tie").alias("key"))
    # The row is one struct, so that no name of the input can clash.
    rows = documents.select(F.struct(*columns_of(documents)).alias("doc"), text_key(F.col("text")).alias("key"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("place.doc_id")) & F.col("doc.source").eqNullSafe(F.col("place.source"))
    joined = rows.join(queue, same & (rows["key"] == queue["key"])).select("doc", "place")
    ordered = joined.orderBy("place.mix_position", "place.order", "place.tie", "place.epoch")
    added = ("epoch", "mix_position")
    kept = [F.col("doc").getField(c).alias(c) for c in documents.columns if c not in added]
    return ordered.select(*kept, *[F.col(f"place.{name}").alias(name) for name in added])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(document_sizes(table(spark, sf_dir, "documents")), "mix_sizes")
    counts = mix_counts(sized)
    # Repeated rows come back as so many rows, and share what was taken.
    each = counts.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    copies = F.floor(F.col("copies") / F.col("rows")) + (F.col("row") <= F.col("copies") % F.col("rows")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


OP8_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    row_number() OVER w AS place,
    least(sum(source_size) OVER () * 1.5::DOUBLE, sum(source_size * 2.0::DOUBLE) OVER ()) AS budget,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
),
leveled AS (
  SELECT *, arg_min((budget - full_before) / weight_left, place)
    FILTER (cap > (budget - full_before) / weight_left * weight) OVER () AS level
  FROM levels
),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM leveled
),
running AS (
  SELECT s.*, t.source_size, t.target,
    sum(size) OVER (PARTITION BY s.source ORDER BY place ROWS UNBOUNDED PRECEDING) AS running
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
queued AS (
  SELECT r.*, epoch, CASE WHEN target > 0 THEN CAST(epoch * source_size + running AS DOUBLE) / target END AS finish
  FROM running r, (SELECT unnest([0, 1]) AS epoch)
),
cut AS (
  SELECT *, finish IS NOT NULL AND sum(size) OVER (ORDER BY finish NULLS LAST, place, epoch ROWS UNBOUNDED PRECEDING)
    <= (SELECT CAST(floor(sum(size) * 1.5::DOUBLE) AS BIGINT) FROM sized) AS taken
  FROM queued
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN taken THEN size ELSE 0 END) AS BIGINT) AS taken
FROM cut GROUP BY doc_id, source, size, source_size, target
"""
