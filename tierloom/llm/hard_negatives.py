"""Hard negatives by candidate lists that the anchors of a cluster share.

Two searches by inner product: an anchor's best rows of its own label are its
positives, and for each of these the best rows of other labels within a
window below the positive's score are its hard negatives.

Anchors are clustered by direction. For a cluster with centre c, all whose
members are within the angle b of c, a row x at the angle t to c has with no
member u a larger product than ``|u| |x| cos(max(0, t - b))``: t - b bounds
the angle between u and x from below. Candidates are sorted by this bound
once per cluster, and every member walks the one list, until its own length
times the next bound is below what it still looks for: the last of its best
scores, or the least score of its window. What follows in the list is then
certified to be worse. Where directions cluster, walks are short; in data
without structure b is so large that they go through the whole list.

Lists are made per cluster and shard (see ``vectors``), so that each has a
bounded size, and merged by anchor. Centres come from a bounded sample of
the anchors (``SAMPLE`` of them, at most ``CLUSTERS`` centres); they decide
who shares a list, nothing else. Large clusters, and a group of equal
anchors, are split into blocks; each block takes its own centre and angle.

Scores are exact: components become whole numbers, products are taken as
doubles where no sum can reach 2⁵³, else as 64-bit integers.

Defined cases: rows with a null label, a null vector, or a null or
non-finite component take no part, nor do vectors of another length than
most; components too large for 64-bit products (beyond about ±2¹⁷ at 64
dimensions) count as the largest that fits; repeated rows are candidates
each, and each anchor row has its own results; rows of the anchor's own id
are neither its positives nor its negatives; a null id is no anchor and
comes last among ties; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.storage import table, written
from tierloom.llm.vectors import block_of, cells, ids_of, matrix_of, ranked_within, sharded, valid

# Fixed values of op11's rule.
OP11_EVERY = 50
OP11_MOVED = 7
OP11_LABELS = 10
OP11_SCALE = 256.0
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is between these shares of the positive's, in percent.
LOW, HIGH = 50, 95

#: Anchors that the centres are fitted on, centres, and anchors per centre.
SAMPLE = 20_000
CLUSTERS = 1_024
PER_CLUSTER = 64
_ROUNDS = 6
#: Rows of a list that a member walks at once, and vectors in a packed row.
STEP = 256
PIECE = 1_024

_FOUND = "found array<struct<less:long,unknown:boolean,vec_id:long>>"


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(lengths > 0, lengths, 1)[:, None], lengths


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Directions of ``k`` clusters at most, by spherical k-means."""
    units, _ = _units(sample.astype(np.float64))
    centres = units[:k]
    for _ in range(_ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        moved, lengths = _units(sums)
        centres = np.where(lengths[:, None] > 0, moved, centres)
    return centres


def shared_list(members: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates in order of their bound, and the bounds: no member of
    length one has a larger product with the candidate."""
    units, _ = _units(members)
    centre, length = _units(units.sum(axis=0, keepdims=True))
    if not length[0]:
        centre[0, 0] = 1.0
    wide = np.arccos(np.clip(units @ centre[0], -1, 1)).max(initial=0)
    directions, lengths = _units(candidates)
    away = np.arccos(np.clip(directions @ centre[0], -1, 1))
    bounds = lengths * np.cos(np.clip(away - wide, 0, math.pi))
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order]


class Walk:
    """The walk of a block's members along their list.

    Each member looks for ``k`` rows in each of its slots. ``least`` is what
    a row must score there to count, ``most`` what it must not exceed;
    slots where ``least > most`` look for nothing.
    """

    def __init__(self, members: np.ndarray, own: np.ndarray, labels: np.ndarray, least: np.ndarray, most: np.ndarray, k: int):
        self.members, self.own, self.labels, self.least, self.most, self.k = members, own, labels, least.copy(), most, k
        self.lengths = np.linalg.norm(members.astype(np.float64), axis=1)
        n = np.empty(0, np.int64)
        self.held = (n, least.ravel()[:0], n.astype(bool), n)  # slot of all, score, unknown, id
        self.walked = np.zeros(len(members), np.int64)

    def along(self, candidates: np.ndarray, ids: np.ndarray, unknown: np.ndarray, labels: np.ndarray, same: bool) -> None:
        order, bounds = shared_list(self.members.astype(np.float64), candidates.astype(np.float64))
        slots = self.least.shape[1]
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            wanted = np.where(self.least <= self.most, self.least, np.inf).min(axis=1)
            reach = self.lengths * bounds[at]
            walks = np.flatnonzero(reach + 1e-9 * self.lengths * np.abs(bounds[at]) + 0.5 >= wanted)
            if not len(walks):
                break  # bounds only fall, wishes only rise
            self.walked[walks] += len(some)
            scores = self.members[walks] @ candidates[some].T
            fits = (labels[some][None, :] == self.labels[walks, None]) == same
            fits &= unknown[some][None, :] | (ids[some][None, :] != self.own[walks, None])
            new = []
            for slot in range(slots):
                good = fits & (scores >= self.least[walks, slot, None]) & (scores <= self.most[walks, slot, None])
                left, right = np.nonzero(good)
                new.append((walks[left] * slots + slot, scores[left, right], unknown[some][right], ids[some][right]))
            group, score, no_id, vec_id = (np.concatenate(x) for x in zip(self.held, *new, strict=True))
            by, place = ranked_within(group, -score, no_id, vec_id)
            by, place = by[place < self.k], place[place < self.k]
            self.held = (group[by], score[by], no_id[by], vec_id[by])
            full = place == self.k - 1
            self.least.ravel()[group[by][full]] = score[by][full]


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """The shards' vectors, ``PIECE`` in a row, written."""

    def pack(shard: pa.Table) -> pa.Table:
        parts = [shard.slice(at, PIECE) for at in range(0, shard.num_rows, PIECE)]
        return pa.table(
            {
                "shard": pa.array([p.column("shard")[0].as_py() for p in parts], pa.int32()),
                "ids": pa.array([p.column("vec_id").to_pylist() for p in parts], pa.list_(pa.int64())),
                "labels": pa.array([p.column("label").to_pylist() for p in parts], pa.list_(pa.int64())),
                "vectors": pa.array([matrix_of(p.column("vec"), size).astype(np.int32).tobytes() for p in parts], pa.binary()),
            }
        )

    packed = rows.select("shard", "vec_id", "label", "vec").groupBy("shard")
    return written(packed.applyInArrow(pack, "shard int, ids array<long>, labels array<long>, vectors binary"), "negative_vectors")


def _clustered(anchors: DataFrame, count: int, size: int) -> tuple[DataFrame, int]:
    """The anchors with ``block``, written, and the number of blocks."""
    k = min(CLUSTERS, -(-count // PER_CLUSTER))
    sample = anchors.select("vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow().column("vec")
    shared = anchors.sparkSession.sparkContext.broadcast(centres_of(matrix_of(sample, size), k))

    def assign(batches):
        for batch in batches:
            units = matrix_of(pa.chunked_array([batch.column("vec")]), size).astype(np.float64)
            nearest = (units @ shared.value.T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(nearest, pa.int32()))

    named = written(anchors.mapInArrow(assign, "row long, anchor_id long, label long, vec array<int>, cluster int"), "anchors")
    sizes = {r["cluster"]: r["n"] for r in named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts, blocks = [], [], 0
    for cluster in range(k):
        first.append(blocks)
        parts.append(block_of(sizes.get(cluster, 0), size)[1])
        blocks += parts[-1]
    at = F.col("cluster") + 1
    part = F.pmod(F.xxhash64("row", F.lit("block")), F.element_at(F.lit(parts), at))
    return named.withColumn("block", (F.element_at(F.lit(first), at) + part).cast("int")).drop("cluster"), blocks


def _merged(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
    return lists.groupBy(*keys).agg(best.alias("found"))


def _searched(left: pa.Table, right: pa.Table, size: int, limit: int, kind: type, k: int, same: bool) -> pa.Table:
    """One block's walk along a shard: a row per anchor and slot."""
    members = np.clip(matrix_of(left.column("vec"), size), -limit, limit).astype(kind)
    own, _ = ids_of(left.column("anchor_id"))
    shape = (len(members), -1)
    least, most = (left.column(c).combine_chunks().flatten().to_numpy().reshape(shape).astype(kind) for c in ("least", "most"))
    walk = Walk(members, own, left.column("label").to_numpy(), least, most, k)
    vectors = np.concatenate([np.frombuffer(v.as_buffer(), np.int32) for v in right.column("vectors")]).reshape(-1, size)
    ids, unknown = ids_of(pa.chunked_array([right.column("ids").combine_chunks().flatten()]))
    labels = right.column("labels").combine_chunks().flatten().to_numpy()
    walk.along(np.clip(vectors, -limit, limit).astype(kind), ids, unknown, labels, same)
    group, score, no_id, vec_id = walk.held
    some, first = np.unique(group, return_index=True)
    found = pa.StructArray.from_arrays(
        [pa.array((-score).astype(np.int64)), pa.array(no_id), pa.array(vec_id, mask=no_id)], ["less", "unknown", "vec_id"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(group)], pa.int32()), found)
    slots = least.shape[1]
    return pa.table({"row": left.column("row").take(pa.array(some // slots)), "slot": pa.array(some % slots, pa.int32()), "found": lists})


def hard_negatives(
    vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = OP11_SCALE
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` of each row that ``is_anchor``.

    ``vectors`` has ``vec_id``, ``label`` and ``vec``. A negative n of the
    positive p has ``low * p <= 100 * n <= high * p``.
    """
    spark = vectors.sparkSession
    whole = F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    largest = (1 << 31) - 1
    whole = F.transform(whole, lambda x: F.greatest(F.lit(-largest), F.least(F.lit(largest), x)).cast("int"))
    rows = vectors.where(F.col("label").isNotNull() & valid(F.col("vec")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vec"))
    rows, n, shards, size = sharded(rows, "negative_rows")
    counted = rows.agg(F.max(F.array_max(F.transform("vec", F.abs))).alias("largest"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    if not n or not counted["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    limit = math.isqrt((1 << 63) // (101 * size))
    kind = np.float64 if 100 * size * min(limit, counted["largest"]) ** 2 < 1 << 53 else np.int64
    anchors = rows.where(is_anchor).select("row", F.col("vec_id").alias("anchor_id"), "label", "vec")
    anchors, blocks = _clustered(anchors, counted["anchors"], size)
    index = _packed(rows, size)
    search = partial(_searched, size=size, limit=limit, kind=kind)
    schema = f"row long, slot int, {_FOUND}"
    # Products are below 2^63 / 100, in doubles below 2^53 / 100.
    bound = (1 << 63) // 101 if kind is np.int64 else (1 << 53) // 100

    wished = anchors.withColumn("least", F.array(F.lit(-bound))).withColumn("most", F.array(F.lit(bound)))
    lists = cells(wished, index, range(shards), blocks, partial(search, k=positives, same=True), schema)
    found = written(_merged(lists, positives, "row"), "positives")

    def score(x):
        return -x["less"]

    scores = F.transform("found", score)
    hundred = F.lit(100).cast("decimal(3,0)")  # a decimal quotient is exact
    fewest = F.transform(scores, lambda p: F.ceil(low * p / hundred).cast("long"))
    largest = F.transform(scores, lambda p: F.floor(high * p / hundred).cast("long"))
    # As many slots for every anchor: those without a positive look for nothing.
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("found"))
    wished = found.select("row", F.concat(fewest, F.transform(fill, lambda x: x + 1)).alias("least"), F.concat(largest, fill).alias("most"))
    lists = cells(anchors.join(wished, "row"), index, range(shards), blocks, partial(search, k=negatives, same=False), schema)
    lists = _merged(lists, negatives, "row", "slot").select("row", "slot", F.posexplode("found").alias("at", "negative"))
    each = found.select("row", F.posexplode("found").alias("slot", "positive"))
    out = lists.join(each, ["row", "slot"]).join(anchors.select("row", "anchor_id"), "row")
    return out.select(
        "anchor_id",
        F.col("positive.vec_id").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"),
        score(F.col("positive")).alias("positive_score"),
        score(F.col("negative")).alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % OP11_MOVED == 0, (F.col("label") + 1) % OP11_LABELS).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), F.col("embedding").alias("vec"))
    return hard_negatives(rows, F.col("vec_id") % OP11_EVERY == 0)


OP11_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % {OP11_MOVED} = 0 THEN (label + 1) % {OP11_LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({OP11_SCALE} * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % {OP11_EVERY} = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
 AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
