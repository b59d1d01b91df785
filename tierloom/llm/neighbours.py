"""Approximate nearest neighbours by vantage-point trees per shard.

Nearness is the largest inner product. With one coordinate more that fills
each vector up to the greatest length M (and 0 for a query, whose own length
does not matter), the largest inner product is the smallest Euclidean
distance, so the triangle inequality holds between queries and vectors:
after scaling by M, ``distance² = 2 - 2 <q, x> / (|q| M)``.

Index: vectors are dealt to shards of bounded size by row. Each shard has a
tree: a node's vectors are halved at the median of their distances to a
vantage point, down to leaves of at most ``LEAF`` vectors. The index is
written, a row per leaf: its vectors, and for each vantage point on its path
the least and greatest distance to a vector below that branch.

Search: queries go in blocks to every shard. With ``d`` the distance of the
query to a vantage point, no vector below a branch is nearer than ``low - d``
or ``d - high``. A leaf is skipped if the greatest of these bounds on its
path, times ``factor``, exceeds the distance of the k-th best vector so far.
With factor one nothing that counts is skipped: the search is exact. Each
query opens its most promising leaf first. The first shards are searched on
their own; the k-th best there bounds the search in all others, which then
return no more than what beats it. Lists are merged by query.

How much a factor misses depends on the data, so where none is given it is
fitted: ``FIT_QUERIES`` vectors of each of the first ``FIT_SHARDS`` shards
are searched in their shard exactly and with every factor of ``FACTORS``, and
the largest that finds ``FIT_RECALL`` of the exact lists is taken.

In data without structure (64 random dimensions) all bounds are small and
any index has to open most leaves to reach a recall of 0.9; where vectors
are clustered, bounds beyond a cluster are large and few leaves are opened.
``compared`` says how many vectors a query was compared with.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than most; repeated
rows are candidates each, and each query row has a list of its own; rows of
the query's own id are no candidates; a null id is no query, and comes last
among ties; an inner product beyond the range of doubles is infinite; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.storage import table, written
from tierloom.llm.vectors import block_of, cells, ids_of, matrix_of, numpy_type, ranked_within, sharded, unpacked, valid

# Fixed values of op12's rule.
OP12_EVERY = 20
OP12_NEIGHBOURS = 20

#: Bounds count this many times; 1 is exact, more is faster and misses more.
FACTORS = (8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0)
FIT_SHARDS = 4
FIT_QUERIES = 64
FIT_RECALL = 0.97
LEAF = 128
#: Shards that are searched first, to bound the search in the others.
FIRST_SHARDS = 8
#: Rounding of squared distances, so that factor one stays exact.
_SLACK = 1e-9
#: Vantage points that are tried per node, and vectors they are tried on.
_TRIED, _TRIED_ON = 8, 64

_LEAF_SCHEMA = "shard int, ids array<long>, vectors binary, points binary, low array<double>, high array<double>"
_FOUND_SCHEMA = "row long, query_id long, found array<struct<less:double,unknown:boolean,vec_id:long>>, compared long"


def filled(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors scaled by the greatest length, with the coordinate that
    fills them up to it."""
    scaled = vectors / longest
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Between points of length one."""
    return np.sqrt(np.maximum(0, 2 - 2 * (points @ others.T)))


def leaves_of(points: np.ndarray, leaf: int = LEAF) -> list[tuple[np.ndarray, list[tuple[int, float, float]]]]:
    """The leaves of the vantage-point tree: ``(members, path)``, a path
    being ``(vantage point, least distance, greatest distance)`` by node."""
    out, open_nodes = [], [(np.arange(len(points)), [])]
    while open_nodes:
        members, path = open_nodes.pop()
        if len(members) <= leaf:
            out.append((members, path))
            continue
        tried = members[np.linspace(0, len(members) - 1, _TRIED).astype(int)]
        on = members[np.linspace(0, len(members) - 1, _TRIED_ON).astype(int)]
        best = int(tried[_distances(points[tried], points[on]).std(axis=1).argmax()])
        away = _distances(points[[best]], points[members])[0]
        order = np.argsort(away, kind="stable")
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            open_nodes.append((members[half], [*path, (best, float(away[half].min()), float(away[half].max()))]))
    return out


def build_index(rows: DataFrame, size: int, longest: float) -> DataFrame:
    """A row per leaf of each shard's tree, written."""
    kind = numpy_type(rows)

    def build(shard: pa.Table) -> pa.Table:
        vectors = matrix_of(shard.column("vec"), size)
        points = filled(vectors.astype(np.float64), longest)
        leaves = leaves_of(points)
        ids = shard.column("vec_id").combine_chunks()
        number = shard.column("shard")[0].as_py()
        return pa.table(
            {
                "shard": pa.array([number] * len(leaves), pa.int32()),
                "ids": pa.array([ids.take(pa.array(m)).to_pylist() for m, _ in leaves], pa.list_(pa.int64())),
                "vectors": pa.array([vectors[m].astype(kind).tobytes() for m, _ in leaves], pa.binary()),
                "points": pa.array([points[[v for v, _, _ in path]].tobytes() if path else b"" for _, path in leaves], pa.binary()),
                "low": pa.array([[low for _, low, _ in path] for _, path in leaves], pa.list_(pa.float64())),
                "high": pa.array([[high for _, _, high in path] for _, path in leaves], pa.list_(pa.float64())),
            }
        )

    return written(rows.select("shard", "vec_id", "vec").groupBy("shard").applyInArrow(build, _LEAF_SCHEMA), "vantage_index")


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component on, so
    that equal vectors have equal products wherever they lie."""
    out = np.zeros(len(left))
    for k in range(left.shape[1]):
        out += left[:, k] * right[:, k]
    return out


class _Best:
    """The k best candidates of each query of a block."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int):
        self.queries, self.own, self.bound, self.k = queries, own, bound, k
        self.lengths = np.linalg.norm(queries, axis=1)
        n = np.empty(0, np.int64)
        self.held = (n, np.empty(0), n.astype(bool), n)  # query, score, unknown, id
        self.last = bound.copy()
        self.compared = np.zeros(len(queries), np.int64)

    def open(self, which: np.ndarray, vectors: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """Compare the queries ``which`` with the vectors of a leaf."""
        self.compared[which] += len(ids)
        with np.errstate(over="ignore", invalid="ignore"):
            rough = self.queries[which] @ vectors.T
            error = 1e-12 * self.lengths[which, None] * np.linalg.norm(vectors, axis=1)[None, :]
            near = ~(rough + error < self.last[which, None])
            near &= unknown[None, :] | (ids[None, :] != self.own[which, None])
            left, right = np.nonzero(near)
            query = which[left]
            score = exact_products(self.queries[query], vectors[right])
        new = (query, score, unknown[right], ids[right])
        query, score, unknown, ids = (np.concatenate(x) for x in zip(self.held, new, strict=True))
        order, place = ranked_within(query, -score, unknown, ids)
        order, place = order[place < self.k], place[place < self.k]
        self.held = (query[order], score[order], unknown[order], ids[order])
        full = place == self.k - 1
        self.last[query[order][full]] = np.fmax(self.bound[query[order][full]], score[order][full])


def search_leaves(queries: np.ndarray, own: np.ndarray, bound: np.ndarray, leaves: list, longest: float, k: int, factor: float) -> _Best:
    """The k nearest of each query in the leaves of a shard, but for those
    that are farther than its ``bound``. A leaf is ``(vectors, ids, unknown,
    points, low, high)``."""
    best = _Best(queries, own, bound, k)
    units = queries / best.lengths[:, None]
    least = np.zeros((len(leaves), len(queries)))
    for n, (*_, points, low, high) in enumerate(leaves):
        if len(points):
            away = _distances(points[:, :-1], units)
            least[n] = np.maximum(low[:, None] - away, away - high[:, None]).max(axis=0)
    least = np.maximum(0, least)
    first = least.argmin(axis=0)
    for turn in ("first", "others"):
        for n, (vectors, ids, unknown, *_) in enumerate(leaves):
            reach = 2 - 2 * best.last / (best.lengths * longest)
            wanted = ~((factor * least[n]) ** 2 > reach + _SLACK) & ((first == n) == (turn == "first"))
            if wanted.any():
                best.open(np.flatnonzero(wanted), vectors, ids, unknown)
    return best


def _leaves(rows: pa.Table, size: int, kind: type) -> list:
    """The leaves of a shard's index rows, as ``search_leaves`` takes them."""
    vectors = [v.reshape(-1, size).astype(np.float64) for v in unpacked(rows.column("vectors"), kind)]
    ids = [ids_of(pa.chunked_array([x.values])) for x in rows.column("ids")]
    points = [p.reshape(-1, size + 1) for p in unpacked(rows.column("points"), np.float64)]
    low, high = ([np.array(x.as_py(), np.float64) for x in rows.column(c)] for c in ("low", "high"))
    return [(v, *i, p, a, b) for v, i, p, a, b in zip(vectors, ids, points, low, high, strict=True)]


def fitted_factor(index: DataFrame, size: int, kind: type, longest: float, k: int) -> float:
    """The largest of ``FACTORS`` that finds ``FIT_RECALL`` of the k nearest
    of some vectors in their own shards."""

    def measure(shard: pa.Table) -> pa.Table:
        leaves = [(v, np.arange(len(v)) + at, np.zeros(len(v), bool), *rest) for at, (v, _, _, *rest) in zip(*_numbered(_leaves(shard, size, kind)), strict=True)]
        every = np.concatenate([v for v, *_ in leaves])
        asked = np.unique(np.linspace(0, len(every) - 1, FIT_QUERIES).astype(int))
        hits, exact = [], None
        for factor in reversed(FACTORS):
            best = search_leaves(every[asked], asked, np.full(len(asked), -np.inf), leaves, longest, k, factor)
            found = set(zip(best.held[0].tolist(), best.held[3].tolist(), strict=True))
            exact = found if exact is None else exact
            hits.append(len(found & exact))
        return pa.table({"factor": pa.array(FACTORS[::-1]), "hits": pa.array(hits, pa.int64()), "wanted": pa.array([len(exact)] * len(hits), pa.int64())})

    each = index.where(F.col("shard") < FIT_SHARDS).groupBy("shard").applyInArrow(measure, "factor double, hits long, wanted long")
    sums = each.groupBy("factor").agg(F.sum("hits").alias("hits"), F.sum("wanted").alias("wanted"))
    return max((r["factor"] for r in sums.collect() if r["hits"] >= FIT_RECALL * r["wanted"]), default=1.0)


def _numbered(leaves: list) -> tuple[np.ndarray, list]:
    """The leaves, with the number of vectors before each."""
    return np.cumsum([0, *(len(v) for v, *_ in leaves[:-1])]), leaves


def nearest(vectors: DataFrame, is_query, k: int, factor: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score, compared``: the ``k`` nearest rows
    found for each row that ``is_query``.

    ``vectors`` has ``vec_id`` and ``vec``. Without a ``factor`` one is
    fitted to the data.
    """
    spark = vectors.sparkSession
    nonzero = F.exists("vec", lambda x: x != 0)
    if vectors.schema["vec"].dataType.elementType.simpleString() != "float":
        vectors = vectors.withColumn("vec", F.col("vec").cast("array<double>"))
    kind = numpy_type(vectors)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vec").where(valid(F.col("vec")) & nonzero)
    rows, n, shards, size = sharded(rows, "neighbour_vectors")
    found_schema = "query_id long, rank int, vec_id long, score double, compared long"
    if not n:
        return spark.createDataFrame([], found_schema)

    largest = F.array_max(F.transform("vec", lambda x: F.abs(x).cast("double")))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("largest")) * (x / F.col("largest")))
    measured = rows.withColumn("largest", largest).select("vec_id", (F.col("largest") * F.sqrt(square)).alias("length"))
    whole = measured.agg(F.max("length").alias("longest"), F.count(F.when(is_query, 1)).alias("queries")).first()
    longest = float(min(whole["longest"], np.finfo(np.float64).max))
    block, blocks = block_of(whole["queries"], size)
    queries = rows.where(is_query).select(block.alias("block"), "row", F.col("vec_id").alias("query_id"), "vec")
    index = build_index(rows, size, longest)
    factor = factor or fitted_factor(index, size, kind, longest, k)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = matrix_of(left.column("vec"), size).astype(np.float64)
        own, _ = ids_of(left.column("query_id"))
        bound = left.column("bound").fill_null(-np.inf).to_numpy().astype(np.float64)
        leaves = _leaves(right, size, kind)
        best = search_leaves(asked, own, bound, leaves, longest, k, factor)
        query, score, unknown, ids = best.held
        ends = np.searchsorted(query, np.arange(len(asked) + 1))
        found = pa.StructArray.from_arrays(
            [pa.array(-score), pa.array(unknown), pa.array(ids, mask=unknown)], ["less", "unknown", "vec_id"]
        )
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
        return pa.table({"row": left.column("row"), "query_id": left.column("query_id"), "found": lists, "compared": pa.array(best.compared)})

    def merged(lists: DataFrame) -> DataFrame:
        found = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
        return lists.groupBy("row", "query_id").agg(found, F.sum("compared").alias("compared"))

    head = range(0, min(FIRST_SHARDS, shards))
    begun = written(merged(cells(queries.withColumn("bound", F.lit(None).cast("double")), index, head, blocks, search, _FOUND_SCHEMA)), "neighbours_begun")
    lists = begun
    if shards > head.stop:
        kth = begun.where(F.size("found") == k).select("row", (-F.element_at("found", k)["less"]).alias("bound"))
        rest = cells(queries.join(kth, "row", "left"), index, range(head.stop, shards), blocks, search, _FOUND_SCHEMA)
        lists = merged(begun.unionByName(rest))
    each = lists.select("query_id", "compared", F.posexplode("found").alias("at", "found"))
    return each.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.less")).alias("score"), "compared"
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return nearest(vectors, F.col("vec_id") % OP12_EVERY == 0, OP12_NEIGHBOURS)
