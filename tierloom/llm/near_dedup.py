"""MinHash near-dedup with circulant signatures and exact confirmation.

A document's set holds the hashes of its distinct word shingles. All
coordinates of its signature come from two permutations of the 32-bit
circle: the first spreads the set over the circle, and the second, shifted
by one step more for each coordinate, ranks the places; a coordinate is the
smallest rank. Bands of coordinates put likely pairs into buckets.

Documents with equal sets are one class from the start, so copies never
become pairs. Classes that share a bucket are then linked, without making
all pairs of a bucket:

1. Each bucket has a hub: the class that shares most buckets with others
   (mostly the text that others were made from). Every class is compared
   with the hubs of its buckets, on the full sets, and what passes is united
   (connected components over links). Buckets whose classes are now one
   component are done, and the hub, compared with all, goes.
2. Of the classes that are left, shingles that no such class of another
   component has are counted. They are in no intersection that matters, so
   they bound each similarity from above; classes whose bound stays below the
   limit for every size in their bucket that may link with theirs go. (Texts
   around one shared passage go here, one row at a time, however many they
   are.)
3. Two classes x and y of different components, one of them unlike their
   hub h, can now link only if they share shingles outside h: if x is not
   like h, then h and x have too few shingles in common. In one order of
   the shingles outside h, rarest first, they meet at the first that they
   share, and have no more in common than what follows there and inside h.
   So each class spreads only its first shingles, as long as enough follows,
   and only classes that meet in one, with enough behind it in both, are
   compared. (Of copies with many edits of their own, nearly none.)
   The one exception are classes smaller than h, for which x may have enough
   in common with h alone; those few are joined by hub.

So each pair that shares a bucket is either compared, or in one component
already, or proven not to link. Two documents of the least similarity miss
each other's buckets with odds of (1 - s^ROWS)^BANDS: 6e-7 at 0.8.

Defined cases: null, empty or wordless texts have an empty set and link
with nothing; repeated rows (also of one ``doc_id``) are copies like any
other, and all rows with the kept ``doc_id`` are kept; rows with a null
``doc_id`` link like others, but a group is named by its smallest known id
(null if it has none); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.graph import connected_components
from tierloom.llm.storage import WORD, columns_of, passing_tables, table, text_key, written

# Fixed values of op4's rule.
OP4_WORDS = 4
#: Where no other rule is stated.
WORDS = 5
SIMILARITY = 80  # percent

ROWS = 5
BANDS = 36
#: How often step 2 is made.
BOUND_ROUNDS = 2
#: Shingles that are hashed at once; keeps the arrays in the CPU's cache.
_BLOCK = 1 << 14

_MULTIPLIERS = tuple(np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""
    cut = (text or b"").lower().split()  # both know only ASCII: exactly the rule
    if not cut:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64, len(cut))
    width = min(words, len(cut))
    n = len(each) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * _MULTIPLIERS[k % len(_MULTIPLIERS)] + each[k : k + n]
    return np.unique((out ^ (out >> np.uint64(29))) * _MULTIPLIERS[0])


def _spread(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: places of shingles on the 32-bit circle."""
    return ((hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(32)).astype(np.uint32)


def _rank(places: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit words."""
    x = places ^ (places >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of coordinates per set; all ones for an empty set."""
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, np.uint32)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (not size or size + len(sets[end]) <= _BLOCK):
            size += len(sets[end])
            end += 1
        full = [n for n in range(start, end) if len(sets[n])]
        if full:
            places = _spread(np.concatenate([sets[n] for n in full]))
            firsts = np.cumsum([0, *[len(sets[n]) for n in full[:-1]]])
            for k in range(coordinates):
                out[full, k] = np.minimum.reduceat(_rank(places - np.uint32(k)), firsts)
        start = end
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> list[int]:
    each = signature.reshape(bands, rows)
    return [xxhash.xxh3_64_intdigest(band.tobytes(), seed=n) for n, band in enumerate(each)]


def document_sets(documents: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, key, set_id, n_shingles, bands``, one row per document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t.as_py(), words) for t in part.column("text")]
                signed = signatures(sets, bands * rows)
                hashed = [band_hashes(x, bands, rows) if len(s) else [] for s, x in zip(sets, signed, strict=True)]
                flat = pa.array(np.array([h for each in hashed for h in each], np.uint64).view(np.int64))
                ends = pa.array(np.cumsum([0, *map(len, hashed)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(ends, flat),
                    ],
                    ["doc_id", "key", "set_id", "n_shingles", "bands"],
                )

    rows_in = _identified(documents)
    return rows_in.mapInArrow(sketch, "doc_id long, key long, set_id binary, n_shingles long, bands array<long>")


def _row_key() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("long"), text_key(F.col("text")))


def _identified(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long"), _row_key().alias("key"), F.col("text").cast("binary").alias("text")
    )


def _class_sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, shingles``: the full sets of the wanted classes, as bytes.

    Only texts of class representatives pass; a repeated row passes once.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(t.as_py(), words).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    texts = _identified(documents).select("key", "text").join(wanted.select("node", "key"), "key")
    return texts.dropDuplicates(["key"]).select("node", "text").mapInArrow(sets, "node long, shingles binary")


def _new_pairs(pairs: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """``a, b``: distinct pairs whose sizes allow a link, and not yet tested."""
    fits = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    new = pairs.where(fits).select("a", "b").distinct()
    return new if tested is None else new.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with their sets ``left`` and ``right``."""
    left, right = _named(sets, a="node", left="shingles"), _named(sets, b="node", right="shingles")
    return pairs.join(left, "a").join(right, "b")


def _confirm(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``a, b, link``: whether the full sets of each pair are alike enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), True))
                for x, y in zip(batch.column("left"), batch.column("right"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"]
            )

    both = _with_sets(pairs, sets).select("a", "b", "left", "right").mapInArrow(count, "a long, b long, common long")
    both = both.join(_named(sizes, a="node", n_a="n"), "a").join(_named(sizes, b="node", n_b="n"), "b")
    link = F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("common"))
    return written(both.select("a", "b", link.alias("link")), "near_links")


def _starred(pending: DataFrame) -> DataFrame:
    """The classes of each bucket with its hub, the one that shares most
    buckets (ties: the smallest), but for the hub itself."""
    hub = F.min(F.struct((-F.col("degree")).alias("less"), "n", "node")).alias("hub")
    hubs = pending.groupBy("bucket").agg(hub)
    starred = pending.join(hubs, "bucket").withColumn("component", F.col("node"))
    return starred.select(
        "bucket", "node", "n", "component", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")
    ).where("node != hub")


def _with_least(pending: DataFrame, percent: int) -> DataFrame:
    """The rows with the least size that a class of their bucket can have to
    link with theirs."""
    least = pending.groupBy("bucket").agg(F.min("n").alias("least"))
    allowed = F.ceil(F.lit(percent) * F.col("n") / F.lit(100))
    return pending.join(least, "bucket").withColumn("least", F.greatest("least", allowed))


def _linkable(pending: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows that can link at all: see step 2 of the module's text."""
    shared = _shared_shingles(sets, pending.select("node", "component").distinct())
    shared = shared.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    can = F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("n") + F.col("least") - F.col("shared"))
    return _with_least(pending, percent).join(shared, "node").where(can).drop("least", "shared")


def _met(pending: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, n_a, n_b``: the pairs of step 3 of the module's text."""

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, rest = [], []
            for common, left, right in zip(*(batch.column(c) for c in ("common", "left", "right")), strict=True):
                x, h = (np.frombuffer(each.as_buffer(), np.int64) for each in (left, right))
                some = common.values.to_numpy() if common.is_valid else x[:0]
                inside.append(int(np.isin(x, h, assume_unique=True).sum()))
                rest.append(some[~np.isin(some, h)])
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *rest]))
            ends = pa.array(np.cumsum([0, *map(len, rest)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(inside, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                ["a", "b", "inside", "rest"],
            )

    def needed(left: str, right: str) -> Column:
        return F.ceil(F.lit(percent) * (F.col(left) + F.col(right)) / F.lit(100 + percent))

    stars = _with_least(pending, percent).groupBy("node", "n", "component", "hub", "hub_n").agg(F.min("least").alias("least"))
    stars = stars.join(_named(linked, hub="node", hub_component="component"), "hub", "left")
    stars = stars.withColumn("hub_component", F.coalesce("hub_component", "hub")).withColumn("must", needed("n", "least"))
    stars = written(stars, "near_hubs")
    common = _shared_shingles(sets, pending.select("node", "component").distinct())
    # Rarest first, in one order for all hubs.
    common = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("classes", "shingle"))).alias("common"))
    common = common.withColumn("common", F.col("common.shingle"))
    rest = _with_sets(_named(stars, a="node", b="hub"), sets).join(_named(common, a="node", common="common"), "a", "left")
    rest = rest.select("a", "b", "common", "left", "right").mapInArrow(outside, "a long, b long, inside long, rest array<long>")
    stars = stars.join(_named(rest, node="a", hub="b", inside="inside", rest="rest"), ["node", "hub"])
    stars = written(stars.where(F.col("inside") + F.size("rest") >= F.col("must")), "near_outside")
    # What a class has in common with another, if this is the first shingle
    # that they share: no more than its shingles from here on. Only shingles
    # with enough from there on are spread.
    enough = F.size("rest") + F.col("inside") - F.col("must") + 1
    first = F.slice("rest", 1, F.least(F.size("rest"), enough).cast("int"))
    heads = stars.select("hub", "node", "component", "n", "inside", F.size("rest").alias("all"), F.posexplode(first).alias("before", "shingle"))
    heads = heads.withColumn("shared", (F.col("all") - F.col("before")).cast("long")).drop("all", "before")
    heads = written(heads, "near_heads")

    columns = {"node": "", "n": "n_", "component": "comp_", "inside": "in_", "shared": "out_"}

    def side(frame: DataFrame, end: str, *keys: str) -> DataFrame:
        there = {mark + end: name for name, mark in columns.items() if name in frame.columns}
        return _named(frame, **{k: k for k in keys}, **there)

    most = F.least("in_a", "in_b") + F.least("out_a", "out_b")
    both = _across(heads, heads, side, needed, "hub", "shingle")
    met = both.where(most >= needed("n_a", "n_b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("n_a"), F.col("n_b")
    )

    # Classes with enough in common with the hub alone, one of them not of
    # the hub's component, the other smaller than the hub.
    like = stars.where(F.col("inside") >= F.col("must"))
    strangers = like.where(~F.col("component").eqNullSafe(F.col("hub_component")))
    smaller = like.where(F.col("n") < F.col("hub_n"))
    enough = F.least("in_a", "in_b") >= needed("n_a", "n_b")
    near = _across(strangers, smaller, side, needed, "hub").where(enough).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_a", "n_b"
    )
    return met.unionByName(near)


def _across(left: DataFrame, right: DataFrame, side: Callable, needed: Callable, *keys: str) -> DataFrame:
    """Rows of ``left`` as ``a`` and of ``right`` as ``b`` that agree in the
    ``keys``, are of different components and may have enough in common.

    Components meet first, one row each, so that classes of one component
    are never paired, however many share a key. Two components meet if the
    most that any of their classes have, inside the hub and in shared
    shingles outside it, suffices for the smallest of them.
    """
    common = ("inside", "shared") if "shared" in left.columns else ("inside",)

    def components(rows: DataFrame, end: str) -> DataFrame:
        most = [F.max(c).alias(f"{c}_{end}") for c in common]
        of = rows.groupBy(*keys, "component").agg(F.min("n").alias(f"n_{end}"), *most)
        return of.withColumnRenamed("component", f"comp_{end}")

    order = F.col("comp_a") < F.col("comp_b") if left is right else F.col("comp_a") != F.col("comp_b")
    several = left if left is right else left.select(*keys, "component").unionByName(right.select(*keys, "component"))
    several = several.groupBy(*keys).agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select(*keys)
    of_a = components(left, "a").join(several, list(keys))
    least = [F.least(f"{c}_a", f"{c}_b") for c in common]
    pairs = of_a.join(components(right, "b"), list(keys)).where(order & (sum(least[1:], least[0]) >= needed("n_a", "n_b")))
    pairs = pairs.select(*keys, "comp_a", "comp_b", F.col("n_b").alias("least_b"), *[f"{c}_b" for c in common])
    # Each class meets only components that it can link with by itself.
    own = [F.least(f"{mark}_a", f"{c}_b") for c, mark in zip(common, ("in", "out"))]
    able = side(left, "a", *keys).join(pairs, [*keys, "comp_a"]).where(sum(own[1:], own[0]) >= needed("n_a", "least_b"))
    able = able.drop("least_b", *[f"{c}_b" for c in common])
    return able.join(side(right, "b", *keys), [*keys, "comp_b"])


def _shared_shingles(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingle, classes``: those shingles of the ``nodes`` (``node,
    component``) that one of another component has too, and how many have
    them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, found in enumerate(batch.column("shingles")):
                each = np.frombuffer(found.as_buffer(), np.int64)
                ends = (pa.array(np.full(len(each), batch.column(c)[n].as_py())) for c in ("node", "component"))
                yield pa.RecordBatch.from_arrays([*ends, pa.array(each)], ["node", "component", "shingle"])

    rows = sets.join(nodes, "node").select("node", "component", "shingles")
    rows = rows.mapInArrow(spread, "node long, component long, shingle long")
    mixed = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("classes"), (F.min("component") != F.max("component")).alias("mixed"))
    return rows.join(mixed.where("mixed").select("shingle", "classes"), "shingle").select("node", "shingle", "classes")


def _named(frame: DataFrame, **names: str) -> DataFrame:
    return frame.select(*[F.col(old).alias(new) for new, old in names.items()])


def _mixed(pending: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    spread = pending.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return pending.join(spread.where("low != high").select("bucket"), "bucket")


def near_duplicates(
    documents: DataFrame, words: int = WORDS, percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, key, n_shingles, component, component_id, kept``, a row per
    document; ``component`` is a number of the group (null without words)."""
    docs = written(document_sets(documents, words, bands, rows), "near_documents")
    # A class per distinct set, with a number of its own once it is written.
    classes = docs.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near_classes")

    members = classes.select("node", "n", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(members.join(shared, "bucket"), "near_buckets")
    degree = shared.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    wanted = degree.join(classes.select("node", "key"), "node")
    sets = written(_class_sets(documents, wanted, words), "near_sets")

    pending = shared.join(degree, "node").select("bucket", "node", "n", "degree")
    sizes = classes.select("node", "n")
    starred = written(_starred(pending), "near_stars")
    pairs = starred.select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.col("n").alias("n_a"), F.col("hub_n").alias("n_b")
    )
    tested = _confirm(_new_pairs(pairs, None, percent), sets, sizes, percent)
    linked = written(connected_components(tested.where("link").select("a", "b")), "near_components")
    pending = starred.drop("component").join(linked, "node", "left")
    pending = written(_mixed(pending.withColumn("component", F.coalesce("component", "node"))), "near_pending")
    for _ in range(BOUND_ROUNDS):  # each time fewer classes are left to share a shingle with
        pending = written(_mixed(_linkable(pending, sets, percent)), "near_pending")
    if not pending.isEmpty():
        found = _confirm(_new_pairs(_met(pending, linked, sets, percent), tested, percent), sets, sizes, percent)
        links = found.where("link").select("a", "b").unionByName(_named(linked, a="node", b="component"))
        linked = written(connected_components(links), "near_components")

    named = classes.select("node", "set_id", "doc_id").join(linked, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.select("set_id", "component").join(names, "component").select("set_id", "component", "component_id")
    out = docs.select("doc_id", "key", "set_id", "n_shingles").join(by_set, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "key", "n_shingles", "component", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def near_copy_classes(documents: DataFrame, **rules) -> DataFrame:
    """``key, class``: the group of each document that has near copies, by
    ``line_dedup.document_key``."""
    with passing_tables(documents.sparkSession):
        groups = near_duplicates(documents, **rules).where("component is not null").select("key", "component")
        groups = written(groups, "near_groups", lasting=True)
    several = groups.groupBy("component").agg((F.min("key") != F.max("key")).alias("several")).where("several")
    return groups.join(several, "component").select("key", F.col("component").alias("class"))


def drop_near_duplicates(documents: DataFrame, **rules) -> DataFrame:
    """One document of each group (the smallest known ``doc_id``), and all
    documents without words; all columns as they are. Of rows that are equal
    in ``doc_id`` and text one stays."""
    with passing_tables(documents.sparkSession):
        groups = near_duplicates(documents, **rules)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("first")
        keep = groups.where("component is not null").groupBy("component").agg(first).select("first.key")
        keep = written(keep.unionByName(groups.where("component is null").select("key")).distinct(), "near_kept", lasting=True)
    rows = documents.select(F.struct(*columns_of(documents)).alias("doc"), _row_key().alias("key"))
    rows = rows.join(keep, "key", "left_semi").dropDuplicates(["key"])
    return rows.select(*[F.col("doc").getField(name).alias(name) for name in documents.columns])


OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {OP4_WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {OP4_WORDS - 1}], ' ') for i in range(1, len(w) - {OP4_WORDS - 2})]) END AS s
  FROM words
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {SIMILARITY} * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, p.b FROM reached r JOIN pairs p ON p.a = r.other
)
SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(r.other) AS component_id, min(r.other) = s.doc_id AS kept
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(documents, words=OP4_WORDS).select("doc_id", "n_shingles", "component_id", "kept")
