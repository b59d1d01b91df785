"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document leaks a benchmark item if some window of the item occurs in it
with at most ``ERROR`` edits per character. (An item up to ``WINDOW``
characters is one window; a longer one has a window every half, and one at
its end.) Case and runs of white space make no difference. Where so few
characters have no q-gram to spare for that many edits, a short item has fewer
(down to none: it must occur as it is); an item shorter than a q-gram is leaked
by a text that is just this item.

If a window of m characters is matched with at most k edits, the two share
at least T = m - q + 1 - kq q-grams, and all of them lie on diagonals
(document place minus window place) that are at most k apart. So, in three
steps, each exact in what it throws away:

1. Places of the document whose q-gram is in the benchmark are marked; only
   stretches dense enough to hold T of them go on.
2. Marked places are counted per window and diagonal band. Bands are 2k wide
   and start every k, so some band holds every diagonal of a match. Bands
   with fewer than T places are dropped. A q-gram that a window repeats (a
   ruler of dashes) stands for a run of places there, whose diagonals meet a
   run of bands: bands are counted once per run, not once per place. Texts
   that hit very often are counted stretch by stretch, with an overlap that
   no band outreaches, so the memory has a bound.
3. What is left is aligned within its band, and kept if it needs at most k
   edits.

The benchmark is a stated query set. It is cut into blocks of about
``BLOCK_CHARS`` characters, so that the index of a block has a bounded size
(some 60 MB at most) however many items there are. A scan of the documents
normalises and hashes each text once and searches ``SCAN_BLOCKS`` blocks; a
larger benchmark takes more scans, each written before the next begins.
Nothing is shuffled: a document is searched where it is read, long ones piece
by piece with an overlap.

Defined cases: null or blank texts leak nothing and are not leaked; items
of any length are searched, but ``decontaminate`` drops no document for items
under ``EVIDENCE_CHARS`` characters; repeated rows each get their rows; equal items are each found;
null ids are kept as they are; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tierloom.llm.storage import columns_of, table, text_key, written

Q = 10
WINDOW = 100
ERROR = 0.07
#: Shorter items are found, but are not reason enough to drop a document.
EVIDENCE_CHARS = 40
BLOCK_CHARS = 200_000
SCAN_BLOCKS = 4
#: Pairs of place and band that are counted at once.
MAX_PAIRS = 1 << 21
#: Characters that are searched at once.
PIECE_CHARS = 1 << 20

_GAP = "\x00"  # between documents; no q-gram of an item has it


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with runs of blanks as one space, and the
    place of each in the text. Gaps stay."""
    lowered = text.replace("İ", "i").lower()  # the one character that lower() makes longer
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = ((codes <= 32) & (codes > 0)) | (codes == 0xA0)
    kept = np.ones(len(codes), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    places = np.flatnonzero(kept)
    return np.where(blank[kept], np.uint32(32), codes[kept]), places


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``Q`` code points from each place on."""
    n = len(codes) - Q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)

    def paired(hashes: np.ndarray, width: int) -> np.ndarray:
        return (hashes[:-width] ^ (hashes[:-width] >> np.uint64(29))) * step + hashes[width:]

    two = paired(codes.astype(np.uint64), 1)
    eight = paired(paired(two, 2), 4)
    out = (eight[:n] ^ (eight[:n] >> np.uint64(31))) * step + two[8 : 8 + n]
    return (out ^ (out >> np.uint64(32))) * step


def edit_budget(m: int) -> int:
    """Edits for a window of m characters, such that a match still shares a
    q-gram with it."""
    return max(0, min(int(m * ERROR), (m - Q) // Q))


class BenchmarkIndex:
    """The q-grams of a block of items, by window; equal windows are one."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.text, self.whole = [], [], {}
        known: dict[bytes, int] = {}
        for item, text in items:
            codes, _ = normalised(text.strip())
            if len(codes) < Q:
                if len(codes):
                    self.whole.setdefault(codes.tobytes(), []).append(item)
                continue
            m = min(len(codes), WINDOW)
            for start in sorted({*range(0, len(codes) - m + 1, max(1, m // 2)), len(codes) - m}):
                part = codes[start : start + m]
                window = known.setdefault(part.tobytes(), len(self.text))
                if window == len(self.text):
                    self.text.append(part)
                    self.items.append(set())
                self.items[window].add(item)
        self.sizes = np.array([len(x) for x in self.text], np.int64)
        self.edits = np.array([edit_budget(len(x)) for x in self.text], np.int64)
        self.least = np.maximum(1, self.sizes - Q + 1 - self.edits * Q)
        hashed = [gram_hashes(x) for x in self.text]
        grams = np.concatenate([np.empty(0, np.uint64), *hashed])
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in hashed)]).astype(np.int64)
        window = np.repeat(np.arange(len(hashed)), [len(x) for x in hashed])
        order = np.lexsort((at, window, grams))
        grams, at, window = grams[order], at[order], window[order]
        # A run: places of a q-gram in a window, at most k apart, so that its
        # diagonals leave out no band.
        new = np.ones(len(grams), bool)
        step = np.maximum(self.edits[window], 1)[1:]
        new[1:] = (grams[1:] != grams[:-1]) | (window[1:] != window[:-1]) | (at[1:] - at[:-1] > step)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(grams)][: len(first)] - 1
        self.grams, self.window, self.low, self.high = grams[first], window[first], at[first], at[last]
        bits = max(16, int(len(self.grams) * 64).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.grams >> self.shift] = True

    def search(self, codes: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(window, start, end, edits)`` of the matches in a text with these
        hashes of its q-grams."""
        if not len(self.grams):
            return []
        hits = np.flatnonzero(self.maybe[hashes >> self.shift])
        first = np.searchsorted(self.grams, hashes[hits])
        real = self.grams[np.minimum(first, len(self.grams) - 1)] == hashes[hits]
        hits, first = hits[real], first[real]
        # Step 1: T hits within the length of a match, counted from each hit.
        least, span = int(self.least.min()), int((self.sizes + self.edits).max())
        if len(hits) < least:
            return []
        dense = hits[least - 1 :] - hits[: len(hits) - least + 1] < span
        marks = np.zeros(len(hits) + 1, np.int64)
        starts = np.flatnonzero(dense)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + least, -1)
        near = np.cumsum(marks[:-1]) > 0
        hits, first = hits[near], first[near]
        last = np.searchsorted(self.grams, hashes[hits], "right")
        window, band = self._bands(hits, first, last)
        # Step 3, for windows of one size at a time.
        found = []
        for m in np.unique(self.sizes[window]):
            of_size = np.flatnonzero(self.sizes[window] == m)
            k = edit_budget(int(m))
            for some in np.array_split(of_size, -(-len(of_size) // 2048)):
                patterns = np.stack([self.text[w] for w in window[some]])
                starts = band[some] * max(k, 1) - k
                ends, edits = banded_alignment(patterns, codes, starts, k)
                ok = edits <= k
                for w, end, cost in zip(window[some][ok], ends[ok], edits[ok], strict=True):
                    found.append((int(w), max(0, int(end) - int(m)), int(end), int(cost)))
        return found

    def _bands(self, hits: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step 2: ``window, band`` with enough hits. ``first`` to ``last`` are
        the runs of each hit's q-gram."""
        runs = np.r_[0, np.cumsum(self._widths()[0])]
        pairs = runs[last] - runs[first]  # an upper bound of pairs of each hit
        # No band reaches over more places than this.
        reach = int(self.sizes.max()) + 4 * max(1, int(self.edits.max()))
        found, todo = [], [(0, len(hits))]
        while todo:
            a, b = todo.pop()
            if b - a > 1 and pairs[a:b].sum() > MAX_PAIRS and hits[b - 1] - hits[a] > 3 * reach:
                middle = (hits[a] + hits[b - 1]) // 2
                cut = np.searchsorted(hits[a:b], [middle - reach, middle + reach]) + a
                todo += [(a, int(cut[1])), (int(cut[0]), b)]
            else:
                found.append(self._counted(hits[a:b], first[a:b], last[a:b]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate([np.stack(x, axis=1) for x in found]), axis=0)
        return both[:, 0], both[:, 1]

    def _widths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bands that a hit of each run meets, at most, and the run's k."""
        k = np.maximum(self.edits[self.window], 1)
        return (self.high - self.low) // k + 3, k

    def _counted(self, hits: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = last - first
        run = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, k = np.repeat(hits, n), self._widths()[1][run]
        low, high = (place - self.high[run]) // k - 1, (place - self.low[run]) // k
        n = high - low + 1
        band = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()) + WINDOW + 2  # at least 1
        window, place = np.repeat(self.window[run], n), np.repeat(place, n)
        if not len(place):
            return window, band
        base = int(place.min())
        wide = int(place.max()) + 3 * WINDOW
        far = int(place.max()) - base + 1
        keys = np.unique((window * wide + band) * far + (place - base))
        keys, counts = np.unique(keys // far, return_counts=True)
        window, band = keys // wide, keys % wide - WINDOW - 2
        good = counts >= self.least[window]
        return window[good], band[good]


def banded_alignment(patterns: np.ndarray, codes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern, the end and the edits of its best match in ``codes``
    that stays within the diagonals ``starts`` to ``starts + 4k``.

    Row r holds the costs of the first r pattern characters, one column per
    diagonal; a match may start and end on any of them, but not go over the
    gap between two documents.
    """
    count, m = patterns.shape
    band = 4 * max(k, 1) + 1
    at = starts[:, None] + np.arange(m + band)[None, :]
    inside = (at >= 0) & (at < len(codes))
    text = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
    # What a character of the text costs that the pattern lacks.
    gap = text == ord(_GAP)
    price = 1 + 4 * m * gap.astype(np.int32)
    extra = np.cumsum(price, axis=1, dtype=np.int32) if gap.any() else np.broadcast_to(np.arange(m + band, dtype=np.int32), text.shape)
    cost = np.zeros((count, band), np.int32)
    over = np.full((count, 1), m + 1, np.int32)
    for r in range(m):
        unlike = (text[:, r : r + band] != patterns[:, r : r + 1]) * price[:, r : r + band]
        skipped = np.concatenate([cost[:, 1:], over], axis=1) + 1
        cost = np.minimum(cost + unlike, skipped)
        # Extra characters of the text: along the row, one edit a column.
        cost = np.minimum.accumulate(cost - extra[:, r : r + band], axis=1) + extra[:, r : r + band]
    best = cost.argmin(axis=1)
    return starts + m + best, cost[np.arange(count), best]


def _pieces(texts: list[str | None]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts joined up to ``PIECE_CHARS``, long ones cut with an overlap;
    with ``(place, text number, place in the text)`` of each part."""
    overlap = 8 * WINDOW
    parts, at, size = [], [], 0
    for n, text in enumerate(texts):
        text = (text or "").replace(_GAP, " ")
        for start in range(0, max(1, len(text) - overlap), PIECE_CHARS - overlap):
            part = text[start : start + PIECE_CHARS]
            if size and size + len(part) > PIECE_CHARS:
                yield _GAP.join(parts), at
                parts, at, size = [], [], 0
            at.append((size, n, start))
            parts.append(part)
            size += len(part) + 1
    if parts:
        yield _GAP.join(parts), at


def search_texts(indexes: list[BenchmarkIndex], texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """``(text number, item): (start, end, edits)``: the stretch from the
    first to the last match of an item in a text, and the fewest edits."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def add(key: tuple[int, int], start: int, end: int, edits: int) -> None:
        was = found.get(key, (start, end, edits))
        found[key] = (min(start, was[0]), max(end, was[1]), min(edits, was[2]))

    for joined, at in _pieces(texts):
        codes, places = normalised(joined)
        hashes = gram_hashes(codes)
        begins = np.array([a for a, _, _ in at])
        for index in indexes:
            for window, start, end, edits in index.search(codes, hashes):
                start, end = int(places[min(start, len(places) - 1)]), int(places[min(end, len(places)) - 1]) + 1
                part = int(np.searchsorted(begins, (start + end) // 2, "right")) - 1
                begin, n, offset = at[part]
                for item in index.items[window]:
                    add((n, item), max(start - begin, 0) + offset, end - begin + offset, edits)
    if whole := {text: items for index in indexes for text, items in index.whole.items()}:
        for n, text in enumerate(texts):
            for item in whole.get(normalised((text or "").strip())[0].tobytes(), ()):
                add((n, item), 0, len(text), 0)
    return found


def _blocks(benchmark: DataFrame) -> Iterator[list[list[tuple[object, str]]]]:
    """The benchmark in groups of ``SCAN_BLOCKS`` blocks of bounded size, one
    group on the driver at a time. Equal texts are in one block."""
    items = benchmark.where(F.length("text") > 0).select("item_id", "text")
    total = items.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    blocks = total // BLOCK_CHARS + 1 if total else 0
    number = F.pmod(text_key(F.col("text")), F.lit(max(blocks, 1)))
    for first in range(0, blocks, SCAN_BLOCKS):
        group: list[list[tuple[object, str]]] = [[] for _ in range(min(SCAN_BLOCKS, blocks - first))]
        for row in items.where(number.between(first, first + len(group) - 1)).withColumn("block", number).collect():
            group[row["block"] - first].append((row["item_id"], row["text"]))
        yield group


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, key, item_id, start, end, edits``: one row per document and
    item that it leaks. ``key`` tells texts of one ``doc_id`` apart."""
    spark = documents.sparkSession
    schema = StructType([documents.schema["doc_id"]]).add("key", "long")
    schema = StructType([*schema.fields, benchmark.schema["item_id"]]).add("start", "long").add("end", "long").add("edits", "long")
    rows = documents.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def searched(group: list[list[tuple[object, str]]]) -> DataFrame:
        names = [item for block in group for item, _ in block]
        numbers = iter(range(len(names)))
        shared = spark.sparkContext.broadcast(([[(next(numbers), text) for _, text in block] for block in group], names))
        built: list[BenchmarkIndex] = []

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, items = shared.value
            if not built:
                built.extend(map(BenchmarkIndex, blocks))
            for batch in batches:
                found = search_texts(built, batch.column("text").to_pylist())
                which = pa.array([n for n, _ in found], pa.int64())
                numbers = [pa.array([m[k] for m in found.values()], pa.int64()) for k in range(3)]
                ids = pa.array([items[item] for _, item in found], item_type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(which), batch.column("key").take(which), ids, *numbers], names=schema.names
                )

        return rows.mapInArrow(search, schema)

    parts = []
    for group in _blocks(benchmark):
        if parts:  # one scan after the other, each with its own blocks
            parts[-1] = written(parts[-1], "leaks")
        parts.append(searched(group))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item of ``EVIDENCE_CHARS`` or more, all
    columns as they are."""
    evident = F.length(F.trim(F.regexp_replace("text", r"[\x01-\x20\xA0]+", " "))) >= EVIDENCE_CHARS
    leaked = find_leaks(documents, benchmark.where(evident)).select(F.struct("doc_id", "key").alias("leak")).distinct()
    rows = documents.select(F.struct(*columns_of(documents)).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("leak.doc_id")) & (text_key(F.col("doc.text")) == F.col("leak.key"))
    rows = rows.join(leaked, same, "left_anti")
    return rows.select(*[F.col("doc").getField(name).alias(name) for name in documents.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(documents, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "end", "edits")
