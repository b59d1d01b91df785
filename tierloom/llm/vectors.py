"""Vectors of a table in shards, and searches of query blocks in them.

A table of vectors is dealt to shards by row, so that equal vectors, labels
and ids spread alike. What a shard holds is packed into rows of many vectors
each. Queries are dealt to blocks of bounded size. A search runs one task's
work per block and shard (``cells``): both have a size bound, whatever the
table's size, and either can be read again when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tierloom.llm.storage import written

#: Bytes of the vectors in a shard, and of the queries in a block, at most.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
#: Shards that even a small table has, so that its work spreads.
MIN_SHARDS = 32

_NUMPY = {"float": np.float32, "double": np.float64, "int": np.int32}


def valid(vector: Column) -> Column:
    """No null, nor a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows whose ``vec`` has the most frequent length (ties: the
    longest); only vectors of one length have an inner product."""
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("size > 0")
    best = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("vec") == (best["size"] if best else 0))


def sharded(rows: DataFrame, name: str) -> tuple[DataFrame, int, int, int]:
    """``rows`` with ``row`` (a number of its own) and ``shard``, written; the
    number of rows, of shards, and the vectors' length."""
    rows = written(of_one_length(rows).withColumn("row", F.monotonically_increasing_id()), name)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("size")).first()
    n, size = total["n"], total["size"] or 0
    shards = max(MIN_SHARDS, -(-n * size * 4 // SHARD_BYTES))
    return rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), n, shards, size


def block_of(queries: int, size: int) -> tuple[Column, int]:
    """A block number for each query row, and how many blocks there are."""
    blocks = max(1, -(-queries * size * 8 // BLOCK_BYTES))
    return F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int"), blocks


def cells(queries: DataFrame, pieces: DataFrame, shards: range, blocks: int, search: Callable, schema: str) -> DataFrame:
    """``search(queries, pieces)`` for each block and each of the ``shards``.

    ``queries`` has ``block``, ``pieces`` has ``shard``. A query row goes to
    every shard and a piece to every block, and no further: rows meet in
    blocks, never one by one.
    """
    left = queries.withColumn("shard", F.explode(F.sequence(F.lit(shards.start), F.lit(shards.stop - 1))))
    right = pieces.where(F.col("shard").between(shards.start, shards.stop - 1))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return search(left, right) if left.num_rows and right.num_rows else out.empty_table()

    out = to_arrow_schema(StructType.fromDDL(schema))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(cell, schema)


def matrix_of(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of lists as a matrix, a row per list."""
    flat = column.combine_chunks().flatten() if column.num_chunks else pa.array([])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), size)


def ids_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column with nulls as 0, and where nulls are."""
    unknown = column.is_null().to_numpy().astype(bool)
    return column.fill_null(0).to_numpy().astype(np.int64), unknown


def unpacked(column: Iterable[pa.Scalar], kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def ranked_within(group: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of group, then of the ``order`` arrays, and the
    place of each in its group."""
    by = np.lexsort((*reversed(order), group))
    sorted_group = group[by]
    first = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(by) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(by)])
    return by, np.arange(len(by)) - np.repeat(first, sizes)


def numpy_type(df: DataFrame) -> type:
    return _NUMPY[df.schema["vec"].dataType.elementType.simpleString()]
