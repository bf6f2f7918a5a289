"""Buckets of a candidate search, cut into tiles of bounded size, and streamed tile by tile through Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize


#: A bucket of about so many rows or more is hot; they are found by counting one member in SHARE, and none is left out for it.
HOT, SHARE = 200_000, 64


def tiled(rows: DataFrame, key: str, member: str, tile: int) -> DataFrame:
    """Rows of the buckets that hold two members at least, with columns t1 and t2.

    ``rows`` has a bucket ``key`` (long) and a ``member`` (long). A bucket of at most ``tile`` rows is one tile
    (0, 0). A larger one is dealt by a hash into chunks of about that many; every row then goes to the tiles of its
    chunk with each chunk, so that each pair of rows meets in a tile, and no task ever holds more than a tile. Rows that
    come more than once are kept once, in the tiles that their number asks for.

    Rows are shuffled once, by their key. Hot buckets, of which there are at most as many as HOT goes into the rows, stay
    out of that shuffle: their sizes are summed where their rows are, and sent to all tasks.
    """
    some = rows.where(F.pmod(F.xxhash64(member, F.lit(13)), F.lit(SHARE)) == 0)
    hot = materialize(some.groupBy(key).count().where(F.col("count") * SHARE > HOT).select(key), "hot-keys")
    none = hot.isEmpty()
    each = Window.partitionBy(key)
    cold = rows if none else rows.join(F.broadcast(hot), key, "left_anti")
    kept = cold.withColumn("_n", F.count("*").over(each)).where("_n > 1").dropDuplicates([key, member])
    if not none:
        many = rows.join(F.broadcast(hot), key)
        sizes = many.groupBy(key).agg(F.count("*").alias("_n"))
        kept = kept.unionByName(many.join(F.broadcast(sizes), key).dropDuplicates([key, member]))
    chunks = F.ceil(F.col("_n") / tile).cast("int")
    mine = F.pmod(F.xxhash64(member, F.lit(11)), chunks.cast("long")).cast("int")
    kept = kept.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return kept.withColumn("t1", F.least("_mine", "_other")).withColumn("t2", F.greatest("_mine", "_other")).drop("_mine", "_other")


def runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that rows with equal values in the first ``columns`` (long or int) columns, which come together, stay together.

    Each batch that is yielded holds one or more whole tiles.
    """
    held: list[pa.RecordBatch] = []

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(columns)], 1)

    for batch in batches:
        if not batch.num_rows:
            continue
        k = keys(batch)
        change = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held and (keys(held[-1].slice(held[-1].num_rows - 1, 1))[0] != k[0]).any():
            yield joined(held)
            held = []
        if len(change):
            last = int(change[-1])
            yield joined([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    table = pa.Table.from_batches(parts).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=table.column_names)


def bounds(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Starts of the tiles of a batch of whole tiles, with the number of rows last."""
    k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(columns)], 1)
    return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])


def fixed(column: pa.Array, width: int, kind: type = np.uint8) -> np.ndarray:
    """A binary column of values of ``width`` bytes as a matrix."""
    if len(column) == 0:
        return np.zeros((0, width // np.dtype(kind).itemsize), kind)
    column = column.cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * width]
    return raw.reshape(len(column), width).view(kind)
