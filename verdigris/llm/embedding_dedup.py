"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

* A hash rotates a unit vector by three rounds of random signs and a fast Walsh-Hadamard transform, and takes the
  nearest vertex of the cross-polytope: the place and sign of the largest component. A table's bucket joins ``width`` hashes.
* Multiprobe: a vector goes to its ``probes`` nearest buckets of each table, by how far the components chosen instead
  fall below the largest ones. Two vectors are candidates if they share a bucket of a table. With the values
  below, pairs at the threshold of 0.98 share none in 1 of 20,000 trials at most (tests/llm measure it).
* Candidates are verified by their cosine in double precision, inside the bucket, so no pair leaves it.

Equal vectors of one label are a class before anything is compared. A pair that several buckets hold is counted in
the first of them only, so the links are counted without making rows of them; for the components every tile gives a
spanning forest of its links. Buckets are cut into tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, materialize
from ._textvec import mix
from ._tiles import bounds, fixed, runs, tiled

TABLES, WIDTH, PROBES = 8, 2, 4
TILE = 512
_U = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of 2."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, width: int = WIDTH, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """(rows, tables * probes) bucket keys of unit vectors; the keys of one vector differ from each other."""
    rows, d = unit.shape
    size = 1 << max(0, (d - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :d] = unit
    out = np.empty((rows, tables, probes), _U)
    for t in range(tables):
        choice, loss = [], []
        for w in range(width):
            rng = np.random.Generator(np.random.PCG64([seed, t, w, d]))
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size))
            near = np.argpartition(-np.abs(x), min(probes, size - 1), axis=1)[:, : min(probes, size)]
            value = np.take_along_axis(np.abs(x), near, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
            sign = np.take_along_axis(x, near, 1) < 0
            choice.append((near * 2 + sign).astype(_U))
            loss.append((value[:, :1] - value) ** 2)
        options = min(probes, size)
        total, code = loss[0], mix(choice[0] + _U(1))
        for w in range(1, width):
            total = (total[:, :, None] + loss[w][:, None, :]).reshape(rows, -1)
            with np.errstate(over="ignore"):
                code = mix(code[:, :, None] * _U(0x9E3779B97F4A7C15) + choice[w][:, None, :] + _U(1)).reshape(rows, -1)
            keep = np.argsort(total, axis=1, kind="stable")[:, :probes]
            total, code = np.take_along_axis(total, keep, 1), np.take_along_axis(code, keep, 1)
        if options < probes and code.shape[1] < probes:  # very short vectors have fewer buckets
            code = np.concatenate([code, np.repeat(code[:, :1], probes - code.shape[1], 1)], 1)
        with np.errstate(over="ignore"):
            out[:, t, :] = mix(code[:, :probes] * _U(31) + mix(label.astype(np.int64).view(_U) * _U(1009) + _U(t * 131071 + d))[:, None])
    return out.reshape(rows, tables * probes).view(np.int64)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, usable) of an array column: null vectors and those with null or non-finite components, or without length, aren't usable."""
    column = column.cast(pa.large_list(pa.float64()))
    valid = np.asarray(column.is_valid())
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = valid & (bad[offsets[1:]] == bad[offsets[:-1]])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    usable &= some[offsets[1:]] > some[offsets[:-1]]
    return values, offsets, usable


def hashed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, tables: int, width: int, probes: int) -> DataFrame:
    """(vec_id, label, vec, keys): usable rows with a label have the vector as bytes of doubles and their bucket keys, others nulls."""
    source = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"), vectors[label_col].cast("long").alias("label"))
    kind = source.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                values, offsets, usable = vectors_of(batch.column(1))
                usable = usable & np.asarray(batch.column(2).is_valid())
                label = np.asarray(batch.column(2).fill_null(0))
                width_of = np.diff(offsets)
                vec: list = [None] * batch.num_rows
                keys: list = [None] * batch.num_rows
                for d in np.unique(width_of[usable]):
                    rows = np.flatnonzero(usable & (width_of == d))
                    x = values[offsets[rows][:, None] + np.arange(d)] + 0.0  # a negative zero becomes zero
                    scale = np.abs(x).max(1, keepdims=True)
                    unit = x / scale
                    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                    own = buckets(unit, label[rows], tables, width, probes)
                    for r, k, row in zip(rows, own, x, strict=True):
                        vec[r], keys[r] = row.tobytes(), k
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(2), "vec": pa.array(vec, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return source.mapInArrow(run, f"vec_id {kind}, label bigint, vec binary, keys array<bigint>")


def _first_shared(keys: np.ndarray, i: np.ndarray, j: np.ndarray, here: int, probes: int) -> np.ndarray:
    """Which of the pairs (i, j) have no shared key smaller than ``here``; keys of one table stand together."""
    ok = np.ones(len(i), bool)
    for lo in range(0, len(i), 20_000):
        a, b = keys[i[lo : lo + 20_000]], keys[j[lo : lo + 20_000]]
        shared = np.zeros(len(a), bool)
        for c in range(keys.shape[1]):
            table = c - c % probes
            shared |= ((b[:, table : table + probes] == a[:, c : c + 1]).any(1)) & (a[:, c] < here)
        ok[lo : lo + 20_000] = ~shared
    return ok


def links_in_tiles(rows: DataFrame, threshold: float, probes: int) -> DataFrame:
    """From rows (key, t1, t2, cls, vec, keys, m): (a, b, n) with b null: n vectors more that class a links with; with n 0: an edge of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 3):
            edge = bounds(batch, 3)
            key, t1, t2 = (np.asarray(batch.column(i)) for i in range(3))
            cls, m = np.asarray(batch.column(3)), np.asarray(batch.column(6))
            keys = batch.column(5)
            wide = np.asarray(keys.flatten()).reshape(len(cls), -1)
            chunk = np.asarray(batch.column(7))
            raw = batch.column(4)
            a, b, n = [], [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi - lo < 2:
                    continue
                part = raw.slice(lo, hi - lo).to_pylist()
                size = np.array([len(x) for x in part])
                i, j = [], []
                for wide_as in np.unique(size):  # the number of components is hashed into the key: more than one by a collision only
                    rows = np.flatnonzero(size == wide_as)
                    x = np.frombuffer(b"".join([part[r] for r in rows]), np.float64).reshape(len(rows), -1)
                    unit = x / np.abs(x).max(1, keepdims=True)
                    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
                    near = np.triu(unit @ unit.T >= threshold - 1e-9, 1)
                    if t1[lo] != t2[lo]:  # pairs within a chunk are counted in its own tile
                        near &= chunk[lo:hi][rows][:, None] != chunk[lo:hi][rows][None, :]
                    p, q = np.nonzero(near)
                    ok = (unit[p] * unit[q]).sum(1) >= threshold
                    i.append(rows[p[ok]]), j.append(rows[q[ok]])
                i, j = np.concatenate(i), np.concatenate(j)
                ok = _first_shared(wide[lo:hi], i, j, key[lo], probes)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                mine = m[lo:hi]
                got = np.bincount(i, mine[j], hi - lo) + np.bincount(j, mine[i], hi - lo)
                some = np.flatnonzero(got)
                a.append(cls[lo:hi][some]), b.append(np.full(len(some), -1)), n.append(got[some].astype(np.int64))
                root = list(range(hi - lo))

                def top(v: int, root: list[int] = root) -> int:
                    while root[v] != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                # In order of the first member a dense group needs few steps: each row's first link, then what is still apart.
                lead = np.concatenate([[True], i[1:] != i[:-1]])
                order = np.concatenate([np.flatnonzero(np.isin(np.arange(len(j)), np.unique(j, return_index=True)[1])), np.flatnonzero(lead), np.arange(len(i))])
                apart = hi - lo - 1
                for p in order:
                    u, v = top(int(i[p])), top(int(j[p]))
                    if u != v:
                        root[v] = u
                        a.append(cls[lo + i[p] : lo + i[p] + 1]), b.append(cls[lo + j[p] : lo + j[p] + 1]), n.append(np.zeros(1, np.int64))
                        apart -= 1
                        if not apart:
                            break
            none = np.zeros(0, np.int64)
            ends = np.concatenate(b) if b else none
            counts = np.concatenate(n) if n else none
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a) if a else none, "b": pa.array(ends, pa.int64(), mask=counts > 0), "n": counts})

    laid = rows.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").select("key", "t1", "t2", "cls", "vec", "keys", "m", "chunk")
    return laid.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int = TABLES,
    width: int = WIDTH,
    probes: int = PROBES,
) -> DataFrame:
    """Per row of ``vectors``: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and the cosine of their vectors is ``threshold`` or more.
    n_links counts the rows linked directly, equal ones included; component_id is the smallest id reachable. Vectors
    that are null, empty, zero, or hold a null or non-finite component link with nothing: n_links 0, their own
    component. Rows with one id are rows of their own; a null id doesn't name a component unless it has no other.
    An empty table gives no rows; other columns are ignored whatever their names.
    """
    base = materialize(hashed(vectors, id_col, vector_col, label_col, tables, width, probes).withColumn("cls", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))), "hashed")
    usable = base.where("cls is not null")
    classes = materialize(usable.groupBy("cls").agg(F.count("*").alias("m"), F.min("vec_id").alias("first_id"), F.first("vec").alias("vec"), F.first("keys").alias("keys")), "classes")
    rows = classes.select(F.explode(F.array_distinct("keys")).alias("key"), "cls")
    placed = tiled(rows, "key", "cls", TILE)
    chunk = F.pmod(F.xxhash64("cls", F.lit(11)), F.ceil(F.col("_n") / TILE).cast("long")).cast("int")
    found = materialize(links_in_tiles(placed.withColumn("chunk", chunk).join(classes.select("cls", "vec", "keys", "m"), "cls"), threshold, probes), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    groups = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    named = classes.select("cls", "m", "first_id").join(groups, "cls", "left").join(counts, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = materialize(named, "named")
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "comp").select("cls", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = base.select("vec_id", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
