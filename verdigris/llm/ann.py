"""Approximate nearest neighbours by largest inner product: balanced posting lists behind a graph of centroids.

* Index: rows go to the list of their nearest centroid, and boundary rows to other lists whose centroid is not much
  farther (CLOSURE times the nearest distance), at most REPLICAS of them. Largest inner products become nearest
  points by one more component that gives every row the same norm.
* Fit: centroids by balanced k-means on a sample of the rows whose ids hash lowest, in one task of an executor: an eighth
  of the table, at least LEAST_SAMPLE and at most SAMPLE rows, or fewer that hold some SAMPLE_CELLS components. Only the
  centroids and one row for each list come to the driver. Over FLAT centroids are found in two steps, groups first and
  then the centroids of each group. Lists hold about LIST_ROWS rows each, until there are SAMPLE / 16 of them.
  A list that holds many rows all the same, such as one of copies, is cut into parts of PART_ROWS by a hash, and a
  query that selects the list goes to all of them; so no task has more than a part.
* Search: a best-first search in a neighbour graph of the centroids finds a query's WIDTH nearest ones, and looks at few
  of the others; it selects the lists
  whose distance is within a ratio of the nearest's (or of a typical nearest one, if that is larger), and as many of
  the nearest as hold enough different rows. The ratio is the least that finds RECALL of the true neighbours of
  sampled queries in the sample, by brute force. Rows of the lists are scored exactly, in double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from .embedding_dedup import vectors_of

SAMPLE, LEAST_SAMPLE = 131_072, 16_384
SAMPLE_CELLS = SAMPLE * 128
#: Cells of a matrix of rows by centroids or by sampled rows that is held at once.
CELLS = 1 << 20
#: Rows of a list, about; one list for fewer rows than two lists hold.
LIST_ROWS = 256
FLAT = 512
#: Centroids that the graph search of a query ends with; it stops when the nearest one left to expand is farther than all of them.
WIDTH = 48
REPLICAS, CLOSURE = 4, 1.25
#: Lists whose hits say what the hits of a query's other lists must reach.
FIRST = 4
PART_ROWS = 8192
QUERY_ROWS = 4096
DEGREE = 24
RECALL = 0.97


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


@dataclass
class Centroids:
    """Points and their neighbour graph; ``top`` is the largest norm of a row. ``ratio`` prunes the lists of a query, whose nearest distance counts as ``floor`` (squared) at least; it looks into lists of ``least`` rows in all."""

    points: np.ndarray
    graph: np.ndarray
    top: float
    ratio: float = 1.0
    floor: float = 0.0
    sizes: np.ndarray | None = None
    least: int = 0
    width: int = WIDTH
    #: Where searches begin: centroids spread over the space.
    entries: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, top: float, seed: int = 17) -> "Centroids":
        rows = lift(x, top)
        lists = max(1, min(lists, len(rows)))
        groups = int(np.sqrt(lists)) if lists > FLAT else 1
        if groups == 1:
            points = balanced(rows, lists, seed)
        else:
            heads = balanced(rows, groups, seed)
            home = nearest(rows, heads)
            share = np.bincount(home, minlength=groups) * lists / len(rows)
            points = np.concatenate([balanced(rows[home == g], max(1, round(share[g])), seed + 1 + g) for g in range(groups) if share[g] > 0])
        lists = len(points)
        degree = min(DEGREE, lists - 1)
        own = np.arange(lists)[:, None]
        graph = np.empty((lists, degree), np.int32)
        step = max(1, CELLS // lists)
        for lo in range(0, lists, step):
            far = squared(points[lo : lo + step], points)
            far[np.arange(len(far)), np.arange(lo, lo + len(far))] = np.inf
            near = np.argpartition(far, degree - 1, axis=1)[:, :degree] if degree else np.empty((len(far), 0), np.int64)
            graph[lo : lo + step] = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(far, near, 1))), 1)
        for jump in (1, 1 + max(1, lists // 2)):  # a ring keeps the graph connected
            to = (own + jump) % lists
            graph = np.concatenate([graph, np.where((graph == to).any(1, keepdims=True), own, to).astype(np.int32)], 1)  # its own number where it is a neighbour already
        entries = np.unique(nearest(balanced(points, min(lists, 16), seed), points))
        return cls(points, graph, top, entries=entries)

    def search(self, rows: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of each row's ``wide`` nearest centroids as the graph search finds them, nearest first.

        Infinite distances stand behind them if the search met fewer.
        """
        lists = len(self.points)
        wide = min(wide, lists)
        norm = (self.points * self.points).sum(1)
        if wide < lists:  # a byte is held for each of a row's centroids, and the points that a step visits
            at_once = max(1, wide // WIDTH)
            step = max(1, 4 * CELLS // max(lists, at_once * self.graph.size // lists * rows.shape[1]))
            found = [self._walk(rows[lo : lo + step], wide, norm, at_once) for lo in range(0, len(rows), step)]
        else:  # all are wanted, so there is nothing to search
            step = max(1, CELLS // lists)
            found = [self._all(rows[lo : lo + step]) for lo in range(0, len(rows), step)]
        self.visited = sum(f[2] for f in found) / max(1, len(rows))
        if not found:
            return np.zeros((0, wide), np.int64), np.zeros((0, wide))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, rows: np.ndarray, wide: int, norm: np.ndarray, at_once: int) -> tuple[np.ndarray, np.ndarray, int]:
        """``search`` of a block of rows, and how many centroids it looked at. Of the centroids met only the ``wide`` nearest are kept; a step expands the ``at_once`` nearest of them."""
        n = len(rows)
        own = (rows * rows).sum(1)
        met = np.zeros((n, len(self.points)), bool)
        kept, far, todo = np.zeros((n, wide), np.int32), np.full((n, wide), np.inf), np.zeros((n, wide), bool)

        def visit(r: np.ndarray, c: np.ndarray) -> None:
            fresh = ~met[r[:, None], c]
            met[r[:, None], c] = True
            if at_once == 1:
                d = np.where(fresh, np.maximum(own[r][:, None] + norm[c] - 2 * np.einsum("nd,ncd->nc", rows[r], self.points[c]), 0.0), np.inf)
            else:
                order = np.argsort(c, axis=1, kind="stable")
                c, fresh = np.take_along_axis(c, order, 1), np.take_along_axis(fresh, order, 1)
                fresh[:, 1:] &= c[:, 1:] != c[:, :-1]  # neighbours of two of the points expanded
                i, j = np.nonzero(fresh)
                d = np.full(c.shape, np.inf)
                d[i, j] = np.maximum(own[r[i]] + norm[c[i, j]] - 2 * np.einsum("nd,nd->n", rows[r[i]], self.points[c[i, j]]), 0.0)
            d = np.concatenate([far[r], d], 1)
            pick = np.argpartition(d, wide - 1, axis=1)[:, :wide]
            kept[r] = np.take_along_axis(np.concatenate([kept[r], c], 1), pick, 1)
            far[r] = np.take_along_axis(d, pick, 1)
            todo[r] = np.take_along_axis(np.concatenate([todo[r], fresh], 1), pick, 1)

        active = np.arange(n)
        visit(active, np.repeat(self.entries[None, :].astype(np.int32), n, 0))
        while len(active):
            left = np.where(todo[active], far[active], np.inf)
            best = left.argmin(1)[:, None] if at_once == 1 else np.argpartition(left, at_once - 1, axis=1)[:, :at_once]
            go = np.isfinite(np.take_along_axis(left, best, 1))  # what is no longer to do leads to points that are met
            some = go.any(1)
            active, best = active[some], np.where(go, best, left.argmin(1)[:, None])[some]
            if len(active):
                todo[active[:, None], best] = False
                visit(active, self.graph[kept[active[:, None], best]].reshape(len(active), -1))
        order = np.lexsort((kept, far))
        return np.take_along_axis(kept, order, 1).astype(np.int64), np.take_along_axis(far, order, 1), int(met.sum())

    def _all(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        far = squared(rows, self.points)
        order = np.argsort(far, axis=1, kind="stable")
        return order, np.take_along_axis(far, order, 1), far.size

    def calibrate(self, x: np.ndarray, k: int, recall: float = RECALL, queries: int = 256) -> None:
        """Sets the ratio by brute force in the sample."""
        if len(self.points) == 1:
            return
        asked = x[:: max(1, len(x) // queries)][:queries]
        mine = np.arange(len(x))[:: max(1, len(x) // queries)][:queries]
        near = np.empty((len(asked), min(k, len(x) - 1)), np.int64)
        step = max(1, CELLS // len(x))
        for lo in range(0, len(asked), step):
            score = asked[lo : lo + step] @ x.T
            score[np.arange(len(score)), mine[lo : lo + step]] = -np.inf
            near[lo : lo + step] = np.argsort(-score, axis=1, kind="stable")[:, : near.shape[1]]
        rows = np.unique(near)
        place = self.assign(x[rows])  # of the rows that are true neighbours
        near = np.searchsorted(rows, near)
        self.width = WIDTH
        while True:  # a width that reaches the lists of all these neighbours
            order, far = self.search(self.aim(asked), self.width)
            near_lists = [set(o[np.isfinite(f)].tolist()) for o, f in zip(order, far, strict=True)]
            met = np.mean([bool(near_lists[i] & set(place[r][place[r] >= 0].tolist())) for i in range(len(asked)) for r in near[i]])
            if met >= recall + 0.02 or self.width >= len(self.points):
                break
            self.width *= 2
        self.floor = float(np.median(far[:, 0]))
        ratio = np.sqrt(far / np.maximum(far[:, :1], max(self.floor, 1e-12)))
        need = np.full(near.shape, np.inf)  # the ratio that the query needs for this neighbour
        for i in range(len(asked)):
            on = (place[near[i]][:, :, None] == order[i][None, None, :]).any(1)
            on &= np.isfinite(far[i])[None, :]
            need[i] = np.where(on.any(1), ratio[i][on.argmax(1)], np.inf)
        need = np.where(np.isfinite(need), need, ratio[np.isfinite(ratio)].max())
        self.ratio = float(np.quantile(need, recall)) + 1e-9

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries as points: scaled to the norm of the rows, their last component 0."""
        norm = np.sqrt((q * q).sum(1, keepdims=True))
        return np.concatenate([q / norm * self.top, np.zeros((len(q), 1))], 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """(rows, REPLICAS) lists of each row, -1 for none."""
        rows = lift(x, self.top)
        order, far = self.search(rows, 2 * REPLICAS)
        order, far = order[:, :REPLICAS], far[:, :REPLICAS]
        keep = far <= far[:, :1] * CLOSURE**2 + 1e-12
        return np.where(keep, order, -1)

    def select(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(lists that each query looks into, which of them it looks into first)"""
        order, far = self.search(self.aim(q), self.width)
        lists, first = self._pruned(order, far)
        few = np.flatnonzero(np.where(np.isfinite(far), self.sizes[order], 0).sum(1) < self.least)
        if len(few):  # the lists found hold too few rows, so all are looked at
            for at, *more in zip(few, *self._pruned(*self.search(self.aim(q[few]), len(self.points))), strict=True):
                lists[at], first[at] = more
        return lists, first

    def _pruned(self, order: np.ndarray, far: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        held = np.where(np.isfinite(far), self.sizes[order], 0)
        keep = far <= np.maximum(far[:, :1], self.floor) * self.ratio**2 + 1e-12
        before = np.cumsum(held, axis=1) - held
        keep |= before < self.least
        keep &= np.isfinite(far)
        first = (before < self.least) | (np.arange(order.shape[1])[None, :] < FIRST)
        return [o[k] for o, k in zip(order, keep, strict=True)], [f[k] for f, k in zip(first, keep, strict=True)]


def nearest(rows: np.ndarray, points: np.ndarray, price: np.ndarray | float = 0.0) -> np.ndarray:
    """The number of each row's nearest point, in blocks."""
    step = max(1, CELLS // max(1, len(points)))
    return np.concatenate([(squared(rows[lo : lo + step], points) + price).argmin(1) for lo in range(0, len(rows), step)] or [np.zeros(0, np.int64)])


def balanced(rows: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids by k-means in which a list above its share becomes dearer, so that the lists even out."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lists = min(lists, len(rows))
    points = rows[rng.choice(len(rows), lists, replace=False)].copy()
    spread = squared(rows[:512], points).min(1).mean() if lists > 1 else 1.0
    price = np.zeros(lists)
    for _ in range(15):
        home = nearest(rows, points, price)
        size = np.bincount(home, minlength=lists)
        price = 0.6 * price + 0.1 * spread * np.clip(size * lists / len(rows) - 1, -1, 3)
        total = np.zeros_like(points)
        np.add.at(total, home, rows)
        points = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], points)
    return points


def lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(1, keepdims=True), 0.0))], 1)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, d, vec) of the rows that take part; the vector as bytes of doubles, or of floats where the table holds floats."""
    kind = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    source = vectors.where(vectors[id_col].isNotNull()).select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                values, offsets, usable = vectors_of(batch.column(1))
                rows = np.flatnonzero(usable)
                vec = [(values[offsets[r] : offsets[r + 1]] + 0.0).astype(kind).tobytes() for r in rows]
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0).take(pa.array(rows)), "d": np.diff(offsets)[rows].astype(np.int32), "vec": pa.array(vec, pa.binary())})

    return source.mapInArrow(run, f"vec_id {source.schema['vec_id'].dataType.simpleString()}, d int, vec binary")


def _matrix(column: list[bytes], d: int) -> np.ndarray:
    """Vectors of ``d`` components each in double precision."""
    return np.frombuffer(b"".join(column), np.float32 if len(column[0]) == 4 * d else np.float64).reshape(len(column), d).astype(np.float64)


def _route(rows: DataFrame, shared, queries: bool) -> DataFrame:
    """Adds the lists that a vector is put into, or that a query looks into, and how many of these it looks into first."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                d = np.asarray(batch.column(1))
                lists = [np.zeros(1, np.int32)] * len(d)
                early = np.ones(len(d), np.int32)
                for width in np.unique(d):
                    if width not in fitted:  # no row of this width was in the sample: one list holds them
                        continue
                    mine = np.flatnonzero(d == width)
                    x = _matrix(batch.column(2).take(pa.array(mine)).to_pylist(), int(width))
                    chosen, first = fitted[width].select(x) if queries else ([p[p >= 0] for p in fitted[width].assign(x)], None)
                    for i, at in enumerate(mine):
                        lists[at] = chosen[i].astype(np.int32)
                        early[at] = first[i].sum() if first else 0
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "d": batch.column(1), "vec": batch.column(2), "lists": pa.array(lists, pa.list_(pa.int32())), "early": early})

    return rows.mapInArrow(run, f"vec_id {kind}, d int, vec binary, lists array<int>, early int")


def _distinct(rows: DataFrame) -> DataFrame:
    """``rows`` of a stored table without repeats; vectors are shuffled only where their id is repeated."""
    more = materialize(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if more.isEmpty():
        return rows
    again = rows.join(more, "vec_id", "left_semi").dropDuplicates(["vec_id", "vec"])
    return materialize(rows.join(more, "vec_id", "left_anti").unionByName(again), "vectors")


def _lowest(rows: DataFrame, some: int) -> DataFrame:
    """(d, vec) of the ``some`` rows whose ids hash lowest. Rows that cannot be among them, by a count of the hashes' first 12 bits, stay out of the one task that sorts."""
    mark = F.xxhash64(F.col("vec_id").cast("string"))
    first, seen = F.shiftright(mark, 52), 0
    for top, n in sorted(tuple(r) for r in rows.groupBy(first).count().collect()):
        seen += n
        if seen >= some:
            rows = rows.where(first <= top)
            break
    return rows.orderBy(mark, "vec_id").limit(some).select("d", "vec")


def search(vectors: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row whose id is divisible by ``every``.

    Nearest is largest inner product, in double precision, ties to the smaller id; a query's own id is no candidate.
    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, take no part.
    Rows repeated with their id and vector are one; a query id with several vectors asks with the first of them by
    bytes; candidates have as many components as the query. An empty table, or one without candidates, gives no rows.
    Other columns are ignored, whatever their names. A vector is held whole, however many components it has.
    """
    spark = vectors.sparkSession
    rows = _distinct(materialize(_usable(vectors, id_col, vector_col), "vectors"))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [float(np.sqrt((_matrix([v], d) ** 2).sum())) for d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"d": batch.column(0), "norm": pa.array(norm, pa.float64())})

    sizes = {r["d"]: (r["n"], r["top"]) for r in rows.select("d", "vec").mapInArrow(norms, "d int, norm double").groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    n, cells = sum(m for m, _ in sizes.values()), sum(m * d for d, (m, _) in sizes.items())
    some = min(sample, max(LEAST_SAMPLE, n // 8), max(1, SAMPLE_CELLS * n // max(1, cells)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            widths = np.asarray(batch.column(0))
            for d in np.unique(widths):
                drawn.setdefault(int(d), []).append(_matrix(batch.column(1).take(pa.array(np.flatnonzero(widths == d))).to_pylist(), int(d)))
        for d in sorted(drawn):
            x = np.concatenate(drawn.pop(d))
            lists = int(max(1, min(sizes[d][0] // list_rows, len(x) // 16)))
            centroids = Centroids.fit(x, lists, sizes[d][1])
            centroids.calibrate(x, k, recall)
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "fitted": pa.array([pickle.dumps(centroids)], pa.binary())})

    drawn = _lowest(rows, some).coalesce(1).mapInArrow(fit, "d int, fitted binary")
    fitted: dict[int, Centroids] = {r["d"]: pickle.loads(r["fitted"]) for r in drawn.collect()}
    index = materialize(_route(rows, spark.sparkContext.broadcast(fitted), queries=False), "postings")
    held = materialize(index.select("d", F.explode("lists").alias("list")).groupBy("d", "list").count(), "list-sizes")
    for centroids in fitted.values():
        centroids.sizes, centroids.least = np.zeros(len(centroids.points), np.int64), (k + 1) * REPLICAS  # no row stands in more lists than that
    for r in held.collect():  # one row for each list
        if r["d"] in fitted:
            fitted[r["d"]].sizes[r["list"]] = r["count"]
    shared = spark.sparkContext.broadcast(fitted)
    asks = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "d")).alias("q")).select("vec_id", "q.d", "q.vec")
    asks = materialize(_route(asks, shared, queries=True), "asked")

    def pieces(held: DataFrame, most: int, name: str) -> DataFrame:
        """Into how many pieces the rows of each larger list are cut; their number grows with the table, so they stay a frame."""
        return F.broadcast(held.where(F.col("count") > most).select("d", "list", F.ceil(F.col("count") / most).cast("int").alias(name)))

    parts, blocks = pieces(held, PART_ROWS, "parts"), pieces(materialize(asks.select("d", F.explode("lists").alias("list")).groupBy("d", "list").count(), "asked-sizes"), QUERY_ROWS, "blocks")
    place = F.xxhash64("vec_id", "vec")

    def cut(table: DataFrame, own: str, part: str, other: str, each: str) -> DataFrame:
        """A row for each list of a vector: ``part`` is its piece, and it comes once for ``each`` piece of the other side."""
        single = table.select("*", F.posexplode("lists").alias("pos", "list")).drop("lists")
        known = single.join(parts, ["d", "list"], "left").join(blocks, ["d", "list"], "left").fillna(1, ["parts", "blocks"])
        return known.withColumn(part, F.pmod(place, own).cast("int")).withColumn(each, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("parts", "blocks")

    index = cut(index, "parts", "part", "blocks", "block").select("d", "list", "part", "block", "vec_id", "vec")

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of one part of a list for each query, if they reach what the query has already."""
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
            ids = right["vec_id"].to_numpy()[order]
            x = _matrix([right["vec"].iloc[i] for i in order], int(key[0]))
            for lo in range(0, len(left), 256):
                asked = left["vec_id"].to_numpy()[lo : lo + 256]
                q = _matrix(list(left["vec"].iloc[lo : lo + 256]), int(key[0]))
                least = left["reach"].to_numpy(np.float64, na_value=-np.inf)[lo : lo + 256].copy()
                score = q @ x.T
                score[asked[:, None] == ids[None, :]] = -np.inf
                if len(ids) > 4 * k:
                    least = np.maximum(least, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
                for i in range(len(asked)):
                    some = np.flatnonzero((score[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]))) & np.isfinite(score[i])) if np.isfinite(least[i]) else np.flatnonzero(np.isfinite(score[i]))
                    exact = np.einsum("nd,d->n", x[some], q[i])  # each pair summed alike, so equal vectors tie
                    keep = np.lexsort((ids[some], -exact))[:k]
                    out.append(pd.DataFrame({"query_id": asked[i], "vec_id": ids[some[keep]], "score": exact[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype=left["vec_id"].dtype), "vec_id": pd.Series(dtype=left["vec_id"].dtype), "score": pd.Series(dtype="float64")})

    keys = ["d", "list", "part", "block"]

    def hits(queries: DataFrame, which: str) -> DataFrame:
        some = cut(queries, "blocks", "block", "parts", "part").where(which).select(*keys, "vec_id", "vec", "reach")
        return some.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(best, f"query_id {kind}, vec_id {kind}, score double")

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.repartition("query_id").dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order))

    # What the k-th hit of its first lists scores is what a query's other lists have to reach, so they return few rows.
    first = materialize(hits(asks.withColumn("reach", F.lit(None).cast("double")), "pos < early"), "first-hits")
    reach = ranked(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
    more = hits(asks.join(reach, "vec_id", "left"), "pos >= early")
    return ranked(first.union(more)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
