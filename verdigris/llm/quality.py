"""Quality classifier: naive Bayes support vectors on hashed n-gram indicators.

Features of a text: its distinct words, and 1- to 3-grams of word shapes (letters, digits and marks of a word, runs
collapsed; a word repeated from the one before has a shape of its own). Each is an indicator, scaled by the log ratio of
its smoothed counts in good and in bad texts (NB); a linear hinge-loss model is fitted on the scaled, length-normalised
vectors by dual coordinate descent, with the classes weighted alike, and its margins on a fifth of the sample that was
left out give the sigmoid that makes a score of them.

The fit uses at most ``max_train`` labelled rows, those whose ids hash lowest; scoring is one pass over the documents
with a broadcast weight vector of FEATURES doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _textvec as tv

BITS = 18
FEATURES = 1 << BITS
#: Labelled rows that a fit uses at most: a bound on what is collected.
MAX_TRAIN = 12_000
_U = np.uint64
#: Classes of bytes for shapes: letters (also all bytes of other scripts) are one, digits one, every mark its own.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of every text."""
    for _, _, data, offsets in tv.text_slices(column):
        low, starts, ends, first = tv.words(data, offsets)
        word = tv.word_hashes(low, starts, ends)
        shape = _SHAPE[low]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[starts] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        form = tv.word_hashes(shape[keep], at[starts], at[ends])
        again = np.zeros(len(word), bool)
        again[1:] = word[1:] == word[:-1]
        again[first[:-1][first[:-1] < len(word)]] = False
        form[again] = _U(0x1234567)
        mask = _U(FEATURES - 1)
        one = (tv.mix(word ^ _U(0x77)) & mask).astype(np.int32)
        with np.errstate(over="ignore"):
            grams = [(tv.mix(form + _U(1)) & mask).astype(np.int32)]
            run = form.copy()
            for n in (2, 3):
                run = run[:-1] * _U(0x9FB21C651E98DF25) + form[n - 1 :] if len(run) else run
                grams.append((tv.mix(run + _U(n)) & mask).astype(np.int32))
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            yield np.unique(np.concatenate([one[a:b], *[g[a : max(a, b - n)] for n, g in enumerate(grams)]]))


@dataclass
class NbSvm:
    """score = 1 / (1 + exp(-(slope * margin + shift)))"""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weight[features].sum() / np.sqrt(max(1, len(features))) + self.bias)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


class Features:
    """Feature sets of many texts as one array with offsets; iterates and slices like a list of arrays."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, picked: np.ndarray | None = None):
        self.values, self.offsets = values, offsets
        self.picked = np.arange(len(offsets) - 1) if picked is None else picked

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> "Features":
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.picked)

    def __getitem__(self, i: int) -> np.ndarray:
        at = self.picked[i]
        return self.values[self.offsets[at] : self.offsets[at + 1]]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[i] for i in range(len(self)))

    def take(self, which: np.ndarray) -> "Features":
        return Features(self.values, self.offsets, self.picked[which])


def descend(rows: Features, ratio: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent (Hsieh et al. 2008), features scaled by ``ratio``; y is 1 or -1."""
    weight, bias = np.zeros(len(ratio)), 0.0
    scaled = lambda r: ratio[r] / np.sqrt(max(1, len(r)))
    diagonal = np.array([(v := scaled(r)) @ v + 1.0 for r in rows])
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    limit = np.array([cost * share[s] for s in y])
    alpha = np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            row = rows[i]
            value = scaled(row)
            gradient = y[i] * (weight[row] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weight[row] += step * value
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weight * ratio, bias


def log_ratio(rows: Features, good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, FEATURES), smooth)
    for r, g in zip(rows, good, strict=True):
        counts[int(g)][r] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit(rows: Features, good: np.ndarray) -> NbSvm:
    """Fits on feature sets and labels. With one class only, or no row, the score is that class's smoothed share everywhere."""
    good = np.asarray(good, bool)
    if good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return NbSvm(np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    y = np.where(good, 1, -1)
    test = np.arange(len(rows)) % 5 == 4
    if good[~test].all() or not good[~test].any() or not test.any():
        test[:] = False
    part = rows.take(np.flatnonzero(~test))
    ratio = log_ratio(part, good[~test])
    weight, bias = descend(part, ratio, y[~test])
    sample = test if test.any() else ~test
    model = NbSvm(weight, bias, 1.0, 0.0)
    margin = np.array([model.margin(r) for r in rows.take(np.flatnonzero(sample))])
    slope, shift = sigmoid(margin, good[sample])
    weight, bias = descend(rows, ratio := log_ratio(rows, good), y)
    return NbSvm(weight, bias, slope, shift)


def sigmoid(margin: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets (Platt)."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * theta)
        theta = theta + np.clip(move, -3, 3)
        if abs(move).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", folds: int = 5, max_train: int = MAX_TRAIN) -> NbSvm:
    """Fits on labelled rows outside fold 0; the ids of at most ``max_train`` rows and their features come to the driver."""
    known = labels.where(labels[label_col].isNotNull() & labels[label_id].isNotNull()).groupBy(labels[label_id].alias("doc_id")).agg(F.max(labels[label_col]).cast("int").alias("y"))
    sample = known.where(remainder(F.col("doc_id"), folds) != 0).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_train).collect()
    if not sample:
        return fit(Features.of([]), np.zeros(0, bool))
    spark = docs.sparkSession
    picked = spark.createDataFrame(sample, known.schema)
    mine = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tv.kept("quality")
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "f": pa.array(list(feature_sets(batch.column(2))), pa.list_(pa.int32()))})

    got = mine.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, y int, f array<int>")
    table = got.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("f").alias("f")).toArrow().sort_by("doc_id")
    order = np.random.Generator(np.random.PCG64(9)).permutation(table.num_rows)
    lists = table.column("f").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    rows = Features(np.asarray(lists.values), np.asarray(lists.offsets).astype(np.int64), order)
    return fit(rows, np.asarray(table.column("y"))[order] > 0)


def score(docs: DataFrame, model: NbSvm, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of whole texts; null and empty ones get the score of a text without features."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.slope, model.shift))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tv.kept("quality")
        mine = NbSvm(*shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                margin = np.array([mine.margin(f) for f in feature_sets(batch.column(1))], np.float64)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": mine.score(margin)})

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double").withColumnRenamed("doc_id", id_col)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted.

    Only labels of rows whose crc32(id as text) mod ``folds`` isn't 0 are learned from. Labels without a document
    and documents without a label are allowed; of several labels of an id the largest counts. Null ids and texts get
    a score; held_out of a null id is false. Repeated rows are scored alike; an empty table gives no rows. Columns
    other than id and text are ignored, whatever their names.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, folds=folds)
    held = F.coalesce(remainder(F.col(id_col), folds) == 0, F.lit(False))
    return score(docs, model, id_col=id_col, text_col=text_col).select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: NbSvm, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.slope, model.shift))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tv.kept("quality")
        mine = NbSvm(*shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                margin = np.array([mine.margin(f) for f in feature_sets(batch.column(at))], np.float64)
                yield batch.filter(pa.array(mine.score(margin) >= threshold))

    return docs.mapInArrow(run, docs.schema)
