"""Language-model scoring by prediction by partial matching over bytes, pretrained on the training part of a corpus.

The text that is modelled is the sequence of its words (A-Z lower-cased), one space between two, and an end byte.

* Trie: counts of all byte (order + 1)-grams of the training texts; a shorter context's counts are those of all longer
  ones that end in it. No entry is left out.
* Escape: a context in which D different symbols followed T times passes down with weight D * ESCAPE of T + D * ESCAPE.
* Exclusion: below an escape the symbols of the longer context are left out, which takes from T and D of the shorter
  context a sum that belongs to the longer one alone; so it is computed once for each context, not for each position.
  Below order 0 the rest of the 256 byte values and the end share what is left alike.
* Scores: grams are dealt by their last ROOT context bytes, so that a task has all longer contexts of its grams; the
  levels of shorter contexts, at most 256^ROOT entries each, are sent to all. Every different gram is scored once. The
  scores of the commonest, at most ``max_nodes``, are sent to all tasks and looked up there; the occurrences of all
  other grams are joined with theirs by a shuffle.

The base is a model of single words with one pseudo-count. Words with many counts, at most ``max_words``, are sent to
all tasks; the occurrences of all other words are joined with the full counts by a shuffle, and so are exact too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _textvec as tv
from ._shared import materialize
from ._tiles import joined, runs

ORDER = 5
#: Grams whose scores, and words whose counts are broadcast at most.
MAX_NODES, MAX_WORDS = 4_000_000, 1 << 18
#: Context bytes by which grams are dealt to tasks.
ROOT = 3
#: Weight of a symbol that follows a context, in the estimate of the escape.
ESCAPE = 0.5
END = 10
_U = np.uint64
#: Distinct entries that a task keeps before it hands them on.
_HELD = 3_000_000


def byte_stream(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts as modelled, where each begins with the total last)."""
    rows = len(first) - 1
    per_row = np.diff(first)
    sizes = ends - starts + 1
    filler = np.zeros(rows, np.int64)
    filler[per_row == 0] = 1  # a text without words is an end
    words_before = np.concatenate([[0], np.cumsum(sizes)])
    begin = words_before[first] + np.concatenate([[0], np.cumsum(filler)])
    row_of = np.repeat(np.arange(rows), per_row)
    at = words_before[:-1] + np.concatenate([[0], np.cumsum(filler)])[row_of]
    out = np.full(int(begin[-1]), 32, np.uint8)
    length = ends - starts
    if len(starts):
        place = np.arange(int(length.sum())) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        out[np.repeat(at, length) + place] = low[np.repeat(starts, length) + place]
    out[begin[1:] - 1] = END
    return out, begin


def grams(stream: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """The (order + 1)-gram that ends at each byte, as an integer; before a text stand ends."""
    out = stream.astype(_U)
    position = np.arange(len(stream)) - np.repeat(begin[:-1], np.diff(begin))
    for back in range(1, order + 1):
        before = np.full(len(stream), END, _U)
        before[back:] = stream[:-back] if back < len(stream) else 0
        before[position < back] = END
        out |= before << _U(8 * back)
    return out


class Ppm:
    """levels[k]: (sorted (k + 1)-grams, their counts), k from 0 to the order; ``below`` has the first of them worked out."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], escape: float = ESCAPE, below: "Ppm | None" = None):
        self.levels = levels
        self.contexts = list(below.contexts) if below else []
        for k, (key, count) in list(enumerate(levels))[len(self.contexts) :]:
            context = key >> _U(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(count.astype(np.float64), first) if len(key) else np.zeros(0)
            kinds = np.diff(np.concatenate([first, [len(key)]])).astype(np.float64)
            taken = np.zeros(len(first))
            if k and len(key):  # what this level's contexts take from their suffix: the suffix's counts of the same symbols
                below, below_count = levels[k - 1]
                at = np.searchsorted(below, key & _U((1 << (8 * k)) - 1))
                taken = np.add.reduceat(below_count[at].astype(np.float64), first)
            self.contexts.append((context[first], total, kinds, taken))
        self.escape = escape

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        out = np.zeros(len(gram))
        live = np.arange(len(gram))
        taken, kinds_taken = np.zeros(len(gram)), np.zeros(len(gram))
        for k in range(len(self.levels) - 1, -1, -1):
            key, count = self.levels[k]
            context, total, kinds, takes = self.contexts[k]
            if not len(key) or not len(live):
                continue
            mine = gram[live] & _U((1 << (8 * (k + 1))) - 1)
            c = np.minimum(np.searchsorted(context, mine >> _U(8)), len(context) - 1)
            known = context[c] == mine >> _U(8)
            t, d = total[c] - taken[live], kinds[c] - kinds_taken[live]
            known &= d > 0.5  # with nothing left to see, all passes down
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = known & (key[at] == mine)
            weight = np.where(known, t + d * self.escape, 1.0)
            out[live[hit]] += np.log10(count[at[hit]] / weight[hit])
            miss = known & ~hit
            out[live[miss]] += np.log10(d[miss] * self.escape / weight[miss])
            here = context[c] == mine >> _U(8)
            taken[live[here]], kinds_taken[live[here]] = takes[c[here]], kinds[c[here]]
            live = live[~hit]
        seen = self.contexts[0][2][0] if len(self.contexts[0][2]) else 0
        out[live] -= np.log10(max(1.0, 256 - seen))
        return out

    @classmethod
    def from_grams(cls, key: np.ndarray, count: np.ndarray, order: int, escape: float = ESCAPE, below: "Ppm | None" = None) -> "Ppm":
        levels = list(below.levels) if below else []
        for k in range(len(levels), order + 1):
            short = key & _U((1 << (8 * (k + 1))) - 1)
            u, inverse = np.unique(short, return_inverse=True)
            levels.append((u, np.bincount(inverse, count, len(u)).astype(np.int64)))
        return cls(levels, escape, below)


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key)
    key, count = key[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def corpus_counts(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n) over the rows (doc_id, held, text): kind 0 words by hash, 1 byte grams, 2 tokens in all; 3 grams of the held-out rows, and nothing else of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], []), 3: ([], [])}
        tokens = 0

        def give(kind: int) -> pa.RecordBatch:
            key, count = _summed(*held[kind])
            held[kind] = ([], [])
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": key.view(np.int64), "n": count})

        for batch in batches:
            for out in (False, True):
                texts = batch.column(0).filter(pc.equal(batch.column(1), out))
                for _, _, data, offsets in tv.text_slices(texts, 4 << 20):
                    low, starts, ends, first = tv.words(data, offsets)
                    stream, begin = byte_stream(low, starts, ends, first)
                    tokens += 0 if out else len(starts) + len(offsets) - 1
                    found = {3 if out else 1: grams(stream, begin, order)} | ({} if out else {0: tv.word_hashes(low, starts, ends)})
                    for kind, keys in found.items():
                        key, count = np.unique(keys, return_counts=True)
                        held[kind][0].append(key), held[kind][1].append(count)
                        if sum(map(len, held[kind][0])) > _HELD:
                            key, count = _summed(*held[kind])
                            held[kind] = ([key], [count])
                            if len(key) > _HELD // 2:
                                yield give(kind)
        for kind in held:
            if held[kind][0]:
                yield give(kind)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([2], pa.int32()), "key": pa.array([0], pa.int64()), "n": pa.array([tokens], pa.int64())})

    return docs.select("text", "held").mapInArrow(run, "kind int, key bigint, n bigint")


def _least_count(counts: DataFrame, most: int) -> int:
    """The least n for which at most ``most`` rows have n or more."""
    found = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n"))
    total = 0
    for n, rows in found.toLocalIterator():
        if total + rows > most:
            return n + 1
        total += rows
    return 1


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, the last one aside."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield joined(held)
            held = []
    if held:
        yield joined(held)


def gram_scores(counted: DataFrame, order: int, escape: float) -> DataFrame:
    """(key, n, score) of every gram of the texts from (kind, key, n): how often it is in them, and its log10 probability."""
    root = min(ROOT, order)
    short = counted.where("kind = 1").groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * root)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 256^root rows
    key, count = np.asarray(short.column("key")).astype(np.int64).view(_U), np.asarray(short.column("n")).astype(np.int64)
    shared = counted.sparkSession.sparkContext.broadcast((key, count))
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * root)) - 1))
    learned = F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0))
    each = counted.where("kind in (1, 3)").groupBy("key").agg(learned.alias("learned"), F.sum("n").alias("n")).select(context.alias("context"), "key", "learned", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = Ppm.from_grams(*shared.value, root - 1, escape)
        for batch in gathered(runs(batches, 1)):
            key, learned = np.asarray(batch.column(1)).view(_U), np.asarray(batch.column(2))
            known = learned > 0
            model = Ppm.from_grams(key[known], learned[known], order, escape, below)
            yield pa.RecordBatch.from_pydict({"key": batch.column(1), "n": batch.column(3), "score": model.log10(key)})

    return each.repartition("context").sortWithinPartitions("context").mapInArrow(run, "key bigint, n bigint, score double")


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    escape: float = ESCAPE,
    max_nodes: int = MAX_NODES,
    max_words: int = MAX_WORDS,
    modulus: int = 7,
    remainder: int = 2,
) -> DataFrame:
    """Per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities).

    Learns from rows whose crc32(id as text) mod ``modulus`` isn't ``remainder``; rows with a null id are learned from.
    Null texts are empty: one token, the end. Repeated rows are counted and scored as rows of their own; with nothing
    to learn from, every byte has the same probability; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col], modulus, remainder).alias("held"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = materialize(corpus_counts(source, order).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counted.where("kind = 0").select("key", "n")
    ends = source.where("not held").count()
    known_words = words.count()
    tokens = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    distinct = known_words + (1 if ends else 0)
    scores = materialize(gram_scores(counted, order, escape), "gram-scores")
    least_gram = _least_count(scores, max_nodes)
    frequent = scores.where(F.col("n") >= least_gram).select("key", "score").toArrow()
    gram_key, gram_score = np.asarray(frequent.column("key")).astype(np.int64).view(_U), np.asarray(frequent.column("score")).astype(np.float64)
    by = np.argsort(gram_key)
    gram_key, gram_score = gram_key[by], gram_score[by]
    del frequent
    least = _least_count(words, max_words) if known_words > max_words else 1
    common = words.where(F.col("n") >= least).toArrow()
    key, count = np.asarray(common.column("key")).astype(np.int64), np.asarray(common.column("n")).astype(np.int64)
    by = np.argsort(key.view(_U))
    rest, rest_grams = least > 1, least_gram > 1
    shared = spark.sparkContext.broadcast((gram_key, gram_score, key.view(_U)[by], count[by], float(ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_key, gram_score, common, counts, ends = shared.value
        logs = np.log10(counts + 1.0)
        for batch in batches:
            for lo, hi, data, offsets in tv.text_slices(batch.column(2), 4 << 20):
                low, starts, last, first = tv.words(data, offsets)
                stream, begin = byte_stream(low, starts, last, first)
                gram, inverse = np.unique(grams(stream, begin, order), return_inverse=True)
                at = np.minimum(np.searchsorted(gram_key, gram), max(0, len(gram_key) - 1))
                scored = gram_key[at] == gram if len(gram_key) else np.zeros(len(gram), bool)
                mine = np.zeros(len(gram))
                mine[scored] = gram_score[at[scored]]
                total = np.concatenate([[0.0], np.cumsum(mine[inverse])])
                left = ~scored[inverse]
                others = gram.view(np.int64)[inverse] if rest_grams else None
                word, where = np.unique(tv.word_hashes(low, starts, last), return_inverse=True)
                at = np.minimum(np.searchsorted(common, word), max(0, len(common) - 1))
                hit = common[at] == word if len(common) else np.zeros(len(word), bool)
                mine = np.zeros(len(word))
                mine[hit] = logs[at[hit]]
                summed = np.concatenate([[0.0], np.cumsum(mine[where])])
                found = np.concatenate([[0], np.cumsum(hit[where])])
                unseen = word.view(np.int64)[where]
                missed = ~hit[where]
                rows = len(offsets) - 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(lo, rows),
                        "held": batch.column(1).slice(lo, rows),
                        "n_tokens": np.diff(first) + 1,
                        "known": found[first[1:]] - found[first[:-1]] + (1 if ends else 0),
                        "logs": summed[first[1:]] - summed[first[:-1]] + np.log10(ends + 1),
                        "score": total[begin[1:]] - total[begin[:-1]],
                        "rare": pa.array([unseen[a:b][missed[a:b]] if rest else None for a, b in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.int64())),
                        "grams": pa.array([others[a:b][left[a:b]] if rest_grams else None for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.list_(pa.int64())),
                    }
                )

    scored = source.select("doc_id", "held", "text").mapInArrow(run, f"doc_id {kind}, held boolean, n_tokens bigint, known bigint, logs double, score double, rare array<bigint>, grams array<bigint>")
    if rest or rest_grams:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    if rest_grams:
        asked = scored.select("row", F.explode("grams").alias("key"))
        given = asked.join(scores.where(F.col("n") < least_gram).select("key", F.col("score").alias("_g")), "key").groupBy("row").agg(F.sum("_g").alias("_g"))
        scored = scored.drop("grams").join(given, "row", "left").withColumn("score", F.col("score") + F.coalesce("_g", F.lit(0.0)))
    if rest:
        asked = scored.select("row", F.explode("rare").alias("key"))
        given = asked.join(words.where(F.col("n") < least), "key").groupBy("row").agg(F.count("*").alias("_k"), F.sum(F.log10(F.col("n") + 1.0)).alias("_s"))
        scored = scored.drop("rare").join(given, "row", "left")
        scored = scored.withColumn("known", F.col("known") + F.coalesce("_k", F.lit(0))).withColumn("logs", F.col("logs") + F.coalesce("_s", F.lit(0.0)))
    below = float(np.log10(tokens + distinct + 1.0))
    return scored.select(
        F.col("doc_id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        "score",
    )
