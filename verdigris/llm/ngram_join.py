"""Jaccard join on word n-grams by parity sketches.

A document's set of k-word shingles flips, for every shingle, one bit of a wide bit vector: its parity sketch. Two
sketches differ in at most as many bits as the sets have elements in their symmetric difference, and two sets of
Jaccard similarity t, the larger of b elements, differ in at most 2b(1-t)/(1+t).

* Size bands: bands of set sizes, the upper end BAND times the lower. A document is keyed in its own band and, if a
  partner may be in the next one, in that too, so two documents that can link share the larger one's band.
* Pigeonhole: in a band whose pairs differ in at most d elements the sketch is cut into d + 1 blocks, so that two
  linked documents agree on a whole block. Blocks are hashed to join keys; empty blocks are no keys. The first
  FIRST_BLOCKS blocks are keys of a first pass, which finds nearly all links: at the threshold a block stays equal with
  probability 1/e or more, so it misses one with a probability below (1 - 1/e)^FIRST_BLOCKS, 5e-9 for 42. All other
  blocks are keys of a second pass, which compares only what isn't connected by then, so that no link is missed
  (``exact=False`` leaves it out).
* Prefix: two linked documents that agree on empty blocks only differ in every block that either fills, so both fill no
  more blocks than they can differ in. Documents of so few filled blocks, if all their blocks are keys, are keyed by
  the least of their hashed shingles too, so many that two linked sets have one of them in common.
* A second, folded sketch of 1024 bits prunes the pairs of a bucket: its Hamming distance is a lower bound too.
* What is left is verified on the exact sets.

Documents with equal sets are one class before any pair is made. Buckets are cut into tiles of bounded size. In a
small tile every pair that the sketch doesn't exclude is verified; in a large one first those of a minimum spanning
forest by Hamming distance, then every other pair across components that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _textvec as tv
from ._shared import connected_components, materialize
from ._tiles import bounds, fixed, runs, tiled

BAND = 1.5
FIRST_BLOCKS = 42
#: Rows of a tile, and up to how many rows a tile's pairs are all verified at once.
TILE, SMALL = 1024, 12
SKETCH_BYTES = 128
#: Words of 64 bits of the wide sketches of the second pass.
WIDE_WORDS = 256
#: Classes that a task remembers to have keyed.
MET = 200_000
#: Up to this many documents in candidate pairs, their ids (8 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def band_edges(threshold: float, top: float = 1e13) -> np.ndarray:
    """Least set sizes of the bands."""
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges, np.int64)


def most_apart(size: int | np.ndarray, threshold: float):
    """The most elements in which a linked pair can differ if the larger set has ``size`` elements."""
    return np.floor(2 * size * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)


def sketch_one(tokens: np.ndarray, edges: np.ndarray, threshold: float, first_blocks: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(join keys of the first pass, those of the second, folded sketch) of a set of hashed shingles."""
    with np.errstate(over="ignore"):
        n = len(tokens)
        spots = tv.mix(tokens ^ _U(0x5851F42D4C957F2D))
        home = int(np.searchsorted(edges, n, side="right")) - 1
        levels = [home] + ([home + 1] if n / threshold + 1e-9 >= edges[home + 1] else [])
        keys, more, few = [np.zeros(0, _U)], [np.zeros(0, _U)], False
        for level in levels:
            blocks = int(most_apart(int(edges[level + 1]) - 1, threshold)) + 1
            block = ((spots >> _U(32)) * _U(blocks)) >> _U(32)
            bit = tv.mix(spots & _U((1 << 32) - 1))  # the flipped bit of the block, as its Zobrist value
            order = np.argsort(block, kind="stable")
            block = block[order]
            first = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
            largest = min(int(n / threshold + 1e-9), int(edges[level + 1]) - 1)  # of the partners of this level
            few = few or len(first) <= min(blocks - 1, int((n + largest) * (1 - threshold) / (1 + threshold) + 1e-9))
            value = np.bitwise_xor.reduceat(bit[order], first)
            key = tv.mix(value + tv.mix(block[first] + _U(level << 32) + _U(1)))
            early = block[first] < _U(first_blocks)
            keys.append(key[early]), more.append(key[~early])
        if few:
            keys.append(tv.mix(np.sort(tokens)[: n - int(np.ceil(threshold * n - 1e-9)) + 1] ^ _U(0x2545F4914F6CDD1D)))
        folded = np.zeros(SKETCH_BYTES * 8, np.uint8)
        np.bitwise_xor.at(folded, (spots & _U(SKETCH_BYTES * 8 - 1)).astype(np.int64), np.uint8(1))
        return np.concatenate(keys).view(np.int64), np.concatenate(more).view(np.int64), np.packbits(folded).tobytes()


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashed shingles of every text."""
    for _, _, data, offsets in tv.text_slices(column):
        low, starts, ends, first = tv.words(data, offsets)
        hashes = tv.word_hashes(low, starts, ends)
        for i in range(len(offsets) - 1):
            yield np.unique(tv.shingle_hashes(hashes[first[i] : first[i + 1]], k))


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, first_blocks: int, exact: bool) -> DataFrame:
    """(doc_id, text_hash, n, cls, keys, more, sketch) per row; cls: a 64-bit hash of the set, null for an empty one.

    Keys and sketch stand with the first row of a class in a task, or a later one if the task has met many others since.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    kind = source.schema["doc_id"].dataType.simpleString()
    edges = band_edges(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tv.kept("ngram_join")
        met: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                n, cls, keys, more, sketch = [], [], [], [], []
                if len(met) > MET:
                    met.clear()
                with np.errstate(over="ignore"):
                    for tokens in shingle_sets(batch.column(1), k):
                        n.append(len(tokens))
                        if not len(tokens):
                            cls.append(None), keys.append(None), more.append(None), sketch.append(None)
                            continue
                        cls.append(set_name(tokens))
                        if cls[-1] in met:
                            keys.append(None), more.append(None), sketch.append(None)
                            continue
                        met.add(cls[-1])
                        own, others, folded = sketch_one(tokens, edges, threshold, first_blocks)
                        keys.append(own), more.append(others if exact else None), sketch.append(folded)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_hash": batch.column(2), "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())), "more": pa.array(more, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())})

    return source.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n bigint, cls bigint, keys array<bigint>, more array<bigint>, sketch binary")


def _distances(sketch: np.ndarray, i: int) -> np.ndarray:
    return np.bitwise_count(sketch ^ sketch[i]).sum(1, dtype=np.int64)


def may_link(n: np.ndarray, i: int, apart: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows the sizes and the distances from row ``i`` leave as partners of it."""
    both = n + n[i]
    return (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9) & (apart <= both * (1 - threshold) / (1 + threshold) + 1e-9)


def spanning(sketch: np.ndarray, n: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A minimum spanning forest by distance of the pairs that may link (Prim)."""
    size, edges = len(n), []
    far = np.iinfo(np.int64).max
    left = np.ones(size, bool)
    best, via = np.full(size, far), np.full(size, -1)
    for _ in range(size):
        at = int(np.where(left, best, far).argmin())
        if not left[at]:
            at = int(left.argmax())
        left[at] = False
        if best[at] < far:
            edges.append((int(via[at]), at))
        apart = _distances(sketch, at)
        nearer = left & may_link(n, at, apart, threshold) & (apart < best)
        best[nearer], via[nearer] = apart[nearer], at
    return edges


def candidate_pairs(rows: DataFrame, threshold: float, across: int | None = None) -> DataFrame:
    """(a, b, big) from tiles of rows (key, t1, t2, cls, n, sketch, comp).

    All pairs of small tiles, and spanning forests of the others. With ``across``: of tiles of more rows than that, every pair of different comp.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tv.kept("ngram_join")
        for batch in runs(batches, 3):
            edge = bounds(batch, 3)
            cls = np.asarray(batch.column(3))
            n = np.asarray(batch.column(4))
            sketch = fixed(batch.column(5), SKETCH_BYTES, np.uint64)
            comp = np.asarray(batch.column(6))
            a, b = [], []
            sizes = np.diff(edge)
            if across is None:
                first = edge[:-1][sizes == 2]  # most tiles are pairs: all of them at once
                if len(first):
                    apart = np.bitwise_count(sketch[first] ^ sketch[first + 1]).sum(1, dtype=np.int64)
                    x, y = n[first], n[first + 1]
                    ok = (np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9) & (apart <= (x + y) * (1 - threshold) / (1 + threshold) + 1e-9)
                    a.append(cls[first[ok]]), b.append(cls[first[ok] + 1])
            least = 2 if across is None else 1
            for lo, size in zip(edge[:-1][sizes > least], sizes[sizes > least], strict=True):
                s, m, c, g = sketch[lo : lo + size], n[lo : lo + size], cls[lo : lo + size], comp[lo : lo + size]
                if across is None and size <= SMALL:
                    for i in range(size - 1):
                        ok = np.flatnonzero(may_link(m, i, _distances(s, i), threshold)[i + 1 :]) + i + 1
                        a.append(np.full(len(ok), c[i])), b.append(c[ok])
                elif across is None:
                    pairs = np.array(spanning(s, m, threshold), np.int64).reshape(-1, 2)
                    a.append(c[pairs[:, 0]]), b.append(c[pairs[:, 1]])
                elif size > across and (g != g[0]).any():
                    common = np.bincount(np.unique(g, return_inverse=True)[1]).argmax()
                    rare = np.flatnonzero(np.unique(g, return_inverse=True)[1] != common)  # one side of every pair across is outside the commonest component
                    for i in rare:
                        ok = np.flatnonzero((g != g[i]) & may_link(m, i, _distances(s, i), threshold))
                        a.append(np.full(len(ok), c[i])), b.append(c[ok])
            x = np.concatenate(a) if a else np.zeros(0, np.int64)
            y = np.concatenate(b) if b else np.zeros(0, np.int64)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    laid = rows.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").select("key", "t1", "t2", "cls", "n", "sketch", "comp")
    return laid.mapInArrow(run, "a bigint, b bigint").distinct()


def set_name(tokens: np.ndarray) -> int:
    """A 64-bit hash of a non-empty set of hashed shingles."""
    with np.errstate(over="ignore"):
        return int(tv.mix(np.array([tv.mix(tokens).sum(dtype=_U) + _U(len(tokens))], _U) ^ tokens[:1]).view(np.int64)[0])


def exact_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(cls, tokens) of the documents whose ids are in ``wanted``, and of those without an id."""
    ids = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    few = wanted.count() <= BROADCAST_IDS
    mine = ids.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").union(ids.where("doc_id is null")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tv.kept("ngram_join")
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                sets = [x for x in shingle_sets(whole.slice(lo, 1000).column(0), k) if len(x)]
                yield pa.RecordBatch.from_pydict({"cls": pa.array(map(set_name, sets), pa.int64()), "tokens": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})

    return mine.mapInArrow(run, "cls bigint, tokens array<bigint>")


def wide_sketches(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(cls, n, wide) of the documents whose ids are in ``wanted``, and of those without an id: parity sketches of WIDE_WORDS words of 64 bits."""
    few = wanted.count() <= BROADCAST_IDS
    ids = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    mine = ids.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").union(ids.where("doc_id is null")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tv.kept("ngram_join")
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                sets = [x for x in shingle_sets(whole.slice(lo, 1000).column(0), k) if len(x)]
                wide = []
                with np.errstate(over="ignore"):
                    for tokens in sets:
                        spots = tv.mix(tokens ^ _U(0x27BB2EE687B0B0FD)) & _U(WIDE_WORDS * 64 - 1)
                        wide.append(np.packbits((np.bincount(spots.astype(np.int64), minlength=WIDE_WORDS * 64) & 1).astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_pydict({"cls": pa.array(map(set_name, sets), pa.int64()), "n": pa.array(list(map(len, sets)), pa.int64()), "wide": pa.array(wide, pa.list_(pa.int64()))})

    return mine.mapInArrow(run, "cls bigint, n bigint, wide array<bigint>").dropDuplicates(["cls"])


def still_near(pairs: DataFrame, wide: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the wide sketches don't exclude."""
    left, right = wide.toDF("a", "n", "x"), wide.toDF("b", "m", "y")
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    most = (F.col("n") + F.col("m")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9
    return pairs.join(left, "a").join(right, "b").where(apart <= most).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("_i", common).where(F.col("_i") * 100 >= (F.size("x") + F.size("y") - F.col("_i")) * percent).select("a", "b")


def jaccard_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    first_blocks: int = FIRST_BLOCKS,
    exact: bool = True,
    keep_links: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: id, text_hash (xxhash64 of the text), n_shingles, class_id, component_id.

    class_id is the smallest id with the same set, component_id the smallest reachable by links between documents
    whose sets have a Jaccard similarity of ``percent`` / 100 or more. Null or empty texts have n_shingles 0 and are
    their own class and component. Texts are taken whole, however long: a document has a key for some 0.22 of its shingles. Rows repeated with one id are separate rows of one class; a null id is never a
    class's or component's name, which is null if there is no other. An empty table gives no rows; other columns are
    ignored whatever their names. With ``keep_links``: also the links found between classes (a, b as class_id),
    which connect every component, but aren't every link of a large group.
    """
    threshold = percent / 100
    base = materialize(sketches(docs, id_col, text_col, k, threshold, first_blocks, exact), "sketches")
    classes = base.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"))
    stand = materialize(base.where("sketch is not null").select("cls", "n", "sketch").dropDuplicates(["cls"]), "classes")
    rows = base.select(F.explode("keys").alias("key"), "cls")
    placed = materialize(tiled(rows, "key", "cls", TILE), "tiles")
    described = placed.join(stand, "cls")
    first = materialize(candidate_pairs(described.withColumn("comp", F.lit(0).cast("long")), threshold), "pairs")
    involved = placed.where(f"_n > {SMALL}").select("cls").union(first.select("a")).union(first.select("b")).distinct()

    def representatives(involved: DataFrame) -> DataFrame:
        """An id for each class of ``involved`` that has one."""
        return base.where("doc_id is not null and cls is not null").join(involved.toDF("cls"), "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()

    wanted = representatives(involved)
    sets = materialize(exact_sets(docs, id_col, text_col, k, wanted).dropDuplicates(["cls"]), "sets")
    links = materialize(verified(first, sets, percent), "links")
    groups = materialize(connected_components(links), "groups")

    def across(rows: DataFrame, above: int, groups: DataFrame) -> DataFrame:
        """Pairs of buckets that no component holds whole, of classes that aren't connected."""
        labelled = rows.join(groups, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls")).drop("node")
        several = labelled.groupBy("key", "t1", "t2").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high")
        some = labelled.join(several.select("key", "t1", "t2"), ["key", "t1", "t2"], "left_semi").join(stand, "cls")
        return candidate_pairs(some, threshold, above).join(first, ["a", "b"], "left_anti")

    large = placed.where(f"_n > {SMALL}")
    if not large.isEmpty():
        extra = materialize(verified(across(large, SMALL, groups), sets, percent), "more-links")
        if not extra.isEmpty():
            links = links.union(extra)
            groups = materialize(connected_components(links), "groups")
    if exact:
        others = materialize(tiled(base.select(F.explode("more").alias("key"), "cls"), "key", "cls", TILE), "other-tiles")
        last = materialize(across(others, 1, groups), "other-pairs")
        if not last.isEmpty():
            # Long sets fill the folded sketch, so most of these pairs are far apart; wide ones tell before any set is moved.
            wanted = representatives(last.select("a").union(last.select("b")).distinct())
            wide = materialize(wide_sketches(docs, id_col, text_col, k, wanted), "wide")
            last = materialize(still_near(last, wide, threshold), "near-pairs")
            wanted = representatives(last.select("a").union(last.select("b")).distinct())
            extra = materialize(verified(last, exact_sets(docs, id_col, text_col, k, wanted).dropDuplicates(["cls"]), percent), "other-links") if not last.isEmpty() else last
            if not extra.isEmpty():
                links = links.union(extra)
                groups = materialize(connected_components(links), "groups")
    named = classes.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "class_id", F.coalesce("comp", "cls").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = materialize(named.join(smallest, "comp").select("cls", "class_id", "component_id"), "named")
    empty = F.col("cls").isNull()
    out = base.select("doc_id", "text_hash", "n", "cls").join(named, "cls", "left").select(
        F.col("doc_id").alias(id_col),
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    if not keep_links:
        return out
    ids = named.select("cls", "class_id")
    a, b = ids.toDF("a", "class_a"), ids.toDF("b", "class_b")
    return out, links.join(a, "a").join(b, "b").select("class_a", "class_b")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays: that with the component's id.

    Of several rows with that id the one whose text hashes lowest stays, of rows that are the same one. Texts without
    words are components of their own id; rows with a null id stay unless their component has an id.
    """
    joined = jaccard_join(docs, id_col=id_col, text_col=text_col, **options)
    component = F.col("component_id")
    stays = joined.where(F.col(id_col).eqNullSafe(component)).groupBy(component, F.when(component.isNull(), F.col("text_hash")).alias("_own")).agg(F.min("text_hash").alias("_th"), F.count("*").alias("_rows"))
    stays = materialize(stays.select(F.col("component_id").alias("_id"), "_th", "_rows"), "stays")
    match = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_th"))
    kept = docs.join(stays, match)
    once = kept.where("_rows = 1").select(*[docs[c] for c in docs.columns])
    again = kept.where("_rows > 1").select(*[docs[c] for c in docs.columns]).dropDuplicates([id_col, text_col])
    return once if stays.where("_rows > 1").isEmpty() else once.unionByName(again)
