"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the bytes before a white-space run says so, so that passages that documents
share are cut alike wherever they stand. A chunk that any earlier document of the worker process held is not encoded
again. A chunk seen for the first time is itself cut into fine chunks (at every white-space run), and each different
one is encoded once, many in one call. Neighbouring chunks are then joined: the last fine chunk on the left and the
first on the right are re-encoded together, once for each different pair; if that differs from what the chunks gave,
both chunks are merged and encoded whole, and the merged chunk is joined again, until the join agrees exactly.

Chunks are shared within a worker process, by bounded caches that only save work: results don't depend on them, on
partitioning or on lost executors. They are not shuffled to be shared by the whole corpus: of the characters of the
check input 90 % stand in different chunks of 1,100 characters and 83 % in different ones of 100, so a shuffle would
move more text than it saves the encoding of.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _textvec as tv

#: A chunk ends at a white-space run where the hash of the 16 bytes before it has these bits zero.
COARSE_MASK = 0xFF
#: Entries of each generation of a cache.
FINE_ENTRIES, COARSE_ENTRIES = 300_000, 4_000
#: Longer chunks aren't kept: a text without white space is one chunk.
COARSE_BYTES = 16_384
_WINDOW = 16
#: Stands between fine chunks that are encoded in one text, where their last ids don't say so themselves; those that hold it are encoded alone.
_MARK = "\x01"


def tokenizer_path() -> str:
    """The vocabulary file of the encoding queries; VERDIGRIS_TOKENIZER names another."""
    named = os.environ.get("VERDIGRIS_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: Bytes of text that are encoded at once.
SLICE = 1 << 18
_SPACE = b" \t\n\r\x0b\x0c"


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers: what the caches hold of a chunk."""
    return np.array(ids, np.int32).tobytes()


class _Cache(dict):
    """A dict of two generations: a full one becomes the older, of which what is asked for again is kept."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def turn(self) -> None:
        """To be called between uses, not while entries are gathered."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()

    def known(self, keys: list) -> tuple[list, list[int]]:
        """The entries of keys, and which of the keys have none."""
        found = list(map(self.get, keys))
        missing = [i for i, entry in enumerate(found) if entry is None] if None in found else []
        if self.older and missing:
            for i in missing:
                if (entry := self.older.get(keys[i])) is not None:
                    found[i] = self[keys[i]] = entry
            missing = [i for i in missing if found[i] is None]
        return found, missing


class ChunkCodec:
    """Encodes and decodes whole texts exactly as the tokenizer file's own library does."""

    def __init__(self, path: str, fine_entries: int = FINE_ENTRIES, coarse_entries: int = COARSE_ENTRIES, reuse: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.reuse = reuse
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.number = [str(i).encode() for i in range(size)]
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.plain_decoder = config.get("decoder") is None
        self.separable = self._separable(config)
        mark = self._library(_MARK)
        self.mark = mark[0] if len(mark) == 1 and self._library(f"a {_MARK} a") == [*self._library("a"), *mark, *self._library("a")] else None
        suffix = config["model"].get("end_of_word_suffix")
        self.last = np.array([bool(suffix) and t.endswith(suffix.encode()) for t in self.token]) if suffix else None
        self.fine: _Cache = _Cache(fine_entries)
        self.coarse: _Cache = _Cache(coarse_entries)
        self.joins: _Cache = _Cache(fine_entries // 4)

    @staticmethod
    def _separable(config: dict) -> bool:
        """True if white space is dropped before merging, so that fine chunks cannot influence each other."""
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [config.get("pre_tokenizer") or {}]
        first = steps[0]
        added = [t["content"] for t in config.get("added_tokens", [])]
        return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "\\s" in first["pattern"].get("Regex", "") and not any(c.isspace() for t in added for c in t)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Puts different fine chunks that aren't known into the cache; a few hundred are encoded in one text."""
        words, marked, alone = [], [], pieces
        if self.separable:
            texts = [p.decode() for p in pieces]
            letters = [self.last is not None and t.isalpha() for t in texts]
            words = [t for t, w in zip(texts, letters, strict=True) if w]  # what is letters only is merged as one
            marked = [t for t, w in zip(texts, letters, strict=True) if not w and self.mark is not None and _MARK not in t]
            alone = [p for p, t, w in zip(pieces, texts, letters, strict=True) if not w and (self.mark is None or _MARK in t)]
        alone = alone + self._split(words, " ") + self._split(marked, f" {_MARK} ")
        for piece, ids in zip(alone, self._batch([p.decode() for p in alone]), strict=True):
            self.fine[piece] = packed(ids)

    def _split(self, words: list[str], between: str) -> list[bytes]:
        """Encodes groups of fine chunks, cut again at the ids that end them; those of groups that can't be cut are returned."""
        failed = []
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, ids in zip(groups, self._batch([between.join(g) for g in groups]), strict=True):
            code = np.array(ids, np.int32)
            skip = 0 if between == " " else 1
            ends = (np.append(np.flatnonzero(code == self.mark), len(code)) if skip else np.flatnonzero(self.last[code]) + 1).tolist()
            if len(ends) != len(group):
                failed += [w.encode() for w in group]
                continue
            raw, a = code.tobytes(), 0
            for word, b in zip(group, ends, strict=True):
                self.fine[word.encode()] = raw[4 * a : 4 * b]
                a = b + skip
        return failed

    def _fine(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of fine chunks."""
        found, missing = self.fine.known(pieces)
        if missing:
            self._learn(list(dict.fromkeys([pieces[i] for i in missing])))
            for i in missing:
                found[i] = self.fine[pieces[i]]
        return found

    def _agree(self, pairs: list[tuple[bytes, bytes]]) -> list[bool]:
        """For (left, right) around a join, whole fine chunks next to it, whether encoding across gives what both sides give alone.

        The right side begins with its white space.
        """
        keys = [a + b for a, b in pairs]  # the left side has no white space, so each pair is a key of its own
        found, missing = self.joins.known(keys)
        new = list(dict.fromkeys([pairs[i] for i in missing]))
        sides = self._fine([x for a, b in new for x in (a, b.lstrip(_SPACE))]) if self.separable else []
        for i, ((left, right), ids) in enumerate(zip(new, self._batch([(a + b).decode() for a, b in new]), strict=True)):
            if self.separable:
                alone = sides[2 * i] + sides[2 * i + 1]
            else:
                alone = packed(self._library(left.decode()) + self._library(right.decode()))
            self.joins[left + right] = packed(ids) == alone
        for i in missing:
            found[i] = self.joins[keys[i]]
        return found

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The packed ids of the texts of one buffer of bytes."""
        raw = data.tobytes()
        if not self.reuse:
            return [packed(self._library(raw[a:b].decode())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        _, starts, ends, first = tv.words(data, offsets)
        up, down = tv.powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(tv.BYTE[data] * up[: len(data)], out=total[1:])
            begin = np.maximum(ends - _WINDOW, np.repeat(offsets[:-1], np.diff(first)))
            rolled = tv.mix((total[ends] - total[begin]) * down[begin])
        last = np.zeros(len(ends), bool)  # the last word of a text always ends a chunk, with the white space behind it
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        stop = np.flatnonzero(last | ((rolled & np.uint64(COARSE_MASK)) == 0))
        edge = ends[stop].copy()
        row = np.searchsorted(first, stop, side="right") - 1
        edge[last[stop]] = offsets[1:][row[last[stop]]]
        opens = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        left = np.concatenate([[0], edge[:-1]])
        left[opens] = offsets[:-1][row[opens]]
        chunks = [raw[a:b] for a, b in zip(left.tolist(), edge.tolist(), strict=True)]
        for cache in (self.fine, self.coarse, self.joins):
            cache.turn()
        entries = self._chunks(raw, chunks, np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop, stop + 1, starts, ends)
        inner = np.flatnonzero(~opens)
        pairs = [(raw[starts[stop[i - 1]] : ends[stop[i - 1]]], raw[ends[stop[i - 1]] : ends[stop[i - 1] + 1]]) for i in inner.tolist()]
        broken = {int(i) for i, ok in zip(inner, self._agree(pairs), strict=True) if not ok}
        out, at = [], np.searchsorted(row, np.arange(len(offsets))).tolist()
        for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a == b and not self.separable:  # white space alone may have tokens too
                out.append(packed(self._library(raw[offsets[r] : offsets[r + 1]].decode())))
                continue
            done: list[tuple[bytes, bytes, bool]] = []  # the last says whether it has been merged
            for i in range(a, b):
                chunk, entry, merged = chunks[i], entries[i], False
                while done and not (self._join_whole(done[-1][0], chunk) if merged or done[-1][2] else i not in broken):
                    chunk, merged = done.pop()[0] + chunk, True
                    entry = packed(self._library(chunk.decode()))
                done.append((chunk, entry, merged))
            out.append(b"".join([e for _, e, _ in done]))
        return out

    def _join_whole(self, left: bytes, right: bytes) -> bool:
        """Whether merged chunks, whole, encode as they do apart."""
        a, b = left.decode(), right.decode()
        return self._library(a + b) == self._library(a) + self._library(b)

    def _chunks(self, raw: bytes, chunks: list[bytes], begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The packed ids of chunks, of which chunk i holds the words from begin[i] to end[i]."""
        found, missing = self.coarse.known(chunks)
        new = {chunks[i]: i for i in missing}
        known: dict[bytes, bytes] = {}
        if self.separable:
            at = [(int(begin[i]), int(end[i])) for i in new.values()]
            s, e = starts.tolist(), ends.tolist()
            entries = self._fine([raw[s[w] : e[w]] for a, b in at for w in range(a, b)])
            place = 0
            for chunk, (a, b) in zip(new, at, strict=True):
                known[chunk] = b"".join(entries[place : place + b - a])
                place += b - a
        else:
            for chunk, ids in zip(new, self._batch([c.decode() for c in new]), strict=True):
                known[chunk] = packed(ids)
        self.coarse.update((c, e) for c, e in known.items() if len(c) <= COARSE_BYTES)
        return [known[c] if e is None else e for c, e in zip(chunks, found, strict=True)]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; a null text has none."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        return np.frombuffer(self.encode_slice(data, np.array([0, len(data)]))[0], np.int32).tolist()

    def numbers(self, ids: list[int]) -> bytes:
        """Decimal ids with one space between."""
        return b" ".join([self.number[i] for i in ids])

    def decoded(self, ids: list[int]) -> bytes:
        """What the ids decode to, in UTF-8."""
        if self.plain_decoder:
            return b" ".join([self.token[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False).encode()

    def decode(self, ids: list[int]) -> str:
        return self.decoded(ids).decode()


def _codec(path: str) -> ChunkCodec:
    """The worker's codec; it and its caches serve tasks until another operator's come."""
    codecs = tv.kept("bpe")
    if path not in codecs:
        codecs[path] = ChunkCodec(path)
    return codecs[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, (ids,) ids_sha256 and decoded_sha256.

    Texts that are null or empty have no tokens and the digests of the empty string. Repeated rows give repeated
    rows, an empty table none; other columns are ignored whatever their names. The tokenizer file must be at
    ``tokenizer_path`` on every executor. Nothing is shuffled; memory is bounded by the caches and a few times the
    longest text, which is encoded whole.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_path)
        for batch in batches:
            for lo, hi, data, offsets in tv.text_slices(batch.column(1), SLICE):
                done = codec.encode_slice(data, offsets)
                sizes = np.array([len(e) // 4 for e in done], np.int64)
                digests = []
                for e in done:
                    ids = np.frombuffer(e, np.int32).tolist()
                    digests.append((hashlib.sha256(codec.numbers(ids)).hexdigest(), hashlib.sha256(codec.decoded(ids)).hexdigest()))
                columns = {"id": batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array(sizes)}
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.frombuffer(b"".join(done), np.int32))
                columns["ids_sha256"] = pa.array([d[0] for d in digests], pa.string())
                columns["decoded_sha256"] = pa.array([d[1] for d in digests], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    ids = "ids array<int>, " if keep_ids else ""
    out = source.mapInArrow(run, f"id {kind}, n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
