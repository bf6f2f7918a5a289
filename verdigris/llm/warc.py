"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive is a .warc.zst file: a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame per WARC record. The dictionary is built from records of the archive itself, a bounded sample spread
over its first buffer. The first record is a warcinfo record.

Equal payloads of ``min_revisit`` bytes or more are written once: the record with the smallest id is the response, the
others are revisit records that name its digest and its id. Payloads move in one shuffle, with what their record has
to be; each task writes archives of bounded size into the shared folder, under a name of its own, and only the names
that a finished task returns are read back, so a task that is run again leaves nothing that is read twice.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, shared_dir

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Bytes of records from which a dictionary is built, and after how many bytes of records an archive ends.
SAMPLE_BYTES, ARCHIVE_BYTES = 1 << 20, 64 << 20
LEVEL = 3
READ_TASKS = 20_000
MIN_REVISIT = 100


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    payload: bytes

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": self.kind, **self.headers, "Content-Length": str(len(self.payload))}.items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.payload + b"\r\n\r\n"

    @classmethod
    def parse(cls, raw: bytes) -> "Record":
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:20]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        payload = rest[: int(headers.pop("Content-Length"))]
        if rest[len(payload) :] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        return cls(headers.pop("WARC-Type"), headers, payload)


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from an even sample of the records; of few or short ones their own bytes, which Zstandard takes as they are."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, total // sample_bytes)
    samples = [r[: 64 << 10] for r in records[::step]]
    if len(samples) >= 8 and sum(map(len, samples)) >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=256, d=8, steps=1).as_bytes()
        except zstandard.ZstdError:  # samples too much alike to train on
            pass
    return b"".join(samples)[-size:]


class ArchiveWriter:
    """Collects records into one archive; ``add`` says when it is full."""

    def __init__(self, limit: int = ARCHIVE_BYTES):
        self.limit, self.size, self.records = limit, 0, [Record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n").to_bytes()]

    def add(self, record: Record) -> bool:
        raw = record.to_bytes()
        self.records.append(raw)
        self.size += len(raw)
        return self.size >= self.limit

    def to_bytes(self) -> bytes:
        import zstandard

        built = build_dictionary(self.records)
        out = io.BytesIO()
        out.write(struct.pack("<II", SKIPPABLE, len(built)) + built)
        engine = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(built), write_checksum=True, write_content_size=True)
        for raw in self.records:
            out.write(engine.compress(raw))
        return out.getvalue()


def read_archive(raw: bytes) -> Iterator[Record]:
    """The records of an archive, without its warcinfo."""
    import zstandard

    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("an archive does not begin with a dictionary frame")
    built = raw[8 : 8 + size]
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(built))
    rest = memoryview(raw)[8 + size :]
    while len(rest):
        one = engine.decompressobj()
        text = one.decompress(rest)
        if not one.eof:
            raise ValueError("an archive ends inside a record")
        rest = rest[len(rest) - len(one.unused_data) :]
        record = Record.parse(text)
        if record.kind != "warcinfo":
            yield record


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


def _header(text: str | None) -> str:
    """A value that fits in a header line."""
    return re.sub(r"[\r\n]+", " ", text or "").strip()


def _write_rows(rows: Iterable[dict], folder: str, limit: int) -> Iterator[dict]:
    store, at = _place(folder)
    store.create_dir(at, recursive=True)
    writer = ArchiveWriter(limit)

    def close() -> dict:
        name = f"{at}/{uuid.uuid4().hex}.warc.zst"
        raw = writer.to_bytes()
        with store.open_output_stream(name, compression=None) as out:
            out.write(raw)
        return {"archive": name, "records": len(writer.records) - 1, "bytes": len(raw)}

    for row in rows:
        key = "" if row["page_id"] is None else str(row["page_id"])
        headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {row["digest"]}')}>", "WARC-Page-ID": key, "WARC-Target-URI": _header(row["url"]), "WARC-Payload-Digest": f"sha256:{row['digest']}", "WARC-Payload-Length": str(row["size"])}
        if row["revisit"]:
            refers = "" if row["refers_to"] is None else str(row["refers_to"])
            headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers} {row["digest"]}')}>", "WARC-Refers-To-Page-ID": refers}
        full = writer.add(Record("revisit" if row["revisit"] else "response", headers, b"" if row["revisit"] else row["payload"]))
        if full:
            yield close()
            writer = ArchiveWriter(limit)
    if len(writer.records) > 1:
        yield close()


def write_warc(pages: DataFrame, *, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row and returns (archive, records, bytes), one row per archive.

    Null html is an empty payload; a payload is one record however long it is, and a task holds one archive and one
    payload at a time. Columns other than id, url and html are ignored, whatever their names. Of equal payloads of ``min_revisit`` bytes or more the row with the smallest id is
    the response, one of them if the id is repeated; rows with a null id come after all others. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/verdigris-warc-{uuid.uuid4().hex}"
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # Which row of equal payloads comes first is found from ids and digests alone; payloads move once, to meet it.
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "url")
    known = rows.where(F.col("size") >= min_revisit).select("digest", place.alias("place"))
    groups = known.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    mine = rows.join(groups, "digest", "left").withColumn("later", F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    same = known.groupBy("digest", "place").agg(F.count("*").alias("copies")).where("copies > 1")
    same = materialize(same.select(F.col("digest").alias("_digest"), F.col("place").alias("_place"), "copies"), "repeated")
    if not same.isEmpty():  # rows alike in id, url and payload: one of them stands for all, and is written as often as it comes
        match = (F.col("digest") == F.col("_digest")) & place.eqNullSafe(F.col("_place"))
        once = mine.join(same, match, "left_anti")
        again = mine.join(same, match).dropDuplicates(["digest", "page_id", "url"]).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        mine = once.unionByName(again.withColumn("later", F.col("later") | (F.col("_nth") > 1)).drop("_digest", "_place", "copies", "_nth"))
    laid = mine.select("page_id", "url", "payload", "digest", "size", F.col("later").alias("revisit"), F.when(F.col("later"), F.col("first.page_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    yield from batch.slice(lo, 256).to_pylist()

        for done in _write_rows(every(), folder, archive_bytes):
            yield pa.RecordBatch.from_pylist([done], schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    store = _scheme(folder)
    return materialize(laid.mapInArrow(run, "archive string, records bigint, bytes bigint"), "archives").withColumn("archive", F.concat(F.lit(store), "archive"))


def _scheme(folder: str) -> str:
    """What has to stand before a path of ``folder``'s store to make a URI of it."""
    found = re.match(r"([a-z][a-z0-9+.-]*:(//[^/]*)?)", folder)
    return found[1] if found else ""


def read_warc(archives: DataFrame, *, id_type: str = "bigint") -> DataFrame:
    """(page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload) of every record of the archives.

    The digest of a response is computed from the payload that was read; one that isn't what its header says is an error.
    A revisit has no payload of its own: its size and digest are those of the payload it refers to, from its headers.
    Archives are read side by side, at most READ_TASKS tasks of them; no archives give no rows.
    """
    schema = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def row(record: Record) -> dict:
        digest, size = record.headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(record.headers["WARC-Payload-Length"])
        if record.kind == "response" and (hashlib.sha256(record.payload).hexdigest() != digest or len(record.payload) != size):
            raise ValueError(f"damaged payload in {record.headers['WARC-Record-ID']}")
        return {"page_id": record.headers["WARC-Page-ID"] or None, "record_type": record.kind, "url": record.headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "refers_to": record.headers.get("WARC-Refers-To-Page-ID") or None, "payload": record.payload if record.kind == "response" else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _place(path)
                with store.open_input_stream(at, compression=None) as f:
                    raw = f.read()
                held = []
                for record in read_archive(raw):
                    held.append(row(record))
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    names = archives.select("archive")
    spread = names.repartition(max(1, min(names.count(), READ_TASKS)))  # a number of its own, so that no small table ends up in one task
    out = spread.mapInArrow(run, "page_id string, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
