"""WARC archives whose records are compressed one by one with a Zstandard dictionary.

Every archive starts with a skippable frame that holds a dictionary trained on the archive's own first records; each
record is a frame of its own, so one record can be read without the others. Of pages with equal payloads (compared by
SHA-256) one is written as `response`, the others as `revisit` records that name it and hold no payload.

Archives are files in the session's shared folder, named per attempt; the manifest, a table written with Spark's commit,
lists the complete ones only, so lost executors and repeated tasks leave no half-written or doubled archive in it.

A null html is an empty payload. Among rows with one id and payload one is the response. Null ids rank lowest, and a
revisit of a page without id names none. A null url is written as `urn:page:<id>`. An empty table gives no archives and
an empty result. Extra columns are not read. Archives of few or tiny records have no dictionary; nothing is cut.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import flag_maybe, keep, parts, text_of, work_folder

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 0
#: An archive is closed after this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is fitted to at most so many of an archive's first records, so many bytes of each, and so many bytes in all.
FIT_RECORDS, FIT_EACH, FIT_BYTES, DICTIONARY = 200, 16_384, 1_000_000, 32_768
#: Groups that hold at least one row in so many are joined by broadcast: there are at most that many.
HOT_GROUPS = 1_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE = 0x184D2A5D
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def staged(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The pages with payload, its length and digests, and a row number, written once: what is decided later holds for these rows."""
    payload = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    return keep(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", size.alias("size"),
                            F.sha1(F.col("payload").cast("binary")).alias("sha1"),
                            F.when(size >= least_bytes, F.sha2("payload", 256)).alias("key"), "payload"), "pages")


def decided(rows: DataFrame) -> DataFrame:
    """Staged rows with `lead_id`, `lead_row` of the response they revisit (lead_row null: a response itself).

    Rows of payloads that occur once are not shuffled, nor are those of the most common payloads.
    """
    narrow = rows.where("key IS NOT NULL")
    # of repeated rows with the largest id, the one written first leads
    groups = keep(narrow.groupBy("key").agg(F.max(F.struct("page_id", (-F.col("row")).alias("back"))).alias("lead"),
                                            F.count(F.lit(1)).alias("n"))
                  .where("n > 1").select("key", F.col("lead.page_id").alias("lead_id"), (-F.col("lead.back")).alias("lead_row"), "n"), "payloads")
    total = rows.count()
    is_hot = F.col("n") * HOT_GROUPS >= total
    hot = groups.where(is_hot).drop("n")
    marked = flag_maybe(rows, F.coalesce("key", F.lit("")), groups, "key")
    near = marked.withColumn("_maybe", F.col("_maybe") & F.col("key").isNotNull()).join(F.broadcast(hot), "key", "left")
    settled = ~F.col("_maybe") | F.col("lead_row").isNotNull()
    far = near.where(~settled).drop("lead_id", "lead_row").join(groups.where(~is_hot).drop("n"), "key", "left")
    names = ["row", "page_id", "url", "size", "sha1", "lead_id", "lead_row", "payload"]
    itself = F.col("lead_row").isNull() | (F.col("lead_row") == F.col("row"))
    return near.where(settled).select(names).unionByName(far.select(names)).select(
        "row", "page_id", "url", "size", "sha1", F.when(~itself, F.col("lead_id")).alias("lead_id"),
        F.when(~itself, F.col("lead_row")).alias("lead_row"), F.when(itself, F.col("payload")).alias("payload"))


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{row}'.encode()).hexdigest())}>"


def _target(url: str | None, page_id: int | None) -> str:
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{'' if page_id is None else page_id}"


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record(row: dict) -> bytes:
    """One WARC record of a decided row."""
    revisit = row["lead_row"] is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(row["page_id"], row["row"])),
            ("WARC-Date", DATE), ("WARC-Target-URI", _target(row["url"], row["page_id"])),
            ("WARC-Payload-Digest", f"sha1:{_base32(row['sha1'])}"), ("X-Payload-Length", str(row["size"]))]
    if row["page_id"] is not None:
        head.append(("X-Page-Id", str(row["page_id"])))
    body = _HTTP % row["size"]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["lead_id"], row["lead_row"]))]
        if row["lead_id"] is not None:
            head.append(("X-Refers-To-Page", str(row["lead_id"])))
    else:
        body += row["payload"].encode()
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + body + b"\r\n\r\n"


_INFO_BODY = b"software: parley\r\nformat: WARC File Format 1.1\r\n"
_INFO = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(int=0)}>\r\nWARC-Date: {DATE}\r\n"
         f"Content-Type: application/warc-fields\r\nContent-Length: {len(_INFO_BODY)}\r\n\r\n").encode() + _INFO_BODY + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on records, none where they are too few or too small for one."""
    cut = [s[:FIT_EACH] for s in samples]
    size = min(DICTIONARY, sum(map(len, cut)) // 8)
    if len(cut) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, cut)
    except zstandard.ZstdError:  # the records have too little in common
        return None


class _Archive:
    """One file: dictionary frame, then a frame a record."""

    def __init__(self, folder: str, samples: list[bytes]) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, path = _files(self.uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.bytes, self.records = files.open_output_stream(path, compression=None), 0, 0
        fitted = dictionary(samples)
        if fitted is not None:
            raw = fitted.as_bytes()
            self._put(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
            self.press = zstandard.ZstdCompressor(level=3, dict_data=fitted, write_checksum=True)
        else:
            self.press = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._put(self.press.compress(_INFO))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.press.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.bytes


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a plain local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _writer(folder: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, archive = 0, None

        def opened() -> _Archive:
            new = _Archive(folder, held)
            for data in held:
                new.add(data)
            held.clear()
            return new

        def told(done: _Archive) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done.close(), _MANIFEST.types)], schema=_MANIFEST)

        for batch in batches:
            for at in range(batch.num_rows):
                data = record({name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)})
                if archive is None:
                    held.append(data)
                    size += len(data)
                    if len(held) >= FIT_RECORDS or size >= FIT_BYTES:
                        archive, size = opened(), 0
                else:
                    archive.add(data)
                if archive is not None and archive.bytes >= most:
                    yield told(archive)
                    archive = None
        if held:
            archive = opened()
        if archive is not None:
            yield told(archive)

    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages (page_id, url, html) as archives; the manifest (archive, records, bytes) of the complete ones."""
    folder = folder or f"{work_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = decided(staged(pages, least_bytes))
    return keep(rows.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "manifest")


def frames(source, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive read from a stream, each decompressed alone with the dictionary of the leading frame."""
    data = source.read(chunk)
    reader = zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = 8 + struct.unpack_from("<I", data, 4)[0]
        while len(data) < size:
            more = source.read(max(chunk, size - len(data)))
            if not more:
                raise ValueError("the archive ends inside its dictionary")
            data += more
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:size]))
        data = data[size:]
    while True:
        data = data or source.read(chunk)
        if not data:
            return
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            data = data or source.read(chunk)
            if not data:
                raise ValueError("the archive ends inside a record")
            out.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def parsed(data: bytes) -> dict | None:
    """Fields of a response or revisit record, checked against its own lengths and digest; None for other records."""
    head, body = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    told = dict(line.split(": ", 1) for line in lines)
    size = int(told["Content-Length"])
    if not version.startswith("WARC/") or len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if told["WARC-Type"] not in ("response", "revisit"):
        return None
    payload = body[:size].split(b"\r\n\r\n", 1)[1] if told["WARC-Type"] == "response" else None
    digest, length = told["WARC-Payload-Digest"].removeprefix("sha1:"), int(told["X-Payload-Length"])
    if payload is not None and (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, length):
        raise ValueError(f"payload of {told['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(told[name]) if name in told else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": length, "payload_digest": digest, "record_type": told["WARC-Type"],
            "refers_to": number("X-Refers-To-Page"), "url": told["WARC-Target-URI"], "payload": None if payload is None else payload.decode()}


def _reader(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                files, path = _files(uri)
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as source:
                    for data in frames(source):
                        row = parsed(data)
                        if row is None:
                            continue
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or "")
                        if len(rows) >= 1000 or size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every page record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    spark: SparkSession = manifest.sparkSession
    return manifest.select("archive").repartition(parts(spark)).mapInArrow(_reader(with_payload), READ)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the pages, read the archives back: one row per page, without its payload."""
    return read(write(pages, least_bytes=least_bytes), False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
