"""WARC archives: a writer that stores equal payloads once, and a reader that splits compressed archives.

`write_archives` writes one .warc.gz per task into a shared folder, a gzip member per record. The record of the least id with a payload
is a response, records of the same payload revisit it. `read_archives` cuts the files into byte ranges; a task searches its range for the gzip
magic, takes a candidate for a member only if it decodes to a WARC header, and owns the records that start inside the range,
reading on past its end for the last. The end of a member is where the next is expected, so later magics inside compressed data are
not even looked at; before the first member of a range they are refuted by decoding.

Files are written under another name and moved into place, so a task that runs twice leaves one file. The shared folder is
reached through pyarrow's file systems (file, hdfs, s3, gs).

Defined cases: a null payload is the empty one; a null url gives a record without target; a row without an id is a response unless
its payload has an owner, and has the id null again when read. Rows that repeat the least id of a payload are all responses. An empty table gives
no archive and no rows. A stored range that itself holds whole WARC members uncompressed (archives within archives) can be
mistaken for records at the start of a range.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SPLIT_BYTES = 8 << 20
_READ = 1 << 20
#: Fixed values of the gzip and WARC formats.
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:page:"


def sha1_base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """An uncompressed record: a response, or a revisit of record `first`."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page is None else page}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisit:
        fields += [f"WARC-Refers-To: <{_ID}{first}>", f"WARC-Profile: {_PROFILE}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse_record(data: bytes) -> dict:
    """The fields of a decoded record, and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http_head, _, body = block.partition(b"\r\n\r\n")
    kind = warc["warc-type"]
    own = re.fullmatch(rf"<{_ID}(-?\d*)>", warc.get("warc-record-id", ""))
    to = re.fullmatch(rf"<{_ID}(-?\d+)>", warc.get("warc-refers-to", ""))
    digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    return {
        "page_id": int(own[1]) if own and own[1] else None, "url": warc.get("warc-target-uri"), "payload": None if kind == "revisit" else body, "payload_bytes": int(_fields(http_head).get("content-length", len(body))), "payload_digest": digest,
        "record_type": kind, "refers_to": int(to[1]) if to else None, "intact": kind == "revisit" or sha1_base32(hashlib.sha1(body).hexdigest()) == digest,
    }


def records_in(read, size: int, start: int, end: int):
    """The decoded records whose gzip member starts in [start, end). read(offset, n): bytes of the archive."""
    at, data, base = start, bytearray(), start

    def more() -> bool:
        got = read(base + len(data), _READ) if base + len(data) < size else b""
        data.extend(got)
        return bool(got)

    while at < end:
        k = data.find(_MAGIC, at - base)
        if k < 0:
            at = max(at, base + len(data) - len(_MAGIC) + 1)
            data, base = data[at - base :], at
            if not more():
                return
            continue
        at = base + k
        if at >= end:
            return
        data, base = data[k:], at
        opened, out, fed, good = zlib.decompressobj(31), [], 0, True
        try:
            while not opened.eof:
                if fed == len(data) and not more():
                    good = False
                    break
                out.append(opened.decompress(data[fed:]))
                fed = len(data)
                if not b"".join(out[:2])[:7].startswith(_VERSION) and sum(map(len, out)) >= 7:
                    good = False
                    break
        except zlib.error:
            good = False
        whole = b"".join(out) if good else b""
        if good and whole.startswith(_VERSION):
            yield whole
            at = base + len(data) - len(opened.unused_data)
        else:
            at += 1
        data, base = data[at - base :], at


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def with_owners(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, first): first is the least id of an equal payload, null for itself and for short payloads."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("hex", F.sha1("payload"))
    # Only payloads that occur twice have anything to say; copies of a hot one are summed up before the shuffle.
    shared = own.where(F.octet_length("payload") >= min_bytes).groupBy("hex").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("hex", "least")
    both = own.join(shared, "hex", "left")
    return both.select("page_id", "url", "payload", "hex", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per page; (path, n_records, n_bytes) of each archive, written as the result is computed."""
    names = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}"
        temp, n, size, out = f"{name}.{uuid.uuid4().hex}.tmp", 0, 0, None
        for batch in batches:
            for page, url, payload, hexed, first in zip(*(c.to_pylist() for c in batch.columns)):
                packed = _gzip(record_bytes(page, url, payload, sha1_base32(hexed), first))
                out = out or store.open_output_stream(temp)
                out.write(packed)
                n, size = n + 1, size + len(packed)
        if out is not None:
            out.close()
            store.move(temp, f"{name}.warc.gz")
            yield C.batch_of(names, [[f"{name}.warc.gz"], [n], [size]])

    return with_owners(pages, min_bytes).mapInArrow(run, "path string, n_records long, n_bytes long")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per record of the .warc.gz files of a folder."""
    from pyarrow import fs

    store, root = _file_system(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    splits = [(f.path, f.size, s, min(f.size, s + split_bytes)) for f in found if f.path.endswith(".warc.gz") for s in range(0, f.size, split_bytes)]
    ranges = spark.createDataFrame(splits, "path string, size long, start long, end long")
    if splits:
        ranges = ranges.repartition(len(splits))

    def run(batches):
        store, _ = _file_system(folder)
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for data in records_in(lambda at, n, f=f: f.read_at(n, at), size, start, end):
                        rows.append(parse_record(data))
                        held += len(data)
                        if held > C.CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return ranges.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.new_folder(spark, "warc")
    write_archives(C.table(spark, sf_dir, "pages"), folder).agg(F.sum("n_records")).collect()
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
