"""WARC archives: written with a gzip member per record, read back sequentially.

Writing: every task streams its pages into archive files of a bounded size in a shared folder; a
file gets its final name only when it is whole, so a task that is repeated leaves no half files.
Pages that repeat the payload of another become revisit records that refer to it.

Reading: one task per archive walks through it record by record, inflating one member after the
other as bytes come in. Records are framed by their Content-Length; the digests of the block and of
the payload are checked, and so is that nothing is left over in a member.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, new_path, qualified

READ_BYTES = 64 << 10
#: Bytes of a written archive after which the next file is begun.
ARCHIVE_BYTES = 32 << 20
#: Smaller payloads are never written as revisits.
MIN_REVISIT_BYTES = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format or doesn't match its digests."""


def _one_line(value: str) -> str:
    """A header's value: white space and control signs would break the framing, or be stripped."""
    return re.sub(r"[%\s\x00-\x1f\x7f]", lambda m: quote(m[0], safe=""), value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One record as a gzip member. A revisit's block has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"),
        ("WARC-Date", RECORD_DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>"),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _members(source: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The inflated bytes of each gzip member, piece by piece. Each must be read to its end."""
    held = source.read(READ_BYTES)
    while held:
        inflate = zlib.decompressobj(31)

        def pieces(inflate=inflate):
            nonlocal held
            while not inflate.eof:
                if not held and not (held := source.read(READ_BYTES)):
                    raise WarcError("the archive ends inside a record")
                out = inflate.decompress(held, READ_BYTES)
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out
            if not held:
                held = source.read(READ_BYTES)

        yield pieces()


def _headers(lines: Iterable[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]!r}")
        found[name.decode().strip().lower()] = value.decode().strip()
    return found


def read_records(source: BinaryIO) -> Iterator[dict]:
    """The records of an archive in order; every digest has been checked.

    Payloads are hashed while they are inflated and kept as a whole (``payload``), since a record's
    payload is one value of the result; nothing else is held.
    """
    for pieces in _members(source):
        held = bytearray()
        seen = 0  # where the header's end has been looked for
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not (more := next(pieces, b"")):
                raise WarcError("a record without a header's end")
            held += more
        held = bytes(held)
        version, *lines = held[:end].split(b"\r\n")
        if version != VERSION:
            raise WarcError(f"not a record: {version[:40]!r}")
        headers = _headers(lines)
        left = int(headers["content-length"])
        held = held[end + 4 :]
        block_hash, payload_hash, http, payload = hashlib.sha256(), hashlib.sha256(), b"", []
        while True:
            part, held = held[:left], held[left:]
            left -= len(part)
            block_hash.update(part)
            if http is not None:
                http += part
                if (cut := http.find(b"\r\n\r\n")) >= 0:
                    http_headers, part, http = _headers(http[:cut].split(b"\r\n")[1:]), http[cut + 4 :], None
            if http is None:
                payload_hash.update(part)
                payload.append(part)
            if not left:
                break
            if not (held := next(pieces, b"")):
                raise WarcError("a block shorter than its Content-Length")
        for more in pieces:
            held += more
        if held != b"\r\n\r\n":
            raise WarcError("a record that doesn't end after its block")
        if http is not None:
            raise WarcError("a block without HTTP headers")
        if headers["warc-block-digest"] != f"sha256:{block_hash.hexdigest()}":
            raise WarcError("a block that doesn't match its digest")
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        whole = headers["warc-type"] != "revisit"
        if whole and digest != payload_hash.hexdigest():
            raise WarcError("a payload that doesn't match its digest")
        yield {
            "page_id": int(headers["x-page-id"]) if "x-page-id" in headers else None,
            "url": unquote(headers["warc-target-uri"]) if "warc-target-uri" in headers else None,
            "record_type": headers["warc-type"],
            "payload_bytes": int(http_headers["content-length"]),
            "payload_digest": digest,
            "refers_to": int(headers["x-refers-to-page-id"]) if "x-refers-to-page-id" in headers else None,
            "payload": b"".join(payload) if whole else None,
        }


def page_roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size, refers_to) of every page that revisits another.

    Only ids and digests are shuffled. The smallest page_id of a digest is the response, in all its
    rows; pages without an id are responses too.
    """
    seen = materialize(
        pages.select(F.col("page_id").alias("id"), F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size"))
        .where((F.col("size") >= MIN_REVISIT_BYTES) & F.col("id").isNotNull()),
        "digests",
    )
    first = (
        seen.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("last > refers_to")
    )
    return (
        seen.join(first, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()
    )


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html); return (archive, records, bytes) of each file.

    ``path`` is a folder that all executors share, as Spark understands it; any store that pyarrow can
    write to does. Null html is an empty payload; urls and payloads of any length and content come back
    as they were. Rows that repeat a page_id are records of their own. Extra columns are not read.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    roles = page_roles(source).withColumnRenamed("id", "page_id")
    digested = source.withColumn("digest", F.sha2("payload", 256))
    rows = digested.join(roles, ["page_id", "digest"], "left").select(
        "page_id",
        "url",
        "digest",
        "refers_to",
        F.length("payload").cast("long").alias("size"),
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )

    uri = qualified(pages.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = uuid.uuid4().hex
                    begun, final = f"{folder}/_{name}.part", f"{folder}/{name}.warc.gz"
                    out, records, size = store.open_output_stream(begun), 0, 0
                packed = record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["refers_to"], row["size"])
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    store.move(begun, final)
                    yield pa.RecordBatch.from_pydict({"archive": [final], "records": [records], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            store.move(begun, final)
            yield pa.RecordBatch.from_pydict({"archive": [final], "records": [records], "bytes": [size]})

    return materialize(rows.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records of the listed archives, one task per few files; see ``read_records``."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")] + ["payload"] * payloads
    kinds = pa.schema(
        [
            pa.field(n, {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}.get(n, pa.string()))
            for n in names
        ]
    )

    uri = qualified(archives.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                with store.open_input_stream(name, compression=None) as source:
                    rows, size = [], 0
                    for found in read_records(source):
                        rows.append({n: found[n] for n in names})
                        size += 200 + len(found["payload"] or b"") * payloads
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    spark = archives.sparkSession
    tasks = max(1, min(archives.count(), spark.sparkContext.defaultParallelism * 64))
    return archives.repartition(tasks, "archive").mapInArrow(run, schema + ", payload binary" * payloads)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them; one row per record."""
    path = new_path(spark, "warc")
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(written, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = {
    "op4_warc": f"""
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
    FROM (
      SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first
      FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages))"""
}
