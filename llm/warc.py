"""WARC archives: written with one gzip member per record, read back as a sequence of members.

Archives are rows (archive, content) of about ``ARCHIVE_BYTES`` of compressed records, the shape that
``spark.read.format("binaryFile")`` gives for files as well. Writing them as a table leaves commits and
retries to Spark. The reader takes one compressed member after the other, in pieces of ``PIECE`` bytes,
finds the header's end, frames the block by Content-Length and checks the digest on the way.

Payloads equal to that of a record with a larger id become revisits of it. For that, only (digest, largest
id) of payloads that occur more than once is joined to the pages. Digests that hold at least a
``HOT``-th of all pages are at most ``HOT`` rows and broadcast, so no task gets a hot payload's pages.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import keep, keep_table, small

ARCHIVE_BYTES = 8 << 20
PIECE = 1 << 16
HOT = 500
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with an empty block. Ids and the
    payload's length are in fields of their own, so that they return exactly."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def read_records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each member in turn. Raises BrokenArchive where a member is cut short, a
    length does not fit or a digest differs."""
    at = 0
    while at < len(content):
        unpack = zlib.decompressobj(31)
        head, fields, need, block = bytearray(), None, 0, bytearray()
        while not unpack.eof:
            if at >= len(content):
                raise BrokenArchive("the last member is cut short")
            piece = content[at : at + PIECE]
            try:
                out = unpack.decompress(piece)
            except zlib.error as error:
                raise BrokenArchive(f"member at byte {at}: {error}") from error
            at += len(piece) - len(unpack.unused_data)
            if fields is None:
                head += out
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    continue
                fields = _fields(bytes(head[:end]))
                need = int(fields["content-length"])
                out = bytes(head[end + 4 :])
            block += out
        if fields is None or len(block) != need + 4 or block[need:] != b"\r\n\r\n":
            raise BrokenArchive("a record's length differs from its Content-Length")
        payload = bytes(block[:need])
        if fields.get("warc-block-digest", "") != f"sha1:{digest(payload)}":
            raise BrokenArchive(f"digest of {fields.get('warc-record-id')} differs")
        if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise BrokenArchive(f"payload digest of {fields.get('warc-record-id')} differs")
        yield fields, payload


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise BrokenArchive("not a WARC record")
    pairs = (line.split(":", 1) for line in lines)
    fields = {k.strip().lower(): v.strip() for k, v in pairs}
    if not fields.get("content-length", "").isdigit():
        raise BrokenArchive("no Content-Length")
    return fields


def _heads(pages: DataFrame, key: str, html: str, least: int) -> tuple[DataFrame, Column]:
    """(print, head, n) of payloads that occur more than once, head the largest id; and the print's expression."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    print_ = F.when(F.octet_length(payload) >= least, F.sha1(payload.cast("binary")))
    groups = keep(
        pages.select(print_.alias("print"), F.col(f"`{key}`").alias("id"))
        .filter("print IS NOT NULL")
        .groupBy("print")
        .agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND head IS NOT NULL")
    )
    return groups, print_


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(archive, content) with a record per row of ``pages``, kept in the shared folder.

    The payload is the bytes of the html, null as empty. Of equal payloads of at least ``least`` bytes the
    records of the largest id are responses and the others revisit it; repeated rows of that id are all
    responses, and so is a group without any id. A null url is empty. Other columns are ignored. An
    empty table has no archives.
    """
    groups, print_ = _heads(pages, key, html, least)
    frame = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("binary").alias("html"), print_.alias("print"))
    if small(groups):
        frame = frame.join(F.broadcast(groups.select("print", "head")), "print", "left")
    else:
        total = groups.agg(F.sum("n")).first()[0]
        hot = groups.filter(F.col("n") * HOT >= total).select("print", F.col("head").alias("hot"))
        rest = groups.filter(F.col("n") * HOT < total).select(F.col("print").alias("own"), "head")
        frame = frame.join(F.broadcast(hot), "print", "left")
        # Rows that have no use for the second join get keys of their own, so that none is hot.
        own = F.when(F.col("print").isNotNull() & F.col("hot").isNull(), F.col("print")).otherwise(F.concat(F.lit("#"), F.xxhash64("id", "url").cast("string")))
        frame = frame.withColumn("own", own).join(rest, "own", "left").withColumn("head", F.coalesce("hot", "head"))
    refers = F.when(~F.col("id").eqNullSafe(F.col("head")), F.col("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.gz"]), pa.array([content], pa.binary())], ["archive", "content"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                one = [batch.column(k)[i].as_py() for k in range(4)]
                held.append(record(one[0], one[1], one[2] or b"", one[3]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return keep_table(
        frame.select(F.col("id").cast("long"), "url", "html", refers.cast("long").alias("refers")).mapInArrow(run, "archive string, content binary")
    )


def read_archives(archives: DataFrame, archive: str = "archive", content: str = "content") -> DataFrame:
    """(archive, record_id, record_type, refers_to, url, payload_bytes, payload_digest, block) per record.

    A broken archive, of which an empty member or a wrong digest are signs, fails the job with BrokenArchive.
    Null contents have no records. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])

        def number(value: str | None) -> int | None:
            inner = (value or "")[len("<urn:page:") : -1]
            return int(inner) if inner else None

        for batch in batches:
            for i in range(batch.num_rows):
                scalar = batch.column(1)[i]
                if not scalar.is_valid:
                    continue
                rows, size = [], 0
                for fields, block in read_records(memoryview(scalar.as_buffer())):
                    rows.append({
                        "archive": batch.column(0)[i].as_py(),
                        "record_id": number(fields["warc-record-id"]),
                        "record_type": fields["warc-type"],
                        "refers_to": number(fields.get("warc-refers-to")),
                        "url": fields.get("warc-target-uri"),
                        "payload_bytes": int(fields["warc-payload-length"]),
                        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                        "block": block,
                    })
                    size += len(block)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(F.col(f"`{archive}`").alias("archive"), F.col(f"`{content}`").alias("content")).mapInArrow(
        run,
        "archive string, record_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, block binary",
    )
