"""Seekable Zstandard WARC bundles.

Records are packed into bundles: runs of independent Zstandard frames followed by a skippable frame that
holds the seek table (compressed and decompressed size of each frame, frame count, descriptor, magic
number). Any frame can be decompressed alone. The record index maps each record identifier to its bundle,
frame and offset within the decompressed frame, so that one record is read by seeking to one frame.

Bundles are rows of a Parquet table in the shared folder: the writer's commit protocol makes a lost
executor's work repeatable, and any executor can read them back.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_bytes

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

MIN_REVISIT = 100
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
CAPTURED = "1970-01-01T00:00:00Z"  # for tables that don't say when a page was fetched

BUNDLE = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, body binary"


def _uri(url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else ""


def encode_record(page_id, url, payload: bytes, digest: str, first=None, first_url: str | None = None, place: str = "", captured: str = CAPTURED) -> tuple[str, bytes]:
    """A WARC/1.1 record and its identifier, which `place` tells apart from a repeated row's. A revisit record names the response it refers to and has no body."""
    target = _uri(url)
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{target}|{digest}|{place}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {captured}"]
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {captured}", f"X-Refers-To-Page: {first}"]
        if first_url:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(first_url)}")
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return record_id, "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decode_record(frame: bytes, offset: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record at `offset`."""
    head = frame.index(b"\r\n\r\n", offset)
    fields = dict(line.split(": ", 1) for line in frame[offset:head].decode().split("\r\n")[1:])
    end = head + 4 + int(fields["Content-Length"])
    return fields, frame[head + 4 : end], end + 4


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames and their seek table."""
    table = b"".join(struct.pack("<II", len(data), size) for data, size in frames)
    table += struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return b"".join(data for data, _ in frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed size and decompressed size of each frame, from the footer alone."""
    count, descriptor, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC or descriptor & 0x7F:
        raise ValueError("not a seekable Zstandard bundle without checksums")
    at, found = 0, []
    for packed, size in struct.iter_unpack("<II", content[-9 - 8 * count : -9]):
        found.append((at, packed, size))
        at += packed
    return found


def read_frame(content: bytes, frame: int) -> bytes:
    """Decompress one frame; no other is touched."""
    import zstandard

    start, packed, size = seek_table(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=size)


def _digests(batches):
    for batch in batches:
        html = text_bytes(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([hashlib.sha256(h).hexdigest() for h in html]), pa.array([len(h) for h in html], pa.int64())],
            names=["page_id", "url", "html", "digest", "n_bytes"],
        )


def _bundles(captured: str):
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        packer, part, done = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        frames, records, buffer, size = [], [], bytearray(), 0

        def close_frame():
            nonlocal buffer, size
            if buffer:
                frames.append((packer.compress(bytes(buffer)), len(buffer)))
                size += len(frames[-1][0])
                buffer = bytearray()

        def close_bundle():
            nonlocal frames, records, size
            close_frame()
            content = seal(frames)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            row = pa.RecordBatch.from_pylist([{"bundle": name, "content": content, "records": records}], schema=schema)
            frames, records, size = [], [], 0
            return row

        schema = pa.schema(
            [("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))]
        )
        for batch in batches:
            pages = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            for page_id, url, html, digest, first, first_url in pages:
                done += 1
                record_id, data = encode_record(page_id, url, html, digest, first, first_url, f"{part}:{done}", captured)
                records.append({"record_id": record_id, "frame": len(frames), "offset": len(buffer), "length": len(data)})
                buffer += data
                if len(buffer) >= FRAME_BYTES:
                    close_frame()
                    if size >= BUNDLE_BYTES:
                        yield close_bundle()
        if records:
            yield close_bundle()

    return run


def _records(batches):
    for batch in batches:
        for content, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, frame, data = [], -1, b""
            for entry in index:
                if entry["frame"] != frame:
                    frame, data = entry["frame"], read_frame(content, entry["frame"])
                fields, body, _ = decode_record(data, entry["offset"])
                page, first, kind = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page"), fields["WARC-Type"]
                rows.append(
                    {
                        "page_id": int(page) if page is not None else None,
                        "payload_bytes": len(body) if kind == "response" else int(fields["X-Payload-Length"]),
                        "payload_digest": hashlib.sha256(body).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        "record_type": kind,
                        "refers_to": int(first) if first is not None else None,
                        "url": fields.get("WARC-Target-URI"),
                        "record_id": fields["WARC-Record-ID"],
                        "body": body,
                    }
                )
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("body", pa.binary())]
)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: str = CAPTURED) -> DataFrame:
    """Bundles of one WARC record per row: bundle, content, records (the index); written to the shared folder.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least MIN_REVISIT bytes the
    one with the smallest id is a response and the others are revisits of it; shorter ones are all responses.
    Rows that repeat that smallest id are responses too; a row without id can only be the response if no row
    of its group has one, and then all of them are. Repeated rows have records of their own. `captured` is the records'
    date. Payloads are kept whole, however long: a frame ends behind the record that fills it. Other columns are ignored. An
    empty table gives no bundles.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.mapInArrow(_digests, "page_id long, url string, html string, digest string, n_bytes long")
    copies = (
        rows.select("page_id", "url", "digest", "n_bytes")
        .where(F.col("n_bytes") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("copy_digest"), "first", "first_url")
    )
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    packed = rows.join(copies, F.col("digest") == F.col("copy_digest"), "left").select("page_id", "url", "html", "digest", first, "first_url")
    return materialise(packed.mapInArrow(_bundles(captured), BUNDLE), "warc")


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id → bundle, frame, offset within the decompressed frame, length."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def read_archives(bundles: DataFrame) -> DataFrame:
    """One row per record, parsed from the frames (schema RECORD)."""
    return bundles.select("content", "records").mapInArrow(_records, RECORD)


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


def op4_warc(spark, sf_dir):
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
