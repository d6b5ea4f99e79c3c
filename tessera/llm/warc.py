"""Operator 10, WARC: seekable Zstandard bundles with a frame index."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_key, materialize, ship, small_batches

# Fixed values of the seekable format: a skippable frame at the end of the file
# holds an entry for each frame, the number of frames, a descriptor and a magic number.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLES = "bundle string, body binary, records array<struct<id:long,frame:int,at:int,length:int>>"


#: When a record was made, where the caller does not say: fixed, so that reruns agree.
WRITTEN = "2000-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f]")


def header_value(text: str) -> str:
    """A URI in one header line: white space and control characters are percent-encoded."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record_id(page_id: int | None, place: tuple[int, int] | None = None) -> str:
    """A page's URN; ``place`` tells apart the records of repeated page ids."""
    return f"<urn:page:{':'.join(str(x) for x in (page_id, *(place or ())))}>"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, place: tuple[int, int] | None = None, date: str = WRITTEN, exact: bool = True) -> bytes:
    """One WARC 1.1 record. A revisit has no block; its payload is that of the record it names.

    Where page ids repeat, ``place`` makes the record's id unique. A revisit
    names the page it refers to and, if ``exact``, that page's only record.
    """
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, place)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    if revisit:
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if exact:
            head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; lengths are verified."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not found or first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return headers, rest[:length]


class BundleWriter:
    """Groups records into independent frames and closes with a seek table."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.entries, self.index, self.open = [], [], [], bytearray()
        self.size = 0

    def add(self, page_id: int, raw: bytes) -> None:
        self.index.append({"id": page_id, "frame": len(self.frames), "at": len(self.open), "length": len(raw)})
        self.open += raw
        if len(self.open) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self.frames.append(frame)
            self.entries.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def close(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(body: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed length, length) of each frame, from the bundle's footer."""
    frames, descriptor, magic = struct.unpack("<IBI", body[-9:])
    if magic != SEEKABLE_MAGIC or descriptor & 0x7C:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    start = len(body) - 9 - frames * width
    if struct.unpack("<II", body[start - 8 : start]) != (SKIPPABLE_MAGIC, frames * width + 9):
        raise ValueError("the seek table's frame is damaged")
    out, at = [], 0
    for k in range(frames):
        packed, length = struct.unpack_from("<II", body, start + k * width)
        out.append((at, packed, length))
        at += packed
    return out


def read_frame(body: bytes, entry: tuple[int, int, int]) -> bytes:
    at, packed, length = entry
    data = zstandard.ZstdDecompressor().decompress(body[at : at + packed], max_output_size=length)
    if len(data) != length:
        raise ValueError("a frame's length is not the seek table's")
    return data


def read_record(body: bytes, frame: int, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """Random access: decompress one frame and parse the record at an offset in it."""
    return parse_record(read_frame(body, seek_table(body)[frame])[at : at + length])


def plan_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, repeated, exact): ``refers_to`` is null for responses.

    Of equal payloads of ``min_bytes`` or more the smallest page_id is the
    response and the rest revisit it; smaller ones are all responses. Rows that
    share the smallest page_id are all responses, as are rows of null page_id.
    ``repeated``: other rows have this page_id, too; ``exact``: one row alone has
    the page_id referred to. Null html is an empty payload, null url an empty one; page ids are whole
    numbers. Payloads are joined by page and digest; the pages of a payload that
    very many share meet its first page in pieces.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(html.cast("binary"), 256).alias("digest")
    page = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page, F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(html, "UTF-8").alias("payload"), digest)
    keys = pages.select(page, digest, (F.octet_length(html) >= min_bytes).alias("large")).where("page_id IS NOT NULL").groupBy("page_id", "digest", "large").agg(F.count("*").alias("n"))
    keys = materialize(keys, "page-keys")
    twice = keys.groupBy("page_id").agg(F.sum("n").alias("rows")).where("rows > 1").select("page_id", F.lit(True).alias("repeated"))
    firsts = keys.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1")
    firsts = firsts.join(twice.withColumnRenamed("page_id", "first"), "first", "left").select("digest", "first", F.coalesce(~F.col("repeated"), F.lit(True)).alias("exact"), "pages")
    met = join_by_key(keys.where("large"), materialize(firsts, "first-pages"), ["digest"], "pages", "page_id")
    revisits = met.where(F.col("first") < F.col("page_id")).select("page_id", "digest", F.col("first").alias("refers_to"), "exact")
    marks = keys.join(revisits, ["page_id", "digest"], "left").join(twice, "page_id", "left").select("page_id", "digest", "refers_to", "repeated", "exact").where("refers_to IS NOT NULL OR repeated")
    repeated = F.coalesce("repeated", F.col("page_id").isNull())
    return rows.join(marks, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to", repeated.alias("repeated"), F.coalesce("exact", F.lit(True)).alias("exact"))


def write_bundles(records: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 8 << 20, date: str = WRITTEN) -> DataFrame:
    """Pack planned records into bundles: one row for each, with its index.

    Every partition writes bundles of about ``bundle_bytes`` compressed bytes;
    nothing is shuffled and no task holds more than one open bundle. All
    records carry ``date``. Record ids are unique: those of repeated page ids
    name their place among the task's records.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("bundle", pa.string()), ("body", pa.binary()), ("records", pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int32()), ("at", pa.int32()), ("length", pa.int32())])))])

        def done(writer: BundleWriter) -> pa.RecordBatch:
            body = writer.close()
            return pa.RecordBatch.from_pylist([{"bundle": hashlib.sha256(body).hexdigest(), "body": body, "records": writer.index}], schema=schema)

        names = ("page_id", "url", "payload", "digest", "refers_to", "repeated", "exact")
        writer, task, count = BundleWriter(frame_bytes), TaskContext.get().partitionId(), 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to, repeated, exact in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                writer.add(page_id, record_bytes(page_id, url, payload, digest, refers_to, (task, count) if repeated else None, date, exact))
                count += 1
                if writer.size >= bundle_bytes:
                    yield done(writer)
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield done(writer)

    ship(records.sparkSession)
    return records.mapInArrow(pack, BUNDLES)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Read every record of the bundles by their indexes, frame after frame.

    The payload's length and digest are computed from the bytes read where the
    record has a block; a revisit's are those its headers state, to be held
    against the response that it names (see :func:`check_revisits`). The record
    that an index entry points at must name the entry's page.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("url", pa.string()), ("record_id", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for k in range(batch.num_rows):
                body, records = batch.column("body")[k].as_py(), batch.column("records")[k].as_py()
                table, current, data, rows, held = seek_table(body), None, b"", [], 0
                for r in records:
                    if r["frame"] != current:
                        current, data = r["frame"], read_frame(body, table[r["frame"]])
                    headers, block = parse_record(data[r["at"] : r["at"] + r["length"]])
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    revisit = kind == "revisit"
                    if headers.get("x-page") != (None if r["id"] is None else str(r["id"])):
                        raise ValueError(f"record {r['id']}: the index points at another page's record")
                    if not revisit and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"record {r['id']}: the payload is not that of its digest")
                    rows.append({
                        "page_id": r["id"], "payload_bytes": int(headers["x-payload-length"]) if revisit else len(block), "payload_digest": digest, "record_type": kind,
                        "refers_to": int(headers["x-refers-to-page"]) if revisit else None, "url": headers["warc-target-uri"], "record_id": headers["warc-record-id"],
                        "payload": None if revisit else block,
                    })
                    held += len(block)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ship(bundles.sparkSession)
    return bundles.mapInArrow(unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary")


def check_revisits(records: DataFrame) -> DataFrame:
    """``records`` as read; raises an error unless each revisit's length and digest are those of the response it names."""
    named = ["refers_to", "payload_bytes", "payload_digest"]
    asked = records.where("record_type = 'revisit'").select(*named).distinct()
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *named[1:])
    lost = asked.join(held, named, "left_anti").first()
    if lost is not None:
        raise ValueError(f"revisits of page {lost['refers_to']} do not match its response")
    return records


def op10_warc_bundles(spark, sf_dir):
    """All pages written as bundles to the shared folder, read back and compared."""
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bundles = materialize(write_bundles(plan_records(pages)), "warc", compression="uncompressed")
    found = materialize(read_bundles(bundles).drop("payload", "url", "record_id"), "records")
    return check_revisits(found)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
                  octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first < p.page_id AND p.n >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id AND p.n >= 100 THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
