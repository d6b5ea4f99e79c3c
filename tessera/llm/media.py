"""Operator 6, media columns: PNG in binary columns, with perceptual hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import documents, materialize, ship, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
BLOCK = 576
WIDTH = 96


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """Bytes 255 up to a positive multiple of ``block``."""
    return payload + b"\xff" * (-len(payload) % block if payload else block)


def _guesses(left: np.ndarray, above: np.ndarray, corner: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What the scanline filters 0 to 4 add to each sample, of int32 neighbours; ``kinds`` names a filter for each."""
    p = left + above - corner
    a, b, c = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    return np.choose(kinds, (np.zeros_like(left), left, above, (left + above) >> 1, paeth))


def filtered(samples: np.ndarray, kinds: np.ndarray | int | None = None) -> np.ndarray:
    """Scanlines with their filter byte. Without ``kinds`` each row takes the filter of the least sum of absolute values, the first of equals."""
    height, width = samples.shape
    padded = np.zeros((height + 1, width + 1), np.int32)
    padded[1:, 1:] = samples
    left, above, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    own = padded[1:, 1:]
    shape = np.zeros((height, 1), np.int64)
    rows = [(own - _guesses(left, above, corner, shape + k)).astype(np.uint8) for k in range(5)]
    if kinds is None:
        kinds = np.argmin([np.abs(r.view(np.int8).astype(np.int32)).sum(axis=1) for r in rows], axis=0)
    out = np.empty((height, width + 1), np.uint8)
    out[:, 0] = kinds
    out[:, 1:] = np.choose(np.broadcast_to(kinds, height)[:, None], rows)
    return out


def encode_png(samples: np.ndarray, kinds: np.ndarray | int | None = None, level: int = 6) -> bytes:
    """An 8-bit grey PNG of a (height, width) array; ``kinds`` fixes the filter of each row, or of all (see :func:`filtered`)."""
    height, width = samples.shape
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(samples, kinds).tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """Undo the five scanline filters of many images of one width, a byte a pixel, in numpy.

    A sample needs its left, upper and upper left neighbours, so all samples
    whose row and column sum to the same number can be restored at once, in all
    images together. Rows lie in order of their place in the image: those at
    work are one slice.
    """
    if not images:
        return []
    heights = np.array([len(i) for i in images])
    width = images[0].shape[1] - 1
    scan = np.concatenate(images)
    place = np.arange(len(scan)) - np.repeat(np.cumsum(heights) - heights, heights)
    order = np.argsort(place, kind="stable")
    back = np.empty(len(scan), np.int64)
    back[order] = np.arange(len(scan))
    scan, place = scan[order], place[order]
    kinds = scan[:, 0].astype(np.int64)
    if (kinds > 4).any():
        raise ValueError(f"unknown PNG filter {kinds.max()}")
    upper = np.where(place > 0, back[np.maximum(order - 1, 0)], len(scan))
    stride = width + 1
    flat = np.zeros((len(scan) + 1) * stride, np.int32)  # a last row of zeros stands above the first ones
    flat[: len(scan) * stride] = scan.ravel()
    flat[:-stride:stride] = 0  # and a column of zeros left of all
    own, above = np.arange(len(scan)) * stride, upper * stride
    top = int(heights.max()) if len(heights) else 0
    bounds = np.searchsorted(place, np.arange(top + 1))
    for t in range(top + width - 1):
        a, b = bounds[max(0, t - width + 1)], bounds[min(t, top - 1) + 1]
        x = t - place[a:b] + 1
        at, up = own[a:b] + x, above[a:b] + x
        flat[at] = (flat[at] + _guesses(flat[at - 1], flat[up], flat[up - 1], kinds[a:b])) & 255
    plain = flat[: len(scan) * stride].reshape(len(scan), stride)[back, 1:].astype(np.uint8)
    return np.split(plain, np.cumsum(heights)[:-1])


def scanlines(data: bytes) -> np.ndarray:
    """The filtered scanlines of an 8-bit grey PNG; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        (length,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        (crc,) = struct.unpack_from(">I", data, at + 8 + length)
        if zlib.crc32(kind + chunk) != crc:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        ended, at = kind == b"IEND", at + 12 + length
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG without interlacing")
    width, height = head[:2]
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)


#: Bytes of scanlines that are unfiltered together.
TOGETHER = 4 << 20


def decode_pngs(data: list[bytes]) -> Iterator[np.ndarray]:
    """The samples of each PNG, in order."""
    held, size = [], 0
    for one in data:
        lines = scanlines(one)
        if held and (size + lines.size > TOGETHER or held[0].shape[1] != lines.shape[1]):
            yield from unfilter(held)
            held, size = [], 0
        held.append(lines)
        size += lines.size
    yield from unfilter(held)


def decode_png(data: bytes) -> np.ndarray:
    """:func:`decode_pngs` of one."""
    return next(decode_pngs([data]))


def _cosines(size: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the type-II cosine transform of ``size`` points."""
    k, n = np.arange(low)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * size))


_DCT = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits, in hex: which low-frequency coefficients of the 32 x 32 area means exceed their median."""
    sums = np.zeros((samples.shape[0] + 1, samples.shape[1] + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def at_edges(table: np.ndarray) -> np.ndarray:
        edges = np.linspace(0, table.shape[0] - 1, 33)
        low = np.minimum(edges.astype(int), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    grid = np.diff(np.diff(at_edges(at_edges(sums).T).T, axis=0), axis=1)
    grid *= 1024 / samples.size
    low = np.round((_DCT @ grid @ _DCT.T).ravel(), 4)  # rounding noise is no feature
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as padded UTF-8 payloads in PNG: id, ``n_bytes``, ``media``.

    Null text is empty. Equal texts give equal media. Rows with null or
    repeated ids are kept as they are. Stored rows may be written anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                payload = (text or "").encode()
                sizes.append(len(payload))
                media.append(encode_png(np.frombuffer(pad(payload), np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode stored media: the payload, its digests and the cosine hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            stored = batch.column(2).to_pylist()
            for media, samples in zip(stored, decode_pngs(stored), strict=True):
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    ship(stored.sparkSession)
    kind = stored.schema[id_col].dataType.simpleString()
    return stored.select(id_col, "n_bytes", "media").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_media_columns(spark, sf_dir):
    """All documents stored as PNG in a table of the shared folder, read back and hashed."""
    small_batches(spark)
    stored = materialize(store_media(documents(spark, sf_dir)), "media", compression="uncompressed")
    return media_features(stored)

