"""PNG filters, unfiltering and the cosine hash against plain loops."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from tessera.llm.media import WIDTH, cosine_hash, decode_png, decode_pngs, encode_png, filtered, op6_media_columns, pad, scanlines, unfilter

SF = "/root/testdata/sf0.001"


def plain_unfilter(lines):
    """The five filters by their definition, sample after sample."""
    height, width = len(lines), lines.shape[1] - 1
    out = [[0] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            a, b = (out[y][x - 1] if x else 0), (out[y - 1][x] if y else 0)
            c = out[y - 1][x - 1] if x and y else 0
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out[y][x] = (int(lines[y, x + 1]) + (0, a, b, (a + b) // 2, paeth)[lines[y, 0]]) % 256
    return np.array(out, np.uint8).reshape(height, width)


def plain_hash(samples):
    """Area means of a 32 x 32 grid, their cosine transform by its definition, bits over the median."""
    height, width = samples.shape

    def shares(size):
        edges = [k * size / 32 for k in range(33)]
        return np.array([[max(0.0, min(edges[k + 1], j + 1) - max(edges[k], j)) for j in range(size)] for k in range(32)])

    grid = shares(height) @ samples.astype(float) @ shares(width).T * (1024 / samples.size)
    cell = [[sum(grid[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = np.round(np.array(cell).ravel(), 4)
    bits = flat > np.median(flat[1:])
    bits[0] = False
    return int("".join("1" if b else "0" for b in bits), 2).to_bytes(8, "big").hex()


def test_unfilter_equals_the_definition():
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (h, 14), dtype=np.uint8) for h in (1, 7, 3, 20, 2)]
    for i in images:
        i[:, 0] = rng.integers(0, 5, len(i))
    for got, lines in zip(unfilter(images), images, strict=True):
        assert (got == plain_unfilter(lines)).all()
    assert unfilter([]) == []
    with pytest.raises(ValueError):
        unfilter([np.full((1, 4), 5, np.uint8)])


@pytest.mark.parametrize("kind", [None, 0, 1, 2, 3, 4, [0, 4, 3, 2, 1, 4]])
def test_filters_are_undone(kind):
    x = np.random.default_rng(4).integers(0, 256, (6, 9), dtype=np.uint8)
    assert (plain_unfilter(filtered(x, kind)) == x).all() and (decode_png(encode_png(x, kind)) == x).all()


def test_stored_rows_use_several_filters(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_media_columns(spark, SF).collect()
    used = np.zeros(5, int)
    for k, r in enumerate(rows):
        media = encode_png(np.frombuffer(pad(texts[r["doc_id"]]), np.uint8).reshape(-1, WIDTH))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        used += np.bincount(scanlines(media)[:, 0], minlength=5)
        if k < 12:
            assert r["feature"] == plain_hash(plain_unfilter(scanlines(media)))
    assert (used[1:] > 0).all() and len(rows) == len(texts)


def test_images_of_several_widths_and_broken_ones():
    xs = [np.full((h, w), 200, np.uint8) for h, w in ((2, 5), (3, 5), (1, 8), (4, 5))]
    assert all((a == b).all() for a, b in zip(decode_pngs([encode_png(x) for x in xs]), xs, strict=True))
    whole = encode_png(xs[0])
    for at in (3, 20, len(whole) - 20):
        with pytest.raises((ValueError, zlib.error)):
            decode_png(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
    with pytest.raises(Exception):
        decode_png(whole[:-12])
    assert cosine_hash(xs[0]) == plain_hash(xs[0])
