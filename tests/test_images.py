"""PNG decoding, block hashes and vector text."""

import struct
import zlib

import numpy as np
import pytest

from factweave.functions import images as I


def png(pixels: np.ndarray, how: int = 0) -> bytes:
    height, width, step = pixels.shape
    rows, above = [], np.zeros(width * step, dtype=np.int64)
    for y in range(height):
        line = pixels[y].reshape(-1).astype(np.int64)
        left = np.concatenate([np.zeros(step, dtype=np.int64), line[:-step]])
        corner = np.concatenate([np.zeros(step, dtype=np.int64), above[:-step]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * line, left, above, (left + above) // 2, near][how]
        rows.append(bytes([how]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_round_trip(how, step):
    rng = np.random.default_rng(how)
    pixels = rng.integers(0, 256, size=(7, 9, step), dtype=np.uint8)
    got = I.decode_png(png(pixels, how))
    assert (got[..., 0] == pixels[..., 0]).all() and (got[..., 3] == (pixels[..., -1] if step in (2, 4) else 255)).all()


def test_hashes(spark):
    half = np.zeros((40, 37, 3), dtype=np.uint8)
    half[:, 18:] = 255
    noisy = np.clip(half.astype(int) + np.random.default_rng(1).integers(-8, 8, half.shape), 0, 255).astype(np.uint8)
    df = spark.createDataFrame([(0, png(half)), (1, png(noisy, 4)), (2, b"junk"), (3, None)], "i int, b binary")
    got = {r.i: r.h for r in df.select("i", I.logo_hash("b").alias("h")).collect()}
    assert len(got[0]) == 64 and got[2] is None and got[3] is None
    assert sum((int(a, 16) ^ int(b, 16)).bit_count() for a, b in zip(got[0], got[1], strict=True)) < 40


def test_svg(spark):
    df = spark.createDataFrame([('<svg aria-label="Uni X"><title> Logo </title></svg>',), ("<svg/>",)], "s string")
    assert [r[0] for r in df.select(I.svg_text("s")).collect()] == ["Logo Uni X", None]
