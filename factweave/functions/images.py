"""Perceptual hashes of raster logos, and text inside vector ones.

A PNG is decoded with the standard library and numpy; other formats give NULL.  The hash is
the block mean value hash: 16 x 16 blocks, each brighter or not than the median of its quarter.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import _c

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray | None:
    """Height x width x (r, g, b, alpha) of an 8-bit PNG that isn't interlaced, else None."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, palette, alpha, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(chunk, dtype=np.uint8)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS:
        return None
    width, height, _, kind = head[:4]
    step = _CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.uint8)
    for y in range(height):
        how, line = int(raw[y, 0]), raw[y, 1:]
        if how == 0:
            row = line.copy()
        elif how == 2:
            row = line + above
        elif how == 1:
            row = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        else:
            row = _filtered(line, above, step, how)
        out[y] = above = row
    pixels = out.reshape(height, width, step)
    full = np.full((height, width, 4), 255, dtype=np.uint8)
    if kind == 3:
        full[..., :3] = palette[pixels[..., 0]]
        if alpha is not None:
            full[..., 3] = np.append(alpha, np.full(256 - len(alpha), 255, dtype=np.uint8))[pixels[..., 0]]
    else:
        full[..., :3] = pixels[..., :3] if step >= 3 else pixels[..., :1]
        if step in (2, 4):
            full[..., 3] = pixels[..., -1]
    return full


def _filtered(line: np.ndarray, above: np.ndarray, step: int, how: int) -> np.ndarray:
    """Rows that lean on both the left and the upper neighbour."""
    row = [0] * len(line)
    for i, v in enumerate(line.tolist()):
        left = row[i - step] if i >= step else 0
        up = int(above[i])
        if how == 3:
            guess = (left + up) // 2
        else:
            corner = int(above[i - step]) if i >= step else 0
            p = left + up - corner
            guess = min((left, up, corner), key=lambda n: abs(p - n))
        row[i] = (v + guess) & 255
    return np.array(row, dtype=np.uint8)


def _shares(size: int, blocks: int) -> np.ndarray:
    """How much of each pixel lies in each block."""
    edges = np.linspace(0, size, blocks + 1)
    pixel = np.arange(size)
    return np.clip(np.minimum(edges[1:, None], pixel + 1) - np.maximum(edges[:-1, None], pixel), 0, 1)


def block_hash(pixels: np.ndarray, bits: int = 16) -> str:
    height, width = pixels.shape[:2]
    light = pixels[..., :3].astype(np.float64).sum(axis=2)
    light[pixels[..., 3] == 0] = 765  # nothing there: white
    blocks = (_shares(height, bits) @ light @ _shares(width, bits).T).reshape(4, -1)
    half = height * width / bits**2 * 256 * 3 / 2
    middle = np.median(blocks, axis=1, keepdims=True)
    on = (blocks > middle) | ((np.abs(blocks - middle) < 1) & (middle > half))
    return np.packbits(on.reshape(-1)).tobytes().hex()


def _hash_all(images):
    """Hexadecimal hash of each image, NULL for what can't be decoded."""
    def one(data):
        try:
            pixels = decode_png(bytes(data)) if data is not None else None
            return None if pixels is None or 0 in pixels.shape else block_hash(pixels)
        except (ValueError, struct.error, zlib.error, IndexError, TypeError):
            return None

    return images.map(one)


def logo_hash(image) -> Column:
    """Hash of each distinct image is worked out in Arrow batches; join images by url first."""
    _hash_all.__annotations__ = {"images": pd.Series, "return": pd.Series}
    return F.pandas_udf(_hash_all, StringType())(_c(image))


def svg_text(svg) -> Column:
    """Title, description and label of a vector image, joined."""
    of = lambda tag: F.trim(F.regexp_extract(_c(svg), rf"(?is)<{tag}[^>]*>\s*(.*?)\s*</{tag}>", 1))
    label = F.regexp_extract(_c(svg), r"""(?is)<svg[^>]*\saria-label\s*=\s*["']([^"']*)["']""", 1)
    return F.nullif(F.array_join(F.filter(F.array(of("title"), of("desc"), F.trim(label)), lambda x: x != ""), " "), F.lit(""))
