"""Vectorised word handling shared by the Python stages: batches, words, hashes.

Words are maximal runs of bytes other than space and tab to carriage return, which in UTF-8
is the same as on characters.  Everything works on whole texts; a batch only bounds memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


def _table(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE = _table(1, 256)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        step = np.full(1 << max(12, int(n).bit_length()), U64(base), dtype=U64)
        step[0] = 1
        _POW[base] = have = np.multiply.accumulate(step)
    return have[:n]


def chunks(batch: pa.RecordBatch, text: str, max_bytes: int = 750_000):
    """Slices of a batch whose texts have about ``max_bytes`` at most (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    if len(column) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def views(column: pa.Array) -> list:
    """The bytes of each text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text starts (and the end)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), starts


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``joined`` bytes, and how many words lie before each text."""
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, last = edge[0::2], edge[1::2]
    return first, last, np.searchsorted(first, starts)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(first):
        return np.zeros(0, dtype=U64)
    # differences of one running sum, shifted back to the start of each word
    running = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE[data] * powers(_BASE, len(data)), out=running[1:])
    own = (running[last] - running[first]) * powers(_INVERSE, len(data))[first]
    return mix(own + (last - first).astype(U64))


def text_bytes(batch: pa.RecordBatch, text: str, lower: bool = False) -> list[bytes]:
    texts = views(batch.column(batch.schema.get_field_index(text)))
    return [t.lower() for t in texts] if lower else texts
