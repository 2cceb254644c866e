"""Words of many texts at once, as numpy arrays over one buffer of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 19

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _tables:
        _tables.clear()
        up, down = np.full(size, _P, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _tables[size] = np.cumprod(up), np.cumprod(down)
    return _tables[size]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes of text; nulls are empty."""
    col = batch.column(column)
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """starts, ends (byte places), doc (row of each word), first (index of each document's first word, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        space = _SPACE[data]
        word = ~space
        begins = word.copy()
        begins[1:] &= space[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = word[inner]  # a word never goes from one text into the next
        closes = word.copy()
        closes[:-1] &= space[1:]
        closes[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64 bits of every word."""
        up, down = _powers(len(self.data))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
            h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
            return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """64 bits of every n consecutive values; the result is n - 1 shorter."""
    with np.errstate(over="ignore"):
        m = len(h) - n + 1
        out = np.zeros(max(m, 0), np.uint64)
        for i in range(n if m > 0 else 0):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + mix(h[i : i + m] + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
        return mix(out)
