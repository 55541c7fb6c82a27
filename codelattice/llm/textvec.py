"""Whole-batch text primitives in numpy: tokenising, hashing and shingling without a Python loop per word.

A *word* is a maximal run of letters and digits of the lower-cased UTF-8 text (see ``lowered``).  Every other ASCII
character and the punctuation of the blocks U+0080-00BF (but for the letters among them), U+2000-206F and
U+3000-303F separates words.  Word hashes are 64-bit polynomial hashes taken from one prefix sum over the
buffer, so their cost is a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes, which bounds the temporary arrays.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES = _powers(SLICE_BYTES + 4096)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _TABLES
    return _TABLES if n <= len(_TABLES[0]) else _powers(n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts add up to about ``limit`` bytes; a longer text is a range of its own."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by one zero byte, and the offset of each text."""
    joined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\0", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII, Latin-1 and basic Cyrillic letters, byte for byte, so that offsets stay."""
    out = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    at = np.flatnonzero(data[:-1] == 0xD0) + 1
    out[at[(data[at] >= 0x90) & (data[at] <= 0x9F)]] += 0x20
    up = at[(data[at] >= 0xA0) & (data[at] <= 0xAF)]
    out[up] -= 0x20
    out[up - 1] = 0xD1
    return out


def word_mask(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    is_word = _WORD[data]
    n = len(data)
    c2 = np.flatnonzero(data == 0xC2)
    if len(c2):
        c2 = c2[c2 + 1 < n]
        c2 = c2[~np.isin(data[c2 + 1], (0xAA, 0xB5, 0xBA))]
        is_word[c2] = is_word[c2 + 1] = False
    for lead, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(data == lead)
        if len(at):
            at = at[at + 2 < n]
            at = at[np.isin(data[at + 1], seconds)]
            is_word[at] = is_word[at + 1] = is_word[at + 2] = False
    return is_word


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [start, end); equal content, equal hash, wherever it stands."""
    up, down = _tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * up[start] ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a slice of texts: hash, byte range in ``data`` and bounds[i]:bounds[i+1] as those of text i."""

    __slots__ = ("bounds", "data", "end", "hash", "offsets", "start")

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.offsets = buffer_of(texts)
        self.data = lowered(self.data)
        self.start, self.end = runs(word_mask(self.data))
        self.hash = span_hashes(self.data, self.start, self.end)
        self.bounds = np.searchsorted(self.start, self.offsets)

    def text_of(self) -> np.ndarray:
        """For each word, the row of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``size`` consecutive entries; runs over text borders are included."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total *= np.uint64(0xFF51AFD7ED558CCD)
        total += words[j : j + n]
    return mix(total)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
