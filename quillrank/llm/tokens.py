"""Words of many texts at once: spans, hashes and windows as numpy arrays over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = bytes([9, 10, 11, 12, 13, 32])
SLICE_BYTES = 2_000_000  # texts are worked on in slices of about this size, each of whole texts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and the n + 1 offsets. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of about ``size`` bytes, or one text if that is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte spans, and how many each text has."""

    _is_word = np.ones(256, bool)
    _is_word[list(SPACES)] = False

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = self._is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        self.starts = np.flatnonzero(first)
        last = inside
        last[:-1] &= ~inside[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.data, self.offsets = data, offsets
        self.bounds = np.searchsorted(self.starts, offsets)  # n + 1 bounds into the words
        self.counts = np.diff(self.bounds)

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, equal in every process; ``lower`` reads A-Z as a-z."""
        if len(self.starts) == 0:
            return np.zeros(0, np.uint64)
        values = randoms(seed, 256)
        if lower:
            values[65:91] = values[97:123]
        lengths = self.ends - self.starts
        # Spaces add nothing, so each word may be summed up to the start of the next.
        values[list(SPACES)] = 0
        begin = int(self.starts[0])
        spans = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(len(self.data) - begin, dtype=np.int64)
        place -= np.repeat(self.starts - begin, spans)
        factors = randoms(seed + 7, 4096)
        terms = values[self.data[begin:]] * factors[place & 4095]
        if lengths.max() > 4096:
            blocks = randoms(seed + 13, 4096)
            terms *= np.where(place > 4095, blocks[(place >> 12) & 4095], np.uint64(1))
        sums = np.add.reduceat(terms, self.starts - begin)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def documents(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``width`` words that lies in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(randoms(seed + 29, width) | np.uint64(1)):
        total += hashes[k : k + n] * factor
    # A window fits if it ends before its text does.
    remaining = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(hashes))
    at = np.flatnonzero(remaining[:n] >= width)
    return mix(total[at]), at


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
