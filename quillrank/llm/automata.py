"""Weighted acyclic automata over words: counts of word sequences with shared beginnings and shared ends."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 divided by the golden ratio


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; multiplications wrap."""
    values = (values ^ (values >> np.uint64(32))) * GOLDEN
    values = (values ^ (values >> np.uint64(29))) * GOLDEN
    return values ^ (values >> np.uint64(32))


def sort_rows(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, with the sums of their counts. As many columns as fit are compared as one number."""
    if not len(rows):
        return rows, counts
    bits = int(rows.max() + 2).bit_length()
    keys = []
    for column in rows.T[: int((rows >= 0).any(axis=0).sum())]:
        if not keys or filled + bits > 63:
            keys.append(np.zeros(len(rows), np.int64))
            filled = 0
        keys[-1] = (keys[-1] << bits) + column + 1
        filled += bits
    by = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    rows, counts = rows[by], counts[by]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[starts], np.add.reduceat(counts, starts)


def shrunk(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


@dataclass
class Counts:
    """A deterministic acyclic automaton whose arcs carry the count of the sequence that ends with them, 0 if none does.

    Arcs of a state lie together, in the order of their labels. State 0 has no arc; the last state is the root.
    """

    first: np.ndarray  # of each state, its first arc; one more at the end
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, counts: np.ndarray) -> Counts:
        """From distinct sorted rows of labels, padded with -1.

        A row adds arcs only behind what it shares with the row before. States are closed from the ends of the rows
        to the root; closed states with equal arcs become one.
        """
        width = rows.shape[1]
        new = np.ones(rows.shape, bool)
        new[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        at = [np.flatnonzero(new[:, d] & (rows[:, d] >= 0)) for d in range(width)]
        first, arcs, states = [np.zeros(2, np.int64)], [], 1
        target = np.zeros(len(at[-1]), np.int64)
        n_arcs = 0
        for d in reversed(range(width)):
            ends = rows[at[d], d + 1] < 0 if d + 1 < width else np.ones(len(at[d]), bool)
            label, weight = rows[at[d], d].astype(np.int64), np.where(ends, counts[at[d]], 0)
            parent = np.searchsorted(at[d - 1], at[d], side="right") - 1 if d else np.zeros(len(at[d]), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
            state, kept = register(starts, label, weight, target)
            sizes = np.diff(np.append(starts, len(label)))
            chosen = np.repeat(np.isin(np.arange(len(starts)), kept), sizes)
            arcs.append((label[chosen], weight[chosen], target[chosen]))
            first.append(n_arcs + np.cumsum(sizes[kept]))
            n_arcs += int(sizes[kept].sum())
            if d:
                target = np.zeros(len(at[d - 1]), np.int64)
                target[parent[starts]] = states + state
            states += len(kept)
        if not len(rows):
            first.append(np.zeros(1, np.int64))
        columns = [np.concatenate(c) for c in zip(*arcs, strict=True)]
        return cls(np.concatenate(first), *columns)

    @property
    def root(self) -> int:
        return len(self.first) - 2

    def rows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All sequences with a count, padded with -1, and the counts."""
        path = np.full((1, width), -1, np.int32)
        state = np.array([self.root])
        found = [(path[:0], self.weight[:0])]
        for d in range(width):
            sizes = self.first[state + 1] - self.first[state]
            path = np.repeat(path, sizes, axis=0)
            arc = np.repeat(self.first[state] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            path[:, d] = self.label[arc]
            ends = self.weight[arc] > 0
            found.append((path[ends], self.weight[arc[ends]]))
            state = self.target[arc]
        return np.concatenate([p for p, _ in found]), np.concatenate([w for _, w in found])

    def walk(self, rows: np.ndarray) -> np.ndarray:
        """Composition with the sequences of ``rows``: the count of each of their beginnings, 0 where there is none."""
        out = np.zeros(rows.shape, np.int64)
        if not len(self.label):
            return out
        span = int(max(self.label.max(), rows.max())) + 2
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        keys = owner * span + self.label
        state = np.full(len(rows), self.root)
        on = np.ones(len(rows), bool)
        for d in range(rows.shape[1]):
            wanted = state * span + rows[:, d]
            arc = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            on &= (rows[:, d] >= 0) & (keys[arc] == wanted)
            out[:, d] = np.where(on, self.weight[arc], 0)
            state = np.where(on, self.target[arc], 0)
        return out

    def pack(self, words: pa.Array) -> bytes:
        """The automaton and the words of its labels."""
        words = words.cast(pa.large_string())
        lengths = pa.compute.binary_length(words).to_numpy()
        data = pa.concat_arrays([words]).buffers()[2] if lengths.sum() else b""
        columns = [shrunk(c) for c in (lengths, self.first, self.label, self.weight, self.target)]
        text = np.frombuffer(data, np.uint8)[: int(lengths.sum())] if len(words) else np.zeros(0, np.uint8)
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps([text, *columns], protocol=5))

    @classmethod
    def unpack(cls, packed: bytes) -> tuple[pa.Array, Counts]:
        text, lengths, *columns = pickle.loads(zstandard.ZstdDecompressor().decompress(packed))
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(text))
        return words, cls(*[c.astype(np.int64) for c in columns])


def register(starts: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each state, states kept): states with the same arcs get the number of the first of them."""
    if not len(starts):
        return starts, starts
    sizes = np.diff(np.append(starts, len(label)))
    arc = mix(label.astype(np.uint64) + mix(weight.astype(np.uint64) + mix(target.astype(np.uint64))))
    _, first, of = np.unique(np.add.reduceat(arc, starts), return_index=True, return_inverse=True)
    like = first[of]
    other = np.repeat(starts[like], sizes) + np.arange(len(label)) - np.repeat(starts, sizes)
    other = np.minimum(other, len(label) - 1)
    equal = (label == label[other]) & (weight == weight[other]) & (target == target[other])
    alike = (sizes == sizes[like]) & np.logical_and.reduceat(equal, starts)  # hashes only propose
    like = np.where(alike, like, np.arange(len(starts)))
    kept = np.unique(like)
    return np.searchsorted(kept, like), kept


def union(parts: list[tuple[pa.Array, Counts]], width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, rows, counts): the sums of several automata, each with its own words, in the order of the words' bytes."""
    words = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    order = pa.compute.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    number = np.append(place[words.indices.to_numpy()], np.int32(-1))  # the padding stays
    rows, counts, base = [], [], 0
    for own, automaton in parts:
        path, weight = automaton.rows(width)
        rows.append(number[np.where(path < 0, -1, path + base)])
        counts.append(weight)
        base += len(own)
    return words.dictionary.take(pa.array(order)), *sort_rows(np.concatenate(rows), np.concatenate(counts))
