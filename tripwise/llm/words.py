"""Whole texts as numpy arrays of words, for use inside ``mapInArrow`` tasks.

A batch of texts is cut into slices of about ``SLICE_BYTES``, so memory follows the
slice (or one longer text), not the batch. Words get 64-bit hashes, and runs of words
get hashes of their words in order.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
PART_BYTES = 1 << 18


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in each Python worker."""
    held = sys.modules.setdefault("_tripwise_worker", types.ModuleType("_tripwise_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def space_words() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letter_words() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, to be applied to folded text."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2 ** 64 for i up to ``n``."""
    held = per_worker(f"powers_{base}", lambda: [np.ones(1, np.uint64)] * 2)
    if len(held[0]) <= n:
        size = max(n + 1, PART_BYTES)
        for k, factor in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            held[k] = np.cumprod(steps, dtype=np.uint64)
    return held[0], held[1]


def byte_values() -> np.ndarray:
    return per_worker("byte_values", lambda: mixed(np.arange(1, 257, dtype=np.uint64)))


def _fold_table() -> np.ndarray:
    def make() -> np.ndarray:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        return table

    return per_worker("fold_table", make)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, stop
        at = stop


@dataclass
class Words:
    """Words of some texts; ``bounds[i]:bounds[i + 1]`` are the words of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def run_hashes(self, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """Hash of the ``n`` words from each word on; valid where ``starts_of(n)`` says so."""
        total = len(self.hashes)
        if total < n:
            return np.empty(0, np.uint64)
        power, inverse = powers(base, total)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(self.hashes * power[:total], out=sums[1:])
        count = total - n + 1
        return mixed((sums[n:] - sums[:count]) * inverse[:count] + np.uint64(n))

    def starts_of(self, n: int) -> np.ndarray:
        """Indices of the words at which ``n`` words of one text start."""
        rest = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.hashes))
        return np.flatnonzero(rest >= n)

    def row_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, words, "right") - 1

    def text_of(self, first: int, count: int) -> bytes:
        """``count`` words from ``first`` on, joined by one space."""
        return b" ".join(
            self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + count)
        )


def words_of(column: pa.Array, in_word: np.ndarray, fold: bool = False) -> Words:
    """Words of every text; a null text has none. ``fold`` lower-cases A-Z first."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if fold:
        data = _fold_table()[data]
    inside = in_word[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        edges = offsets[:-1]
        before[edges[edges < len(data)]] = False
        edges = offsets[1:] - 1
        after[edges[edges >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + PART_BYTES, "right")))
        part = data[low : ends[stop - 1]]
        power, inverse = powers(0xD6E8FEB86659FD93, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte_values()[part] * power[: len(part)], out=sums[1:])
        first = starts[at:stop] - low
        hashes[at:stop] = mixed((sums[ends[at:stop] - low] - sums[first]) * inverse[first])
        at = stop
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
