"""Words of whole columns at once, as numpy arrays over Arrow buffers.

A word is a maximal run of bytes other than space and the controls 9 to 13;
as these are single bytes in UTF-8, that is the same as over code points.
Nothing here keeps state between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Batches are worked on in pieces of about this many bytes, so memory does not follow the batch size.
PIECE_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006 the powers are the same for every call
    if base not in kept or len(kept[base]) < n:
        size = max(n, SEGMENT_BYTES)
        powers = np.full(size, U64(base), dtype=U64)
        powers[0] = U64(1)
        powers = np.cumprod(powers, dtype=U64)
        if size > SEGMENT_BYTES:
            return powers
        kept[base] = powers
    return kept[base]


@dataclass
class Words:
    """Words of a run of texts: byte ranges, and per text the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words bounds[i]:bounds[i + 1] belong to text i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about PIECE_BYTES, one text at least."""
    at = batch.schema.get_field_index(column)
    offsets = binary_of(batch.column(at))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + PIECE_BYTES, side="right")) - 1
        stop = min(batch.num_rows, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def binary_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def split_words(texts: pa.Array) -> Words:
    """Words of every text; null counts as empty."""
    data, offsets = binary_of(texts)
    if len(offsets) < 2:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case; other bytes stay, also those of longer code points."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash per word, from prefix sums of a polynomial over the bytes."""
    out = np.empty(len(words.starts), dtype=U64)
    at = 0
    while at < len(out):
        low = words.starts[at]
        stop = max(int(np.searchsorted(words.ends, low + SEGMENT_BYTES, side="right")), at + 1)
        high = words.ends[stop - 1]
        n = int(high - low)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((words.data[low:high].astype(U64) + U64(1)) * _powers(_BASE, n)[:n], out=sums[1:])
        starts, ends = words.starts[at:stop] - low, words.ends[at:stop] - low
        out[at:stop] = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(U64))
        at = stop
    return out


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of n words; a text of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(bounds)
    long = np.maximum(counts - n + 1, 0)
    owners = np.repeat(np.arange(len(counts)), long)
    first = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(long)[:-1])), long) + np.arange(len(owners))
    values = np.zeros(len(owners), dtype=U64)
    for k in range(n):
        values = values * U64(_BASE) + hashes[first + k]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.empty(len(short), dtype=U64)
        for i, text in enumerate(short):
            value = U64(0)
            with np.errstate(over="ignore"):
                for h in hashes[bounds[text] : bounds[text + 1]]:
                    value = value * U64(_BASE) + h
                whole[i] = value + U64(counts[text])
        owners, values = np.concatenate((owners, short)), np.concatenate((values, whole))
    return owners, mix(values)
