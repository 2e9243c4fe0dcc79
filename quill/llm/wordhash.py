"""Word hashes of whole Arrow text columns, without a Python object per word.

A word's hash is a polynomial over its bytes: every byte has a random 64-bit
value, A-Z that of a-z, and a running sum over the column's bytes gives every
word's sum by one subtraction. Words are cut at \\x20 and \\x09-\\x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = 0xFFFFFFFFFFFFFFFF
#: Bytes looked at together; a longer word is looked at whole.
SEGMENT_BYTES = 1 << 20
#: Texts looked at together, at most: their numbers fit 16 bits.
RUN_TEXTS = 60_000
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte; in _VALUE, A-Z have those of a-z.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_VALUE = BYTE_VALUE.copy()
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]


class _Powers:
    """The powers of the base and of its inverse, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text starts (and the last ends)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def runs(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with at most `most` bytes, one text at least, and RUN_TEXTS texts at most."""
    ends = text_bytes(column)[1]
    first = 0
    while first < len(column):
        end = int(np.searchsorted(ends, ends[first] + most, "right")) - 1
        end = min(max(end, first + 1), first + RUN_TEXTS, len(column))
        yield first, end
        first = end


def word_places(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind the last) of all words of texts that follow one another; ends: text_bytes()."""
    n = len(raw)
    gap = _SPACE[raw]
    opens = np.zeros(n + 1, bool)
    opens[ends] = True
    starts, stops = ~gap, ~gap
    starts[1:] &= gap[:-1] | opens[1:n]
    stops[:-1] &= gap[1:] | opens[1:n]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def place_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of the pieces raw[first:last], which are in order; values: a random number for each byte."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        # As many pieces as fit the segment, one at least.
        end = max(at + 1, int(np.searchsorted(last, first[at] + SEGMENT_BYTES, "right")))
        a, b = first[at], last[end - 1]
        up, down = _POWERS.of(max(SEGMENT_BYTES, int(b - a)))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[raw[a:b]] * up[: b - a], out=sums[1:])
        s = first[at:end] - a
        out[at:end] = (sums[last[at:end] - a] - sums[s]) * down[s]
        at = end
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, words before each text and all words)."""
    raw, ends = text_bytes(column)
    first, last = word_places(raw, ends)
    return place_hashes(raw, first, last, _VALUE), np.searchsorted(first, ends)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of every text's word n-grams, one text behind the other, and where each text's start.

    Fewer words than n are one n-gram; a text without words has none.
    """
    w, of = word_hashes(column)
    counts = np.diff(of)
    whole = np.maximum(counts - size + 1, 0)
    grams = np.minimum(np.maximum(whole, 1), counts)
    starts = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(starts[-1]) + np.repeat(of[:-1] - starts[:-1], grams)
    length = np.minimum(counts, size)
    total = np.repeat(length, grams).astype(np.uint64)
    padded = np.concatenate([w, np.zeros(size, np.uint64)])
    short = np.repeat(counts < size, grams)
    for k in range(size):
        # Word hashes are random, so a sum with odd factors tells their sequences apart.
        part = padded[at + k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & MASK)
        if k and short.any():
            part[short & (np.repeat(length, grams) <= k)] = 0
        total += part
    total = mix(total)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        total[a:b].sort()
    fresh = np.ones(len(total), bool)
    fresh[1:] = total[1:] != total[:-1]
    fresh[starts[:-1][grams > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return total[fresh], kept[starts]


def digests(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """63 bits that tell sets apart, 0 for empty ones."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams + np.uint64(_BASE)), dtype=np.uint64)])
    sizes = np.diff(starts)
    out = mix((sums[starts[1:]] - sums[starts[:-1]]) + sizes.astype(np.uint64)) >> np.uint64(1)
    return np.where(sizes > 0, out, np.uint64(0)).astype(np.int64)
