"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. A word's hash is a polynomial over its bytes (mod 2**64), so one
cumulative sum hashes every word of a slice of texts; a finaliser then mixes the bits.
Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) mod 2**64, kept for the next call."""
    table = _powers.get(base)
    if table is None or len(table) < count:
        table = np.full(max(count, SLICE_BYTES + 1024), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        _powers[base] = table
    return table[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (the splitmix64 finaliser)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _hash_segment(data: np.ndarray, cuts: np.ndarray, base: int, inverse: int):
    """Words of one piece of the buffer; `cuts` are the text boundaries inside it."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(base, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table(inverse, len(data) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about SLICE_BYTES that cut no word."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = at + SLICE_BYTES
        if stop >= end:
            yield at, end
            return
        fits = int(np.searchsorted(offsets, stop, "right")) - 1
        if offsets[fits] > at:
            stop = int(offsets[fits])
        else:  # one text is larger than a slice: cut it after a separator
            while stop < end and not SEPARATOR[data[stop - 1]]:
                stop += 1
        yield at, stop
        at = stop


def hash_words(data: np.ndarray, offsets: np.ndarray, base: int = _BASE, inverse: int = _INVERSE):
    """(hash, start byte, end byte, text number) of every word in the buffer, in order."""
    found = []
    for at, stop in _segments(data, offsets):
        cuts = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, stop, "right")] - at
        hashes, starts, ends = _hash_segment(data[at:stop], cuts, base, inverse)
        found.append((hashes, starts + at, ends + at))
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    hashes, starts, ends = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows with about `limit` bytes of text.

    Null texts count as empty. A single text above the limit makes a slice of its own.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), len(column))
        low, high = int(offsets[at]), int(offsets[stop])
        yield at, stop, data[low:high], offsets[at:stop + 1] - low
        at = stop


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int, whole_if_short: bool):
    """(hash, text number) of every run of `size` words, in order of place.

    A text with fewer words gives its whole sequence as one shingle if `whole_if_short`,
    else none.
    """
    count = len(hashes)
    combined = np.zeros(max(count - size + 1, 0), np.uint64)
    step = np.uint64(_BASE)
    for at in range(size):
        combined = combined * step + hashes[at:count - size + 1 + at] if len(combined) else combined
    first = np.flatnonzero(rows[:len(combined)] == rows[size - 1:]) if len(combined) else np.zeros(0, np.int64)
    values, owner = mix(combined[first] + np.uint64(size)), rows[first]
    if whole_if_short:
        per_row = np.bincount(rows, minlength=n_rows)
        short = np.flatnonzero((per_row > 0) & (per_row < size))
        if len(short):
            begin = np.searchsorted(rows, short)
            extra = np.zeros(len(short), np.uint64)
            for at in range(size - 1):
                live = per_row[short] > at
                extra[live] = extra[live] * step + hashes[begin[live] + at]
            values = np.concatenate((values, mix(extra + per_row[short].astype(np.uint64))))
            owner = np.concatenate((owner, short))
            order = np.argsort(owner, kind="stable")
            values, owner = values[order], owner[order]
    return values, owner


def distinct_sets(values: np.ndarray, owner: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted: (values, offsets by text). `owner` ascends."""
    edges = np.searchsorted(owner, np.arange(n_rows + 1))
    parts, sizes = [], np.zeros(n_rows, np.int64)
    for row in range(n_rows):
        part = np.sort(values[edges[row]:edges[row + 1]])
        if len(part):
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
            sizes[row] = len(part)
            parts.append(part)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets
