"""Code points of many texts at once, with tables of what each code point is."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from stratacast.llm.words import text_slices

SLICE_BYTES = 1 << 19
_PLANE = 0x10000


@cache
def letters() -> np.ndarray:
    """By code point: is it a letter? Beyond the basic plane, all are taken as none."""
    return np.array([chr(c).isalpha() for c in range(_PLANE)])


@cache
def uppers() -> np.ndarray:
    return np.array([chr(c).isupper() for c in range(_PLANE)])


@cache
def lowered() -> np.ndarray:
    """By code point: the first code point of its lower case."""
    return np.array([ord(chr(c).lower()[0]) for c in range(_PLANE)], np.uint32)


@cache
def spaces() -> np.ndarray:
    out = np.zeros(_PLANE, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def code_points(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) over runs of rows; a line feed follows each text.

    Null texts count as empty; code points beyond the basic plane are given as 0xFFFF.
    """
    for first, stop, data, edges in text_slices(column, SLICE_BYTES):
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(text) + 1 for text in texts])))
        yield first, stop, np.minimum(points, np.uint32(_PLANE - 1)), offsets
