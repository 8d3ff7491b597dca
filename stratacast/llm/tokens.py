"""Token ids of many texts at once with a `tokenizers` file.

Both vocabularies cut a text at white space before anything else, so the ids of a text are
the ids of its chunks in order. Each distinct chunk of a slice of texts is encoded by the
library once, and a bounded memo carries frequent ones to the next slice; the ids are the
same as those of the whole text (tests hold them against it). Texts with white space
outside ASCII are given to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stratacast.llm.words import SEPARATOR, _BASE, _INVERSE, _power_table, mix, text_slices

SLICE_BYTES = 1 << 19
#: Slots of the memo, as a power of two; it starts anew after six ids for each slot.
MEMO_BITS = 20
JOINED = 2000
_SECOND = 0xD6E8FEB86659FD93
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. for lengths[0] places, then on with the next."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _wide_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold white space outside ASCII, or a separator control character."""
    lead = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
    at = np.flatnonzero(lead[:-1]) if len(data) else np.zeros(0, np.int64)
    pair = data[at].astype(np.int64) << 8 | data[at + 1]
    wide = at[np.isin(pair, (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380))]
    wide = np.concatenate((wide, np.flatnonzero((data >= 0x1C) & (data <= 0x1F))))
    return np.unique(np.searchsorted(offsets, wide, "right") - 1) if len(wide) else wide


def _edges(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> np.ndarray:
    """Places at which chunks begin or end.

    If the vocabulary is `spaced`, a chunk takes the space before it, and other white space
    makes chunks as the byte-level pattern has them: all but the last character of a run,
    then the last one by itself unless it is such a space.
    """
    inside = np.concatenate(([False], ~SEPARATOR[data], [False]))
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    cut = opens.copy()
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | opens))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | opens))
    cut[starts] = True
    cut[ends] = True
    if spaced:
        led = starts[~opens[starts]]
        cut[led[data[led - 1] == 32]] = False
        cut[led - 1] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts by a tokenizer file; `spaced` for the byte-level vocabulary.

    The memo has one slot for each value of a chunk hash's leading bits; a later chunk of
    the same slot takes it over.
    """

    def __init__(self, path: str, spaced: bool, memo_bits: int = MEMO_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.tokenizer.encode_special_tokens = True
        self.bits = memo_bits
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = (np.zeros(1 << self.bits, np.uint64) for _ in range(2))
        self.starts, self.lengths = (np.zeros(1 << self.bits, np.int32) for _ in range(2))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 8):  # the library's results are far larger than the ids
            found = self.tokenizer.encode_batch_fast(texts[at:at + 8], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32) for e in found]
        return out

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk): chunks joined by a mark that gives one id of its own.

        In the spaced vocabulary a line feed between chunks is such a mark; in the other a
        control character between spaces. Chunks that hold the mark, or only white space,
        are encoded one by one.
        """
        mark, join = ("\n", "\n") if self.spaced else ("\x01", " \x01 ")
        plain = [at for at, piece in enumerate(pieces) if mark not in piece and piece[-1] not in "\t\n\x0b\x0c\r "]
        odd = sorted(set(range(len(pieces))) - set(plain))
        groups = [plain[at:at + JOINED] for at in range(0, len(plain), JOINED)]
        lists = self._library([join.join(pieces[at] for at in group) + join for group in groups])
        lists += self._library([pieces[at] for at in odd])
        (mark_id,) = self._library([mark])[0]
        ids = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
        lengths = np.zeros(len(pieces), np.int64)
        after_plain = sum(map(len, lists[:len(groups)]))
        marks = np.flatnonzero(ids[:after_plain] == mark_id)
        lengths[plain] = np.diff(marks, prepend=-1) - 1
        lengths[odd] = [len(x) for x in lists[len(groups):]]
        keep = np.ones(len(ids), bool)
        keep[marks] = False
        ids = ids[keep]
        if odd:  # back into the order of the chunks
            order = np.array(plain + odd)
            begins = np.zeros(len(pieces), np.int64)
            begins[order] = np.cumsum(lengths[order]) - lengths[order]
            ids = ids[_spread(begins, lengths)]
        return ids, lengths

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode chunks, remember them; (first id, number of ids) of each in `self.ids`."""
        ids, lengths = self._encoded(pieces)
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used:self.used + total] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += total
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.keys[slots], self.checks[slots], self.starts[slots], self.lengths[slots] = keys, checks, starts, lengths
        # of two new chunks with one slot the last stands, in all four tables alike
        return starts, lengths

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids)."""
        if self.used > 6 << self.bits:
            self._forget()
        edges = _edges(data, offsets, self.spaced)
        starts, ends = edges[:-1], edges[1:]
        if not self.spaced and len(starts):
            words = ~SEPARATOR[data[starts]]
            starts, ends = starts[words], ends[words]
        keys, checks = [], []
        for out, base, inverse in ((keys, _BASE, _INVERSE), (checks, _SECOND, _SECOND_INVERSE)):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(base, len(data)), out=sums[1:])
            found = (sums[ends] - sums[starts]) * _power_table(inverse, len(data) + 1)[starts]
            out.append(mix(found + (ends - starts).astype(np.uint64)))
        keys, checks = keys[0], checks[0]
        slots = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        known = (self.keys[slots] == keys) & (self.checks[slots] == checks)
        first, count = self.starts[slots].astype(np.int64), self.lengths[slots].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            fresh, at, which = np.unique(keys[new], return_index=True, return_inverse=True)
            same = checks[new] == checks[new[at]][which]
            if not same.all():
                raise ArithmeticError("two chunks of text have one hash")
            raw = data.tobytes()
            pieces = [raw[a:b].decode() for a, b in zip(starts[new[at]].tolist(), ends[new[at]].tolist(), strict=True)]
            begin, length = self._learn(fresh, checks[new[at]], pieces)
            first[new], count[new] = begin[which], length[which]
        ids = self.ids[_spread(first, count)]
        sums = np.concatenate(([0], np.cumsum(count)))
        return ids, sums[np.searchsorted(starts, offsets)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) over runs of rows; null texts count as empty."""
        for first, stop, data, offsets in text_slices(column, SLICE_BYTES):
            wide = _wide_space(data, offsets)
            raw = data.tobytes() if len(wide) else b""
            if len(wide):  # blank here, as their chunks would not be those of the library
                data = data.copy()
                for row in wide:
                    data[offsets[row]:offsets[row + 1]] = 32
            ids, places = self._slice(data, offsets)
            if len(wide):
                lists = np.split(ids, places[1:-1])
                whole = self._library([raw[offsets[row]:offsets[row + 1]].decode() for row in wide])
                for row, mine in zip(wide, whole, strict=True):
                    lists[row] = mine
                ids = np.concatenate(lists)
                places = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            yield first, stop, ids, places


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, spaced: bool, memo_bits: int = MEMO_BITS) -> Encoder:
    """One encoder for all tasks of a worker, so that its memo lasts."""
    key = (path, spaced, memo_bits)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
