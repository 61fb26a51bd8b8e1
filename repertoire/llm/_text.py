"""Vectorised UTF-8 tokenising and hashing over Arrow string columns (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words delimited by [\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes handled at once; a longer text is handled alone and whole.
CHUNK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
#: Powers of an odd number, for the first letters of a word; further ones take them in turn, made apart by the turn.
_TURN = 1 << 12
_POWERS = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(_TURN - 1, 0x9E3779B97F4A7C15 | 1, np.uint64))))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: (first, last, bytes, offsets)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Words of a run of texts: byte spans, 64-bit hashes, and the first word of each text.

    The hash is a polynomial over random letters modulo 2^64, then mixed with the length. Words are hashed
    ``CHUNK`` bytes at a time, so that a long text needs few bytes of memory for each of its own.
    """

    __slots__ = ("low", "start", "end", "hash", "first")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        self.low = low = LOWER[raw]
        n = len(low)
        inside = letters[low]
        begins, ends = inside.copy(), inside.copy()
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[1:] &= ~inside[:-1]
        begins[edge] |= inside[edge]
        ends[:-1] &= ~inside[1:]
        ends[edge - 1] |= inside[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        length = self.end - self.start
        upto = np.cumsum(length)
        self.hash = np.empty(len(length), np.uint64)
        at = 0
        while at < len(length):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
            size = length[at:to]
            head = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(head, size)
            letter = _LETTER[low[place + np.repeat(self.start[at:to], size)]]
            far = np.flatnonzero(place >= _TURN)
            if len(far):
                letter[far] = mix64(letter[far] + (place[far] // _TURN).astype(np.uint64))
                place %= _TURN
            self.hash[at:to] = np.add.reduceat(letter * _POWERS[place], head)
            at = to
        self.hash = mix64(self.hash ^ length.astype(np.uint64) * _U(0xA0761D6478BD642F))

    def bytes_of(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def word_hashes(text: bytes, letters: np.ndarray) -> Words:
    raw = np.frombuffer(text, dtype=np.uint8)
    return Words(raw, np.array([0, len(raw)]), letters)
