"""Words of Arrow text columns found and hashed by their bytes, all at once.

A table classes every byte of the UTF-8 buffer, differences of the classes give the ends of words, and CRC-32
registers of all words advance byte by byte together.  Only numpy arrays over the buffer are made; no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer words are cut into pieces of so many bytes, which advance together and are put in sequence afterwards.
PIECE = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Classes of bytes: no part of a word, part of one, part of one together with the byte behind it.
NONE, PART, LEAD = 0, 1, 2


def _bytes(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for low, high in spans:
        table[low : high + 1] = PART
    return table


#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing: digits, a-z and every byte of other characters.
WORDS = _bytes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: ``[A-Za-z\\u00C0-\\u00FF]+``: the latter are C3 and any byte that may follow it.
LETTERS = _bytes((0x61, 0x7A))
LETTERS[0xC3] = LEAD


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


CRC = _crc_table()
START = np.uint32(0xFFFFFFFF)  # a CRC-32 register begins with it, and is its complement in the end


def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """What each byte of a register becomes behind ``PIECE`` zero bytes; a register's is their sum."""
    value = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(PIECE):
        value = step(value, np.uint32(0))
    return value.reshape(4, 256)


SHIFT = _shift_tables()


def _shifted(state: np.ndarray) -> np.ndarray:
    return SHIFT[0][state & 0xFF] ^ SHIFT[1][state >> 8 & 0xFF] ^ SHIFT[2][state >> 16 & 0xFF] ^ SHIFT[3][state >> 24]


def _march(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after up to ``PIECE`` bytes each: longest first, so that those still under way are a prefix."""
    order = np.argsort(PIECE - lengths.astype(np.uint8), kind="stable")
    at, now = starts[order], state[order]
    under_way = len(order) - np.cumsum(np.bincount(lengths, minlength=PIECE + 1))
    for k in range(PIECE):
        m = under_way[k]
        if not m:
            break
        now[:m] = step(now[:m], data[at[:m] + k])
    out = np.empty_like(now)
    out[order] = now
    return out


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of all spans, from registers ``state``; linear in the bytes for any length."""
    pieces = np.maximum(lengths - 1, 0) // PIECE
    head = lengths - pieces * PIECE
    out = _march(state.astype(np.uint32), data, starts, head)
    long = np.flatnonzero(pieces)
    if len(long):
        first = np.cumsum(pieces[long]) - pieces[long]
        number = np.arange(first[-1] + pieces[long][-1]) - np.repeat(first, pieces[long])
        begin = np.repeat((starts + head)[long], pieces[long]) + number * PIECE
        part = _march(np.zeros(len(begin), np.uint32), data, begin, np.full(len(begin), PIECE))
        order = np.argsort(-pieces[long], kind="stable")
        long, first = long[order], first[order]
        left = pieces[long]
        for k in range(left[0]):
            m = int(np.searchsorted(-left, -k))  # those with more than k pieces
            out[long[:m]] = _shifted(out[long[:m]]) ^ part[first[:m] + k]
    return out


def finished(state: np.ndarray) -> np.ndarray:
    return state ^ START


@dataclass
class Found:
    """Words of a piece of a column: word ``i`` is ``data[starts[i] : starts[i] + lengths[i]]``; text ``t`` owns ``firsts[t] : firsts[t + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    firsts: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def find(column: pa.Array, table: np.ndarray) -> Found:
    """Maximal runs of word bytes of a text column, A-Z lower-cased; nulls have none."""
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.large_binary()), b"")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = LOWER[raw]
    kind = table[data]
    inside = kind != NONE
    lead = np.flatnonzero(kind == LEAD)
    inside[lead[lead + 1 < len(data)] + 1] = True
    edge = np.zeros(len(data) + 1, np.int8)  # one more byte, so that the last word ends
    edge[:-1] = inside
    turns = np.diff(edge, prepend=np.int8(0))
    opens, closes = turns == 1, turns == -1
    touching = offsets[1:-1]
    touching = touching[(touching > 0) & (touching < len(data))]
    touching = touching[inside[touching] & inside[touching - 1]]  # a word ends where its text does
    opens[touching] = closes[touching] = True
    starts = np.flatnonzero(opens)
    return Found(data, starts, np.flatnonzero(closes) - starts, np.searchsorted(starts, offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with texts of up to about ``limit`` bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            gone = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, gone + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
