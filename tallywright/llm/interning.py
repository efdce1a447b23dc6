"""N-grams of words, interned in an open-addressed table of NumPy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from tallywright.llm.text import LOWER, text_bytes

#: Words are runs of digits, letters and all that is not ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Fixed values of the XXH64 algorithm.
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)
#: N-grams of fewer bytes are hashed and compared as four words of eight bytes.
SHORT = 32
#: Masks of the lowest 0 to 8 bytes.
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    return values << np.uint64(by) | values >> np.uint64(64 - by)


def lanes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of short strings as four little-endian numbers each, with zeros behind."""
    padded = np.append(data, np.zeros(SHORT + 8, np.uint8))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.empty((4, len(start)), np.uint64)
    for n in range(4):
        rest = np.clip(length - 8 * n, 0, 8)
        out[n] = windows[np.minimum(start + 8 * n, len(data))].copy().view("<u8").ravel() & LOW_BYTES[rest]
    return out


def xxh64(parts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of strings of fewer than 32 bytes, given by their lanes."""
    size = length.astype(np.uint64)
    found = P5 + size
    for n in range(3):
        mixed = found ^ _turned(parts[n] * P2, 31) * P1
        found = np.where(length >= 8 * (n + 1), _turned(mixed, 27) * P1 + P4, found)
    tail = parts[length >> 3, np.arange(len(length))]
    left = length & 7
    mixed = found ^ (tail & LOW_BYTES[4]) * P1
    found = np.where(left >= 4, _turned(mixed, 23) * P2 + P3, found)
    tail = np.where(left >= 4, tail >> np.uint64(32), tail)
    for n in range(3):
        mixed = found ^ (tail >> np.uint64(8 * n) & LOW_BYTES[1]) * P5
        found = np.where((left & 3) > n, _turned(mixed, 11) * P1, found)
    found ^= found >> np.uint64(33)
    found *= P2
    found ^= found >> np.uint64(29)
    found *= P3
    return found ^ found >> np.uint64(32)


@dataclass
class Grams:
    """All n-grams of some texts: where each lies in ``data``, and the text of each, rising for each
    length of n-grams. ``words`` has the number of words of each text."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    document: np.ndarray
    words: np.ndarray

    def bytes_of(self, number: int) -> bytes:
        return self.data[self.start[number] : self.start[number] + self.length[number]].tobytes()


def grams(text: pa.Array, longest: int) -> Grams:
    """All runs of 1 to ``longest`` consecutive words, A-Z lowered, joined by one space."""
    data, at = text_bytes(text)
    inside = INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.diff(at) > 0
    edge = at[:-1][filled]
    begins[edge] = inside[edge]
    edge = at[1:][filled] - 1
    ends[edge] = inside[edge]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(begins, at)
    size = ends - begins
    # The words in a row, a space after each: every n-gram is one slice of them.
    start = np.cumsum(size + 1) - (size + 1)
    line = np.full(int((size + 1).sum()), 0x20, np.uint8)
    kept = np.ones(len(line), bool)
    kept[start + size] = False
    line[kept] = LOWER[data[inside]]
    document = np.repeat(np.arange(len(text)), np.diff(first))
    starts, lengths, documents = [start], [size], [document]
    for more in range(1, longest):
        whole = np.flatnonzero(document[more:] == document[: len(document) - more])
        starts.append(start[whole])
        lengths.append(start[whole + more] + size[whole + more] - start[whole])
        documents.append(document[whole])
    return Grams(line, *map(np.concatenate, (starts, lengths, documents)), np.diff(first))


@dataclass
class Interned:
    """An open-addressed table: ``owner`` has an n-gram for each slot in use and -1 elsewhere,
    ``slot`` the slot of each n-gram, ``count`` how many n-grams a slot stands for."""

    grams: Grams
    owner: np.ndarray
    slot: np.ndarray
    count: np.ndarray

    def used(self) -> np.ndarray:
        return np.flatnonzero(self.owner >= 0)


def intern(found: Grams) -> Interned:
    """Give equal n-grams one slot.

    The place is the XXH64 of the bytes; probing goes on to the next slot until it finds an empty
    one, or one whose n-gram has the same hash, length and bytes. Hashes alone never decide.
    """
    total = len(found.start)
    size = 1 << max(4, int(2 * total - 1).bit_length()) if total else 16
    mask = np.int64(size - 1)
    owner = np.full(size, -1, np.int64)
    short = found.length < SHORT
    parts = lanes(found.data, found.start, np.minimum(found.length, SHORT - 1))
    hashes = xxh64(parts, np.minimum(found.length, SHORT - 1))
    for number in np.flatnonzero(~short):
        hashes[number] = xxhash.xxh64_intdigest(found.bytes_of(number))
    slot = (hashes & np.uint64(size - 1)).astype(np.int64)
    pending = np.arange(total)
    while len(pending):
        place = slot[pending]
        empty = owner[place] < 0
        owner[place[empty]] = pending[empty]
        there = owner[place]
        same = (hashes[there] == hashes[pending]) & (found.length[there] == found.length[pending])
        for part in parts:
            same &= ~short[pending] | (part[there] == part[pending])
        for n in np.flatnonzero(same & ~short[pending] & (there != pending)):
            same[n] = found.bytes_of(there[n]) == found.bytes_of(pending[n])
        pending = pending[~same]
        slot[pending] = (slot[pending] + 1) & mask
    return Interned(found, owner, slot, np.bincount(slot, minlength=size))
