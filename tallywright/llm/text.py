"""Words of Arrow text columns, split with array operations."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Texts are worked on in runs of about so many bytes; one longer text is a run of its own.
RUN_BYTES = 4 << 20


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (or binaries) in a row, and where each begins (one more at the end)."""
    binary = pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type)
    text = text.fill_null(b"" if binary else "")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    at = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)
    at = at[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return memory that is no longer used to the system: a worker lives on for later tasks, and
    what its allocators keep would add up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def runs(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 16, size: int = RUN_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes of text and at most ``most`` rows.

    One longer text is a slice of its own. At the end of each batch the memory of its work goes back.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + size, "right")) - 1
            end = min(max(end, begin + 1), begin + most, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
        del batch, at
        give_back()


@dataclass
class Words:
    """``codes`` of all words in a row, as places in ``distinct``; document i has those from
    ``first[i]`` to ``first[i + 1]``."""

    codes: np.ndarray
    first: np.ndarray
    distinct: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        each = (xxhash.xxh64_intdigest(word) for word in self.distinct.to_pylist())
        return np.fromiter(each, np.uint64, len(self.distinct))

    def document(self) -> np.ndarray:
        """The number of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def pieces(data: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    """Dictionary-encode consecutive byte strings of the given lengths."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    array = pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return array.dictionary_encode()


def words(text: pa.Array, lower: bool = False) -> Words:
    """Words are runs of other characters than space and U+0009 to U+000D; A-Z may be lowered."""
    data, at = text_bytes(text)
    inside = ~SPACE[data]
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    begins = at[:-1][np.diff(at) > 0]
    starts[begins] = inside[begins]
    ends = at[1:][np.diff(at) > 0] - 1
    stops[ends] = inside[ends]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops)
    kept = data[inside]
    encoded = pieces(LOWER[kept] if lower else kept, stops - starts + 1)
    return Words(
        encoded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, at), encoded.dictionary
    )


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of MurmurHash3)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def shingles(words_: Words, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows of each document, and the document of each. With
    ``short``, a document of fewer words has one window of all its words."""
    hashes = words_.hashes()[words_.codes] if len(words_.codes) else np.zeros(0, np.uint64)
    count = np.diff(words_.first)
    document = words_.document()
    left = words_.first[1:][document] - np.arange(len(document))
    full = np.flatnonzero(left >= size)
    combined = np.full(len(full), size, np.uint64)
    for step in range(size):
        combined = mixed(combined * np.uint64(0x9E3779B97F4A7C15) + hashes[full + step])
    document = document[full]
    if short:
        few = np.flatnonzero((count > 0) & (count < size))
        extra = count[few].astype(np.uint64)
        for step in range(size - 1):
            has = count[few] > step
            at = np.minimum(words_.first[few] + step, max(len(hashes) - 1, 0))
            longer = mixed(extra * np.uint64(0x9E3779B97F4A7C15) + hashes[at])
            extra = np.where(has, longer, extra)
        combined = np.concatenate([combined, extra])
        document = np.concatenate([document, few])
    return combined, document


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it as long as a column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
