"""Public tokenizers over Arrow text columns: ids by array operations, and the bytes of ids."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tallywright.llm.text import pieces, text_bytes

#: Distinct chunks whose ids a task remembers at most, the first that it meets.
REMEMBERED = 250_000
#: Chunks given to the tokenizer at once.
AT_ONCE = 20_000
#: Chunks in one text for the tokenizer at most.
IN_A_ROW = 500


@lru_cache(maxsize=4)
def tokenizer(path: str, plain: bool):
    """The tokenizer of a file. ``plain``: strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain
    return found


def blanks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bytes are a single space or line feed between two characters of one text that surely
    are no white space. Next to what may be white space of another kind, none is."""
    blank = (data == 0x20) | (data == 0x0A)
    odd = (data < 0x20) & ~blank | (data >= 0x7F) & (data < 0x80)
    lead = (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3)
    solid = ~blank & ~odd
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:] = solid[:-1]
    before[2:] &= ~lead[:-2]
    before[3:] &= ~lead[:-3]
    after[:-1] = solid[1:] & ~lead[1:]
    lone = blank & before & after
    # A blank at either end of a text has no character on both sides within its own text.
    inner = at[(at > 0) & (at < len(data))]
    lone[inner - 1] = False
    lone[inner] = False
    return lone


def _chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places at which a byte-level tokenizer's own splitting surely begins a new piece: a lone
    space, and before and after a lone line feed. Between other white space longer chunks remain."""
    lone = blanks(data, at)
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = lone
    edge[1:] |= lone & (data == 0x0A)
    edge[at[:-1]] = True
    return np.flatnonzero(edge[:-1])


class Memory(dict):
    """What was worked out for the first ``most`` chunks. Frequent ones are among them."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most = most

    def keep(self, chunk: bytes, found: object) -> None:
        if len(self) < self.most:
            self[chunk] = found


@lru_cache(maxsize=2)
def _byte_lengths(path: str) -> np.ndarray:
    table = byte_level_bytes(path)
    return np.fromiter(map(len, table), np.int64, len(table))


def _chunk_ids(chunks: list[bytes], path: str, plain: bool) -> list[bytes]:
    """The ids of each chunk, four bytes each.

    Chunks that begin with a lone space go through the tokenizer in a row, as one text, which costs
    it far less than a text each; the bytes that the ids stand for tell where each chunk ends. Should
    they not end where the chunks do, each chunk is a text of its own.
    """
    ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
    begins = np.append(0, ends[:-1])
    raw = b"".join(chunks)
    data = np.frombuffer(raw, np.uint8)
    alone = ~blanks(data, np.array([0, len(data)]))[begins] | (data[begins] != 0x20)
    alone[0] = True
    alone[::IN_A_ROW] = True
    cuts = np.append(begins[alone], len(raw)).tolist()
    found = tokenizer(path, plain)
    texts = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:])]
    rows = [e.ids for e in found.encode_batch_fast(texts, add_special_tokens=False)]
    flat = np.fromiter(chain.from_iterable(rows), "<u4", sum(map(len, rows)))
    reached = np.cumsum(_byte_lengths(path)[flat])
    at = np.searchsorted(reached, ends) + 1
    if not len(reached) or reached[-1] != len(raw) or (reached[at - 1] != ends).any():
        done = found.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]
    ids, places = flat.tobytes(), [0, *(4 * at).tolist()]
    return [ids[a:b] for a, b in zip(places, places[1:])]


def encode(
    text: pa.Array, path: str, memory: Memory, plain: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row and where each text's begin (one more at the end).

    Only distinct chunks go through the tokenizer; their ids are put together by array operations.
    ``memory`` belongs to the task that calls, and goes with it.
    """
    data, at = text_bytes(text)
    starts = _chunk_starts(data, at)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    encoded = pieces(data, np.diff(np.append(starts, len(data))))
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    distinct = encoded.dictionary.to_pylist()
    ids: list[bytes | None] = [memory.get(c) for c in distinct]
    new = [n for n, known in enumerate(ids) if known is None]
    for begin in range(0, len(new), AT_ONCE):
        some = new[begin : begin + AT_ONCE]
        for n, found in zip(some, _chunk_ids([distinct[n] for n in some], path, plain), strict=True):
            ids[n] = found
            memory.keep(distinct[n], found)
    length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    places, reached = gather(length, codes)
    before = np.append(0, reached)[np.searchsorted(starts, at)]
    return flat[places], before


def gather(length: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of each coded list in the lists' concatenation, and the running number
    of members. ``length`` has the lists' lengths."""
    own = np.cumsum(length) - length
    count = length[codes]
    reached = np.cumsum(count)
    total = int(reached[-1]) if len(reached) else 0
    return np.arange(total) + np.repeat(own[codes] - (reached - count), count), reached


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 characters
    stand for themselves, the others, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; added tokens are their text."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    letters = byte_letters()
    known = {i: bytes(letters[c] for c in piece) for piece, i in found["model"]["vocab"].items()}
    known |= {t["id"]: t["content"].encode() for t in found["added_tokens"]}
    return [known.get(i, b"") for i in range(max(known) + 1)]


class Decoder:
    """Bytes of ids by array operations."""

    def __init__(self, table: list[bytes]):
        self.length = np.fromiter(map(len, table), np.int64, len(table))
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        places, _ = gather(self.length, ids)
        return self.flat[places].tobytes()


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(byte_level_bytes(path))
