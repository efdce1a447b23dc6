"""Alignment of two tokenizers over the same texts, counted by inverted bitmaps of token pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.storage import written
from tallywright.llm.text import pieces, runs, text_bytes
from tallywright.llm.tokens import AT_ONCE, Decoder, Memory, blanks, byte_level_bytes, gather, tokenizer

#: Bytes of text worked on at once.
RUN = 2 << 20
#: Distinct chunks whose alignment a task remembers at most.
REMEMBERED = 150_000
#: Documents of a block are so many bits; a bitmap covers one block.
BLOCK_BITS = 12
#: A block's pairs are dealt out in so many parts, so that a few blocks still occupy many tasks.
PARTS = 8
#: Pair entries that a task gathers before it sends them on.
GATHERED = 3_000_000


@lru_cache(maxsize=2)
def _piece_model(path: str):
    """A sentence-piece model and the bytes of its pieces.

    Texts may be cut before a lone space or line feed: no piece goes on over one, which is checked.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            table.append(bytes([int(piece[1:-1], 16)]))
            continue
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} of {path} goes on over a space or line feed")
        table.append(piece.replace("▁", " ").encode())
    return model, table


#: What is known of a chunk: numbers of A tokens, B tokens and groups; the groups as text, each
#: with a semicolon behind, None if the tokens do not spell the chunk; and the pairs that end the
#: groups as bytes of numbers, the A id above the B id's 32 bits.
Aligned = tuple[int, int, int, bytes | None, bytes]


class Spelling:
    """A vocabulary's ids as bytes and as decimals, by array operations."""

    def __init__(self, table: list[bytes], marks: str):
        """``marks`` are what may stand behind an id."""
        self.decoder = Decoder(table)
        texts = [f"{i}{m}".encode() for m in marks for i in range(len(table))]
        self.size = len(table)
        self.text_length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_flat = np.frombuffer(b"".join(texts), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends in the bytes of all."""
        return np.cumsum(self.decoder.length[ids])


@lru_cache(maxsize=2)
def _spellings(first_path: str, second_path: str) -> tuple[Spelling, Spelling]:
    return Spelling(byte_level_bytes(first_path), ",|"), Spelling(_piece_model(second_path)[1], ",;")


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each chunk has."""
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count


def align(
    chunks: list[bytes], first: list[list[int]], second: list[list[int]], spellings: tuple[Spelling, Spelling]
) -> list[Aligned]:
    """Cut the tokens of both sides of each chunk where both end."""
    raw = b"".join(chunks)
    (a, count_a), (b, count_b) = _flat(first), _flat(second)
    if spellings[0].decoder(a) != raw or spellings[1].decoder(b) != raw:
        return _align_each(chunks, first, second, spellings)
    end_a, end_b = spellings[0].ends(a), spellings[1].ends(b)
    stop_a, stop_b = np.cumsum(count_a), np.cumsum(count_b)
    stop = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
    full_a, full_b = np.append(0, end_a)[stop_a], np.append(0, end_b)[stop_b]
    if not (np.array_equal(full_a, stop) and np.array_equal(full_b, stop)):
        return _align_each(chunks, first, second, spellings)
    # Groups end where tokens of both sides end; as every token has bytes, one of each side does.
    _, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    pairs = a[last_a] << 32 | b[last_b]
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 1
    # In the text a group's A tokens come before its B tokens.
    group_a, group_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b) - mark_b
    place_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
    place_b = np.arange(len(b)) + (last_a + 1)[group_b]
    code = np.empty(len(a) + len(b), np.int64)
    sides = len(spellings[0].text_length)
    code[place_a] = a + mark_a * spellings[0].size
    code[place_b] = sides + b + mark_b * spellings[1].size
    length = np.concatenate([spellings[0].text_length, spellings[1].text_length])
    places, reached = gather(length, code)
    text = np.concatenate([spellings[0].text_flat, spellings[1].text_flat])[places].tobytes()
    ends = np.append(0, reached)[stop_a + stop_b].tolist()
    groups = np.searchsorted(last_a, stop_a)
    packed, group_ends = pairs.astype("<i8").tobytes(), (8 * groups).tolist()
    begins, group_begins = [0, *ends[:-1]], [0, *group_ends[:-1]]
    n_groups = np.diff(np.append(0, groups)).tolist()
    rows = zip(count_a.tolist(), count_b.tolist(), n_groups, begins, ends, group_begins, group_ends, strict=True)
    return [(n, m, g, text[x:y], packed[u:v]) for n, m, g, x, y, u, v in rows]


def _align_each(
    chunks: list[bytes], first: list[list[int]], second: list[list[int]], spellings: tuple[Spelling, Spelling]
) -> list[Aligned]:
    """The same, chunk by chunk where some are not spelled by their tokens."""
    if len(chunks) == 1:
        return [(0, 0, 0, None, b"")]
    half = len(chunks) // 2
    left = align(chunks[:half], first[:half], second[:half], spellings)
    return left + align(chunks[half:], first[half:], second[half:], spellings)


def _aligned(chunks: list[bytes], first_path: str, second_path: str) -> Iterator[Aligned]:
    """Align chunks, each of which begins as a text with a space before it does, or with a line feed
    within a text."""
    model, spellings = _piece_model(second_path)[0], _spellings(first_path, second_path)
    for begin in range(0, len(chunks), AT_ONCE):
        some = chunks[begin : begin + AT_ONCE]
        texts = [c.decode() for c in some]
        firsts = tokenizer(first_path, True).encode_batch_fast(texts, add_special_tokens=False)
        # The model puts a space before a text by itself; before a line feed it is taken off again.
        seconds = model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        seconds = [b if t[0] == " " else b[1:] for t, b in zip(texts, seconds, strict=True)]
        yield from align(some, [e.ids for e in firsts], seconds, spellings)


def _spaced(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, a space before each, and where each begins."""
    data, at = text_bytes(text)
    out = np.empty(len(data) + len(text), np.uint8)
    first = at + np.arange(len(at))
    lead = np.zeros(len(out), bool)
    lead[first[:-1]] = True
    out[lead] = 0x20
    out[~lead] = data
    return out, first


class PairBitmaps:
    """Compressed bitmaps of the documents of a block, and how they are merged.

    A pair's documents in a block are a set of bits for each binary digit of the number of links
    that they hold: plane 0 for the ones, plane 1 for the twos, and so on. Each plane is kept as the
    shorter of a sorted array of 16-bit places and the bits themselves.
    """

    @staticmethod
    def planes(place: np.ndarray, links: np.ndarray) -> list[bytes]:
        out, most, digit = [], int(links.max()), 0
        while most >> digit:
            out.append(PairBitmaps._packed(place[(links >> digit & 1) == 1]))
            digit += 1
        return out

    @staticmethod
    def _packed(place: np.ndarray) -> bytes:
        if 2 * len(place) < 1 << BLOCK_BITS >> 3:
            return b"s" + place.astype("<u2").tobytes()
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[place] = 1
        return b"b" + np.packbits(bits).tobytes()

    @staticmethod
    def places(plane: bytes) -> np.ndarray:
        if plane[:1] == b"s":
            return np.frombuffer(plane, "<u2", offset=1)
        return np.flatnonzero(np.unpackbits(np.frombuffer(plane, np.uint8, offset=1)))

    @staticmethod
    def merged(parts: list[list[bytes]]) -> list[bytes]:
        """OR of the planes: the parts hold different documents."""
        if len(parts) == 1:
            return parts[0]
        out = []
        for digit in range(max(map(len, parts))):
            own = [PairBitmaps.places(p[digit]) for p in parts if len(p) > digit]
            out.append(PairBitmaps._packed(np.unique(np.concatenate(own))))
        return out

    @staticmethod
    def popcounts(planes: list[bytes]) -> tuple[int, int]:
        """How many documents hold the pair, and how many links there are."""
        sets = [PairBitmaps.places(p) for p in planes]
        documents = len(np.unique(np.concatenate(sets))) if len(sets) > 1 else len(sets[0])
        return documents, sum(len(s) << digit for digit, s in enumerate(sets))


ROWS = (
    "number long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "pair long, block long, planes array<binary>"
)
ROW_NAMES = ["id", *(part.split(" ")[0] for part in ROWS.split(", "))]


def _posting_rows(keys: np.ndarray, links: np.ndarray, distinct: np.ndarray, numbers: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
    """A row per pair and block. ``keys`` are sorted, pair number above document number."""
    pair, document = np.divmod(keys, np.int64(len(numbers)))
    number = numbers[document]
    block, place = number >> BLOCK_BITS, number & ((1 << BLOCK_BITS) - 1)
    edge = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])))
    ends = np.append(edge[1:], len(keys))
    planes = [PairBitmaps.planes(place[a:b], links[a:b]) for a, b in zip(edge.tolist(), ends.tolist(), strict=True)]
    size = len(edge)
    empty = [pa.nulls(size, id_type)] + [pa.nulls(size, pa.int64())] * 4 + [pa.nulls(size, pa.string())]
    return pa.RecordBatch.from_arrays(
        [*empty, pa.array(distinct[pair[edge]]), pa.array(block[edge]), pa.array(planes, pa.list_(pa.binary()))],
        ROW_NAMES,
    )


def _inverted(slim: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """For each document its numbers of tokens and groups and the digest of these; and for each
    pair and block of a task its bitmaps. The texts are read and tokenized once."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(REMEMBERED)
        gathered, held = [], 0
        for batch in runs(batches, size=RUN):
            numbers, id_type = batch.column("number").to_numpy(), batch.column("id").type
            data, at = _spaced(batch.column("text"))
            cuts = blanks(data, at)
            cuts[at[:-1]] = True
            starts = np.flatnonzero(cuts)
            encoded = pieces(data, np.diff(np.append(starts, len(data))))
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            distinct = encoded.dictionary.to_pylist()
            known = [memory.get(c) for c in distinct]
            new = [n for n, k in enumerate(known) if k is None]
            found_new = _aligned([distinct[n] for n in new], first_path, second_path)
            for n, found in zip(new, found_new, strict=True):
                known[n] = found
                memory.keep(distinct[n], found)
            first = np.searchsorted(starts, at)
            broken = np.array([k[3] is None for k in known])
            bad = np.add.reduceat(broken[codes].astype(np.int64), first[:-1]) > 0
            bad |= np.diff(at) < 2  # a null or empty text has no tokens
            whole = lambda values: np.where(bad, 0, np.add.reduceat(np.array(values, np.int64)[codes], first[:-1]))
            links = np.array([k[2] for k in known], np.int64)
            texts, each = [k[3] for k in known], codes.tolist()
            digests = [
                "" if bad[d] else hashlib.sha256(b"".join([texts[c] for c in each[first[d] : first[d + 1]]])[:-1]).hexdigest()
                for d in range(len(numbers))
            ]
            columns = [whole([k[0] for k in known]), whole([k[1] for k in known]), whole(links)]
            size = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(numbers), *map(pa.array, columns), pa.array(digests)]
                + [pa.nulls(size, pa.int64())] * 2 + [pa.nulls(size, pa.list_(pa.binary()))],
                ROW_NAMES,
            )
            chunk_of = np.repeat(np.arange(size), np.diff(first))
            good = ~bad[chunk_of]
            taken, owner = codes[good], chunk_of[good]
            names, local = np.unique(np.frombuffer(b"".join(k[4] for k in known), "<i8"), return_inverse=True)
            places, _ = gather(links, taken)
            keys = local[places] * np.int64(size) + np.repeat(owner, links[taken])
            keys, times = np.unique(keys, return_counts=True)
            gathered.append((names[keys // size], numbers[keys % size], times))
            held += len(keys)
            del data, cuts, starts, encoded, codes, distinct, known, texts, each, places
            if held > GATHERED:
                yield from _sent(gathered, id_type)
                gathered, held = [], 0
        if held:
            yield from _sent(gathered, id_type)

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(invert, f"id {kind}, {ROWS}")


def _sent(gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    pair, number, times = map(np.concatenate, zip(*gathered, strict=True))
    numbers, document = np.unique(number, return_inverse=True)
    names, local = np.unique(pair, return_inverse=True)
    keys = local * np.int64(len(numbers)) + document
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    step = 200_000
    begin = 0
    while begin < len(keys):  # cut between pairs
        end = begin + step
        if end < len(keys):
            end = int(np.searchsorted(keys, (keys[end] // len(numbers) + 1) * len(numbers)))
        yield _posting_rows(keys[begin:end], times[begin:end], names, numbers, id_type)
        begin = end


def _merged(postings: DataFrame) -> DataFrame:
    """One row per block and pair: the OR of its bitmaps, and their popcounts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts = None, []

        def rows(done: list[tuple[tuple[int, int], list[list[bytes]]]]) -> pa.RecordBatch:
            planes = [PairBitmaps.merged(p) for _, p in done]
            counts = [PairBitmaps.popcounts(p) for p in planes]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[1] for k, _ in done], pa.int64()), pa.array([k[0] for k, _ in done], pa.int64()),
                    pa.array(planes, pa.list_(pa.binary())),
                    pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()),
                ],
                ["pair", "block", "planes", "documents", "links"],
            )

        for batch in batches:
            done = []
            columns = (batch.column(n).to_pylist() for n in ("block", "pair", "planes"))
            for block, pair, planes in zip(*columns, strict=True):
                if (block, pair) != open_key:
                    if open_key is not None:
                        done.append((open_key, parts))
                    open_key, parts = (block, pair), []
                parts.append(planes)
            if done:
                yield rows(done)
        if open_key is not None:
            yield rows([(open_key, parts)])

    dealt = postings.select("pair", "block", "planes").repartition("block", F.pmod(F.xxhash64("pair"), F.lit(PARTS)))
    return dealt.sortWithinPartitions("block", "pair").mapInArrow(
        merge, "pair long, block long, planes array<binary>, documents long, links long"
    )


def pair_counts(merged: DataFrame) -> DataFrame:
    """For each pair of ids: documents that hold it, links, and whether no other first id has more
    links with the second id. Popcounts are summed within the tasks first."""
    counted = merged.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counted.groupBy(second.alias("second")).agg(F.max("links").alias("highest"))
    return counted.withColumn("second", second).join(highest, "second").select(
        "pair", F.shiftright("pair", 32).alias("first_id"), F.col("second").alias("second_id"),
        "documents", "links", (F.col("links") == F.col("highest")).alias("best"),
    )


def _scores(merged: DataFrame, counts: DataFrame) -> DataFrame:
    """(number, n_best, count_sum) of the documents: the postings give each pair's count back to
    the documents in its bitmaps."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BLOCK_BITS
        current, best, total = None, None, None

        def rows() -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array((current << BLOCK_BITS) + some), pa.array(best[some]), pa.array(total[some])],
                ["number", "n_best", "count_sum"],
            )

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("block", "planes", "count", "best"))
            for block, planes, count, top in zip(*columns, strict=True):
                if block != current:
                    if current is not None:
                        yield rows()
                    current, best, total = block, np.zeros(size, np.int64), np.zeros(size, np.int64)
                for digit, plane in enumerate(planes):
                    place = PairBitmaps.places(plane)
                    total[place] += count << digit
                    if top:
                        best[place] += 1 << digit
        if current is not None:
            yield rows()

    weighed = merged.select("pair", "block", "planes").join(
        counts.select("pair", F.col("links").alias("count"), "best"), "pair"
    )
    part = F.pmod(F.xxhash64("pair"), F.lit(PARTS))
    dealt = weighed.repartition("block", part).sortWithinPartitions("block")
    summed = dealt.mapInArrow(add, "number long, n_best long, count_sum long")
    return summed.groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


@dataclass
class Alignment:
    """``documents``: a row per document. ``pairs``: pair, first_id, second_id, documents, links,
    best. ``postings``: the bitmaps by pair and block of document numbers."""

    documents: DataFrame
    pairs: DataFrame
    postings: DataFrame


def align_tokenizers(
    docs: DataFrame,
    first: str | None = None,
    second: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Alignment:
    """Align a byte-level tokenizer (A, its file) and a sentence-piece model (B) on every text.

    A reads a space and the text, B the text, before which it puts a space itself; strings of
    special tokens are plain text. Where tokens of both end, they are cut into groups, and the A and
    the B token that end there are linked. A text whose A or B tokens do not spell it byte for byte
    has no tokens, as null and empty texts. Texts are cut at lone blanks, where both tokenizers
    surely begin a token, and each distinct chunk is tokenized once per run.

    The corpus-wide counts come from an inverted index: for each pair of ids and block of documents
    compressed bitmaps, one per binary digit of a document's number of links, OR-merged where a
    block's parts meet and popcounted. The postings then give the counts back to the documents. A
    pair in most documents is many blocks, dealt out by block; a task holds one block's sums.

    ``documents`` has ``id_col``, n_a, n_b, n_groups, n_links, n_best (links whose pair is its B
    id's most frequent, ties included), count_sum (of the links' pairs), groups_sha256. Repeated
    rows count each, a null id is kept. An empty table gives none. Other columns are not read. A
    text is worked on as a whole, at some 60 bytes for each of its bytes.
    """
    first = first or public_tokenizers.path("byte_bpe_50k.json")
    second = second or public_tokenizers.path("piece_bpe_32k.model")
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("number")
    )
    found = written(_inverted(slim, first, second), "alignment")
    postings = written(_merged(found.filter("pair is not null")), "postings")
    counts = pair_counts(postings)
    scored = _scores(postings, counts).withColumnRenamed("number", "scored")
    own = found.filter("pair is null")
    documents = own.join(scored, own["number"] == scored["scored"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_best", "count_sum")), "groups_sha256",
    )
    return Alignment(documents, counts, postings)
