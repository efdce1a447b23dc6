"""Packing of token sequences by bin completion."""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.positions import with_positions
from tallywright.llm.text import runs
from tallywright.llm.tokens import Memory, encode

#: Bytes of text worked on at once: the more, the fewer chunks are new in each.
RUN = 4 << 20


def token_pieces(
    docs: DataFrame, limit: int, tokenizer: str, end_id: int, id_col: str, text_col: str
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A document of more than ``limit``
    tokens, its end token counted, is cut from the back, so its first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in runs(batches, size=RUN):
            flat, at = encode(batch.column("text"), tokenizer, memory)
            own, rows = batch.column("id").to_pylist(), []
            for number, doc in enumerate(own):
                ids = np.append(flat[at[number] : at[number + 1]], np.uint32(end_id)).astype("<u4")
                begin, end, piece = 0, len(ids) % limit or limit, 0
                while begin < len(ids):
                    end = min(end, len(ids))
                    rows.append((doc, piece, begin, end - begin, zlib.crc32(ids[begin:end])))
                    begin, end, piece = end, end + limit, piece + 1
            columns = zip(*rows, strict=True)
            kinds = (batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(
        cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


def dominates(one: Filling, other: Filling) -> bool:
    """Whether the pieces of ``other`` can be put into the places of those of ``one``: then a packing
    with ``other`` stays one if the two change places, so ``other`` need not be tried."""
    if sum(other) > sum(one) or max(other, default=0) > max(one, default=0):
        return False

    def fits(at: int, rooms: Filling) -> bool:
        if at == len(other):
            return True
        return any(
            fits(at + 1, (*rooms[:i], room - other[at], *rooms[i + 1 :]))
            for i, room in enumerate(rooms)
            if room >= other[at] and room not in rooms[:i]
        )

    return fits(0, one)


def completions(lengths: list[int], left: dict[int, int], space: int, most: int, nodes: int) -> list[Filling]:
    """The ``most`` fullest undominated fillings of ``space`` with what is left, the fullest first.

    Depth first from the largest length that fits, each taken as often as possible first, so no more
    levels than different lengths. A filling to which something could be added is dominated and not
    recorded. The search ends when it has ``most`` full ones, or after ``nodes`` steps once it has
    any; the dominance of others is tested where fillings are short.
    """
    found: dict[Filling, int] = {}
    used: dict[int, int] = {}
    steps = full = 0

    def grow(space: int, at: int, taken: Filling) -> bool:
        nonlocal steps, full
        steps += 1
        smallest = next((n for n in lengths if left[n] > used.get(n, 0)), None)
        if smallest is None or smallest > space:
            full += space == 0 and taken not in found
            found[taken] = space
        for i in range(min(at, bisect.bisect_right(lengths, space)) - 1, -1, -1):
            n = lengths[i]
            for times in range(min(left[n], space // n), 0, -1):
                used[n] = times
                ended = grow(space - times * n, i, taken + (n,) * times)
                used[n] = 0
                if ended:
                    return True
        return full >= most or (steps >= nodes and bool(found))

    grow(space, len(lengths), ())
    kept: list[Filling] = []
    for taken in sorted(found, key=lambda t: (found[t], len(t), t[:1] and -t[0])):
        short = len(taken) <= 8
        if not (short and any(len(k) <= 8 and dominates(k, taken) for k in kept)):
            kept.append(taken)
        if len(kept) == most:
            break
    return kept


def best_fit(counts: dict[int, int], limit: int) -> Plan:
    """Best-fit decreasing over counts: each length, the largest first, goes where it leaves the
    least space; equal sequences are handled together, so steps do not grow with the counts."""
    open_: dict[int, Plan] = {}
    spaces: list[int] = []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        count = counts[length]
        while count:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                filling, there = open_[space].pop()
                times = min(count, there)
                if there > times:
                    open_[space].append((filling, there - times))
                if not open_[space]:
                    del open_[space], spaces[at]
                filling = (*filling, length)
                count -= times
            else:
                each = min(limit // length, count)
                times, space, filling = count // each, limit - (each - 1) * length, (length,) * each
                count -= each * times
            space -= length
            if space not in open_:
                open_[space] = []
                bisect.insort(spaces, space)
            open_[space].append((filling, times))
    return [each for group in open_.values() for each in group]


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """So many sequences any packing needs: the tokens' share, or more where large pieces share badly.

    For each bound up to half of ``limit``: pieces over half have sequences of their own, and what the
    pieces from the bound to half need beyond the room beside those that leave at least the bound
    free comes on top.
    """
    size = np.array(sorted(n for n, c in counts.items() if c), np.int64)
    number = np.array([counts[n] for n in size.tolist()], np.int64)
    least = -(-int((size * number).sum()) // limit)
    over = size * 2 > limit
    for bound in [0, *size[~over].tolist()]:
        beside = over & (size <= limit - bound)
        room = int(((limit - size) * number)[beside].sum())
        rest = int((size * number)[~over & (size >= bound)].sum())
        least = max(least, int(number[over].sum()) + max(0, -((room - rest) // limit)))
    return least


def branch_and_bound(
    counts: dict[int, int],
    limit: int,
    made: int,
    steps: int,
    deviate: tuple[int, int] = (0, 0),
    branches: int = 4,
    nodes: int = 400,
) -> Plan | None:
    """The best plan found with fewer than ``made`` sequences, by bin completion; else None.

    Depth first: the largest piece left goes with each of its undominated fillings in turn, the
    fullest first, as often as the pieces allow, then once. A branch ends as soon as its waste leaves
    no way to need fewer sequences than the best plan so far. ``deviate`` (step, turn) starts one
    step with another filling. The search is complete, if it ends before ``steps`` fillings are put
    and ``branches`` and ``nodes`` do not cut the fillings.
    """
    total = sum(n * c for n, c in counts.items())
    left = {n: c for n, c in counts.items() if c}

    def options(depth: int) -> Iterator[tuple[Filling, int]]:
        lengths = [n for n in left if left[n]]
        lengths.sort()
        largest = lengths[-1]
        left[largest] -= 1
        fillings = completions(lengths, left, limit - largest, branches, nodes)
        left[largest] += 1
        turn = deviate[1] % len(fillings) if depth == deviate[0] else 0
        for taken in fillings[turn:] + fillings[:turn]:
            filling = (largest, *taken)
            times = min(left[n] // filling.count(n) for n in set(filling))
            yield filling, times
            if times > 1:
                yield filling, 1

    def put(filling: Filling, times: int) -> None:
        for n in filling:
            left[n] -= times

    best, plan, waste = None, [], 0
    slack = (made - 1) * limit - total
    if slack < 0 or not left:
        return None
    frames = [options(0)]
    while frames and steps > 0:
        choice = next(frames[-1], None)
        if choice is None:
            frames.pop()
            if plan:
                filling, times = plan.pop()
                put(filling, -times)
                waste -= times * (limit - sum(filling))
            continue
        filling, times = choice
        steps -= 1
        lost = times * (limit - sum(filling))
        if waste + lost > slack:
            continue
        put(filling, times)
        plan.append(choice)
        waste += lost
        if any(left.values()):
            frames.append(options(len(plan)))
            continue
        best = list(plan)
        slack = (sum(t for _, t in best) - 1) * limit - total
        if slack < 0:
            return best
        plan.pop()
        put(filling, -times)
        waste -= lost
    return best


def complete(counts: dict[int, int], limit: int, effort: int = 40, seed: int = 1) -> Plan:
    """Fill sequences of ``limit`` from so many pieces of each length: fillings and their numbers.

    Best fit gives the incumbent. Branch and bound then works on the pieces of its wasteful
    sequences, together with some full ones drawn anew each time, and a filling of them with fewer
    sequences takes their place. It ends at :func:`lower_bound`, or after ``effort`` fillings put for each
    different length (and 1000 more). The work depends on the number of different lengths, not on how
    many pieces there are.
    """
    draw = random.Random(seed)
    plan = best_fit(counts, limit)
    least = lower_bound(counts, limit)
    steps, attempt = 1000 + effort * len(counts), 0
    while steps > 0 and sum(times for _, times in plan) > least:
        share = (0.0, 0.1, 0.3, 0.6, 1.0)[attempt % 5]
        loose = [p for p in plan if sum(p[0]) < limit or draw.random() < share]
        chosen = set(map(id, loose))
        pool: dict[int, int] = {}
        for filling, times in loose:
            for n in filling:
                pool[n] = pool.get(n, 0) + times
        made = sum(times for _, times in loose)
        now = min(steps, 4 * len(pool) + 60)
        steps, attempt = steps - now, attempt + 1
        found = branch_and_bound(pool, limit, made, now, (draw.randrange(20), attempt))
        if found is not None:
            plan = [p for p in plan if id(p) not in chosen] + found
    return plan


def pack(
    docs: DataFrame,
    limit: int = 1024,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` tokens, as few as the search finds.

    The pieces' lengths are counted; these at most ``limit`` counts are all that the search sees,
    on the driver, whatever the number of documents. Each piece then finds its place by its number
    among the pieces of its length.

    Returns per piece ``id_col``, piece (from 0), start, length, ids_crc32, sequence_id (gapless
    from 0), offset. A null or empty text is a piece of one token, the end. Repeated rows are
    packed each. An empty table gives no rows. Other columns are not read. ``tokenizer`` is the
    path of a vocabulary file (default: the byte-level BPE of the public tokenizers).
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    cut = token_pieces(docs, limit, path, end_id, id_col, text_col)
    placed = with_positions(cut, ["length", "id", "piece", "ids_crc32"], ["start"])
    counts = {
        r["length"]: (r["n"], r["first"])
        for r in placed.groupBy("length")
        .agg(F.count("*").alias("n"), F.min("position").alias("first"))
        .collect()
    }
    table = _places(complete({n: c for n, (c, _) in counts.items()}, limit), counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            row = table[np.searchsorted(table[:, 0], position, "right") - 1]
            number, slot = np.divmod(position - row[:, 0], np.maximum(row[:, 1], 1))
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(row[:, 2] + number), pa.array(row[:, 3] + slot * row[:, 4])],
                [id_col, *names[1:], "sequence_id", "offset"],
            )

    kind = placed.schema["id"].dataType.simpleString()
    return placed.mapInArrow(
        place,
        f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint",
    )


def _places(plan: Plan, counts: dict[int, tuple[int, int]]) -> np.ndarray:
    """Rows of (first position, pieces of that length in a sequence, first sequence, offset of the
    first of them, length), by position: a few for each filling."""
    reached = {length: first for length, (_, first) in counts.items()}
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for length in dict.fromkeys(filling):
            each = filling.count(length)
            rows.append((reached[length], each, sequence, offset, length))
            reached[length] += each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)
