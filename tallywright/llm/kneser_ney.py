"""Interpolated modified Kneser-Ney models counted in Spark, kept as sorted arrays in files.

An n-gram is one 64-bit key: its symbols, ``bits`` each, the newest in the low bits, and above them
a group (a language, say) whose model is its own. Counts travel as sorted blocks of keys; each
shard's blocks are merged in a task of its own and written to the shared folder, from which workers
map the arrays into memory. So a model may grow with the corpus; no process ever holds it whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywright.llm.text import mixed

BLOCK_TYPE = "shard int, level int, keys binary, counts binary, few array<long>, heads binary"
NAMES = ["shard", "level", "keys", "counts", "few", "heads"]


def packed(values: np.ndarray) -> bytes:
    """Bytes of the array, the highest bytes of all values first: sorted values compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass(frozen=True)
class Layout:
    """How keys are made up and dealt out. Level 0 is a plain table of hashes, of ``width`` bits and
    dealt out by range if that is given."""

    folder: str
    order: int
    bits: int
    shards: int
    width: int = 0

    def suffix(self, keys: np.ndarray, level: int) -> np.ndarray:
        """The last ``level`` symbols, with the group."""
        if self.order * self.bits == 64:
            return keys & np.uint64(2 ** (level * self.bits) - 1)
        group = np.uint64(2**64 - 2 ** (self.order * self.bits))
        return keys & (group | np.uint64(2 ** (level * self.bits) - 1))

    def context(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(self.bits)

    def shard(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Contexts stay whole; single words, of which all have one context, go by themselves."""
        if self.width:
            return (keys // np.uint64(-(-(2**self.width) // self.shards))).astype(np.int64)
        return (mixed(self.context(keys) if level > 1 else keys) % np.uint64(self.shards)).astype(np.int64)


def blocks(layout: Layout, level: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard that the sorted distinct keys touch."""
    shard = layout.shard(keys, level)
    order = np.argsort(shard, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.uint64)
    cut = np.append(0, np.cumsum(np.bincount(shard, minlength=layout.shards)))
    some = np.flatnonzero(np.diff(cut))
    part = lambda values: pa.array([packed(values[cut[s] : cut[s + 1]]) for s in some], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some, pa.int32()),
            pa.array(np.full(len(some), level), pa.int32()),
            part(keys),
            part(counts),
            pa.nulls(len(some), pa.list_(pa.int64())),
            pa.nulls(len(some), pa.binary()),
        ],
        NAMES,
    )


def counted(
    rows: DataFrame, layout: Layout, level: int, read: Callable[[Iterator], Iterator[np.ndarray]], most: int = 1_500_000
) -> DataFrame:
    """Blocks of counts of all keys that ``read`` finds in the rows, summed within each task as far
    as ``most`` keys go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for keys in read(batches):
            parts.append(np.unique(keys, return_counts=True))
            size += len(parts[-1][0])
            if size > most:
                yield blocks(layout, level, *summed(*map(np.concatenate, zip(*parts, strict=True))))
                parts, size = [], 0
        if size:
            yield blocks(layout, level, *summed(*map(np.concatenate, zip(*parts, strict=True))))

    return rows.mapInArrow(count, BLOCK_TYPE)


def local_path(uri: str) -> str:
    """The path at which every worker can open a folder: the shared folder must be mounted."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        raise RuntimeError(f"workers map the model's files; mount {uri} and name it as file://")
    return uri


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write under a name of its own and rename: a repeated task leaves the same file."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(part, "wb") as out:
        np.save(out, values)
    os.replace(part, f"{folder}/{name}.npy")


@lru_cache(maxsize=8192)
def mapped(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def merged(blocks_: DataFrame, layout: Layout, level: int, least: int = 1) -> DataFrame:
    """Merge the blocks of each shard of a level and write its arrays, of keys counted ``least``
    times or more.

    Written are the sorted keys and their counts and, above level 1, the contexts with their totals
    and numbers of keys counted once, twice and more often. The result has a row of figures per
    shard and, above level 1, blocks of the next lower level: how many different symbols stand
    before each shorter n-gram. Figures of higher levels pass through.
    """

    def merge(group: pa.Table) -> pa.Table:
        passed = group.filter(pa.compute.is_valid(group.column("few")))
        group = group.filter(pa.compute.is_null(group.column("few")))
        out = [passed.cast(pa.schema(list(zip(NAMES, KINDS, strict=True))))]
        if group.num_rows:
            keys = np.concatenate([unpacked(k) for k in group.column("keys").to_pylist()])
            counts = np.concatenate([unpacked(c) for c in group.column("counts").to_pylist()])
            keys, counts = summed(keys, counts)
            keys, counts = keys[counts >= least], counts[counts >= least]
            shard = group.column("shard")[0].as_py()
            write_array(layout.folder, f"{level}-keys-{shard}", keys)
            write_array(layout.folder, f"{level}-counts-{shard}", np.minimum(counts, 2**32 - 1).astype(np.uint32))
            few = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]
            heads = b""
            if level:
                context = layout.context(keys)
                first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                facts = np.stack(
                    [np.add.reduceat(counts.astype(np.float64), first)]
                    + [np.add.reduceat((np.minimum(counts, 3) == c).astype(np.float64), first) for c in (1, 2, 3)]
                )
                if level > 1:
                    write_array(layout.folder, f"{level}-contexts-{shard}", context[first])
                    write_array(layout.folder, f"{level}-facts-{shard}", facts.T.astype(np.float32))
                    lower = np.unique(layout.suffix(keys, level - 1), return_counts=True)
                    out.append(pa.Table.from_batches([blocks(layout, level - 1, *lower)]))
                else:
                    heads = np.concatenate([context[first][None].astype(np.float64), facts]).T.tobytes()
            row = [[shard], [level], [None], [None], [[len(keys), int(counts.sum()), *few.tolist()]], [heads]]
            out.append(pa.table([pa.array(v, k) for v, k in zip(row, KINDS, strict=True)], NAMES))
        return pa.concat_tables(out)

    return blocks_.groupBy("shard").applyInArrow(merge, BLOCK_TYPE)


KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]


def discounts(few: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of keys counted once to four times;
    0.5, 1 and 1.5 where a table is too small to give them."""
    n1, n2, n3, n4 = (float(x) for x in few)
    plain = np.array([0.5, 1.0, 1.5])
    if min(n1, n2, n3, n4) <= 0:
        return plain
    y = n1 / (n1 + 2 * n2)
    found = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((found > 0) & (found < np.array([1, 2, 3])), found, plain)


@dataclass
class Table:
    """A level as workers see it."""

    layout: Layout
    level: int
    there: np.ndarray
    sizes: np.ndarray
    total: int
    discount: np.ndarray
    heads: dict[int, np.ndarray] = field(default_factory=dict)

    def _search(self, keys: np.ndarray, shard: np.ndarray, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Per shard: which of the keys it has, and at which places."""
        order = np.argsort(keys) if self.layout.width else np.lexsort((keys, shard))
        cut = np.append(0, np.cumsum(np.bincount(shard, minlength=self.layout.shards)))
        for s in np.flatnonzero(np.diff(cut)):
            if not self.there[s]:
                continue
            some = order[cut[s] : cut[s + 1]]
            stored = mapped(self.layout.folder, f"{self.level}-{name}-{s}")
            place = np.searchsorted(stored, keys[some])
            place[place == len(stored)] = 0
            hit = stored[place] == keys[some]
            yield some[hit], place[hit], int(s)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each key, 0 if it is not there, and its place among all keys of the table."""
        counts = np.zeros(len(keys), np.int64)
        places = np.full(len(keys), -1, np.int64)
        before = np.append(0, np.cumsum(self.sizes))
        for some, place, s in self._search(keys, self.layout.shard(keys, self.level), "keys"):
            counts[some] = mapped(self.layout.folder, f"{self.level}-counts-{s}")[place]
            places[some] = before[s] + place
        return counts, places

    def facts(self, keys: np.ndarray) -> np.ndarray:
        """Of each key's context: total count, and numbers of keys counted once, twice, more."""
        context = self.layout.context(keys)
        out = np.zeros((len(keys), 4))
        if self.level == 1:
            for head, values in self.heads.items():
                out[context == np.uint64(head)] = values
            return out
        for some, place, s in self._search(context, self.layout.shard(keys, self.level), "contexts"):
            out[some] = mapped(self.layout.folder, f"{self.level}-facts-{s}")[place]
        return out


def tables(rows: list, layout: Layout) -> dict[int, Table]:
    """The tables of all levels from the figures of their shards: a few numbers per shard."""
    out = {}
    for level in {r["level"] for r in rows}:
        own = [r for r in rows if r["level"] == level]
        sizes = np.zeros(layout.shards, np.int64)
        heads: dict[int, np.ndarray] = {}
        for r in own:
            sizes[r["shard"]] = r["few"][0]
            for head, *values in np.frombuffer(r["heads"] or b"", np.float64).reshape(-1, 5):
                heads[int(head)] = heads.get(int(head), 0) + np.array(values)
        few = np.sum([r["few"] for r in own], axis=0)
        out[level] = Table(layout, level, sizes > 0, sizes, int(few[1]), discounts(few[2:]), heads)
    return out


def fit(counted_: DataFrame, layout: Layout) -> dict[int, Table]:
    """All levels from the blocks of the highest, in one job: a shuffle per level."""
    for level in range(layout.order, 0, -1):
        counted_ = merged(counted_, layout, level)
    return tables(counted_.collect(), layout)


def probabilities(model: dict[int, Table], layout: Layout, keys: np.ndarray) -> np.ndarray:
    """Interpolated probability of the newest symbol of each key after the others.

    The lowest order is interpolated with equal shares for the known symbols and one unknown.
    """
    if 1 not in model:
        return np.ones(len(keys))
    lowest = layout.suffix(keys, 1)
    p = 1 / (model[1].facts(lowest)[:, 1:].sum(1) + 1)
    for level in range(1, layout.order + 1):
        own, back = np.unique(layout.suffix(keys, level), return_inverse=True)
        table = model[level]
        count, _ = table.find(own)
        facts = table.facts(own)
        total = np.maximum(facts[:, 0], 1)
        kept = np.where(count > 0, count - np.append(0, table.discount)[np.minimum(count, 3)], 0) / total
        left = np.where(facts[:, 0] > 0, facts[:, 1:] @ table.discount / total, 1.0)
        p = kept[back] + left[back] * p
    return p
