"""Exact Jaccard self-join of word n-gram sets by blocked sparse products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.components import connected
from tallywright.llm.kneser_ney import Layout, Table, counted, local_path, merged, tables
from tallywright.llm.positions import with_positions
from tallywright.llm.storage import new_folder, stored
from tallywright.llm.text import free_name, mixed, runs, shingles, words

#: Bytes of text worked on at once.
RUN = 2 << 20
#: n-grams per shard of the table of those that occur more than once.
GRAMS_PER_SHARD = 2_000_000
#: A block of the product holds n-gram sets of about so many entries, and each set counts as
#: LEAST_ENTRIES at least, so a block has at most BLOCK_ENTRIES / LEAST_ENTRIES sets.
BLOCK_ENTRIES = 1 << 20
LEAST_ENTRIES = 512
#: Sets compared at once with one set when most of them overlap it.
STRIDE = 64


def _sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each; their numbers; keys of the sets.

    The key is a 64-bit hash of the set, so equal sets have equal keys.
    """
    hashes, document = shingles(words(text, lower=True), size, short=True)
    order = _by_document(np.argsort(hashes), document)
    hashes, document = hashes[order], document[order]
    if len(hashes):
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
        hashes, document = hashes[fresh], document[fresh]
    count = np.bincount(document, minlength=len(text)).astype(np.int64)
    sums = np.append(np.uint64(0), np.cumsum(mixed(hashes)))
    ends = np.cumsum(count)
    key = mixed((sums[ends] - sums[ends - count]) ^ mixed(count.astype(np.uint64)))
    return hashes, count, key.view(np.int64)


def _by_document(order: np.ndarray, document: np.ndarray) -> np.ndarray:
    """``order`` with each document's entries together; a run has few enough for 16 bits."""
    return order[np.argsort(document[order].astype(np.uint16), kind="stable")]


def set_keys(docs: DataFrame, size: int) -> DataFrame:
    """(id, text_hash, n, key) of each document, stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, size=RUN):
            _, count, key = _sets(batch.column("text"), size)
            columns = [*(batch.column(c) for c in ("id", "text_hash")), pa.array(count), pa.array(key)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n", "key"])

    kind = docs.schema["id"].dataType.simpleString()
    marked = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    return stored(marked.mapInArrow(read, f"id {kind}, text_hash bigint, n bigint, key bigint"))


def _once(count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first of the documents of a run with each key."""
    once = np.zeros(len(key), bool)
    once[np.unique(key, return_index=True)[1]] = True
    return once & (count > 0)


def repeated_grams(docs: DataFrame, size: int, total: int) -> Table | None:
    """How many sets hold each n-gram that more than one holds, counted exactly and kept as sorted
    arrays in files. Hashes have some 13 bits more than needed to number all n-grams: a few single
    ones count as repeated, which costs time but loses nothing."""
    spark = docs.sparkSession
    width = min(max(total.bit_length() + 13, 24), 63)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GRAMS_PER_SHARD))
    layout = Layout(local_path(new_folder(spark, "grams")), 1, 0, shards, width)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in runs(batches, size=RUN):
            hashes, count, key = _sets(batch.column("text"), size)
            yield hashes[np.repeat(_once(count, key), count)] >> np.uint64(64 - width)

    grams = counted(docs.select("text"), layout, 0, read)
    return tables(merged(grams, layout, 0, least=2).collect(), layout).get(0)


def candidate_edges(docs: DataFrame, size: int, percent: int, repeated: Table) -> DataFrame:
    """Edges (a, b) between set keys so that any two sets that may reach the bound are connected.

    Sets with at least ``percent`` in common share one of the first ``n - ceil(percent * n) + 1``
    n-grams in any order common to all: here by the number of sets that hold them, so those that
    none other holds come first and lead to nothing. Of the sets that share an n-gram, sorted by
    size, only neighbours whose sizes allow the bound get an edge: what lies
    between two sizes that allow it does too. So a shared n-gram costs one edge per set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated)  # a few numbers per shard

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, size=RUN):
            hashes, count, key = _sets(batch.column("text"), size)
            document = np.repeat(np.arange(len(count)), count)
            times, _ = shared.value.find(hashes >> np.uint64(64 - shared.value.layout.width))
            rare_first = np.argsort(np.minimum(times, 2**16 - 1).astype(np.uint16), kind="stable")
            order = _by_document(rare_first, document)
            rank = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
            length = count - -(-percent * count // 100) + 1
            kept = (rank < length[document]) & _once(count, key)[document] & (times[order] > 1)
            document = document[kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[order][kept].view(np.int64)),
                    pa.array(count[document]),
                    pa.array(key[document]),
                ],
                ["gram", "n", "key"],
            )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((3, 0), np.int64)
        for batch in batches:
            now = np.array([batch.column(c).to_numpy() for c in ("gram", "n", "key")], np.int64)
            gram, n, key = np.concatenate([last, now], axis=1)
            last = np.array([gram[-1:], n[-1:], key[-1:]])
            near = (gram[1:] == gram[:-1]) & (key[1:] != key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            at = np.flatnonzero(near)
            a, b = np.minimum(key[at], key[at + 1]), np.maximum(key[at], key[at + 1])
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    found = docs.select("text").mapInArrow(prefixes, "gram bigint, n bigint, key bigint")
    dealt = found.repartition("gram").sortWithinPartitions("gram", "n", "key")
    return dealt.mapInArrow(neighbours, "a bigint, b bigint")


def _links(
    key: np.ndarray, count: np.ndarray, entries: np.ndarray, split: int, percent: int
) -> Iterator[tuple[int, int]]:
    """Pairs at the bound among sets in ascending size, as a forest: pairs within sets already
    joined are left out. ``split`` > 0: only pairs between the sets before it and the rest."""
    ends = np.cumsum(count)
    begins = ends - count
    names, column = np.unique(entries, return_inverse=True)
    owner = np.repeat(np.arange(len(count)), count)
    by_column = np.argsort(column, kind="stable")
    column_ends = np.cumsum(np.bincount(column, minlength=len(names)))
    column_begins = np.append(0, column_ends[:-1])
    group = np.arange(len(count))
    marked = np.zeros(len(names), bool)
    for one in range(split or len(count)):
        top = int(np.searchsorted(count, 100 * count[one] // percent, "right"))
        others = np.arange(max(split, one + 1), top)
        others = others[group[others] != group[one]]
        if not len(others):
            continue
        own = column[begins[one] : ends[one]]
        spread = column_ends[own] - column_begins[own]
        sparse = spread.sum() <= count[others].sum()
        if sparse:
            shift = np.repeat(column_begins[own] - (np.cumsum(spread) - spread), spread)
            overlap = np.bincount(owner[by_column[np.arange(spread.sum()) + shift]], minlength=len(count))
        else:
            marked[own] = True
        stride = len(others) if sparse else STRIDE
        while len(others):
            some, others = others[:stride], others[stride:]
            if sparse:
                common = overlap[some]
            else:
                shift = np.repeat(begins[some] - (np.cumsum(count[some]) - count[some]), count[some])
                hit = marked[column[np.arange(count[some].sum()) + shift]]
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(count[some]) - count[some])
            linked = some[100 * common >= percent * (count[one] + count[some] - common)]
            for other in linked:
                if group[other] != group[one]:
                    yield int(key[one]), int(key[other])
                    group[group == group[other]] = group[one]
            if len(linked):
                others = others[group[others] != group[one]]
        if not sparse:
            marked[own] = False


def links(docs: DataFrame, light: DataFrame, edges: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between set keys at the bound that connect all such pairs.

    The sets of a candidate component are sorted by size and cut into blocks; each pair of blocks
    whose sizes allow the bound is a product of its own, so no task holds more than two blocks.
    """
    blocked = connected(edges).withColumnRenamed("node", "key")
    once = light.join(blocked, "key").groupBy("root", "key", "n").agg(F.min("id").alias("id"))
    weighed = once.withColumn("weight", F.greatest("n", F.lit(LEAST_ENTRIES)).cast("long"))
    placed = with_positions(weighed, ["root", "n", "key"], ["weight"])
    starts = placed.groupBy("root").agg(F.min("before_weight").alias("start"))
    placed = stored(
        placed.join(starts, "root")
        .withColumn("block", F.floor((F.col("before_weight") - F.col("start")) / BLOCK_ENTRIES).cast("int"))
        .select("root", "block", "key", "n", "id")
    )
    ranges = placed.groupBy("root", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    first = ranges.select("root", F.col("block").alias("i"), F.col("most").alias("most_i"))
    second = ranges.select("root", F.col("block").alias("j"), F.col("least").alias("least_j"))
    products = (
        first.join(second, "root")
        .filter((F.col("i") <= F.col("j")) & (F.col("most_i") * 100 >= F.col("least_j") * percent))
        .select("root", "i", "j")
    )
    uses = products.select("root", F.col("i").alias("block"), "i", "j").union(
        products.filter("i <> j").select("root", F.col("j").alias("block"), "i", "j")
    )
    uses = uses.groupBy("root", "block").agg(F.collect_list(F.struct("i", "j")).alias("uses"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, size=RUN):
            hashes, count, key = _sets(batch.column("text"), size)
            wanted = batch.column("key").to_numpy()
            ends = np.cumsum(count)
            at = np.flatnonzero(key == wanted)
            sets = [hashes[ends[i] - count[i] : ends[i]].tobytes() for i in at]
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in ("root", "block", "key", "n")), pa.array(sets, pa.binary())],
                ["root", "block", "key", "n", "entries"],
            )

    texts = docs.join(placed, "id").select("root", "block", "key", "n", "text")
    sets = texts.mapInArrow(read, "root bigint, block int, key bigint, n bigint, entries binary")
    dealt = (
        sets.dropDuplicates(["key"])
        .join(uses, ["root", "block"])
        .select("root", "key", "n", "entries", "block", F.explode("uses").alias("use"))
        .select("root", "key", "n", "entries", "block", "use.i", "use.j")
    )

    def multiply(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("key", "ascending")])
        block = group.column("block").to_numpy()
        same = group.column("i")[0] == group.column("j")[0]
        order = np.argsort(block, kind="stable")
        group = group.take(pa.array(order))
        entries = np.frombuffer(b"".join(group.column("entries").to_pylist()), np.uint64)
        pairs = list(
            _links(
                group.column("key").to_numpy(),
                group.column("n").to_numpy(),
                entries,
                0 if same else int((block == block.min()).sum()),
                percent,
            )
        )
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("root", "i", "j").applyInArrow(multiply, "a bigint, b bigint")


def similar_sets(
    docs: DataFrame,
    size: int = 4,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents whose sets of ``size``-word n-grams are alike, as components.

    Words are runs of other characters than ASCII white space, A-Z lowered; a text of fewer words
    is one n-gram. Two documents link if ``100 * intersection >= percent * union``, by 64-bit
    hashes of the n-grams. All links count, none is left out however many copies there are: equal
    sets are one class, and links between classes come from exact overlap counts.

    Returns ``id_col``, n_shingles, component_id (least id reachable). Null and empty texts have
    no n-grams and are components of their own. Repeated ids get a row each. Rows without an id
    belong to the component of an equal text, but a text that only such rows have links with no
    other. An empty table gives no rows. Other columns are not read.
    """
    classes = set_classes(docs, size, percent, id_col, text_col)
    return classes.select(id_col, "n_shingles", "component_id")


def set_classes(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of :func:`similar_sets` with set_root, which tells components of one least id apart,
    and text_hash, which tells texts of one id apart."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    light = set_keys(slim, size)
    repeated = repeated_grams(slim, size, int(light.agg(F.sum("n")).first()[0] or 0))
    if repeated is None:
        edges = light.select(F.col("key").alias("a"), F.col("key").alias("b"))
    else:
        edges = links(slim, light, candidate_edges(slim, size, percent, repeated), size, percent)
    roots = connected(edges).withColumnRenamed("node", "key")
    marked = light.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = marked.filter("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    alone = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return marked.join(least, "root", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        alone.alias("component_id"),
        F.col("root").alias("set_root"),
        "text_hash",
    )


def one_of_each(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each component, that with the smallest id, whole.

    Different texts of one id are documents of their own: of those in one component the one with the
    smallest hash stays. Equal rows of one id are one document. Rows without an id cannot be told
    apart and all stay.
    """
    classes = set_classes(docs, size, percent, id_col, text_col)
    kept = (
        classes.filter(F.col(id_col) == F.col("component_id"))
        .groupBy(id_col, "set_root")
        .agg(F.min("text_hash").alias("text_hash"))
        .select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"))
        .distinct()
    )
    same = (docs[id_col] == kept["__id"]) & (F.xxhash64(docs[text_col]) == kept["__hash"])
    hashed = free_name("__text", docs.columns)
    named = docs.join(kept, same, "left_semi").withColumn(hashed, F.xxhash64(text_col))
    named = named.dropDuplicates([id_col, hashed]).drop(hashed)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
