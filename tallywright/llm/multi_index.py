"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.components import connected
from tallywright.llm.storage import stored

#: Rows of either side of one product of the verification: larger strips are cut into such blocks.
RESIDENTS, QUERIES = 4096, 16384
#: Queries whose products are held at once.
BLOCK = 1024
#: Slack of the traversal's last distance, over the rounding of products of other shapes.
ROUNDING = 1e-9


@dataclass
class Grid:
    """Codebooks of the two halves of unit vectors; ``cells`` nearest cells are visited."""

    halves: tuple[np.ndarray, np.ndarray]
    cells: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to their codewords."""
        cut = self.halves[0].shape[1]
        out = []
        for part, book in zip((unit[:, :cut], unit[:, cut:]), self.halves, strict=True):
            square = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
            out.append(np.maximum(square, 0))
        return out[0], out[1]

    def reach(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Distance of the last cell that each query visits.

        The multi-sequence traversal goes through both lists of codewords by distance and takes
        cells by the sum. The cell at places (i, j) has (i + 1) * (j + 1) cells no farther, itself
        included, so only those where that is at most ``cells`` can be among the nearest.
        """
        first, second = np.sort(first, axis=1), np.sort(second, axis=1)
        i, j = np.indices((first.shape[1], second.shape[1])).reshape(2, -1)
        some = (i + 1) * (j + 1) <= self.cells
        sums = first[:, i[some]] + second[:, j[some]]
        last = min(self.cells, sums.shape[1]) - 1
        return np.partition(sums, last, axis=1)[:, last] * (1 + ROUNDING) + ROUNDING


def _codebook(points: np.ndarray, size: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means from drawn points."""
    book = points[draw.permutation(len(points))[:size]].copy()
    for _ in range(rounds):
        near = ((book**2).sum(1) - 2 * points @ book.T).argmin(1)
        count = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        book[count > 0] = sums[count > 0] / count[count > 0, None]
    return book


def fit_grid(sample: np.ndarray, rows: int, groups: int, least: float, recall: float, occupancy: int, most: int, seed: int) -> Grid:
    """Codebooks for about ``occupancy`` vectors a cell, and the number of cells to visit.

    That number is the one at which the share ``recall`` of pairs would be found whose cosine is
    just ``least``: each vector of the sample gets such a partner in a random direction, and the
    rank of the partner's cell in the vector's traversal is looked up.
    """
    draw = np.random.default_rng(seed)
    size = int(np.clip(np.ceil(np.sqrt(rows / max(groups, 1) / occupancy)), 1, most))
    size = min(size, len(sample))
    cut = sample.shape[1] // 2
    grid = Grid((_codebook(sample[:, :cut], size, draw), _codebook(sample[:, cut:], size, draw)), 1)
    away = draw.standard_normal(sample.shape)
    away -= (away * sample).sum(1, keepdims=True) * sample
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    partner = least * sample + np.sqrt(1 - least**2) * away
    ranks = []
    for begin in range(0, len(sample), 256):
        own = grid.distances(sample[begin : begin + 256])
        other = grid.distances(partner[begin : begin + 256])
        row = np.arange(len(own[0]))
        at = own[0][row, other[0].argmin(1)] + own[1][row, other[1].argmin(1)]
        ranks.append((own[0][:, :, None] + own[1][:, None, :] < at[:, None, None]).sum((1, 2)) + 1)
    grid.cells = int(np.quantile(np.concatenate(ranks), recall, method="higher"))
    return grid


def _matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    raw = b"".join(batch.column(column).to_pylist())
    return np.frombuffer(raw, np.float64).reshape(batch.num_rows, -1)


def _forest(a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A few edges that connect what the edges (a, b) between ``rows`` nodes connect."""
    label = np.arange(rows)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    joined = np.flatnonzero(label != np.arange(rows))
    return joined, label[joined]


def similar_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    recall: float = 0.99,
    sample: int = 4096,
    occupancy: int = 16,
    most: int = 256,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links between vectors of one label with a cosine of ``least`` or more, and components.

    Two codebooks, fitted on ``sample`` vectors drawn by the seed, cover the halves of the unit
    vectors; every vector lies in one cell of the product grid and visits the nearest cells until
    ``recall`` is expected at the bound itself (closer pairs are found more often, and each pair has
    two chances). What it meets there is verified in double precision: no pair below the bound
    links. Equal vectors are one class, met once and counted by their number. Links are counted in
    the tasks that find them; only a forest of them leaves a task.

    Returns ``id_col``, n_links, component_id (least id reachable), kept, linkable. A vector links
    with nothing if it, its id or its label is null, or it is empty, zero or holds a null or
    non-finite value; vectors of different lengths do not link. Repeated rows count as copies. An
    empty table gives no rows. Other columns are not read.
    """
    slim = vectors.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    valid = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine & some, F.lit(False)
    )
    light = stored(
        slim.select("id", valid.alias("linkable"), F.xxhash64("label", "v").alias("key"))
    )
    classes = light.filter("linkable").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    once = stored(
        slim.filter(valid)
        .withColumn("key", F.xxhash64("label", "v"))
        .join(classes, ["key", "id"])
        .dropDuplicates(["key"])
        .mapInArrow(_units, "id long, label string, size int, copies long, unit binary")
    )
    shape = once.groupBy("label", "size").agg(F.count("*").alias("n")).groupBy("size").agg(
        F.sum("n").alias("n"), F.count("*").alias("groups")
    )
    found = None
    for row in shape.collect():  # as many rows as there are lengths of vectors
        part = once.filter(F.col("size") == row["size"])
        drawn = part.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("unit").collect()
        points = np.frombuffer(b"".join(r["unit"] for r in drawn), np.float64).reshape(len(drawn), -1)
        grid = fit_grid(points, row["n"], row["groups"], least, recall, occupancy, most, seed)
        own = _search(part, grid, least)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = light.sparkSession.createDataFrame([], "a long, b long, links long")
    found = stored(found)
    counts = found.filter("links > 0").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = connected(found.filter("b is not null").select("a", "b"))
    least_of = roots.groupBy("root").agg(F.min("node").alias("component"))
    placed = roots.join(least_of, "root").select(F.col("node").alias("class"), "component")
    facts = (
        classes.withColumnRenamed("id", "class").join(counts, "class", "left").join(placed, "class", "left")
    )
    linked = F.col("linkable")
    component = F.when(linked, F.coalesce("component", "class")).otherwise(F.col("id"))
    return (
        light.join(facts, "key", "left")
        .select(
            F.col("id").alias(id_col),
            F.when(linked, F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
            .otherwise(0)
            .cast("long")
            .alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
            "linkable",
        )
    )


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; scaled by the largest value first, so squares stay finite."""
    for batch in batches:
        units, sizes = [], []
        for value in batch.column("v"):
            vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            vector = vector / np.abs(vector).max()
            units.append((vector / np.sqrt((vector**2).sum())).tobytes())
            sizes.append(len(vector))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").cast(pa.int64()),
                batch.column("label"),
                pa.array(sizes, pa.int32()),
                batch.column("copies"),
                pa.array(units, pa.binary()),
            ],
            ["id", "label", "size", "copies", "unit"],
        )


def _search(rows: DataFrame, grid: Grid, least: float) -> DataFrame:
    """(a, b, links): edges of a forest (a, b), and numbers of links to be added to a."""
    shared = rows.sparkSession.sparkContext.broadcast(grid)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "label", "copies", "unit"]
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                first, second = shared.value.distances(_matrix(part, "unit"))
                reach = shared.value.reach(first, second)
                query, strip = np.nonzero(first + second.min(1)[:, None] <= reach[:, None])
                at = np.concatenate([np.arange(part.num_rows), query])
                taken = part.select(names).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        *taken.columns,
                        pa.array(np.concatenate([first.argmin(1), strip]), pa.int32()),
                        pa.array(np.arange(len(at)) >= part.num_rows),
                    ],
                    [*names, "strip", "is_query"],
                )

    dealt = rows.mapInArrow(
        deal, "id long, label string, copies long, unit binary, strip int, is_query boolean"
    )
    sizes = dealt.groupBy("label", "strip").agg(
        F.ceil(F.count_if(~F.col("is_query")) / RESIDENTS).cast("int").alias("resident_blocks"),
        F.ceil(F.count_if("is_query") / QUERIES).cast("int").alias("query_blocks"),
    )
    own_blocks = F.when(F.col("is_query"), F.col("query_blocks")).otherwise(F.col("resident_blocks"))
    other = F.when(F.col("is_query"), F.col("resident_blocks")).otherwise(F.col("query_blocks"))
    blocks = (
        dealt.join(sizes, ["label", "strip"])
        .filter((F.col("resident_blocks") > 0) & (F.col("query_blocks") > 0))
        .withColumn("own", F.pmod(F.xxhash64("id"), own_blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
        .withColumn("r", F.when(F.col("is_query"), F.col("other")).otherwise(F.col("own")))
        .withColumn("q", F.when(F.col("is_query"), F.col("own")).otherwise(F.col("other")))
        .select("label", "strip", "r", "q", "id", "copies", "unit", "is_query")
    )

    def verify(group: pa.Table) -> pa.Table:
        grid = shared.value
        strip = group.column("strip")[0].as_py()
        is_query = group.column("is_query").to_numpy()
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        unit = _matrix(group, "unit")
        residents, queries = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        links = np.zeros(len(ids), np.int64)
        first_r, second_r = grid.distances(unit[residents])
        reach_r = grid.reach(first_r, second_r)
        cell = second_r.argmin(1)
        edges = [np.zeros((2, 0), np.int64)]
        for begin in range(0, len(queries), BLOCK):
            some = queries[begin : begin + BLOCK]
            first_q, second_q = grid.distances(unit[some])
            near = first_q[:, strip, None] + second_q <= grid.reach(first_q, second_q)[:, None]
            place_q = first_q.argmin(1), second_q.argmin(1)
            for column in np.unique(cell):
                visiting, there = np.flatnonzero(near[:, column]), np.flatnonzero(cell == column)
                if not len(visiting):
                    continue
                cosine = unit[some[visiting]] @ unit[residents[there]].T
                a, b = np.nonzero(cosine >= least)
                a, b = visiting[a], there[b]
                other = ids[some[a]] != ids[residents[b]]
                a, b = a[other], b[other]
                np.add.at(links, some[a], copies[residents[b]])
                # The resident finds the query by itself if it visits the query's cell.
                back = first_r[b, place_q[0][a]] + second_r[b, place_q[1][a]] <= reach_r[b]
                np.add.at(links, residents[b[~back]], copies[some[a[~back]]])
                edges.append(np.stack(_forest(some[a], residents[b], len(ids))))
        pairs = np.concatenate(edges, axis=1)
        a, b = _forest(pairs[0], pairs[1], len(ids))
        counted = np.flatnonzero(links)
        none = pa.nulls(len(counted), pa.int64())
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[a], ids[counted]])),
                "b": pa.chunked_array([pa.array(ids[b]), none], pa.int64()),
                "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[counted]])),
            }
        )

    return blocks.groupBy("label", "strip", "r", "q").applyInArrow(verify, "a long, b long, links long")
