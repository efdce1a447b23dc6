"""Connected components of large graphs by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.storage import written

#: So many edges, 16 MB, are few enough for the last step to be a single task.
LAST_EDGES = 1 << 20


def connected(edges: DataFrame, seed: int = 17, last_edges: int = LAST_EDGES) -> DataFrame:
    """Nodes of the edges (a, b: BIGINT) and a root per component: node, root.

    In each round every node joins the neighbour, or stays itself, that comes first in an order
    drawn for the round; edges are rewritten to the nodes joined. So the nodes left fall by a
    constant factor in expectation, for long chains as for stars, and a node with very many edges
    costs no more than its edges. What is left once there are ``last_edges`` at most is settled by
    a union-find in one task, whose memory that number bounds. Rounds are written to the shared
    folder and put together in the end. No edges give no rows; loops are ignored.
    """
    edges = written(_ends(edges), "components")
    rounds: list[DataFrame] = []
    while edges.count() > last_edges:
        order = lambda c: F.struct(F.xxhash64(F.lit(seed + len(rounds)), c).alias("order"), F.col(c).alias("node"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        joined = written(
            both.groupBy("a")
            .agg(F.min(order("b")).alias("first"))
            .select(F.col("a").alias("node"), F.least(order("a"), F.col("first"))["node"].alias("root")),
            "components",
        )
        rounds.append(joined)
        left = joined.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        right = joined.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        moved = edges.join(left, "a").join(right, "b")
        edges = written(
            _ends(moved.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "components"
        )
    result = edges.coalesce(1).mapInArrow(_union, "node bigint, root bigint")
    while rounds:
        later = result.select(F.col("node").alias("root"), F.col("root").alias("later"))
        result = (
            rounds.pop().join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
        )
    return written(result, "components")


def _ends(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    # A root is never larger than its node, so one pass in order settles all.
    for x in range(len(root)):
        root[x] = root[root[x]]
    return nodes, nodes[np.array(root, np.int64)]


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
    if parts:
        found = roots_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "root"])
