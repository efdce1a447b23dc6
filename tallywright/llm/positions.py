"""Global row numbers and prefix sums from the totals of range partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.storage import stored

PARTITION = "__partition"


def with_positions(df: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Add ``position`` (row number from 0 in the order of ``keys``) and ``before_<amount>`` (sum
    of a BIGINT column over all earlier rows).

    The rows are range-partitioned and sorted by ``keys`` and stored; then only one row of totals
    per partition goes to the driver, and each partition continues from the totals before it. A
    run of equal keys is no trouble if the keys end in a unique column. Amounts must not be null.
    The result is stored too, so it is the same however often it is read.
    """
    light = stored(df)
    ranged = stored(light.repartitionByRange(*keys).sortWithinPartitions(*keys))
    ranged = ranged.withColumn(PARTITION, F.spark_partition_id())
    sums = [F.sum(name).alias(name) for name in amounts]
    start: dict[int, tuple[int, ...]] = {}
    running = [0] * (1 + len(amounts))
    totals = ranged.groupBy(PARTITION).agg(F.count("*").alias("__rows"), *sums)
    for row in sorted(totals.collect(), key=lambda r: r[PARTITION]):
        start[row[PARTITION]] = tuple(running)
        running = [a + b for a, b in zip(running, row[1:], strict=True)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not reached:
                reached = list(start[batch.column(PARTITION)[0].as_py()])
            columns = [pa.array(reached[0] + np.arange(batch.num_rows, dtype=np.int64))]
            reached[0] += batch.num_rows
            for at, name in enumerate(amounts, 1):
                own = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                columns.append(pa.array(reached[at] + np.cumsum(own) - own))
                reached[at] += int(own.sum())
            kept = [batch.column(name) for name in batch.schema.names if name != PARTITION]
            names = [name for name in batch.schema.names if name != PARTITION]
            yield pa.RecordBatch.from_arrays(
                kept + columns, [*names, "position", *(f"before_{a}" for a in amounts)]
            )

    added = ", ".join(["position bigint", *(f"before_{a} bigint" for a in amounts)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in light.schema.fields)
    return ranged.mapInArrow(number, f"{fields}, {added}")
