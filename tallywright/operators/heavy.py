"""The largest keys by mergeable summaries, proven or computed in full.

:func:`sales.top_customers` sends every key that a task meets through a shuffle. Where a few keys
lead, a summary of fixed size per task is enough to find them:

1. Each task adds up positive revenue by key and cuts its table back to ``capacity`` keys whenever it
   has grown to twice as many: the largest value that does not fit is taken off every key, and what
   falls to nothing is dropped. So a key's true sum in the task lies between the value kept and that
   value plus all that was ever taken off (``lost``), also for keys that are not there any more.
2. The summaries add up to the same bounds over all tasks. Tenants' leading keys are candidates.
3. Their exact sums come from a second pass over the rows.
4. A tenant is proven if its fifth exact sum is above the upper bound of every other key. The rest,
   where keys are too alike, are computed in full.

What a task loses is at most its positive revenue over ``capacity``, so leaders with more than that
share of all revenue are always proven, whatever the number of keys. Refunds only lower sums, so the
bounds hold with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallywright.operators import sales
from tallywright.operators.settle import settle

#: Sums of doubles in another order differ by less than this share.
SLACK = 1e-9


def cut(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """``weights`` less the largest one that has no room among ``capacity``, and that amount."""
    if len(weights) <= capacity:
        return weights, 0.0
    place = len(weights) - capacity - 1
    taken = float(np.partition(weights, place)[place])
    return weights - taken, taken


def _summariser(
    keys: Sequence[str], schema: pa.Schema, capacity: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merge(table: pa.Table) -> pa.Table:
        return table.group_by(list(keys)).aggregate([("weight", "sum")]).rename_columns([*keys, "weight"])

    def shrink(table: pa.Table) -> tuple[pa.Table, float]:
        weights, taken = cut(table["weight"].to_numpy(), capacity)
        place = table.schema.get_field_index("weight")
        table = table.set_column(place, "weight", pa.array(weights))
        return table.filter(pc.greater(table["weight"], 0.0)), taken

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).rename_columns([*keys, "weight"])
            held = merge(rows if held is None else pa.concat_tables([held, rows]))
            if held.num_rows > 2 * capacity:
                held, taken = shrink(held)
                lost += taken
        if held is None:
            return
        held, taken = shrink(held)
        lost += taken
        flat = held.append_column("lost", pa.nulls(held.num_rows, pa.float64())).cast(schema)
        yield from flat.to_batches()
        loss = {name: [None] for name in schema.names} | {"lost": [lost]}
        yield pa.RecordBatch.from_pydict(loss, schema)

    return summarise


def summaries(facts: DataFrame, by: Sequence[str], key: str, capacity: int) -> DataFrame:
    """``(by, key, weight)`` of each task's largest keys, and a row with only ``lost`` per task."""
    rows = facts.where(F.col(key).isNotNull() & (F.col("revenue") > 0) & ~F.isnan("revenue"))
    rows = rows.where(F.col("revenue") < float("inf")).select(*by, key, F.col("revenue").alias("weight"))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    kind = T.StructType(
        [*fields, T.StructField("weight", T.DoubleType()), T.StructField("lost", T.DoubleType())]
    )
    return rows.mapInArrow(_summariser([*by, key], to_arrow_schema(kind), capacity), kind)


def _matches(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & left[name].eqNullSafe(right[f"_{name}"])
    return same


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(f"_{n}") for n in names])


def top_by_summaries(
    facts: DataFrame,
    by: Sequence[str],
    key: str,
    capacity: int = 4096,
    candidates: int = 64,
    most: int = 200_000,
) -> DataFrame:
    """The result of ``sales.top_products`` or ``sales.top_customers``, for any data.

    ``capacity`` keys a task are kept, ``candidates`` a tenant are summed exactly. These are broadcast,
    as there are ``most`` at the utmost; with more (very many tenants) everything is computed in full.
    The rows are read twice, and once more for the tenants without proof, so facts that are dear to
    compute should be stored first. Rows without the key are left out; no rows give no rows.
    """
    found = settle(summaries(facts, by, key, capacity))
    lost = found.agg(F.sum("lost")).first()[0] or 0.0
    bounds = found.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.sum("weight").alias("lower"))
    order = Window.partitionBy(*by).orderBy(F.desc("lower"), key)
    place = F.row_number().over(order)
    leaders = settle(bounds.withColumn("_place", place).where(F.col("_place") <= candidates + 1))
    if leaders.count() > most:
        return sales._top(facts, by, key)
    chosen = F.broadcast(_renamed(leaders.where(F.col("_place") <= candidates), [*by, key]))
    wanted = facts.join(chosen, _matches(facts, chosen, [*by, key]), "left_semi")
    best = settle(sales._top(wanted, by, key))
    # No other key reaches more than this: the first that is no candidate, and what tasks lost.
    rest = leaders.where(F.col("_place") == candidates + 1)
    rest = rest.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("lower").alias("_rest"))
    fifth = best.groupBy(*by).agg(F.count("revenue").alias("_n"), F.min("revenue").alias("_least"))
    if by:
        fifth = fifth.join(F.broadcast(rest), _matches(fifth, rest, by), "left")
    else:
        others = rest.first()
        fifth = fifth.withColumn("_rest", F.lit(others["_rest"] if others else None).cast("double"))
    bound = (F.coalesce("_rest", F.lit(0.0)) + lost) * (1 + SLACK)
    proven = fifth.where((F.col("_n") >= sales.TOP) & (F.col("_least") > bound))
    if not by:
        return best if proven.count() else sales._top(facts, by, key)
    proven = settle(_renamed(proven, by))
    safe = F.broadcast(proven)
    sure = best.join(safe, _matches(best, safe, by), "left_semi")
    open_ = facts.join(safe, _matches(facts, safe, by), "left_anti")
    return sure.unionByName(sales._top(open_, by, key))
