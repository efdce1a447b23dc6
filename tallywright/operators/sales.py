"""Sales KPIs over typed sales facts (see ``coerce.sales_facts``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.dates import month_key, month_number
from tallywright.functions.numbers import round2, split_amounts, sum_parts, sum_total

TOP = 5
RANKED = ("product", "customer")
SECTIONS = ("month", "product", "region", "customer")


def growth(last: str, previous: str) -> str:
    """Percentage change, 0 where there was nothing to grow from; not rounded yet."""
    return (
        f"CASE WHEN {previous} = 0 THEN 0D ELSE ({last} - {previous}) / {previous} * 100D END"
    )


def average(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {total} / {n} ELSE 0D END"


def _revenue_by(facts: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    rows = facts.where(F.col(key).isNotNull()).select(*by, key, "revenue")
    summed = split_amounts(rows, ["revenue"]).groupBy(*by, key).agg(*sum_parts("revenue"))
    return summed.select(*by, key, sum_total("revenue"))


def totals(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, number of rows and average row value."""
    rows = split_amounts(facts.select(*by, "revenue"), ["revenue"])
    summed = rows.groupBy(*by).agg(*sum_parts("revenue"), F.count(F.lit(1)).alias("total_orders"))
    return (
        summed.select(*by, sum_total("revenue"), "total_orders")
        .withColumn("_average", F.expr(average("revenue", "total_orders")))
        .select(
            *by,
            round2("revenue").alias("total_revenue"),
            "total_orders",
            round2("_average").alias("average_order_value"),
        )
    )


def monthly_revenue(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue of the months that have rows."""
    numbered = facts.withColumn("month", month_number(F.col("date")))
    return _revenue_by(numbered, by, "month").withColumn("month", month_key(F.col("month")))


def mom_growth(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Growth of the last month present over the one before it, one row per tenant.

    The windows run over monthly totals, so a tenant brings at most one row per month.
    """
    latest = Window.partitionBy(*by).orderBy(F.desc("month"))
    return (
        monthly_revenue(facts, by)
        .withColumns(
            {"_place": F.row_number().over(latest), "_before": F.lead("revenue").over(latest)}
        )
        .where("_place = 1")
        .withColumn("_growth", F.expr(growth("revenue", "_before")))
        .select(*by, "month", round2("_growth").alias("mom_growth_percent"))
    )


def revenue_by_region(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All regions, highest revenue first."""
    regions = _revenue_by(facts, by, "region")
    return regions.orderBy(*by, F.desc("revenue"), "region")


def _top(facts: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    ranked = _revenue_by(facts, by, key)
    if not by:
        return ranked.orderBy(F.desc("revenue"), key).limit(TOP)
    order = Window.partitionBy(*by).orderBy(F.desc("revenue"), key)
    # The bound on row_number() lets Spark cut each tenant to five rows before the shuffle too.
    return ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).where(
        F.col("rank") <= TOP
    )


def top_products(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _top(facts, by, "product")


def top_customers(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _top(facts, by, "customer")


def section_columns(keys: Sequence[str]) -> tuple[Column, Column, Column]:
    """Section name, key text and "has its key" test of a row of grouping sets.

    The sets are one without a key, called ``total``, and one per name in ``keys``; the grouping
    id, column ``_set``, has one bit per key, set where the key is grouped away. The test uses the
    raw keys, since Spark evaluates it on the rows before they are aggregated.
    """
    everything = (1 << len(keys)) - 1
    section = F.when(F.col("_set") == everything, "total")
    for place, k in enumerate(reversed(keys)):
        section = section.when(F.col("_set") == everything - (1 << place), k)
    key = F.coalesce(*[month_key(F.col(k)) if k == "month" else F.col(k) for k in keys])
    keyed = F.col("_set") == everything
    for k in keys:
        keyed = keyed | F.col(k).isNotNull()
    return section, key, keyed


def sectioned(rows: DataFrame, by: Sequence[str], *sums: Column) -> DataFrame:
    """``(by, section, key)`` and ``sums`` over the rows of each section's key, in one pass."""
    keys = [k for k in SECTIONS if k in rows.columns and k not in by]
    sets = [list(by)] + [[*by, k] for k in keys]
    grouped = rows.groupingSets(sets, *by, *keys).agg(F.grouping_id().alias("_set"), *sums)
    section, key, keyed = section_columns(keys)
    return grouped.where(keyed).select(
        *by, section.alias("section"), key.alias("key"), *grouped.columns[len(by) + len(keys) + 1 :]
    )


def cut_amounts(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The tenant, the keys of the sections and the revenue, split for exact sums."""
    numbered = facts.withColumn("month", month_number(F.col("date")))
    keys = [k for k in SECTIONS if k in numbered.columns and k not in by]
    return split_amounts(numbered.select(*by, *keys, "revenue"), ["revenue"])


def breakdown(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and every revenue breakdown the facts allow, from one scan of them.

    Rows are ``(by, section, key, revenue, orders)``; the section ``total`` has no key. Rows
    without a key are left out of that section only.
    """
    orders = F.count(F.lit(1)).alias("orders")
    summed = sectioned(cut_amounts(facts, by), by, *sum_parts("revenue"), orders)
    return summed.select(*by, "section", "key", sum_total("revenue"), "orders")


def leading(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A breakdown with products and customers cut to the top five of each tenant.

    One ``row_number`` bound serves all sections: outside the ranked ones a row is the only one of
    its window partition. So the cut runs before the shuffle as well, and the many customer totals
    are not sent through a second one.
    """
    slot = F.when(F.col("section").isin(*RANKED), F.lit(None)).otherwise(F.col("key"))
    order = Window.partitionBy(*by, "section", "_slot").orderBy(F.desc("revenue"), "key")
    return (
        rows.withColumn("_slot", slot)
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= TOP)
        .drop("_slot", "_place")
    )


def entries(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return leading(breakdown(facts, by), by)
