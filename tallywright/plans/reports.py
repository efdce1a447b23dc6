"""The sales and marketing reports: one document per tenant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions.dates import utc_stamp
from tallywright.functions.numbers import round2
from tallywright.operators import coerce, marketing, sales
from tallywright.operators.settle import positions, settle
from tallywright.schema import ENTRY, HEAD, TAIL


class Report(NamedTuple):
    """A report of every tenant in two tables.

    ``summary`` has a row per tenant with all sections that are bounded: totals, ratios, months of
    the calendar, top fives. ``listing`` has a row per region or campaign, ``(by, position,
    entry)``, position from 0 in the order of the list, which may be of any length. ``growing`` is
    the name of that section, null where the table lacks its column, and ``sections`` the order of
    all.
    """

    summary: DataFrame
    listing: DataFrame
    growing: str | None
    sections: list[str]


def presented(name: str) -> Column:
    """A column rounded to two places, as a decimal that JSON writes without an exponent; null
    where it has too many digits for one (see :func:`oversized`)."""
    return round2(name).try_cast("decimal(38,2)")


def amount(x: Column) -> Column:
    """An unrounded sum, likewise."""
    return x.try_cast("decimal(38,6)")


def oversized(values: Mapping[str, Column]) -> Column:
    """Doubles of more digits than a decimal has, by name as text; null where there are none."""
    pairs = [
        F.when(F.abs(v) >= 1e32, F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")))
        for n, v in values.items()
    ]
    kept = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def _list(section: str, order: Sequence[Column], fields: Mapping[str, Column]) -> Column:
    """The entries of a section as an ordered array of records."""
    places = [c.alias(f"_{i}") for i, c in enumerate(order)]
    record = F.struct(*places, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("entry"))
    gathered = F.sort_array(F.collect_list(F.when(F.col("section") == section, record)))
    return F.transform(gathered, lambda r: r["entry"])


def _of_total(x: Column) -> Column:
    return F.max(F.when(F.col("section") == "total", x))


def _total_or_zero(x: Column) -> Column:
    """A total, which may be null as too large, or 0 where there are no rows at all."""
    return F.when(F.bool_or(F.col("section") == "total"), _of_total(x)).otherwise(F.lit(0.0))


def _listing(
    entries: DataFrame, by: Sequence[str], section: str, order: list[Column], fields: Mapping[str, Column]
) -> DataFrame:
    placed = positions(entries.where(F.col("section") == section), by, order)
    entry = F.struct(*[c.alias(n) for n, c in fields.items()])
    return placed.select(*by, F.col("position").cast("bigint").alias("position"), entry.alias("entry"))


def _finish(
    gathered: DataFrame, listing: DataFrame, by: Sequence[str], sections: Mapping[str, Column | None],
    growing: str, large: Mapping[str, Column], stamp: bool,
) -> Report:
    names = list(sections)
    columns = [c.alias(n) for n, c in sections.items() if n != growing]
    if stamp:
        columns.append(utc_stamp().alias("generated_at"))
        names.append("generated_at")
    summary = gathered.select(*by, *columns, oversized(large).alias("large_values"))
    return Report(summary, listing, growing if growing in sections else None, names)


def sales_report(
    df: DataFrame, by: Sequence[str] = (), *, formats: Sequence[str] = (), stamp: bool = True
) -> Report:
    """All sales KPIs of a table with standard column names, per tenant.

    Sections whose column the table lacks are left out. The regions are the listing.
    """
    facts = coerce.sales_facts(df, by, formats)
    return sales_report_of(sales.entries(facts, by), by, facts.columns, stamp=stamp)


def sales_report_of(
    entries: DataFrame, by: Sequence[str], fields: Sequence[str], *, stamp: bool = True
) -> Report:
    """The sales report of what ``sales.leading`` gives, for a table that has ``fields``."""
    entries = settle(entries)
    revenue, key = F.col("revenue"), F.col("key")
    falling = [F.desc("revenue"), key]
    ranked = [-revenue, key]
    lists = {
        "monthly_revenue_trend": _list("month", [key], {"date": key, "revenue": revenue}),
        "top_products": _list("product", ranked, {"product": key, "revenue": amount(revenue)}),
        "top_customers": _list("customer", ranked, {"customer": key, "revenue": amount(revenue)}),
    }
    gathered = entries.groupBy(*by).agg(
        _total_or_zero(revenue).alias("revenue"),
        F.coalesce(_of_total(F.col("orders")), F.lit(0)).alias("orders"),
        *[c.alias(n) for n, c in lists.items()],
    )
    gathered = gathered.withColumns(
        {
            "_average": F.expr(sales.average("revenue", "orders")),
            "_last": F.expr("try_element_at(monthly_revenue_trend, -1).revenue"),
            "_before": F.expr("try_element_at(monthly_revenue_trend, -2).revenue"),
        }
    ).withColumn("_growth", F.expr(sales.growth("_last", "_before")))
    sections = {
        "total_revenue": presented("revenue"),
        "total_orders": F.col("orders"),
        "average_order_value": presented("_average"),
        "monthly_revenue_trend": F.transform(
            "monthly_revenue_trend",
            lambda m: F.struct(m["date"].alias("date"), amount(m["revenue"]).alias("revenue")),
        ),
        "mom_growth_percent": presented("_growth"),
    }
    for section, column in (
        ("top_products", "product"), ("region_wise_sales", "region"), ("top_customers", "customer"),
    ):
        if column in fields and column not in by:
            sections[section] = F.col(section) if section in lists else None
    large = {
        "total_revenue": revenue,
        "average_order_value": F.col("_average"),
        "mom_growth_percent": F.col("_growth"),
    }
    regions = _listing(
        entries, by, "region", falling, {"region": key, "revenue": amount(revenue)}
    )
    return _finish(gathered, regions, by, sections, "region_wise_sales", large, stamp)


def marketing_report(
    df: DataFrame, by: Sequence[str] = (), *, formats: Sequence[str] = (), stamp: bool = True
) -> Report:
    """All marketing KPIs of a table with standard column names, per tenant. The campaigns are the
    listing."""
    facts = coerce.marketing_facts(df, by, formats)
    with_campaigns = "campaign" in facts.columns and "campaign" not in by
    entries = marketing.with_roas(marketing.entries(facts, by)).withColumn(
        "roas", F.when(F.col("section") == "campaign", F.col("roas"))
    )
    entries = settle(entries)
    key, roas = F.col("key"), F.col("roas")
    trend = _list(
        "month",
        [key],
        {"date": key, "spend": amount(F.col("spend")), "revenue": amount(F.col("revenue"))},
    )
    gathered = entries.groupBy(*by).agg(
        *[_total_or_zero(F.col(m)).alias(m) for m in schema.MEASURES],
        *marketing.best_and_worst(key, roas),
        trend.alias("monthly_trend"),
    )
    gathered = marketing.with_ratios(gathered)
    sections = {
        "total_spend": presented("spend"),
        **{f"total_{m}": marketing.whole(m) for m in marketing.COUNTS},
        "total_revenue": presented("revenue"),
        **{name: presented(name) for name in marketing.RATIOS},
    }
    if with_campaigns:
        sections["campaign_performance"] = None
        for name in ("best_campaign", "worst_campaign"):
            sections[name] = F.col(name)
    sections["monthly_trend"] = F.col("monthly_trend")
    large = {
        **{f"total_{m}": F.col(m) for m in schema.MEASURES},
        **{name: F.col(name) for name in marketing.RATIOS},
    }
    falling = [F.desc_nulls_last("roas"), key]
    measures = {m: amount(F.col(m)) for m in marketing.CAMPAIGN_MEASURES}
    campaigns = _listing(
        entries, by, "campaign", falling,
        {"campaign": key, **measures, "roas": roas.try_cast("decimal(38,2)")},
    )
    return _finish(gathered, campaigns, by, sections, "campaign_performance", large, stamp)


def report(df: DataFrame, domain: str = "sales", by: Sequence[str] = (), **options) -> Report:
    """The report of a domain, after the check for the columns it cannot do without."""
    coerce.require_columns(df, domain)
    build = {"sales": sales_report, "marketing": marketing_report}[schema.domain_of(domain)]
    return build(df, by, **options)


def report_json(made: Report, by: Sequence[str] = ()) -> DataFrame:
    """``(by, part, position, text)``: the report as JSON in rows.

    Joined in the order of part and position, a tenant's texts are the JSON document, with null for
    what cannot be computed. It always has a first and a last row, and between them one for each
    region or campaign, so no list is gathered however long it is. Values of more than 38 digits
    are null in their place and follow as text under ``large_values``.
    """
    whole = {"ignoreNullFields": "false"}
    at = made.sections.index(made.growing) if made.growing else len(made.sections)
    fields = lambda names: F.to_json(F.struct(*names), whole)
    first, last = made.sections[:at], made.sections[at + 1 :]
    head, tail = F.lit("{"), F.lit("")
    if first:
        head = F.expr("substring(_head, 1, length(_head) - 1)")
    if made.growing:
        head = F.concat(head, F.lit(f'{"," if first else ""}"{made.growing}":['))
        tail = F.lit("]")
    if last:
        tail = F.concat(tail, F.lit(","), F.expr("substring(_tail, 2, length(_tail) - 2)"))
    large = F.when(
        F.col("large_values").isNotNull(),
        F.concat(F.lit(',"large_values":'), F.to_json("large_values")),
    )
    tail = F.concat(tail, F.coalesce(large, F.lit("")), F.lit("}"))
    ends = made.summary.select(
        *by,
        (fields(first) if first else F.lit("")).alias("_head"),
        (fields(last) if last else F.lit("")).alias("_tail"),
        "large_values",
    ).select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit(HEAD).alias("part"), head.alias("text")),
                F.struct(F.lit(TAIL).alias("part"), tail.alias("text")),
            )
        ).alias("_end"),
    )
    rows = ends.select(*by, "_end.part", F.lit(0).cast("bigint").alias("position"), "_end.text")
    if not made.growing:
        return rows
    comma = F.when(F.col("position") > 0, ",").otherwise("")
    entries = made.listing.select(
        *by, F.lit(ENTRY).alias("part"), "position", F.concat(comma, F.to_json("entry", whole)).alias("text")
    )
    return rows.unionByName(entries)


def confirm_mapping(
    df: DataFrame, mapping: Mapping[str, str | None], domain: str = "sales",
    by: Sequence[str] = (), **options,
) -> Report:
    """Rename by the confirmed mapping, check, and compute the report of the domain."""
    return report(coerce.rename_by_mapping(df, mapping), domain, by, **options)


def reports_by_domain(rows: DataFrame, by: Sequence[str], **options) -> DataFrame:
    """JSON reports of rows of both domains: ``(by, domain, part, position, text)``.

    ``rows`` has the fields of both domains and a column ``domain``; each branch keeps the fields
    its domain defines.
    """
    reports = []
    for domain, fields in (
        ("sales", schema.SALES_FIELDS), ("marketing", schema.MARKETING_FIELDS),
    ):
        is_marketing = F.coalesce(F.col("domain") == "marketing", F.lit(False))
        mine = rows.where(is_marketing if domain == "marketing" else ~is_marketing)
        kept = mine.select(*by, *[f for f in fields if f in rows.columns and f not in by])
        texts = report_json(report(kept, domain, by, **options), by)
        reports.append(texts.select(*by, F.lit(domain).alias("domain"), "part", "position", "text"))
    return reports[0].unionByName(reports[1])
