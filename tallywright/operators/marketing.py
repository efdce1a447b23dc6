"""Campaign KPIs over typed marketing facts (see ``coerce.marketing_facts``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.dates import month_key, month_number
from tallywright.functions.numbers import ratio, round2, split_amounts, sum_parts, sum_total
from tallywright.operators.sales import section_columns
from tallywright.schema import MEASURES

CAMPAIGN_MEASURES = ("spend", "clicks", "conversions", "revenue")
TREND_MEASURES = ("spend", "revenue")
# Presented as whole numbers.
COUNTS = ("clicks", "impressions", "conversions")


# Each ratio as numerator, denominator, factor.
RATIOS = {
    "ctr_percent": ("clicks", "impressions", 100),
    "cpc": ("spend", "clicks", 1),
    "cpa": ("spend", "conversions", 1),
    "conversion_rate_percent": ("conversions", "clicks", 100),
    "roas": ("revenue", "spend", 1),
    "roi_percent": ("(revenue - spend)", "spend", 100),
}


def whole(name: str) -> Column:
    """A count without its fraction; null beyond BIGINT."""
    return F.expr(f"try_cast({name} AS BIGINT)")


def _split(facts: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    present = [m for m in measures if m in facts.columns]
    return split_amounts(facts.select(*keys, *present), present)


def _sums(facts: DataFrame, measures: Sequence[str]) -> list[Column]:
    return [c for m in measures if m in facts.columns for c in sum_parts(m)]


def _total(facts: DataFrame, measure: str, absent: Column) -> Column:
    """A measure's total, or ``absent`` where the facts do not have the measure."""
    if measure in facts.columns:
        return sum_total(measure)
    return absent.cast("double").alias(measure)


def with_roas(df: DataFrame) -> DataFrame:
    """Adds the rounded ROAS of rows with ``spend`` and ``revenue``."""
    return (
        df.withColumn("_ratio", F.expr(ratio(*RATIOS["roas"])))
        .withColumn("roas", round2("_ratio"))
        .drop("_ratio")
    )


def with_ratios(df: DataFrame) -> DataFrame:
    """Adds all ratios, not rounded yet, to rows with the five measures."""
    return df.withColumns({name: F.expr(ratio(*parts)) for name, parts in RATIOS.items()})


def totals(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The five totals and six ratios; a measure the facts lack counts as 0."""
    rows = _split(facts, by, MEASURES)
    summed = rows.groupBy(*by).agg(*_sums(facts, MEASURES), F.count(F.lit(1)).alias("_rows"))
    measured = summed.select(*by, *[_total(facts, m, F.lit(0.0)) for m in MEASURES])
    return with_ratios(measured).select(
        *by,
        round2("spend").alias("total_spend"),
        *[whole(m).alias(f"total_{m}") for m in COUNTS],
        round2("revenue").alias("total_revenue"),
        *[round2(name).alias(name) for name in RATIOS],
    )


def campaign_performance(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals per campaign with ROAS, best first, without ROAS last.

    A measure the facts lack is the number of rows of the campaign.
    """
    rows = _split(
        facts.where(F.col("campaign").isNotNull()), [*by, "campaign", "date"], CAMPAIGN_MEASURES
    )
    summed = rows.groupBy(*by, "campaign").agg(
        *_sums(facts, CAMPAIGN_MEASURES), F.count("date").alias("_rows")
    )
    measured = summed.select(
        *by, "campaign", *[_total(facts, m, F.col("_rows")) for m in CAMPAIGN_MEASURES]
    )
    return with_roas(measured).orderBy(*by, F.desc_nulls_last("roas"), "campaign")


def best_and_worst(campaign: Column, ratio_: Column) -> list[Column]:
    """First and last campaign by falling ROAS, names rising where it is equal.

    Plain aggregates over the campaigns that have a ROAS; null when none has.
    """
    place = F.when(ratio_.isNotNull(), F.struct((-ratio_).alias("falling"), campaign.alias("name")))
    return [
        F.min(place)["name"].alias("best_campaign"),
        F.max(place)["name"].alias("worst_campaign"),
    ]


def best_worst(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    performance = campaign_performance(facts, by)
    return performance.groupBy(*by).agg(*best_and_worst(F.col("campaign"), F.col("roas")))


def monthly_trend(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spend and revenue of the months that have rows; a measure the facts lack is their count."""
    rows = _split(facts, [*by, "date"], TREND_MEASURES)
    summed = rows.groupBy(*by, month_number(F.col("date")).alias("month")).agg(
        *_sums(facts, TREND_MEASURES), F.count("date").alias("_rows")
    )
    return summed.select(
        *by,
        month_key(F.col("month")).alias("month"),
        *[_total(facts, m, F.col("_rows")) for m in TREND_MEASURES],
    )


def entries(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, campaigns and months from one scan: ``(by, section, key, measures...)``.

    In the section ``total`` a measure the facts lack is 0, in the others the number of rows.
    """
    numbered = facts.withColumn("month", month_number(F.col("date")))
    keys = [k for k in ("month", "campaign") if k in numbered.columns and k not in by]
    rows = _split(numbered, [*by, *keys], MEASURES)
    grouped = rows.groupingSets([list(by)] + [[*by, k] for k in keys], *by, *keys).agg(
        F.grouping_id().alias("_set"),
        *_sums(facts, MEASURES),
        F.count(F.lit(1)).alias("_rows"),
    )
    section, key, keyed = section_columns(keys)
    absent = F.when(section == "total", F.lit(0)).otherwise(F.col("_rows"))
    return grouped.where(keyed).select(
        *by,
        section.alias("section"),
        key.alias("key"),
        *[_total(facts, m, absent) for m in MEASURES],
    )
