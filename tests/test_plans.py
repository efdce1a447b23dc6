"""What the plans must look like for large tables."""

import re

import pytest

import __spark_entry__ as entry
from tallywright.operators import coerce, marketing, sales
from tallywright.sources import sample_facts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tall_facts(spark, sf_dir):
    fields = ("tenant", "date", "revenue", "product", "region", "customer")
    return coerce.sales_facts(sample_facts.sales(spark, sf_dir, fields), ("tenant",))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_join_and_no_row_python(name, spark, sf_dir):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert ("ArrowEvalPython" in text) == (name == "map_columns")


def test_report_reads_the_facts_once(spark, sf_dir):
    text = plan(sales.entries(tall_facts(spark, sf_dir), ("tenant",)))
    assert text.count("lineitem.parquet") == 1 and text.count("Expand") == 1
    # The top-five bound is applied before the shuffle as well.
    assert re.search(r"WindowGroupLimit.*Partial", text) and "Final" in text


def test_marketing_entries_read_the_facts_once(spark, sf_dir):
    facts = coerce.marketing_facts(sample_facts.campaigns(spark, sf_dir), ("tenant",))
    assert plan(marketing.entries(facts, ("tenant",))).count("events.parquet") == 1


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    facts = coerce.sales_facts(sample_facts.sales(spark, sf_dir, ("date", "revenue", "product")))
    text = plan(sales.top_products(facts))
    line = next(l for l in text.splitlines() if "lineitem.parquet" in l)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double,l_discount:double>" in line
    orders = next(l for l in text.splitlines() if "orders.parquet" in l)
    assert "IsNotNull(o_orderdate)" in orders
    assert "TakeOrderedAndProject" in text
    assert "customer.parquet" not in text


def test_trend_scan_is_filtered(spark, sf_dir):
    facts = coerce.marketing_facts(sample_facts.shipments(spark, sf_dir))
    assert "IsNotNull(l_shipdate)" in plan(marketing.monthly_trend(facts))


def test_joins_do_not_depend_on_broadcast(spark, sf_dir):
    """With broadcasting off every join still plans as an equi-join over a shuffle."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for name in ("sales_breakdown_one_scan", "user_lookup", "subscription_gate", "map_columns"):
            text = plan(entry.queries()[name](spark, sf_dir))
            assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.set(key, old)
