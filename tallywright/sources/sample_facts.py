"""Sales and marketing tables derived from the TPC-H-like sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Given schemas save the job that would infer them from a file.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.rint(F.col(c) * 100)


def net_price() -> Column:
    """price x (1 - discount), the double nearest to the four-digit decimal result."""
    return _cents("l_extendedprice") * (F.lit(100.0) - _cents("l_discount")) / F.lit(10000.0)


def discount_amount() -> Column:
    """price x discount, likewise."""
    return _cents("l_extendedprice") * _cents("l_discount") / F.lit(10000.0)


def sales(
    spark: SparkSession, sf_dir: str, fields: Sequence[str] = ("date", "revenue")
) -> DataFrame:
    """One row per line item with the wanted fields; only the tables they need are joined.

    The dimensions of an order are joined to it first, so line items are shuffled once for all of
    them. No side is hinted: Spark broadcasts what its size threshold allows.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if {"customer", "region", "tenant"} & set(fields):
        buyers = table(spark, sf_dir, "customer")
        if "region" in fields:
            places = table(spark, sf_dir, "nation").join(
                table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
            buyers = buyers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        orders = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    if "product" in fields:
        lines = lines.join(
            table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
        )
    source = {
        "tenant": lambda: F.col("c_mktsegment"),
        "date": lambda: F.col("o_orderdate"),
        "revenue": net_price,
        "product": lambda: F.col("p_brand"),
        "region": lambda: F.col("r_name"),
        "customer": lambda: F.col("c_name"),
        "quantity": lambda: F.col("l_quantity"),
    }
    return lines.select(*[source[f]().alias(f) for f in fields])


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a view, click or purchase of a campaign."""
    kind, value = F.col("event_type"), F.col("value")
    number = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("string").alias("tenant"),
        F.col("ts").alias("date"),
        F.concat(F.lit("C"), number.cast("string")).alias("campaign"),
        F.when(kind == "click", value).otherwise(0.0).alias("spend"),
        (kind == "view").cast("int").alias("impressions"),
        (kind == "click").cast("int").alias("clicks"),
        (kind == "purchase").cast("int").alias("conversions"),
        F.when(kind == "purchase", value).otherwise(0.0).alias("revenue"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spend and revenue by ship date, for trends over several years."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("date"),
        discount_amount().alias("spend"),
        net_price().alias("revenue"),
    )
