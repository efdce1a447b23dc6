"""Lookups and gates on the account table. No operator reads the stored password hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_active(flag: str = "is_subscribed") -> Column:
    """Subscribed; an unknown flag is not."""
    return F.coalesce(F.col(flag).cast("boolean"), F.lit(False))


def find_user(users: DataFrame, email: str) -> DataFrame:
    """The account of one address, without its password hash."""
    return users.where(F.col("email") == email).drop("hashed_password").limit(1)


def find_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """The accounts of many requests by ``email``."""
    return requests.join(users.drop("hashed_password"), "email")


def profiles(users: DataFrame) -> DataFrame:
    return users.select("email", "company_name")


def subscription_status(users: DataFrame) -> DataFrame:
    return users.select(
        "email",
        is_active().alias("is_subscribed"),
        F.col("subscription_plan").alias("plan"),
        F.col("subscription_status").alias("status"),
    )


def subscribed_only(
    data: DataFrame, users: DataFrame, on: Sequence[str], flag: str = "is_subscribed"
) -> DataFrame:
    """The rows whose owner has an active subscription."""
    return data.join(users.where(is_active(flag)).select(*on), list(on), "left_semi")


def new_signups(
    signups: DataFrame, users: DataFrame, order: Sequence[str | Column], on: str = "email"
) -> DataFrame:
    """The first signup per address among those without an account.

    The first of each address is taken before the join, so an address that fills the batch meets
    the accounts as one row.
    """
    first = Window.partitionBy(on).orderBy(*order)
    firsts = (
        signups.where(F.col(on).isNotNull())
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") == 1)
        .drop("_place")
    )
    return firsts.join(users.select(on), on, "left_anti")
