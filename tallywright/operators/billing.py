"""Orders, payment checks and the subscription state they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions.signing import hmac_sha256_hex, signed_pair


def known_plan(plan: Column) -> Column:
    """The plan is one on offer; no plan is not."""
    return F.coalesce(plan.isin(*[p for p, _, _ in schema.PLANS]), F.lit(False))


def split_by_plan(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests for a known plan, and the rejected rest."""
    known = known_plan(F.col("plan"))
    return requests.where(known), requests.where(~known)


def order_batch(requests: DataFrame) -> DataFrame:
    """Order rows for ``(user_id, plan, ...)``: price in rupees and minor units, receipt, cycles.

    Requests for unknown plans fall out; see :func:`split_by_plan` for them. The price table has
    two rows by construction.
    """
    plans = F.broadcast(schema.plan_table(requests.sparkSession))
    return requests.join(plans, "plan").select(
        *[c for c in requests.columns],
        "amount",
        (F.col("amount") * 100).alias("amount_minor"),
        F.lit(schema.CURRENCY).alias("currency"),
        F.concat_ws("_", F.lit("order"), F.col("user_id").cast("string"), "plan").alias("receipt"),
        F.lit(schema.PAYMENT_CAPTURE).alias("payment_capture"),
        "cycles",
    )


def payment_signature(first_id: Column, second_id: Column, key: bytes) -> Column:
    """The signature of a payment: order id then payment id; for a subscription, payment id then
    subscription id."""
    return hmac_sha256_hex(signed_pair(first_id, second_id), key)


def check_payments(
    payments: DataFrame, key: bytes, first: str = "order_id", second: str = "payment_id",
    signature: str = "signature",
) -> DataFrame:
    """Adds ``valid``: the given signature is the expected one."""
    expected = payment_signature(F.col(first), F.col(second), key)
    return payments.withColumn(
        "valid", F.coalesce(expected == F.col(signature), F.lit(False))
    )


def check_subscription_payments(payments: DataFrame, key: bytes) -> DataFrame:
    return check_payments(payments, key, "payment_id", "subscription_id")


def split_by_validity(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted payments, and the rejected rest."""
    return checked.where("valid").drop("valid"), checked.where("NOT valid").drop("valid")


def payment_events(accepted: DataFrame) -> DataFrame:
    """Accepted payments as account events."""
    subscription = "subscription_id" in accepted.columns
    return accepted.select(
        "user_id",
        "ts",
        F.col("payment_id").cast("string").alias("event_id"),
        F.lit("payment_verified").alias("event"),
        F.lit(None).cast("string").alias("plan"),
        *([F.col("subscription_id").cast("string")] if subscription else []),
    )


ORDERS = ("order_created", "subscription_created")


def known_events(events: DataFrame) -> DataFrame:
    """Account events of the kinds that change a state, with the ``status`` they lead to; ids as
    text, ``subscription_id`` null where there is no such column."""
    if "subscription_id" not in events.columns:
        events = events.withColumn("subscription_id", F.lit(None).cast("string"))
    status = F.lit(None).cast("string")
    for event, value in schema.STATUS.items():
        status = F.when(F.col("event") == event, value).otherwise(status)
    return events.where(F.col("event").isin(*schema.STATUS)).select(
        "user_id", "ts", F.col("event_id").cast("string").alias("event_id"), "event",
        status.alias("status"), "plan", "subscription_id",
    )


def subscription_state(events: DataFrame) -> DataFrame:
    """Fold account events ``(user_id, ts, event_id, event, plan)`` into one state per user.

    The status is that of the last event, the plan that of the last order, and a user with a
    verified payment is subscribed from then on; a column ``subscription_id`` is optional, its last
    value holds. Ids are text: of equal times the longer id, then the higher one is later, so
    numbers keep their order. It is one aggregation, partial in the map tasks, so a very active user
    arrives as a row per task; a stream takes it too, since a maximum does not depend on the order
    in which events arrive or on their being repeated.
    """
    known = known_events(events)
    ordered = F.col("event").isin(*ORDERS)
    given = F.col("subscription_id").isNotNull()
    order = F.struct("ts", F.length("event_id"), "event_id")
    return known.groupBy("user_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by(F.when(ordered, F.col("plan")), F.when(ordered, order)).alias("plan"),
        F.bool_or(F.col("event") == "payment_verified").alias("is_subscribed"),
        F.max_by("subscription_id", F.when(given, order)).alias("subscription_id"),
    )


def apply_events(users: DataFrame, events: DataFrame) -> DataFrame:
    """The account table after the events."""
    state = subscription_state(events).select(
        F.col("user_id").alias("id"),
        F.col("status").alias("_status"),
        F.col("plan").alias("_plan"),
        F.col("is_subscribed").alias("_subscribed"),
        F.col("subscription_id").alias("_subscription"),
    )
    changed = {
        "is_subscribed": F.coalesce(F.col("is_subscribed"), F.lit(False))
        | F.coalesce(F.col("_subscribed"), F.lit(False)),
        "subscription_plan": F.coalesce(F.col("_plan"), F.col("subscription_plan")),
        "subscription_status": F.coalesce(F.col("_status"), F.col("subscription_status")),
    }
    if schema.SUBSCRIPTION_ID in users.columns:
        changed[schema.SUBSCRIPTION_ID] = F.coalesce("_subscription", schema.SUBSCRIPTION_ID)
    return users.join(state, "id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in users.columns]
    )
