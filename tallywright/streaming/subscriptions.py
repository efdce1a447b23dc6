"""Subscriptions followed on a stream of account events.

The batch fold (``billing.subscription_state``) says how things stand. Here every change is told as
it comes: what a user's subscription was and became, and by which event. Events may arrive late,
twice and in any order; the last change of each user is the batch result over the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywright.operators.billing import ORDERS, known_events

#: The place of an event in time: instant, length of the id, id; nothing known is the earliest.
Place = tuple[int, int, str]
NEVER: Place = (-(2**63), -1, "")


@dataclass
class Subscription:
    """A user's state. Each value goes with the place of the event that gave it, so an event that is
    not later changes nothing, whenever it arrives."""

    status: str | None = None
    status_at: int = NEVER[0]
    status_size: int = NEVER[1]
    status_id: str = NEVER[2]
    plan: str | None = None
    plan_at: int = NEVER[0]
    plan_size: int = NEVER[1]
    plan_id: str = NEVER[2]
    subscription_id: str | None = None
    subscription_at: int = NEVER[0]
    subscription_size: int = NEVER[1]
    subscription_event: str = NEVER[2]
    is_subscribed: bool = False
    revision: int = 0
    reminded_at: int = NEVER[0]

    def seen(self) -> tuple:
        return self.status, self.plan, self.is_subscribed, self.subscription_id

    def take(self, event: str, status: str, plan: str | None, subscription: str | None, place: Place) -> None:
        if place >= (self.status_at, self.status_size, self.status_id):
            self.status, (self.status_at, self.status_size, self.status_id) = status, place
        if event in ORDERS and place >= (self.plan_at, self.plan_size, self.plan_id):
            self.plan, (self.plan_at, self.plan_size, self.plan_id) = plan, place
        at = (self.subscription_at, self.subscription_size, self.subscription_event)
        if subscription is not None and place >= at:
            self.subscription_id = subscription
            self.subscription_at, self.subscription_size, self.subscription_event = place
        self.is_subscribed = self.is_subscribed or event == "payment_verified"

    def waits(self) -> bool:
        """An order or subscription is open and was never paid."""
        return self.status in ("order_created", "created") and not self.is_subscribed


_KINDS = {"str | None": "STRING", "str": "STRING", "int": "BIGINT", "bool": "BOOLEAN"}
STATE = ", ".join(f"{f.name} {_KINDS[f.type]}" for f in fields(Subscription))
CHANGE = (
    "revision BIGINT, cause STRING, event_id STRING, late BOOLEAN, status_before STRING, status STRING,"
    " plan STRING, is_subscribed BOOLEAN, subscription_id STRING"
)
_COLUMNS = [part.split()[0] for part in CHANGE.split(",")]


def _instant(ts: Column, kind: T.DataType) -> Column:
    """A number that grows with the time: microseconds of timestamps, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ts)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(_ts AS TIMESTAMP_NTZ))")
    return ts.cast("bigint")


def follow_subscriptions(
    events: DataFrame, unpaid_after: str | None = None, lateness: str = "30 days"
) -> DataFrame:
    """Changes of every user's subscription, from a stream of ``(user_id, ts, event_id, event, plan)``
    and maybe ``subscription_id``.

    Each row is a change: ``revision`` counts a user's from 1, ``cause`` is the event's kind, ``late``
    tells that a later event had come before. Events that change nothing, repeated ones among them,
    give no row. The events of a batch are taken in the order of their times and ids.

    Without ``unpaid_after`` every event counts however late it is. With it (an interval such as
    "3 days"; ``ts`` must be a timestamp) a user whose last order stays unpaid for so long, by the
    events' own time, gets a row with cause ``unpaid``; a state is then kept by the watermark, and
    events more than ``lateness`` behind the newest are dropped by Spark.

    One state of fixed size per user is kept; a user's events of one batch arrive in one task, as
    batches of rows.
    """
    kind = events.schema["ts"].dataType
    known = known_events(events).withColumn("_ts", F.col("ts"))
    key = known.schema["user_id"].dataType.simpleString()
    known = known.withColumn("_at", _instant(F.col("_ts"), kind))
    wait = None
    if unpaid_after is not None:
        wait = int(pd.Timedelta(unpaid_after).total_seconds() * 1_000_000)
        moment = F.timestamp_micros("_at") if not isinstance(kind, T.TimestampType) else F.col("_ts")
        known = known.withColumn("_moment", moment).withWatermark("_moment", lateness)

    def follow(user: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Subscription(*state.get) if state.exists else Subscription()
        changes: list[tuple] = []
        if state.hasTimedOut:
            now.revision += 1
            now.reminded_at = now.status_at
            changes.append((now.revision, "unpaid", now.status_id, False, now.status, *now.seen()))
        columns = ["_at", "event_id", "event", "status", "plan", "subscription_id"]
        rows = []
        for part in parts:
            for at, id_, *rest in part[columns].astype(object).where(part[columns].notna(), None).itertuples(index=False):
                place = (NEVER[0] if at is None else int(at), -1 if id_ is None else len(id_), id_ or "")
                rows.append((place, *rest))
        for place, event, status, plan, subscription in sorted(rows, key=lambda r: r[0]):
            before, last = now.seen(), (now.status_at, now.status_size, now.status_id)
            now.take(event, status, plan, subscription, place)
            if now.seen() != before:
                now.revision += 1
                changes.append((now.revision, event, place[2], place < last, before[0], *now.seen()))
        if wait is not None and now.waits() and now.reminded_at != now.status_at:
            due = (now.status_at + wait) // 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:
                now.revision += 1
                now.reminded_at = now.status_at
                changes.append((now.revision, "unpaid", now.status_id, False, now.status, *now.seen()))
        state.update(astuple(now))
        if changes:
            out = pd.DataFrame(changes, columns=_COLUMNS)
            out.insert(0, "user_id", user[0])
            yield out

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.EventTimeTimeout
    return known.groupBy("user_id").applyInPandasWithState(
        follow, f"user_id {key}, {CHANGE}", STATE, "append", timeout
    )


def write_changes(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the changes to a Parquet table, each exactly once, also after a restart from the same
    ``checkpoint``. Without a trigger, what is there is read and the query ends."""
    return (
        changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_states(changes: DataFrame) -> DataFrame:
    """How each user's subscription stands after its last change."""
    values = ("status", "plan", "is_subscribed", "subscription_id")
    last = F.max_by(F.struct(*values), "revision").alias("_last")
    return changes.groupBy("user_id").agg(last).select("user_id", *(f"_last.{v}" for v in values))
