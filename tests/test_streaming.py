"""The aggregates are plain enough to run on a stream of arriving files as they are."""

import datetime
import random

import pytest

from tallywright.operators import billing, coerce, marketing, sales
from tallywright.sources import sample_accounts, sample_facts
from tallywright.streaming.subscriptions import follow_subscriptions, latest_states, write_changes


def trend(df):
    return sales.monthly_revenue(coerce.sales_facts(df))


def averages(df):
    return sales.totals(coerce.sales_facts(df, ("tenant",)), ("tenant",))


def campaign_totals(df):
    return marketing.totals(coerce.marketing_facts(df, ("tenant",)), ("tenant",))


@pytest.mark.parametrize(
    "source, transform",
    [
        (lambda s, d: sample_facts.sales(s, d, ("tenant", "date", "revenue")), trend),
        (lambda s, d: sample_facts.sales(s, d, ("tenant", "date", "revenue")), averages),
        (sample_facts.campaigns, campaign_totals),
        (sample_accounts.account_events, billing.subscription_state),
    ],
)
def test_stream_gives_the_batch_result(spark, sf_dir, tmp_path, source, transform):
    batch = source(spark, sf_dir)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema(batch.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    name = f"out_{transform.__name__}"
    running = (
        transform(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination(120)
    got = sorted(map(tuple, spark.table(name).collect()), key=repr)
    assert got == sorted(map(tuple, transform(batch).collect()), key=repr)
    assert got


EVENTS = "user_id BIGINT, ts TIMESTAMP_NTZ, event_id STRING, event STRING, plan STRING, subscription_id STRING"
START = datetime.datetime(2024, 1, 1)


def shuffled_events(rng):
    kinds = ("order_created", "subscription_created", "payment_verified", "other")
    rows = []
    for n in range(600):
        user = 0 if n % 3 == 0 else rng.randrange(1, 40)  # one user has a third of all
        at = START + datetime.timedelta(minutes=rng.randrange(400)) if rng.random() < 0.97 else None
        event = rng.choice(kinds)
        plan = rng.choice(["monthly", "yearly", None]) if event in kinds[:2] else None
        rows.append((user, at, str(n), event, plan, f"sub{n}" if rng.random() < 0.3 else None))
    rows += [(None, START, "x1", "order_created", "monthly", None), (5, None, None, "order_created", "yearly", None)]
    rows += rng.sample(rows, 150)  # repeated events
    rng.shuffle(rows)
    return rows


def run(spark, folder, **options):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(str(folder / "in"))
    changes = follow_subscriptions(stream, **options)
    write_changes(changes, str(folder / "out"), str(folder / "state")).awaitTermination(300)
    return spark.read.parquet(str(folder / "out"))


def test_followed_subscriptions_end_as_the_batch(spark, tmp_path):
    rows = shuffled_events(random.Random(2))
    half = len(rows) // 2
    states = []
    for part in (rows[:half], rows[half:]):  # the second time it goes on from its checkpoint
        spark.createDataFrame(part, EVENTS).repartition(5).write.mode("append").parquet(str(tmp_path / "in"))
        told = run(spark, tmp_path).cache()
        batch = billing.subscription_state(spark.read.parquet(str(tmp_path / "in")))
        got = sorted(map(tuple, latest_states(told).select(batch.columns).collect()), key=repr)
        assert got == sorted(map(tuple, batch.collect()), key=repr)
        states.append(told.count())
        by_user = {}
        for r in sorted(told.collect(), key=lambda r: r.revision):
            by_user.setdefault(r.user_id, []).append(r)
        for changes in by_user.values():  # gapless, and each starts where the one before ended
            assert [r.revision for r in changes] == list(range(1, len(changes) + 1))
            assert all(b.status_before == a.status for a, b in zip(changes, changes[1:]))
        assert any(r.late for changes in by_user.values() for r in changes)
        told.unpersist()
    assert states[0] < states[1]
    again = run(spark, tmp_path).count()
    assert again == states[1]


def test_unpaid_orders_are_told(spark, tmp_path):
    day = datetime.timedelta(days=1)
    batches = [
        [(1, START, "1", "order_created", "monthly", None), (2, START, "2", "order_created", "yearly", None)],
        [(2, START + day, "3", "payment_verified", None, None)],
        [(3, START + 9 * day, "4", "order_created", "monthly", None)],
        [(4, START + 10 * day, "5", "payment_verified", None, None)],
    ]
    told = None
    for part in batches:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        told = run(spark, tmp_path, unpaid_after="3 days", lateness="1 day")
    got = sorted((r.user_id, r.revision, r.cause, r.status) for r in told.collect())
    assert got == [
        (1, 1, "order_created", "order_created"), (1, 2, "unpaid", "order_created"),
        (2, 1, "order_created", "order_created"), (2, 2, "payment_verified", "active"),
        (3, 1, "order_created", "order_created"), (4, 1, "payment_verified", "active"),
    ]
