import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from tallywright import schema
from tallywright.operators import accounts, billing, uploads

T0 = dt.datetime(2024, 1, 1)


def users(spark):
    return spark.createDataFrame(
        [
            (1, "a@x", "h", "A", T0, True, "monthly", "active", None),
            (2, "b@x", "h", None, T0, False, None, None, None),
            (3, "c@x", "h", "C", T0, None, "yearly", "order_created", None),
        ],
        schema.USERS,
    )


def test_lookup_and_projections(spark):
    table = users(spark)
    found = accounts.find_user(table, "b@x")
    assert found.first().id == 2 and "hashed_password" not in found.columns
    assert accounts.find_user(table, "z@x").count() == 0
    requests = spark.createDataFrame([("a@x", 9), ("z@x", 8)], "email STRING, n INT")
    joined = accounts.find_users(table, requests)
    assert [(r.email, r.n, r.id) for r in joined.collect()] == [("a@x", 9, 1)]
    assert "hashed_password" not in joined.columns
    assert accounts.profiles(table).columns == ["email", "company_name"]
    status = {r.email: tuple(r)[1:] for r in accounts.subscription_status(table).collect()}
    assert status == {
        "a@x": (True, "monthly", "active"), "b@x": (False, None, None),
        "c@x": (False, "yearly", "order_created"),
    }


def test_gate(spark):
    data = spark.createDataFrame([("a@x", 1), ("b@x", 2), ("c@x", 3)], "email STRING, v INT")
    assert [r.v for r in accounts.subscribed_only(data, users(spark), ("email",)).collect()] == [1]


def test_new_signups(spark):
    batch = spark.createDataFrame(
        [("a@x", 1), ("n@x", 3), ("n@x", 2), ("n@x", 9), ("m@x", 4), (None, 5)],
        "email STRING, at INT",
    )
    got = accounts.new_signups(batch, users(spark), ("at",)).collect()
    assert sorted(tuple(r) for r in got) == [("m@x", 4), ("n@x", 2)]


def test_orders(spark):
    requests = spark.createDataFrame(
        [(1, "monthly"), (2, "yearly"), (3, "weekly"), (4, None)], "user_id INT, plan STRING"
    )
    got = {r.user_id: r for r in billing.order_batch(requests).collect()}
    assert set(got) == {1, 2}
    assert got[1].amount == 49 and got[1].amount_minor == 4900 and got[1].cycles == 12
    assert got[2].receipt == "order_2_yearly" and got[2].currency == "INR" and got[2].cycles == 1
    assert got[2].amount_minor == 40000 and got[2].payment_capture == 1
    known, rejected = billing.split_by_plan(requests)
    assert {r.user_id for r in known.collect()} == {1, 2}
    assert {r.user_id for r in rejected.collect()} == {3, 4}


def test_signatures_match_the_standard_library(spark):
    for key in (b"k", b"secret" * 5, b"x" * 64, b"long" * 40):
        def sign(text, key=key):
            return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()

        pays = spark.createDataFrame(
            [("o1", "p1", sign("o1|p1")), ("o2", "p2", sign("p2|o2")), ("oé", "p3", sign("oé|p3")),
             ("o4", "p4", None), (None, "p5", sign("|p5"))],
            "order_id STRING, payment_id STRING, signature STRING",
        )
        checked = billing.check_payments(pays, key)
        assert [r.valid for r in checked.collect()] == [True, False, True, False, False]
        accepted, rejected = billing.split_by_validity(checked)
        assert accepted.count() == 2 and rejected.count() == 3
        swapped = billing.check_subscription_payments(
            pays.withColumnRenamed("order_id", "subscription_id"), key
        )
        assert [r.valid for r in swapped.collect()][:2] == [False, True]


def test_subscription_state(spark):
    events = spark.createDataFrame(
        [
            (1, 1, "order_created", "monthly"), (1, 3, "payment_verified", None),
            (1, 4, "order_created", "yearly"),
            (2, 1, "order_created", "yearly"), (2, 2, "payment_verified", None),
            (3, 1, "subscription_created", "monthly"), (3, 2, "ignored", None),
        ],
        "user_id INT, ts INT, event STRING, plan STRING",
    ).withColumn("event_id", F.col("ts"))
    got = {r.user_id: (r.status, r.plan, r.is_subscribed)
           for r in billing.subscription_state(events).collect()}
    assert got == {
        1: ("order_created", "yearly", True), 2: ("active", "yearly", True),
        3: ("created", "monthly", False),
    }
    after = {r.id: r for r in billing.apply_events(users(spark), events).collect()}
    assert after[1].subscription_plan == "yearly" and after[1].is_subscribed
    assert after[2].subscription_status == "active" and after[2].is_subscribed
    assert after[3].subscription_status == "created" and not after[3].is_subscribed


def test_payment_events_feed_the_state(spark):
    accepted = spark.createDataFrame(
        [(7, "p1", T0)], "user_id INT, payment_id STRING, ts TIMESTAMP"
    )
    state = billing.subscription_state(billing.payment_events(accepted)).first()
    assert (state.status, state.plan, state.is_subscribed) == ("active", None, True)


def test_uploads(spark):
    table = spark.createDataFrame(
        [("t", 1, T0), ("t", 3, T0), ("t", 2, T0), ("u", 9, T0)],
        "tenant STRING, upload_id INT, uploaded_at TIMESTAMP",
    )
    assert sorted((r.tenant, r.upload_id) for r in uploads.latest_upload(table).collect()) == [
        ("t", 3), ("u", 9),
    ]
    rows = spark.createDataFrame(
        [("t", 1, "old"), ("t", 3, "new"), ("t", 3, "new too"), ("u", 9, "only")],
        "tenant STRING, upload_id INT, v STRING",
    )
    got = uploads.latest_data(rows, table)
    assert sorted(r.v for r in got.collect()) == ["new", "new too", "only"]


def test_profile(spark):
    df = spark.createDataFrame(
        [(f"2024-01-0{i}", i, None) for i in range(1, 9)], "`Order Date` STRING, amt INT, x STRING"
    )
    about = uploads.profile(df, "sales", ("amt",)).first()
    assert about.columns_found == ["Order Date", "amt", "x"] and about.row_count == 8
    assert about.suggested_mapping["date"] == "Order Date"
    assert about.suggested_mapping["region"] is None
    assert len(about.preview) == 5
    assert about.preview[0] == '{"Order Date":"2024-01-01","amt":1,"x":null}'
    assert uploads.profile(df.where("amt > 99")).first().row_count == 0
