"""Reports kept up to date against full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import sales, uploads
from tallywright.operators.coerce import sales_facts
from tallywright.plans import incremental, reports

ROWS = "tenant STRING, upload_id STRING, date STRING, revenue STRING, product STRING, region STRING, customer STRING"
UPLOADS = "tenant STRING, upload_id STRING, uploaded_at TIMESTAMP_NTZ"


def batch(spark, rng, number, tenants):
    """Uploads of some tenants at random times, one tenant with many rows, one without any."""
    rows, sent = [], []
    for t in tenants:
        for copy in range(rng.choice([1, 2])):
            name = f"{number}-{copy}"
            sent.append((t, name, rng.randrange(1000)))
            for _ in range(0 if t == "none" else 300 if t == "hot" else 12):
                value = rng.choice(["12.345678", "1e-9", "0.1", "-7.25", "123456789012.01", "x", None])
                day = f"20{rng.randrange(20, 24)}-0{rng.randrange(1, 10)}-11"
                rows.append((t, name, day, value, rng.choice(["a", "b", "c", "d", "e", "f", None]),
                             rng.choice(["n", "s", None]), f"c{rng.randrange(30)}"))
    made = spark.createDataFrame([(t, u, s) for t, u, s in sent], "tenant STRING, upload_id STRING, s INT")
    made = made.selectExpr("tenant", "upload_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) AS uploaded_at")
    return spark.createDataFrame(rows, ROWS), made


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def store(spark, tmp_path):
    made = incremental.Store(str(tmp_path / "store"), slots=4)
    incremental.create(spark, made)
    return made


def test_replaced_uploads_equal_a_full_recomputation(spark, store):
    rng = random.Random(5)
    assert plain(incremental.breakdown(spark, store)) == []
    all_rows = all_uploads = None
    names = ["hot", "none", None, *[f"t{i}" for i in range(8)]]
    for number in range(1, 5):
        rows, sent = batch(spark, rng, number, [n for n in names if number == 1 or rng.random() < 0.5])
        assert incremental.apply_change(spark, store, number, rows, sent)
        assert not incremental.apply_change(spark, store, number, rows, sent)
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
        all_uploads = sent if all_uploads is None else all_uploads.unionByName(sent)
        if number == 3:
            assert incremental.compact(spark, store) == 4
            break
    rows, sent = batch(spark, rng, 5, ["hot", "t1"])
    incremental.apply_change(spark, store, 5, rows, sent)
    latest = uploads.latest_data(all_rows.unionByName(rows), all_uploads.unionByName(sent))
    by = ("tenant",)
    afresh = incremental.finished(incremental.partial_states(sales_facts(latest, by), by), by)
    assert plain(incremental.breakdown(spark, store)) == plain(afresh)
    rounded = lambda df: plain(df.withColumn("revenue", F.round("revenue", 6)))
    assert rounded(incremental.breakdown(spark, store)) == rounded(sales.breakdown(sales_facts(latest, by), by))
    whole = incremental.breakdown(spark, store, by=())
    assert rounded(whole) == rounded(sales.breakdown(sales_facts(latest, by)))
    made = reports.report_json(incremental.sales_report(spark, store, stamp=False), by)
    whole_report = reports.sales_report_of(sales.leading(afresh, by), by, store.fields, stamp=False)
    assert plain(made) == plain(reports.report_json(whole_report, by))
    changed = {r.tenant for r in incremental.breakdown(spark, store, change=5).collect()}
    assert changed <= {"hot", "t1"}


def test_a_change_that_failed_is_not_seen_and_can_be_repeated(spark, store, monkeypatch):
    rows, sent = batch(spark, random.Random(1), 1, ["a", "hot"])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(incremental, "_commit", lost)
        with pytest.raises(RuntimeError):
            incremental.apply_change(spark, store, 1, rows, sent)
    assert plain(incremental.breakdown(spark, store)) == []
    assert incremental.apply_change(spark, store, 1, rows, sent)
    assert {r.tenant for r in incremental.breakdown(spark, store).collect()} == {"a", "hot"}
    with pytest.raises(ValueError):
        incremental.apply_change(spark, store, -1, rows, sent)


def test_an_older_upload_changes_nothing_and_an_empty_one_empties(spark, store):
    def one(upload, second, rows):
        sent = spark.sql(f"SELECT 't' AS tenant, '{upload}' AS upload_id, timestamp_ntz'2024-01-01 00:00:{second}' AS uploaded_at")
        return spark.createDataFrame([("t", upload, "2024-01-01", "5", "p", "r", "c")] * rows, ROWS), sent

    incremental.apply_change(spark, store, 1, *one("u", "20", 3))
    incremental.apply_change(spark, store, 2, *one("old", "10", 9))
    total = lambda: [r.orders for r in incremental.breakdown(spark, store).collect() if r.section == "total"]
    assert total() == [3]
    incremental.apply_change(spark, store, 3, *one("empty", "30", 0))
    assert total() == []


def test_only_slots_of_changed_tenants_are_read(spark, store):
    rows, sent = batch(spark, random.Random(2), 1, [f"t{i}" for i in range(12)])
    incremental.apply_change(spark, store, 1, rows, sent)
    rows, sent = batch(spark, random.Random(3), 2, ["t3"])
    incremental.apply_change(spark, store, 2, rows, sent)
    text = incremental.breakdown(spark, store, change=2)._jdf.queryExecution().executedPlan().toString()
    slot = spark.sql("SELECT pmod(xxhash64('t3'), 4)").first()[0]
    assert f"(slot#" in text and f"= {slot})" in text.split("PartitionFilters")[1].split("]")[0]


def test_uploads_are_read_once_a_change(spark, store):
    rows, sent = batch(spark, random.Random(8), 1, ["a", "b", "c"])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for one in batches:
            seen.add(one.num_rows)
            yield one

    assert incremental.apply_change(spark, store, 1, rows, sent.mapInArrow(count, UPLOADS))
    assert seen.value == sent.count()
