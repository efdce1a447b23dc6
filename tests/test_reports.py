import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import coerce, marketing, sales
from tallywright.operators.settle import positions
from tallywright.plans import reports
from tests import brute

SALES_TYPE = (
    "tenant STRING, date TIMESTAMP_NTZ, revenue DOUBLE, product STRING, region STRING,"
    " customer STRING"
)
CAMPAIGN_TYPE = (
    "tenant STRING, date TIMESTAMP_NTZ, campaign STRING, spend DOUBLE, impressions DOUBLE,"
    " clicks DOUBLE, conversions DOUBLE, revenue DOUBLE"
)


def names(ddl):
    return [c.split()[0] for c in ddl.split(",")]


def sales_rows(seed, n, hot="t0"):
    """A third of the rows belong to one tenant, product and customer."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        is_hot = rng.random() < 0.34
        rows.append(
            (
                hot if is_hot else f"t{rng.randrange(4)}",
                rng.choice([None, *[dt.datetime(2023 + m // 12, m % 12 + 1, 3) for m in range(0, 20, 2)]]),
                rng.choice([None, round(rng.uniform(-50, 500), 2), 100.0]),
                "p0" if is_hot else rng.choice([None, *[f"p{i}" for i in range(9)]]),
                rng.choice([None, *[f"r{i}" for i in range(23)]]),
                "c0" if is_hot else rng.choice([None, *[f"c{i}" for i in range(40)]]),
            )
        )
    return rows


def campaign_rows(seed, n):
    rng = random.Random(seed)

    def measure(p):
        return rng.choice([None, 0.0, round(rng.uniform(0, p), 2), float(rng.randrange(int(p)))])

    return [
        (
            f"t{rng.randrange(3)}",
            rng.choice([None, dt.datetime(2024, rng.randrange(1, 13), 5)]),
            rng.choice([None, *[f"c{i}" for i in range(17)]]),
            0.0 if rng.random() < 0.3 else measure(90),
            measure(1000), measure(100), measure(20), measure(300),
        )
        for _ in range(n)
    ]


def documents(made, by=()):
    """JSON reports by tenant, their rows of text put together."""
    texts = {}
    for r in reports.report_json(made, by).orderBy(*by, "part", "position").collect():
        tenant = r[by[0]] if by else None
        texts[tenant] = texts.get(tenant, "") + r.text
    found = {tenant: json.loads(text) for tenant, text in texts.items()}
    for body in found.values():
        body.pop("generated_at", None)
    return found


def cut(rows, ddl, tenant=None, without=()):
    fields = names(ddl)
    return [
        {f: v for f, v in zip(fields, r) if f not in without}
        for r in rows
        if tenant is None or r[0] == tenant
    ]


def test_sales_report(spark):
    rows = sales_rows(1, 3000)
    df = spark.createDataFrame(rows, SALES_TYPE)
    got = documents(reports.sales_report(df, ("tenant",)), ("tenant",))
    assert set(got) == {"t0", "t1", "t2", "t3"}
    for tenant, body in got.items():
        assert body == brute.sales(cut(rows, SALES_TYPE, tenant), names(SALES_TYPE))
    whole = documents(reports.sales_report(df.drop("tenant")))
    assert whole[None] == brute.sales(cut(rows, SALES_TYPE), names(SALES_TYPE))


def test_marketing_report(spark):
    rows = campaign_rows(2, 2000)
    df = spark.createDataFrame(rows, CAMPAIGN_TYPE)
    got = documents(reports.marketing_report(df, ("tenant",)), ("tenant",))
    assert set(got) == {"t0", "t1", "t2"}
    for tenant, body in got.items():
        assert body == brute.marketing(cut(rows, CAMPAIGN_TYPE, tenant), names(CAMPAIGN_TYPE))
    whole = documents(reports.marketing_report(df.drop("tenant")))
    assert whole[None] == brute.marketing(cut(rows, CAMPAIGN_TYPE), names(CAMPAIGN_TYPE))


@pytest.mark.parametrize("absent", [("product",), ("region", "customer"), ("product", "region", "customer")])
def test_sales_without_optional_columns(spark, absent):
    rows = sales_rows(3, 300)
    df = spark.createDataFrame(rows, SALES_TYPE).drop("tenant", *absent)
    fields = [f for f in names(SALES_TYPE) if f not in absent]
    assert documents(reports.sales_report(df))[None] == brute.sales(
        cut(rows, SALES_TYPE, without=absent), fields
    )


@pytest.mark.parametrize("absent", [("clicks",), ("spend",), ("revenue", "impressions"), ("campaign",), ("conversions",)])
def test_marketing_without_optional_columns(spark, absent):
    rows = campaign_rows(4, 300)
    df = spark.createDataFrame(rows, CAMPAIGN_TYPE).drop("tenant", *absent)
    fields = [f for f in names(CAMPAIGN_TYPE) if f not in absent]
    assert documents(reports.marketing_report(df))[None] == brute.marketing(
        cut(rows, CAMPAIGN_TYPE, without=absent), fields
    )


def test_a_field_as_tenant(spark):
    rows = sales_rows(6, 400)
    df = spark.createDataFrame(rows, SALES_TYPE).drop("tenant")
    made = documents(reports.sales_report(df, ("region",), stamp=False), ("region",))
    fields = [f for f in names(SALES_TYPE) if f != "region"]
    for region, body in made.items():
        mine = [x for x in cut(rows, SALES_TYPE) if x["region"] == region]
        if any(x["date"] and x["revenue"] is not None for x in mine):
            assert body == brute.sales(mine, fields)
    with pytest.raises(ValueError, match="month"):
        reports.sales_report(df.withColumn("month", F.lit(1)), ("month",))


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], SALES_TYPE)
    assert documents(reports.sales_report(empty.drop("tenant")))[None] == brute.sales(
        [], names(SALES_TYPE)
    )
    assert documents(reports.sales_report(empty, ("tenant",)), ("tenant",)) == {}
    nothing = spark.createDataFrame([], CAMPAIGN_TYPE).drop("tenant")
    assert documents(reports.marketing_report(nothing))[None] == brute.marketing(
        [], names(CAMPAIGN_TYPE)
    )


def one_product(spark, cells):
    return spark.createDataFrame(cells, "date STRING, revenue STRING, product STRING")


def test_growth_edges(spark):
    def growth(*cells):
        df = one_product(spark, [(d, v, "p") for d, v in cells])
        return documents(reports.sales_report(df))[None]["mom_growth_percent"]

    assert growth(("2024-01-01", "5")) is None
    assert growth(("2024-01-01", "5"), ("2024-06-01", "10")) == 100.0
    assert growth(("2024-01-01", "0"), ("2024-02-01", "10")) == 0
    assert growth(("2024-01-01", "5"), ("2024-01-02", "-5"), ("2024-02-01", "10")) == 0
    assert growth(("2024-01-01", "-10"), ("2024-02-01", "10")) == -200.0


def test_ties_go_by_key(spark):
    df = one_product(spark, [("2024-01-01", "7", p) for p in "gfedcba"])
    top = documents(reports.sales_report(df))[None]["top_products"]
    assert [t["product"] for t in top] == list("abcde")


def test_no_best_campaign_without_spend(spark):
    df = spark.sql("SELECT '2024-01-01' date, 'c' campaign, 0 spend, 5 revenue")
    body = documents(reports.marketing_report(df))[None]
    assert body["best_campaign"] is None and body["worst_campaign"] is None
    assert body["campaign_performance"][0]["roas"] is None


def test_confirm_mapping_and_dispatch(spark):
    raw = spark.sql("SELECT '2024-01-01' `Order Date`, '5' Amt, 'EU' Area, 'x' note")
    mapping = {"date": "Order Date", "revenue": "Amt", "region": "Area", "product": None}
    body = documents(reports.confirm_mapping(raw, mapping))[None]
    assert body["region_wise_sales"] == [{"region": "EU", "revenue": 5.0}]
    assert "top_products" not in body
    with pytest.raises(ValueError, match="spend"):
        reports.confirm_mapping(raw, mapping, "marketing")
    with pytest.raises(ValueError, match="date"):
        reports.confirm_mapping(raw, {"revenue": "Amt"})


def test_generated_at(spark):
    df = spark.sql("SELECT '2024-01-01' date, 5 revenue")
    stamped = reports.sales_report(df).summary.first().generated_at
    age = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.datetime.fromisoformat(stamped)
    assert abs(age.total_seconds()) < 120
    assert "generated_at" not in reports.sales_report(df, stamp=False).summary.columns


def test_form_does_not_depend_on_the_length_of_a_list(spark):
    for n in (0, 1, 25_000):
        df = spark.range(n).selectExpr("'2024-01-01' date", "1 revenue", "'r' || id region")
        made = reports.report_json(reports.sales_report(df, stamp=False))
        assert {r.part: r["count"] for r in made.groupBy("part").count().collect()} == (
            {0: 1, 1: n, 2: 1} if n else {0: 1, 2: 1}
        )
        body = documents(reports.sales_report(df, stamp=False))[None]
        assert len(body["region_wise_sales"]) == n


def test_huge_values_of_one_tenant_leave_the_others_alone(spark):
    rows = [("a", "1e33"), ("b", "1e300"), ("c", "1e308"), ("c", "1e308"), ("d", "12.5")]
    df = spark.createDataFrame(rows, "tenant STRING, revenue STRING").withColumn("date", F.lit("2024-01-01"))
    got = documents(reports.sales_report(df, ("tenant",), stamp=False), ("tenant",))
    assert got["d"]["total_revenue"] == 12.5 and "large_values" not in got["d"]
    assert float(got["b"]["large_values"]["total_revenue"]) == 1e300
    assert float(got["a"]["large_values"]["total_revenue"]) == 1e33
    assert got["c"]["total_revenue"] is None
    clicks = df.withColumnRenamed("revenue", "clicks").withColumn("campaign", F.lit("x"))
    got = documents(reports.marketing_report(clicks, ("tenant",), stamp=False), ("tenant",))
    assert got["a"]["total_clicks"] is None and got["d"]["total_clicks"] == 12
    assert float(got["a"]["large_values"]["total_clicks"]) == 1e33


def test_large_sums_do_not_depend_on_order(spark):
    values = [4.0e12 + 0.11, -4.0e12, 8e12, 2e15, -2e15, 3e20, -3e20, 0.25]
    made = set()
    for seed in range(6):
        mixed = random.Random(seed).sample(values, len(values))
        df = spark.createDataFrame([("2024-01-01", v) for v in mixed], "date STRING, revenue DOUBLE")
        made.add(sales.totals(coerce.sales_facts(df.repartition(seed + 1))).first().total_revenue)
    assert made == {8e12 + 0.36}

def test_positions(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(3)}", float(rng.randrange(4)), i)
            for i in range(3000)]
    rows += [(None, 1.0, 5000), (None, 2.0, 5001)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE, k INT")
    got = positions(df, ["g"], [F.desc("v"), F.col("k")], slices=7).collect()
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        placed = sorted((r for r in got if r.g == g), key=lambda r: r.position)
        assert [r.position for r in placed] == list(range(len(ranked)))
        assert [(r.g, r.v, r.k) for r in placed] == ranked


def test_report_does_not_depend_on_order_or_partitions(spark):
    rows = sales_rows(9, 1500)
    made = set()
    for n, seed in ((1, 1), (5, 2), (13, 3)):
        mixed = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(mixed, SALES_TYPE).repartition(n)
        report = reports.report_json(reports.sales_report(df, ("tenant",), stamp=False), ("tenant",))
        made.add(tuple(sorted(map(tuple, report.collect()))))
    assert len(made) == 1


def test_breakdowns_add_up(spark):
    rows = [r for r in sales_rows(10, 800) if None not in r]
    df = spark.createDataFrame(rows, SALES_TYPE)
    facts = coerce.sales_facts(df, ("tenant",))
    for by in ((), ("tenant",)):
        sums = (
            sales.breakdown(facts, by)
            .groupBy(*by, "section")
            .agg(F.round(F.sum("revenue"), 6).alias("revenue"), F.sum("orders").alias("orders"))
        )
        whole = sums.groupBy(*by).agg(
            F.count_distinct("revenue").alias("r"), F.count_distinct("orders").alias("o"),
            F.count("section").alias("n"),
        )
        assert {(r.r, r.o, r.n) for r in whole.collect()} == {(1, 1, 5)}


def test_single_operators_agree_with_the_report(spark):
    rows = campaign_rows(11, 600)
    facts = coerce.marketing_facts(spark.createDataFrame(rows, CAMPAIGN_TYPE).drop("tenant"))
    want = brute.marketing(cut(rows, CAMPAIGN_TYPE), names(CAMPAIGN_TYPE))
    totals = marketing.totals(facts).first().asDict()
    assert totals == {k: want[k] for k in totals}
    performance = [r.asDict() for r in marketing.campaign_performance(facts).collect()]
    assert performance == want["campaign_performance"]
    assert tuple(marketing.best_worst(facts).first()) == (
        want["best_campaign"], want["worst_campaign"],
    )
    trend = [
        {"date": r.month, "spend": r.spend, "revenue": r.revenue}
        for r in marketing.monthly_trend(facts).orderBy("month").collect()
    ]
    assert trend == want["monthly_trend"]


def test_single_sales_operators_agree_with_the_report(spark):
    rows = sales_rows(12, 600)
    facts = coerce.sales_facts(spark.createDataFrame(rows, SALES_TYPE).drop("tenant"))
    want = brute.sales(cut(rows, SALES_TYPE), names(SALES_TYPE))
    totals = sales.totals(facts).first().asDict()
    assert totals == {k: want[k] for k in totals}
    assert sales.mom_growth(facts).first().mom_growth_percent == want["mom_growth_percent"]
    for made, name in (
        (sales.top_products(facts), "top_products"),
        (sales.top_customers(facts), "top_customers"),
        (sales.revenue_by_region(facts), "region_wise_sales"),
    ):
        assert [r.asDict() for r in made.collect()] == want[name]
    nothing = facts.limit(0)
    assert tuple(sales.totals(nothing).first()) == (0.0, 0, 0.0)
    assert sales.mom_growth(nothing).count() == sales.monthly_revenue(nothing).count() == 0
