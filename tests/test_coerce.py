import pytest
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.operators import coerce


def numbers(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "c STRING")
    return [r[0] for r in df.select(coerce.as_number(F.col("c"), df.schema["c"].dataType)).collect()]


def moments(spark, cells, formats=()):
    df = spark.createDataFrame([(c,) for c in cells], "c STRING")
    kind = df.schema["c"].dataType
    moment = coerce.as_moment(F.col("c"), kind, formats).cast("string")
    return [r[0] for r in df.select(moment).collect()]


def test_number_grammar(spark):
    good = {" 12 ": 12.0, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "-1.25E-2": -0.0125}
    assert numbers(spark, list(good)) == list(good.values())
    bad = ["1,000", "$5", "12d", "1f", "0x10", "inf", "nan", "1e400", "", "1 2", "1_0", None]
    assert numbers(spark, bad) == [None] * len(bad)


def test_typed_numbers(spark):
    df = spark.sql("SELECT 5 i, 2.50BD d, true b, double('NaN') n, DATE'2024-01-01' t")
    got = df.select(*[coerce.as_number(F.col(f.name), f.dataType) for f in df.schema]).first()
    assert tuple(got) == (5.0, 2.5, 1.0, None, None)


def test_date_grammar(spark):
    good = {
        "2024-01-05": "2024-01-05 00:00:00",
        " 2024-1-5 ": "2024-01-05 00:00:00",
        "2024-01-05 10:20:30": "2024-01-05 10:20:30",
        "2024-01-05T10:20:30+05:00": "2024-01-05 10:20:30",
    }
    assert moments(spark, list(good)) == list(good.values())
    bad = ["45000", "2024", "20240105", "2023-02-30", "01/05/2024", "soon", "", None]
    assert moments(spark, bad) == [None] * len(bad)
    assert moments(spark, ["01/05/2024", "2024-02-03"], ("MM/dd/yyyy",)) == [
        "2024-01-05 00:00:00", "2024-02-03 00:00:00",
    ]


def test_typed_dates(spark):
    df = spark.sql("SELECT DATE'2024-01-05' d, TIMESTAMP'2024-01-05 01:02:03' t, 20240105 i")
    got = df.select(
        *[coerce.as_moment(F.col(f.name), f.dataType).cast("string") for f in df.schema]
    ).first()
    assert tuple(got) == ("2024-01-05 00:00:00", "2024-01-05 01:02:03", None)


def test_na_tokens(spark):
    cells = [*schema.NA_TOKENS, "na", "North", None]
    df = spark.createDataFrame([(c, 1) for c in cells], "c STRING, n INT")
    got = [r.c for r in coerce.drop_na_tokens(df).collect()]
    assert got == [None] * len(schema.NA_TOKENS) + ["na", "North", None]
    assert coerce.drop_na_tokens(df, ()) is df


def test_rename(spark):
    df = spark.sql("SELECT 1 `Order Date`, 2 amt, 3 other, 4 revenue")
    renamed = coerce.rename_by_mapping(
        df.drop("revenue"),
        {"date": "Order Date", "revenue": "amt", "price": "amt", "region": None, "x": "absent"},
    )
    assert renamed.columns == ["date", "revenue", "price", "other"]
    assert tuple(renamed.first()) == (1, 2, 2, 3)
    with pytest.raises(ValueError, match="revenue"):
        coerce.rename_by_mapping(df, {"revenue": "amt"})
    cased = spark.sql("SELECT 1 Revenue, 2 amt, 3 other")
    assert coerce.rename_by_mapping(cased, {"revenue": "amt"}).columns == ["revenue", "other"]
    assert coerce.rename_by_mapping(cased, {"revenue": "amt"}).select("revenue").first()[0] == 2
    swapped = coerce.rename_by_mapping(df, {"revenue": "amt", "other": "revenue", "z": "other"})
    assert swapped.columns == ["Order Date", "revenue", "z", "other"]


def test_required_columns(spark):
    df = spark.sql("SELECT 1 date")
    with pytest.raises(ValueError, match="date"):
        coerce.require_columns(spark.sql("SELECT 1 revenue"), "sales")
    with pytest.raises(ValueError, match="revenue"):
        coerce.require_columns(df, "anything")
    with pytest.raises(ValueError, match="spend"):
        coerce.require_columns(df, "marketing")


def test_incomplete_rows(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('2024-01-01', '5', 'x'), ('bad', '5', 'x'), ('2024-01-01', '$', 'x'),"
        " (NULL, NULL, NULL) AS t(date, revenue, product)"
    )
    assert coerce.sales_facts(df).count() == 1
    marketing = coerce.marketing_facts(df.withColumnRenamed("product", "spend"))
    assert sorted((r.revenue, r.spend) for r in marketing.collect()) == [(0.0, 0.0), (5.0, 0.0)]


def test_facts_have_the_target_schemas(spark):
    for target, build in ((schema.SALES, coerce.sales_facts), (schema.MARKETING, coerce.marketing_facts)):
        text = spark.createDataFrame([], ", ".join(f"{f.name} STRING" for f in target))
        typed = spark.createDataFrame([], target)
        for df in (text, typed):
            kinds = {f.name: f.dataType for f in build(df).schema}
            assert kinds == {f.name: f.dataType for f in target}
    assert set(schema.SALES.names) == set(schema.SALES_FIELDS) == set(schema.ALIASES["sales"])
    assert set(schema.MARKETING.names) == set(schema.MARKETING_FIELDS) == set(
        schema.ALIASES["marketing"]
    )
