import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions.similarity import best_aliases, matchers
from tallywright.operators import mapping

EXPECTED = [
    (
        "sales",
        ["Order Date", "Sales_Amt", "Item Name", "City", "Qty", "Client"],
        {
            "date": ("Order Date", 1.0), "revenue": ("Sales_Amt", 0.8),
            "product": ("Item Name", 0.8889), "region": ("City", 1.0), "quantity": ("Qty", 1.0),
            "customer": ("Client", 1.0),
        },
    ),
    (
        "marketing",
        ["Day", "Campaign Name", "Amount Spent (INR)", "Impressions", "Link Clicks", "Results",
         "Purchase Value"],
        {
            "date": ("Day", 1.0), "campaign": ("Campaign Name", 0.9231),
            "spend": ("Amount Spent (INR)", 0.7333), "impressions": ("Impressions", 1.0),
            "clicks": ("Link Clicks", 0.9091), "conversions": ("Results", 1.0),
            "revenue": ("Purchase Value", 0.9286),
        },
    ),
    (
        "sales",
        ["Total Price", "Unit Price", "SKU"],
        {
            "date": (None, 0.3333), "revenue": ("Unit Price", 0.6667), "product": ("SKU", 1.0),
            "region": (None, 0.4), "quantity": (None, 0.5333), "customer": (None, 0.3333),
        },
    ),
    ("sales", ["zzz"], {f: (None, None) for f in schema.ALIASES["sales"]}),
]


def headers(spark, files):
    rows = [(f, i, c, d) for f, d, cols in files for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "file STRING, col_pos INT, column STRING, domain STRING")


def plain(columns, domain):
    """The best column of each field by a plain loop."""
    found = {}
    for field, aliases in schema.ALIASES[domain].items():
        scores = [
            (SequenceMatcher(None, c.lower().strip(), a).ratio(), -i)
            for i, c in enumerate(columns)
            for a in aliases
        ]
        score, place = max(scores)
        found[field] = columns[-place] if score > 0.6 else None
    return found


def test_expected_headers(spark):
    files = [(f"f{i}", domain, cols) for i, (domain, cols, _) in enumerate(EXPECTED)]
    got = mapping.map_columns(headers(spark, files)).collect()
    for i, (domain, cols, want) in enumerate(EXPECTED):
        mine = {r.field: r for r in got if r.file == f"f{i}"}
        assert set(mine) == set(want)
        for field, (column, score) in want.items():
            assert mine[field].source_column == column
            if score is not None:
                assert round(mine[field].score, 4) == score
        assert mapping.suggest_mapping(cols, domain) == {f: c for f, (c, _) in want.items()}


def test_random_headers_match_a_plain_loop(spark):
    rng = random.Random(11)
    words = [a for d in schema.ALIASES.values() for names in d.values() for a in names]

    def header():
        word = rng.choice(words)
        cut = rng.randrange(len(word))
        word = word[:cut] + rng.choice(["", "_", "x", " no", word[::-1]]) + word[cut:]
        return rng.choice(["", " "]) + rng.choice([word, word.upper(), word.title()])

    files = [
        (f"f{i}", rng.choice(["sales", "marketing"]), [header() for _ in range(rng.randrange(1, 9))])
        for i in range(60)
    ]
    got = {(r.file, r.field): r.source_column
           for r in mapping.map_columns(headers(spark, files)).collect()}
    want = {(f, field): c for f, d, cols in files for field, c in plain(cols, d).items()}
    assert got == want
    for f, d, cols in files:
        assert mapping.suggest_mapping(cols, d) == plain(cols, d)


def test_domain_argument(spark):
    one = headers(spark, [("f", "x", ["Day"])]).drop("domain")
    got = {r.field: r.source_column for r in mapping.map_columns(one, "marketing").collect()}
    assert got["date"] == "Day" and "campaign" in got
    other = {r.field for r in mapping.map_columns(one, "whatever").collect()}
    assert other == set(schema.ALIASES["sales"])


def test_threshold_is_strict_and_order_matters():
    assert best_aliases("abc", matchers({"f": ["abcdefg"]})) == [("f", 0.6, 0)]
    assert best_aliases("tide", matchers({"f": ["diet"]}))[0][1] == 0.25
    assert best_aliases("diet", matchers({"f": ["tide"]}))[0][1] == 0.5
    assert best_aliases("ab", matchers({"f": ["xab", "abx"]})) == [("f", 0.8, 0)]


def test_one_header_may_win_two_fields():
    got = mapping.suggest_mapping(["total amount customer name"])
    assert list(got.values()).count("total amount customer name") <= 2
    twice = mapping.suggest_mapping(["date", "item_amount"])
    assert twice["product"] == twice["revenue"] == "item_amount"


def test_standard_columns(spark):
    rows = spark.createDataFrame(
        [("a", ["2024-01-01", "5"]), ("b", ["9", "x", "2024-02-02"]), ("b", ["8"]),
         ("c", ["2024-01-01"])],
        "file STRING, cells ARRAY<STRING>",
    )
    places = spark.createDataFrame(
        [("a", "date", 0), ("a", "revenue", 1), ("b", "date", 2), ("b", "revenue", 0),
         ("b", "region", 1), ("c", "date", 0), ("c", "revenue", None)],
        "file STRING, field STRING, col_pos INT",
    )
    got = mapping.standard_columns(rows, places)
    assert got.columns == ["file", "layout", *schema.ALIASES["sales"]]
    want = {
        ("a", "date,revenue", "2024-01-01", "5", None),
        ("b", "date,revenue,region", "2024-02-02", "9", "x"),
        ("b", "date,revenue,region", None, "8", None),
    }
    made = got.collect()
    assert {(r.file, r.layout, r.date, r.revenue, r.region) for r in made} == want


@pytest.mark.parametrize("domain", ["sales", "marketing"])
def test_hot_header(spark, domain):
    files = [(f"f{i}", domain, ["date", f"note {i}"]) for i in range(300)]
    got = mapping.map_columns(headers(spark, files)).where(F.col("field") == "date")
    assert got.where("source_column = 'date' AND score = 1").count() == 300
