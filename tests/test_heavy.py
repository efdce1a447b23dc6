"""Top lists by summaries, against the full computation."""

import collections
import random

import numpy as np
import pytest

from tallywright.operators import heavy, sales

FACTS = "tenant STRING, customer STRING, revenue DOUBLE"


def facts(spark, rows, parts=7):
    return spark.createDataFrame(rows, FACTS).repartition(parts)


def skewed(rng, rows=6000, keys=2000):
    """A third of each tenant's rows are one customer's; nulls, refunds and a tenant without name."""
    out = []
    for _ in range(rows):
        tenant = rng.choice(["a", "a", "a", "b", None])
        hot = rng.random()
        key = f"hot{int(hot * 18)}" if hot < 0.45 else f"k{rng.randrange(keys)}"
        out.append((tenant, rng.choice([key] * 20 + [None]), float(rng.randrange(-20, 200))))
    return out


def flat(rng, rows=4000, keys=1500):
    return [(rng.choice("ab"), f"k{rng.randrange(keys)}", float(rng.randrange(1, 50))) for _ in range(rows)]


def few(rng):
    """Fewer customers than places, ties, sums of zero and below, amounts that are no numbers."""
    rows = [("a", "x", 5.0), ("a", "y", 5.0), ("a", "z", -3.0), ("b", "x", 0.0), ("b", None, 7.0)]
    return [*rows, ("c", "x", float("nan")), ("c", "y", float("inf")), ("c", "z", None), (None, "n", 1.0)]


@pytest.mark.parametrize("make", [skewed, flat, few, lambda rng: []])
@pytest.mark.parametrize("by", [(), ("tenant",)])
@pytest.mark.parametrize("capacity", [40, 4096])
def test_equals_the_full_computation(spark, make, by, capacity):
    rows = facts(spark, make(random.Random(3)))
    got = heavy.top_by_summaries(rows, by, "customer", capacity=capacity, candidates=12)
    want = sales.top_customers(rows, by)
    assert got.columns == want.columns
    assert collections.Counter(got.collect()) == collections.Counter(want.collect())


def test_bounds_hold_and_stay_small(spark):
    rows = skewed(random.Random(8))
    found = heavy.summaries(facts(spark, rows, 3), ("tenant",), "customer", 50).collect()
    lost = [r.lost for r in found if r.lost is not None]
    true, kept = collections.Counter(), collections.Counter()
    for tenant, customer, revenue in rows:
        if customer is not None and revenue > 0:
            true[tenant, customer] += revenue
    for r in found:
        if r.customer is not None:
            kept[r.tenant, r.customer] += r.weight
    assert len(lost) == 3 and all(x > 0 for x in lost) and len(found) <= 3 * 51
    assert all(kept[k] <= true[k] + 1e-6 <= kept[k] + sum(lost) + 1e-5 for k in true)
    assert sum(lost) <= sum(true.values()) / 50


def test_leaders_are_proven_without_the_full_computation(spark, monkeypatch):
    """Customers above the summaries' share are found from their own rows alone."""
    seen = []
    full = sales._top
    monkeypatch.setattr(sales, "_top", lambda f, by, key: seen.append(f) or full(f, by, key))
    rows = [("a", f"lead{i}", 1000.0 + i) for i in range(6) for _ in range(50)]
    rows += [("a", f"k{i}", 1.0) for i in range(5000)]
    got = heavy.top_by_summaries(facts(spark, rows), (), "customer", capacity=200, candidates=6).collect()
    assert [r.customer for r in got] == [f"lead{i}" for i in (5, 4, 3, 2, 1)]
    assert len(seen) == 1 and seen[0].count() == 300


def test_many_tenants_are_computed_in_full(spark):
    rows = facts(spark, [(f"t{i % 40}", f"c{i % 97}", float(i % 13)) for i in range(2000)])
    got = heavy.top_by_summaries(rows, ("tenant",), "customer", most=100)
    assert sorted(got.collect()) == sorted(sales.top_customers(rows, ("tenant",)).collect())


def test_cut():
    weights, taken = heavy.cut(np.array([5.0, 1.0, 3.0, 3.0, 9.0]), 2)
    assert taken == 3.0 and list(weights) == [2.0, -2.0, 0.0, 0.0, 6.0]
    assert heavy.cut(np.array([5.0, 1.0]), 2)[1] == 0.0
