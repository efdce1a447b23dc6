"""The reports by plain Python over a list of dicts with typed values; None is missing."""

from collections import defaultdict
from decimal import Decimal

MEASURES = ("spend", "impressions", "clicks", "conversions", "revenue")


def add(values):
    return float(sum((Decimal(repr(v)) for v in values), Decimal(0)))


def groups(rows, key, measure):
    found = defaultdict(list)
    for r in rows:
        if r[key] is not None:
            found[r[key]].append(r[measure])
    return {k: add(v) for k, v in found.items()}


def sales(rows, fields):
    rows = [
        {**r, "month": r["date"].strftime("%Y-%m")}
        for r in rows
        if r["date"] is not None and r["revenue"] is not None
    ]
    revenue = add(r["revenue"] for r in rows)
    months = sorted(groups(rows, "month", "revenue").items())
    report = {
        "total_revenue": round(revenue, 2),
        "total_orders": len(rows),
        "average_order_value": round(revenue / len(rows), 2) if rows else 0,
        "monthly_revenue_trend": [{"date": m, "revenue": v} for m, v in months],
        "mom_growth_percent": None,
    }
    if len(months) >= 2:
        before, last = months[-2][1], months[-1][1]
        change = (last - before) / before * 100 if before else 0.0
        report["mom_growth_percent"] = round(change, 2)
    for name, key, top in (
        ("top_products", "product", 5), ("region_wise_sales", "region", None),
        ("top_customers", "customer", 5),
    ):
        if key in fields:
            ranked = sorted(groups(rows, key, "revenue").items(), key=lambda kv: (-kv[1], kv[0]))
            report[name] = [{key: k, "revenue": v} for k, v in ranked[:top]]
    return report


def marketing(rows, fields):
    rows = [{**r, "month": r["date"].strftime("%Y-%m")} for r in rows if r["date"] is not None]
    total = {m: add(r[m] or 0 for r in rows) if m in fields else 0.0 for m in MEASURES}

    def part(a, b, times=1):
        return round(a / b * times, 2) if b > 0 else None

    report = {
        "total_spend": round(total["spend"], 2),
        "total_clicks": int(total["clicks"]),
        "total_impressions": int(total["impressions"]),
        "total_conversions": int(total["conversions"]),
        "total_revenue": round(total["revenue"], 2),
        "ctr_percent": part(total["clicks"], total["impressions"], 100),
        "cpc": part(total["spend"], total["clicks"]),
        "cpa": part(total["spend"], total["conversions"]),
        "conversion_rate_percent": part(total["conversions"], total["clicks"], 100),
        "roas": part(total["revenue"], total["spend"]),
        "roi_percent": part(total["revenue"] - total["spend"], total["spend"], 100),
    }

    def rollup(members, measures):
        return {
            m: add(r[m] or 0 for r in members) if m in fields else float(len(members))
            for m in measures
        }

    def split(key):
        found = defaultdict(list)
        for r in rows:
            if r[key] is not None:
                found[r[key]].append(r)
        return found

    if "campaign" in fields:
        performance = []
        for c, members in split("campaign").items():
            row = {"campaign": c, **rollup(members, ("spend", "clicks", "conversions", "revenue"))}
            performance.append({**row, "roas": part(row["revenue"], row["spend"])})
        performance.sort(
            key=lambda r: (r["roas"] is None, -(r["roas"] or 0), r["campaign"])
        )
        valid = [r["campaign"] for r in performance if r["roas"] is not None]
        report["campaign_performance"] = performance
        report["best_campaign"] = valid[0] if valid else None
        report["worst_campaign"] = valid[-1] if valid else None
    report["monthly_trend"] = [
        {"date": m, **rollup(members, ("spend", "revenue"))}
        for m, members in sorted(split("month").items())
    ]
    return report
