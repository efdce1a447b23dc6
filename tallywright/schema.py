"""Target schemas and the fixed tables the operators look values up in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SALES_FIELDS = ("date", "revenue", "product", "region", "quantity", "customer")
MARKETING_FIELDS = (
    "date", "campaign", "spend", "impressions", "clicks", "conversions", "revenue",
)
MEASURES = ("spend", "impressions", "clicks", "conversions", "revenue")
DOMAINS = ("sales", "marketing")
REQUIRED = {"sales": ("date", "revenue"), "marketing": ("date", "spend")}

SALES = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("product", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("customer", T.StringType()),
    ]
)
MARKETING = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("campaign", T.StringType()),
        *[T.StructField(m, T.DoubleType()) for m in MEASURES],
    ]
)

# ---- fixed values -------------------------------------------------------------------------
# Header aliases per standard field, in the order that decides ties.
ALIASES = {
    "sales": {
        "date": ["date", "order_date", "transaction_date", "txn_date", "order date"],
        "revenue": ["revenue", "sales", "amount", "total", "price", "total_amount", "sale_amount"],
        "product": ["product", "item", "product_name", "sku", "item_name"],
        "region": ["region", "city", "state", "location", "area"],
        "quantity": ["qty", "quantity", "units", "unit_sold"],
        "customer": ["customer", "customer_name", "client", "buyer"],
    },
    "marketing": {
        "date": ["date", "campaign_date", "report_date", "day"],
        "campaign": ["campaign", "campaign_name", "ad_campaign", "ad_set"],
        "spend": ["spend", "cost", "ad_spend", "budget_spent", "amount_spent"],
        "impressions": ["impressions", "views", "reach"],
        "clicks": ["clicks", "link_clicks", "total_clicks"],
        "conversions": ["conversions", "leads", "purchases", "results"],
        "revenue": ["revenue", "sales", "conversion_value", "purchase_value"],
    },
}
MATCH_THRESHOLD = 0.6

# Cell texts the pandas CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Plan, price in rupees, number of billing cycles.
PLANS = (("monthly", 49, 12), ("yearly", 400, 1))
CURRENCY = "INR"
PAYMENT_CAPTURE = 1

# Subscription status written by each kind of account event.
STATUS = {
    "order_created": "order_created",
    "subscription_created": "created",
    "payment_verified": "active",
}

# Prompt texts.
SYSTEM_PROMPTS = {
    "sales": """You are an expert Sales analyst for a business analytics SaaS product.

You will be given a JSON object containing calculated sales KPIs.
Your job:
1. Write a short, plain-language summary (3-5 sentences) of how the business is performing.
2. Identify 2-3 specific problems or risks visible in the data.
3. Give 3 actionable, specific recommendations.

Rules:
- Only use the numbers given to you. Do not invent data.
- If a trend looks like correlation rather than proven causation, say so explicitly.
- Be direct and concise.
- Respond ONLY in valid JSON with this exact structure, no markdown, no preamble:
{
  "summary": "string",
  "problems": ["string", "string"],
  "recommendations": ["string", "string", "string"]
}
""",
    "marketing": """You are an expert Marketing analyst for a business analytics SaaS product.

You will be given a JSON object containing calculated marketing/campaign KPIs
(CTR, CPC, CPA, ROAS, ROI, conversion rate, campaign-wise performance).
Your job:
1. Write a short, plain-language summary (3-5 sentences) of how marketing campaigns are performing overall.
2. Identify 2-3 specific problems (e.g. campaigns with poor ROAS, high CPA, low CTR).
3. Give 3 actionable, specific recommendations (e.g. shift budget from X to Y, pause underperforming campaign Z).

Rules:
- Only use the numbers given to you. Do not invent data.
- Name specific campaigns by their actual name from the data when relevant.
- Be direct and concise.
- Respond ONLY in valid JSON with this exact structure, no markdown, no preamble:
{
  "summary": "string",
  "problems": ["string", "string"],
  "recommendations": ["string", "string", "string"]
}
""",
}
INSIGHT_HEADER = "Here is the KPI data:\n\n"
CHAT_LABELS = {"sales": "sales", "marketing": "marketing campaign"}
CHAT_QUESTION = "User question: "
CHAT_CLOSING = "Answer using only the data above. Be specific and concise."

# Columns of the account table.
USERS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("email", T.StringType()),
        T.StructField("hashed_password", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("is_subscribed", T.BooleanType()),
        T.StructField("subscription_plan", T.StringType()),
        T.StructField("subscription_status", T.StringType()),
        T.StructField("razorpay_subscription_id", T.StringType()),
    ]
)
# ---- end of fixed values ------------------------------------------------------------------

# Parts of a report as text: what comes before its long list, the entries of that list, the rest.
HEAD, ENTRY, TAIL = 0, 1, 2

# The account table's column for the payment provider's subscription.
SUBSCRIPTION_ID = USERS.fieldNames()[-1]

REPLY = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("problems", T.ArrayType(T.StringType())),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
    ]
)


def plan_table(spark: SparkSession) -> DataFrame:
    """The two-row price table, small by construction and so safe to broadcast."""
    rows = ", ".join(f"('{plan}', {amount}, {cycles})" for plan, amount, cycles in PLANS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS plans(plan, amount, cycles)")


def domain_of(name: str | None) -> str:
    """``marketing`` is marketing; everything else is sales."""
    return "marketing" if name == "marketing" else "sales"
