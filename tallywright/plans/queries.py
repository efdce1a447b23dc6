"""The registered queries: every operator over the whole sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.numbers import split_amounts, sum_parts, sum_total
from tallywright.operators import (
    accounts, billing, coerce, heavy, infer, mapping, marketing, prompts, sales, uploads,
)
from tallywright.operators.settle import shared_folder
from tallywright.plans import incremental, reports
from tallywright.sources import files, sample_accounts, sample_facts
from tallywright.sources.sample_facts import table
from tallywright.streaming import subscriptions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALL_FIELDS = ("tenant", "date", "revenue", "product", "region", "customer")
ORDER_MAPPING = {
    "date": "o_orderdate",
    "revenue": "o_totalprice",
    "product": "o_orderstatus",
    "region": "o_orderpriority",
    "customer": None,
    "quantity": None,
}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _sales(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    by = ("tenant",) if "tenant" in fields else ()
    return coerce.sales_facts(sample_facts.sales(spark, sf_dir, fields), by)


def _campaigns(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    return coerce.marketing_facts(sample_facts.campaigns(spark, sf_dir), by)


# Sales --------------------------------------------------------------------------------------


@query
def sales_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.totals(_sales(spark, sf_dir, "date", "revenue"))


@query
def sales_totals_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.totals(_sales(spark, sf_dir, "tenant", "date", "revenue"), ("tenant",))


@query
def sales_monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.monthly_revenue(_sales(spark, sf_dir, "date", "revenue")).orderBy("month")


@query
def sales_mom_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.mom_growth(_sales(spark, sf_dir, "date", "revenue"))


@query
def sales_mom_growth_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.mom_growth(_sales(spark, sf_dir, "tenant", "date", "revenue"), ("tenant",))


@query
def sales_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.top_products(_sales(spark, sf_dir, "date", "revenue", "product"))


@query
def sales_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.top_customers(_sales(spark, sf_dir, "date", "revenue", "customer"))


@query
def sales_top_products_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _sales(spark, sf_dir, "tenant", "date", "revenue", "product")
    return sales.top_products(facts, ("tenant",))


@query
def sales_top_customers_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _sales(spark, sf_dir, "tenant", "date", "revenue", "customer")
    return sales.top_customers(facts, ("tenant",))


@query
def sales_top_customers_by_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _sales(spark, sf_dir, "date", "revenue", "customer")
    return heavy.top_by_summaries(facts, (), "customer")


@query
def sales_top_customers_by_tenant_and_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _sales(spark, sf_dir, "tenant", "date", "revenue", "customer")
    return heavy.top_by_summaries(facts, ("tenant",), "customer")


@query
def sales_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.revenue_by_region(_sales(spark, sf_dir, "date", "revenue", "region"))


@query
def sales_breakdown_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.breakdown(_sales(spark, sf_dir, *ALL_FIELDS[1:]))


@query
def sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = sample_facts.sales(spark, sf_dir, ALL_FIELDS)
    return reports.report_json(reports.sales_report(facts, ("tenant",), stamp=False), ("tenant",))


@query
def confirmed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as uploaded, under its own column names."""
    report = reports.confirm_mapping(
        table(spark, sf_dir, "orders"), ORDER_MAPPING, "sales", stamp=False
    )
    return reports.report_json(report)


@query
def replaced_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdowns of each customer's newest order day, kept up to date over three changes.

    A customer is a tenant and an order day an upload. The days of the second halves of all years
    come first, then those of the first halves, of which many are older than what is there; then
    the first change is sent again.
    """
    facts = sample_facts.sales(spark, sf_dir, ("customer", "date", "revenue", "product", "region"))
    rows = facts.withColumnRenamed("customer", "tenant").withColumn("upload_id", F.col("date"))
    store = incremental.Store(
        shared_folder(spark, "replaced-uploads"), fields=("date", "revenue", "product", "region"),
        slots=8,
    )
    incremental.create(spark, store)
    for number, half in ((1, "month(date) > 6"), (2, "month(date) <= 6"), (1, "month(date) > 6")):
        sent = rows.where(half)
        uploads = sent.select("tenant", "upload_id", F.col("date").alias("uploaded_at"))
        incremental.apply_change(spark, store, number, sent, uploads)
    return incremental.breakdown(spark, store)


# Marketing ----------------------------------------------------------------------------------


@query
def mkt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.totals(_campaigns(spark, sf_dir))


@query
def mkt_totals_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.totals(_campaigns(spark, sf_dir, ("tenant",)), ("tenant",))


@query
def mkt_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.campaign_performance(_campaigns(spark, sf_dir))


@query
def mkt_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.best_worst(_campaigns(spark, sf_dir, ("tenant",)), ("tenant",))


@query
def mkt_monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = coerce.marketing_facts(sample_facts.shipments(spark, sf_dir))
    return marketing.monthly_trend(facts).orderBy("month")


@query
def mkt_count_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns of a file without a clicks column."""
    return marketing.campaign_performance(_campaigns(spark, sf_dir).drop("clicks"))


@query
def mkt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = sample_facts.campaigns(spark, sf_dir)
    report = reports.marketing_report(facts, ("tenant",), stamp=False)
    return reports.report_json(report, ("tenant",))


@query
def reports_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales rows by segment and campaign rows by user group in one table."""
    both = (
        sample_facts.sales(spark, sf_dir, ALL_FIELDS)
        .withColumn("domain", F.lit("sales"))
        .unionByName(
            sample_facts.campaigns(spark, sf_dir).withColumn("domain", F.lit("marketing")),
            allowMissingColumns=True,
        )
    )
    return reports.reports_by_domain(both, ("tenant",), stamp=False)


# Coercion and mapping -----------------------------------------------------------------------


@query
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.infer_types(sample_accounts.upload_cells(spark, sf_dir))


@query
def inferred_types_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.infer_types(sample_accounts.upload_cells(spark, sf_dir), ("file",))


@query
def typed_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.with_types(sample_accounts.upload_cells(spark, sf_dir))


@query
def spanning_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations written as CSV, whose cells hold line feeds, quotes and commas, and read
    back by byte ranges."""
    folder = shared_folder(spark, "spanning-upload")
    told = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat_ws(', "', "role", F.concat("text", F.lit('"\n'))).alias("said")
    )
    told.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)
    read = files.read_upload(spark, folder, ())
    return read.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.length("said").cast("bigint").alias("chars"), F.md5("said").alias("digest"),
    )


@query
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(sample_accounts.DIRTY_NUMBER)
    cells = table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 16).alias("kind"), text.alias("cell")
    )
    number = coerce.as_number(F.col("cell"), cells.schema["cell"].dataType)
    values = cells.select("kind", number.alias("value"))
    filled = values.select("*", F.coalesce("value", F.lit(0.0)).alias("total"))
    return (
        split_amounts(filled, ["total"])
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("ok"), *sum_parts("total"))
        .select("kind", "n", "ok", sum_total("total"))
    )


@query
def coerce_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 9).alias("kind"), F.expr(sample_accounts.DIRTY_DATE).alias("cell")
    )
    moment = coerce.as_moment(F.col("cell"), cells.schema["cell"].dataType, ("MM/dd/yyyy",))
    return (
        cells.select("kind", moment.alias("moment"))
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("moment").alias("ok"),
            F.min("moment").cast("string").alias("first"),
            F.max("moment").cast("string").alias("last"),
        )
    )


@query
def dates_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four ways to write dates, each read in the way of its first date."""
    cells = spark.sql(
        sample_accounts.DATE_FILES_SQL.replace("FROM orders", "FROM {orders}"),
        orders=table(spark, sf_dir, "orders"),
    )
    return (
        coerce.with_inferred_dates(cells, ("file",), "row")
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("date").isNull()).alias("dropped"),
            F.min("date").cast("string").alias("first"),
            F.max("date").cast("string").alias("last"),
        )
    )


@query
def na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", F.expr(sample_accounts.DIRTY_CELL).alias("cell")
    )
    return (
        coerce.drop_na_tokens(cells)
        .groupBy("l_linenumber", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_columns(sample_accounts.headers(spark, sf_dir))


@query
def mapped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files per return flag, each with its columns in another order, as one table."""
    line = table(spark, sf_dir, "lineitem")
    date, price = F.col("l_shipdate").cast("string"), F.col("l_extendedprice").cast("string")
    rows = line.select(
        F.col("l_returnflag").alias("file"),
        F.when(F.col("l_returnflag") == "A", F.array(date, price, F.col("l_linestatus")))
        .otherwise(F.array(F.col("l_linestatus"), date, price))
        .alias("cells"),
    )
    places = (
        line.select("l_returnflag")
        .distinct()
        .select(
            F.col("l_returnflag").alias("file"),
            F.explode(
                F.when(
                    F.col("l_returnflag") == "A",
                    F.create_map(*map(F.lit, ("date", 0, "revenue", 1, "product", 2))),
                ).otherwise(F.create_map(*map(F.lit, ("date", 1, "revenue", 2, "product", 0))))
            ).alias("field", "col_pos"),
        )
    )
    facts = coerce.sales_facts(mapping.standard_columns(rows, places), ("file",))
    return sales.breakdown(facts.select("file", "date", "revenue", "product"), ("file",))


# Uploads ------------------------------------------------------------------------------------


@query
def upload_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = uploads.profile(table(spark, sf_dir, "events"), "marketing", ("event_id",))
    pairs = F.transform(
        F.array_sort(F.map_entries("suggested_mapping")),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
    )
    return about.select(
        "analyst_type",
        F.array_join("columns_found", ",").alias("columns_found"),
        F.array_join(pairs, ",").alias("suggested_mapping"),
        "row_count",
        F.array_join("preview", "\n").alias("preview"),
    )


@query
def upload_profiles_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = uploads.profile_files(table(spark, sf_dir, "events"), "user_id", ("event_id",))
    return files.select("user_id", "row_count", F.array_join("preview", "\n").alias("preview"))


@query
def upload_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.preview(table(spark, sf_dir, "orders"), ("o_orderkey",))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")


@query
def latest_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = uploads.latest_upload(_uploads(spark, sf_dir), ("user_id",), "ts", "event_id")
    return newest.drop("ts")


@query
def latest_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of the day of their newest order, an order day being an upload."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    days = orders.select("o_custkey", "o_orderdate", F.col("o_orderdate").alias("uploaded_at"))
    return uploads.latest_data(orders, days, ("o_custkey",), "uploaded_at", "o_orderdate").select(
        "o_custkey", "o_orderkey"
    )


# Accounts and billing -----------------------------------------------------------------------


@query
def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.profiles(sample_accounts.users(spark, sf_dir))


@query
def user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts behind the purchases, by address."""
    address = F.concat(
        F.lit("customer"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@example.com")
    )
    requests = (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select("event_id", address.alias("email"))
    )
    found = accounts.find_users(sample_accounts.users(spark, sf_dir), requests)
    return found.select("event_id", "email", "id", "company_name")


@query
def subscription_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return accounts.subscribed_only(orders, sample_accounts.users(spark, sf_dir), ("id",))


@query
def new_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First signup event of users without a positive account balance."""
    signups = (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "signup")
        .select("user_id", "ts", "event_id")
    )
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    known = known.select(F.col("c_custkey").alias("user_id"))
    return accounts.new_signups(signups, known, ("ts", "event_id"), "user_id").drop("ts")


@query
def order_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.order_batch(sample_accounts.plan_requests(spark, sf_dir))


@query
def order_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = billing.split_by_plan(sample_accounts.plan_requests(spark, sf_dir))
    return rejected


@query
def payment_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_accounts.payments(spark, sf_dir).select("o_orderkey", "signature")


@query
def accepted_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = billing.check_payments(
        sample_accounts.payments(spark, sf_dir), sample_accounts.SIGNING_KEY
    )
    accepted, _ = billing.split_by_validity(checked)
    return accepted.select("o_orderkey", "o_orderstatus")


@query
def rejected_subscription_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payments read as subscription payments, whose ids are signed in swapped order."""
    paid = sample_accounts.payments(spark, sf_dir).withColumnRenamed("order_id", "subscription_id")
    checked = billing.check_subscription_payments(paid, sample_accounts.SIGNING_KEY)
    _, rejected = billing.split_by_validity(checked)
    return rejected.select("o_orderkey", "o_orderstatus")


@query
def subscription_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = billing.subscription_state(sample_accounts.account_events(spark, sf_dir))
    return state.drop("subscription_id")


@query
def subscription_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after every change that the stream of events told."""
    folder = shared_folder(spark, "subscription-stream")
    changes = subscriptions.follow_subscriptions(sample_accounts.arriving_account_events(spark, sf_dir))
    subscriptions.write_changes(changes, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    told = spark.read.schema(changes.schema).parquet(f"{folder}/changes")
    return subscriptions.latest_states(told).drop("subscription_id")


@query
def subscription_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = sample_accounts.users(spark, sf_dir)
    after = billing.apply_events(users, sample_accounts.account_events(spark, sf_dir))
    return accounts.subscription_status(after)


@query
def payments_to_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, subscriptions and the payments that pass the check, folded into the accounts."""
    paid = sample_accounts.payments(spark, sf_dir).join(
        table(spark, sf_dir, "orders").select(
            "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")
        ),
        "o_orderkey",
    )
    checked = billing.check_payments(paid, sample_accounts.SIGNING_KEY)
    accepted, _ = billing.split_by_validity(checked)
    ordered = sample_accounts.account_events(spark, sf_dir)
    events = ordered.withColumn("event_id", F.col("event_id").cast("string")).unionByName(
        billing.payment_events(accepted)
    )
    after = billing.apply_events(sample_accounts.users(spark, sf_dir), events)
    return accounts.subscription_status(after)


# Dirty data ---------------------------------------------------------------------------------


@query
def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and unusable dates and amounts, missing keys, the key NA."""
    cells = spark.sql(
        sample_accounts.DIRTY_SALES_SQL.replace("FROM orders", "FROM {orders}"),
        orders=table(spark, sf_dir, "orders"),
    )
    return sales.breakdown(coerce.sales_facts(cells))


@query
def dirty_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusable amounts, missing dates and campaigns, no spend, neither clicks nor conversions."""
    cells = spark.sql(
        sample_accounts.DIRTY_CAMPAIGNS_SQL.replace("FROM events", "FROM {events}"),
        events=table(spark, sf_dir, "events"),
    )
    return marketing.campaign_performance(coerce.marketing_facts(cells))


@query
def mkt_trend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of a file without spend."""
    facts = coerce.marketing_facts(sample_facts.shipments(spark, sf_dir).drop("spend"))
    return marketing.monthly_trend(facts)


# Prompts ------------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mkt_report(spark, sf_dir).withColumn("domain", F.lit("marketing"))


@query
def insight_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.insight_prompts(_reports(spark, sf_dir)).select(
        "tenant", "part", "position", "system_prompt", "prompt"
    )


@query
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, _ = sample_accounts.chats(spark, sf_dir)
    asked = prompts.chat_prompts(questions, _reports(spark, sf_dir), ("tenant",))
    return asked.select("conv_id", "tenant", "part", "position", "prompt")


@query
def chat_unready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of tenants without a report."""
    questions, _ = sample_accounts.chats(spark, sf_dir)
    tenants = sample_facts.campaigns(spark, sf_dir).where("date IS NOT NULL").select("tenant")
    _, waiting = prompts.split_by_readiness(questions, tenants, ("tenant",))
    return waiting


@query
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, history = sample_accounts.chats(spark, sf_dir)
    asked = prompts.chat_prompts(questions, _reports(spark, sf_dir), ("tenant",))
    return prompts.chat_messages(asked, history, "conv_id")


@query
def insight_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = prompts.parse_replies(sample_accounts.replies(spark, sf_dir))
    return parsed.select(
        "conv_id",
        "turn",
        "parsed",
        "summary",
        F.array_join("problems", "|").alias("problems"),
        F.array_join("recommendations", "|").alias("recommendations"),
    )
