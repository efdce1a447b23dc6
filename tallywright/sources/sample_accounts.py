"""Accounts, payments, chats and raw text tables derived from the sample tables.

The raw text is written as SQL that both Spark and the checking engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import billing
from tallywright.sources.sample_facts import table

SIGNING_KEY = b"sample-signing-key"

ACCOUNT_PLAN = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'monthly' WHEN 'BUILDING' THEN 'yearly'
    WHEN 'FURNITURE' THEN 'monthly' WHEN 'HOUSEHOLD' THEN 'weekly' END"""
ACCOUNT_FLAG = "CASE WHEN c_acctbal > 5000 THEN TRUE WHEN c_acctbal > 0 THEN FALSE END"
ACCOUNT_EMAIL = "lower(replace(c_name, '#', '')) || '@example.com'"

N = "CAST(l_linenumber AS STRING)"
DIRTY_NUMBER = f"""CASE (l_orderkey + l_linenumber) % 16
    WHEN 0 THEN CAST(l_quantity AS STRING) WHEN 1 THEN ' ' || {N} || ' ' WHEN 2 THEN {N} || 'e3'
    WHEN 3 THEN '+' || {N} WHEN 4 THEN '.' || {N} WHEN 5 THEN {N} || '.'
    WHEN 6 THEN {N} || ',000' WHEN 7 THEN '$' || {N} WHEN 8 THEN {N} || 'd'
    WHEN 9 THEN {N} || 'f' WHEN 10 THEN '0x1' || {N} WHEN 11 THEN 'inf' WHEN 12 THEN '1e400'
    WHEN 13 THEN 'nan' WHEN 14 THEN '-' || {N} || '.5' END"""

D = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
DIRTY_DATE = f"""CASE o_orderkey % 9
    WHEN 0 THEN {D} WHEN 1 THEN {D} || ' 10:20:30' WHEN 2 THEN {D} || 'T10:20:30'
    WHEN 3 THEN substr({D}, 6, 2) || '/' || substr({D}, 9, 2) || '/' || substr({D}, 1, 4)
    WHEN 4 THEN '45000' WHEN 5 THEN substr({D}, 1, 4) WHEN 6 THEN substr({D}, 1, 4) || '-02-30'
    WHEN 7 THEN 'on ' || {D} END"""

# Orders as files by the way their dates are written, a few cells missing.
DATE_FILES_SQL = f"""SELECT CAST(o_orderkey % 4 AS STRING) AS file, o_orderkey AS row,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN {D}
        WHEN o_orderkey % 4 = 1
        THEN substr({D}, 6, 2) || '/' || substr({D}, 9, 2) || '/' || substr({D}, 1, 4)
        WHEN o_orderkey % 4 = 2
        THEN substr({D}, 9, 2) || '.' || substr({D}, 6, 2) || '.' || substr({D}, 1, 4)
        ELSE replace({D}, '-', '/') END AS date FROM orders"""

DIRTY_CELL = """CASE l_linenumber WHEN 1 THEN 'NA' WHEN 2 THEN 'null' WHEN 3 THEN ''
    WHEN 4 THEN 'n/a' ELSE l_returnflag END"""

# Facts as text with all that can be wrong in them: missing and unusable dates and amounts, no key.
DIRTY_SALES_SQL = f"""SELECT {DIRTY_DATE} AS date, CASE o_orderkey % 7 WHEN 0 THEN NULL
        WHEN 1 THEN 'n/a' WHEN 2 THEN '-12.5' WHEN 3 THEN '1,000' WHEN 4 THEN '1e400'
        ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) END AS revenue,
    CASE WHEN o_orderkey % 11 > 2 THEN o_orderstatus END AS product,
    CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority WHEN o_orderkey % 5 = 1 THEN 'NA' END AS region
    FROM orders"""
DIRTY_CAMPAIGNS_SQL = """SELECT CASE WHEN event_id % 13 > 0 THEN ts END AS date,
    CASE WHEN user_id % 9 > 0 THEN 'C' || CAST(user_id % 9 AS STRING) END AS campaign,
    CASE WHEN user_id % 9 < 3 THEN '0' WHEN event_id % 4 = 0 THEN 'free' WHEN event_id % 4 = 1
        THEN NULL ELSE CAST(event_id % 50 AS STRING) || '.25' END AS spend,
    CASE event_id % 3 WHEN 0 THEN '-3' WHEN 1 THEN 'none' ELSE '7.5' END AS revenue FROM events"""


# Line items as an upload of text: columns that are of one kind, of several, and of none.
UPLOAD_SQL = f"""SELECT l_returnflag AS file, l_orderkey AS item, CAST(l_orderkey AS STRING) AS id,
    ' +' || {N} || ' ' AS padded, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) AS price,
    CASE WHEN l_linenumber % 2 = 0 THEN {N} ELSE {N} || '.125' END AS mixed,
    CASE l_orderkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END AS flag,
    CAST(CAST(l_shipdate AS DATE) AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN ' 10:20:30'
        ELSE '' END AS shipped,
    CASE WHEN l_orderkey % 7 = 0 THEN '2024-02-30' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING)
        END AS impossible, {DIRTY_NUMBER} AS dirty,
    CASE l_linenumber WHEN 1 THEN 'NA' WHEN 2 THEN 'null' WHEN 3 THEN '' END AS nothing,
    CASE WHEN l_returnflag = 'N' AND l_orderkey % 1009 = 7 THEN 'unknown' ELSE {N} END AS rarely,
    CASE WHEN l_orderkey % 5 = 0 THEN '9223372036854775808' ELSE {N} END AS huge,
    CASE WHEN l_orderkey % 5 = 0 THEN {N} || 'e2' ELSE {N} END AS powers,
    CASE WHEN l_orderkey % 2 = 0 THEN 'true' ELSE {N} END AS blend FROM lineitem"""


def upload_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UPLOAD_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr(ACCOUNT_EMAIL).alias("email"),
        F.col("c_mktsegment").alias("company_name"),
        F.expr(ACCOUNT_FLAG).alias("is_subscribed"),
        F.expr(ACCOUNT_PLAN).alias("subscription_plan"),
        F.lit(None).cast("string").alias("subscription_status"),
    )


def plan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.expr(ACCOUNT_PLAN).alias("plan")
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment per order; orders of status P carry a signature over the ids swapped."""
    ids = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.concat(F.lit("pay_"), F.col("o_custkey").cast("string")).alias("payment_id"),
    )
    right = billing.payment_signature(F.col("order_id"), F.col("payment_id"), SIGNING_KEY)
    swapped = billing.payment_signature(F.col("payment_id"), F.col("order_id"), SIGNING_KEY)
    return ids.withColumn(
        "signature", F.when(F.col("o_orderstatus") == "P", swapped).otherwise(right)
    )


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_account_events(table(spark, sf_dir, "events"))


def arriving_account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the table's files."""
    kinds = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 4)
    # A pattern may stand for a single file, which a plain path of a stream may not.
    return as_account_events(stream.parquet(f"{sf_dir}/events.parque[t]"))


def as_account_events(events: DataFrame) -> DataFrame:
    """Signups order a plan, clicks start a subscription, purchases are verified payments."""
    number = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "user_id",
        "ts",
        "event_id",
        F.when(F.col("event_type") == "signup", "order_created")
        .when(F.col("event_type") == "click", "subscription_created")
        .when(F.col("event_type") == "purchase", "payment_verified")
        .alias("event"),
        F.when(F.col("event_type").isin("signup", "click"),
               F.when(number < 50, "monthly").otherwise("yearly")).alias("plan"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the data taken as file headers: event types of a user as a marketing file,
    customers of a nation as a sales file."""
    marketing = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("file"),
        F.col("event_id").alias("col_pos"),
        F.concat(F.lit(" "), F.upper("event_type")).alias("column"),
        F.lit("marketing").alias("domain"),
    )
    sales = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("file"),
        F.col("c_custkey").alias("col_pos"),
        F.col("c_name").alias("column"),
        F.lit("sales").alias("domain"),
    )
    return marketing.unionByName(sales)


def chats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions and histories: a conversation's last user turn asks, the turns before it led there."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").groupBy("conv_id").agg(
        F.max("turn").alias("asked_at"), F.max_by("text", "turn").alias("question")
    )
    questions = asked.select(
        "conv_id", (F.col("conv_id") % 7).cast("string").alias("tenant"), "question"
    )
    history = turns.join(asked.select("conv_id", "asked_at"), "conv_id").where(
        F.col("turn") < F.col("asked_at")
    )
    return questions, history.drop("asked_at")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model replies: fenced and bare JSON, JSON of other shapes, prose."""
    full = F.to_json(
        F.struct(
            F.col("text").alias("summary"),
            F.array(F.col("role"), F.lit("late")).alias("problems"),
            F.array(F.lit("wait")).alias("recommendations"),
        )
    )
    short = F.to_json(F.struct(F.col("text").alias("summary")))
    shape = F.col("conv_id") % 6
    raw = (
        F.when(shape == 0, F.concat(F.lit("\n```json\n"), full, F.lit("\n```\n")))
        .when(shape == 1, F.concat(F.lit("```\n"), full, F.lit("```")))
        .when(shape == 2, short)
        .when(shape == 3, F.concat(F.lit("  "), full, F.lit("\n")))
        .when(shape == 4, F.lit("[1, 2]"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
