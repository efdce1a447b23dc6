"""Prompt tables for a language model that runs elsewhere, and the replies it leaves.

Only the KPI report enters a prompt, never the rows it was computed from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions.text import clean_reply
from tallywright.schema import HEAD, TAIL

_JSON_STRING = (
    r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
)


def _by_domain(values: dict[str, str]) -> Column:
    return F.when(F.col("domain") == "marketing", values["marketing"]).otherwise(values["sales"])


def insight_prompts(reports: DataFrame) -> DataFrame:
    """Adds ``system_prompt`` and ``prompt`` to reports ``(..., domain, part, position, text)``.

    As the report, a prompt is rows of text, joined in the order of part and position.
    """
    header = F.when(F.col("part") == HEAD, schema.INSIGHT_HEADER).otherwise("")
    return reports.select(
        "*",
        _by_domain(schema.SYSTEM_PROMPTS).alias("system_prompt"),
        F.concat(header, F.col("text")).alias("prompt"),
    )


def split_by_readiness(
    requests: DataFrame, reports: DataFrame, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Requests of tenants with a report, joined to it, and the rest, which have none yet.

    For the second, ``reports`` may be any table of the tenants that have rows.
    """
    return (
        requests.join(reports, list(by)),
        requests.join(reports.select(*by).distinct(), list(by), "left_anti"),
    )


def chat_text() -> Column:
    """The chat prompt's text in each row of ``(domain, part, text, question)``."""
    label = F.concat(F.lit("Business "), _by_domain(schema.CHAT_LABELS), F.lit(" KPI data:\n"))
    closing = F.concat(
        F.lit(f"\n\n{schema.CHAT_QUESTION}"),
        F.col("question"),
        F.lit(f"\n\n{schema.CHAT_CLOSING}"),
    )
    return F.concat(
        F.when(F.col("part") == HEAD, label).otherwise(""),
        F.col("text"),
        F.when(F.col("part") == TAIL, closing).otherwise(""),
    )


def chat_prompts(questions: DataFrame, reports: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``prompt`` to the questions of tenants that have a report, in rows of text by part and
    position."""
    ready, _ = split_by_readiness(questions, reports, by)
    return ready.withColumn("prompt", chat_text())


def chat_messages(prompts: DataFrame, history: DataFrame, conversation: str) -> DataFrame:
    """The messages of each chat, ``(conversation, turn, part, position, role, text)``, prompts last.

    Conversations of any length stay spread over the cluster, and a reader orders by turn, part and
    position; a message of the history is one row, with 0 for the latter two. ``history`` has
    conversation, turn, role and text. Prompts get the turns after their conversation's last, in
    the order of their questions.
    """
    asked = prompts.select(conversation, "question", "part", "position", "prompt")
    turns = history.groupBy(conversation).agg(F.max("turn").alias("_last"))
    number = F.dense_rank().over(Window.partitionBy(conversation).orderBy("question"))
    numbered = (
        asked.where(F.col("part") == HEAD)
        .select(conversation, "question")
        .distinct()
        .withColumn("_number", number)
        .join(turns, conversation, "left")
        .withColumn("turn", (F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_number")).cast("bigint"))
        .select(conversation, "question", "turn")
    )
    closing = asked.join(numbered, [conversation, "question"]).select(
        conversation, "turn", "part", "position", F.lit("user").alias("role"),
        F.col("prompt").alias("text"),
    )
    kept = history.join(numbered.select(conversation).distinct(), conversation, "left_semi")
    return kept.select(
        conversation, F.col("turn").cast("bigint"), F.lit(HEAD).alias("part"),
        F.lit(0).cast("bigint").alias("position"), "role", "text",
    ).unionByName(closing)


def is_json(text: Column) -> Column:
    """The text is one JSON value and nothing else.

    The JSON functions stop reading after the first value. Inside a list and inside an object that
    value must be followed by the closing bracket, so text after it is noticed. They also pass over
    strings in single quotes, with bare control characters or with unknown escapes, so once the
    proper strings are taken out no quote may be left.
    """
    listed = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    named = F.json_object_keys(F.concat(F.lit('{"value":'), text, F.lit("}")))
    left = F.regexp_replace(text, _JSON_STRING, "")
    valid = (listed == 1) & named.isNotNull() & ~left.rlike("[\"']")
    return F.coalesce(valid, F.lit(False))


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``summary, problems, recommendations, parsed`` to stored replies.

    A reply that is not JSON is its own summary. JSON of another shape gives nulls where fields are
    missing, and ``parsed`` is true beside the raw text.
    """
    cleaned = clean_reply(F.col(raw))
    parsed = is_json(cleaned)
    body = F.from_json(cleaned, schema.REPLY)
    plain = F.struct(
        F.col(raw).alias("summary"),
        F.array().cast("array<string>").alias("problems"),
        F.array().cast("array<string>").alias("recommendations"),
    )
    return (
        replies.withColumn("parsed", parsed)
        .withColumn("_reply", F.when(F.col("parsed"), body).otherwise(plain))
        .select("*", "_reply.summary", "_reply.problems", "_reply.recommendations")
        .drop("_reply")
    )
