"""Which column of a file holds which standard field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.functions.similarity import alias_matcher, best_aliases, matchers
from tallywright.functions.text import normal_header


def alias_scores(vocabulary: DataFrame) -> DataFrame:
    """Every ``(domain, header)`` with its closest alias of each field: ``field, score``.

    Scoring costs time per header, not per byte, so the rows are spread evenly first: on a hash, as
    a repartition by the columns themselves would be dropped after a distinct, and its small
    partitions merged again by size.
    """
    spread = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_marketing = F.col("domain") == "marketing"
    match = {d: alias_matcher(schema.ALIASES[d]) for d in schema.DOMAINS}
    # A null header is not scored: each row costs one domain's aliases.
    found = F.coalesce(
        match["marketing"](F.when(is_marketing, F.col("header"))),
        match["sales"](F.when(~is_marketing, F.col("header"))),
    )
    return (
        vocabulary.repartition(spread, F.xxhash64("domain", "header"))
        .withColumn("_match", F.explode(found))
        .select("domain", "header", "_match.field", "_match.score")
    )


def map_columns(headers: DataFrame, domain: str = "sales") -> DataFrame:
    """The best source column of every field of every file.

    ``headers`` is ``(file, col_pos, column[, domain])``; the result ``(file, field,
    source_column, col_pos, score)`` has nulls where no header scores above 0.6. Among equal scores the first
    column wins. One file may give a column to two fields.

    Files share most of their headers, so each distinct header is scored once and the scores are
    joined back: broadcast where Spark finds them small, with hot headers split by AQE otherwise.
    """
    chosen = F.col("domain") if "domain" in headers.columns else F.lit(domain)
    known = F.when(chosen == "marketing", "marketing").otherwise("sales")
    # A row per file and spelling. Everything below starts from it, so the headers are read once.
    named = (
        headers.where(F.col("column").isNotNull())
        .select(
            "file", "column", known.alias("domain"), F.col("col_pos").cast("bigint").alias("col_pos"),
            normal_header(F.col("column")).alias("header"),
        )
        .groupBy("file", "domain", "header", "column")
        .agg(F.min("col_pos").alias("col_pos"))
        .where(F.col("col_pos").isNotNull())
    )
    scored = named.join(
        alias_scores(named.select("domain", "header").distinct()), ["domain", "header"]
    )
    # Score, then position, in one BIGINT, so that the maximum is a hash aggregate. Scores are
    # ratios of lengths, so different ones stay apart at nine digits.
    rank = F.expr("CAST(round(score * 1e9D) AS BIGINT) * 8589934592 + (8589934591 - col_pos)")
    best = scored.groupBy("file", "field").agg(
        F.max(rank).alias("_rank"), F.max("score").alias("score")
    )
    found = F.col("score") > schema.MATCH_THRESHOLD
    place = F.when(found, F.expr("8589934591 - _rank % 8589934592"))
    chosen_names = named.select("file", "col_pos", F.col("column").alias("source_column"))
    return (
        best.select("file", "field", place.alias("col_pos"), "score")
        .join(chosen_names.groupBy("file", "col_pos").agg(F.max("source_column").alias("source_column")),
              ["file", "col_pos"], "left")
        .select("file", "field", "source_column", "col_pos", "score")
    )


def correct_mapping(mapping: DataFrame, headers: DataFrame, corrections: DataFrame) -> DataFrame:
    """The mapping with the choices ``(file, field, source_column)`` that someone made instead.

    A null choice takes the field away; a column that the file does not have counts as null.
    """
    places = headers.groupBy("file", F.col("column").alias("_chosen")).agg(
        F.min("col_pos").cast("bigint").alias("_pos")
    )
    chosen = corrections.select("file", "field", F.col("source_column").alias("_chosen")).join(
        places, ["file", "_chosen"], "left"
    )
    made = F.col("_made").isNotNull()
    name = F.when(F.col("_pos").isNotNull(), F.col("_chosen"))
    return mapping.join(chosen.withColumn("_made", F.lit(1)), ["file", "field"], "left").select(
        "file",
        "field",
        F.when(made, name).otherwise(F.col("source_column")).alias("source_column"),
        F.when(made, F.col("_pos")).otherwise(F.col("col_pos")).alias("col_pos"),
        F.when(made, F.lit(None)).otherwise(F.col("score")).alias("score"),
    )


def suggest_mapping(columns: Sequence[str], domain: str = "sales") -> dict[str, str | None]:
    """Field -> column for the header of one table, at the API edge."""
    aliases = schema.ALIASES[schema.domain_of(domain)]
    prepared = matchers(aliases)
    best = dict.fromkeys(aliases, 0.0)
    mapping: dict[str, str | None] = dict.fromkeys(aliases)
    for column in columns:
        for field, score, _ in best_aliases(column.lower().strip(), prepared):
            if score > best[field]:
                best[field], mapping[field] = score, column
    return {f: c if best[f] > schema.MATCH_THRESHOLD else None for f, c in mapping.items()}


def standard_columns(rows: DataFrame, mapping: DataFrame, domain: str = "sales") -> DataFrame:
    """Rows of many files with different headers as one table of the domain's fields.

    ``rows`` is ``(file, cells ARRAY<STRING>, ...)``, ``mapping`` ``(file, field, col_pos)`` with
    positions from 0. The mapping becomes one small row per file with a ``layout``, the names of the
    fields the file has; files that lack a required field are left out. Spark joins by size and
    splits hot files.
    """
    domain = schema.domain_of(domain)
    fields = tuple(schema.ALIASES[domain])
    placed = mapping.where(F.col("col_pos").isNotNull())
    places = placed.groupBy("file").agg(
        *[F.max(F.when(F.col("field") == f, F.col("col_pos"))).alias(f"_{f}") for f in fields]
    )
    for required in schema.REQUIRED[domain]:
        places = places.where(F.col(f"_{required}").isNotNull())
    layout = F.concat_ws(",", *[F.when(F.col(f"_{f}").isNotNull(), f) for f in fields])
    places = places.withColumn("layout", layout)
    others = [c for c in rows.columns if c not in ("file", "cells")]
    return rows.join(places, "file").select(
        "file",
        "layout",
        *others,
        *[F.get(F.col("cells"), F.col(f"_{f}").cast("int")).alias(f) for f in fields],
    )


def unusable_files(mapping: DataFrame, domain: str = "sales") -> DataFrame:
    """Files without a column for a required field, with the fields they lack."""
    required = schema.REQUIRED[schema.domain_of(domain)]
    return (
        mapping.where(F.col("field").isin(*required) & F.col("col_pos").isNull())
        .groupBy("file")
        .agg(F.sort_array(F.collect_list("field")).alias("missing"))
    )
