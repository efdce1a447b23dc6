"""Profiles of uploaded tables and the choice of the latest upload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.mapping import suggest_mapping

PREVIEW = 5


def preview(df: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:
    """The first five rows, in ``order`` if one is given."""
    return (df.orderBy(*order) if order else df).limit(PREVIEW)


def profile(df: DataFrame, domain: str = "sales", order: Sequence[str | Column] = ()) -> DataFrame:
    """One row about a table: columns, row count, preview and suggested mapping."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    shown = preview(df, order).agg(F.collect_list(record).alias("preview"))
    mapping = suggest_mapping(df.columns, domain)
    pairs = [v for f, c in mapping.items() for v in (F.lit(f), F.lit(c).cast("string"))]
    return shown.select(
        F.lit(domain).alias("analyst_type"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns_found"),
        F.create_map(*pairs).alias("suggested_mapping"),
        df.agg(F.count(F.lit(1))).scalar().alias("row_count"),
        "preview",
    )


def profile_files(df: DataFrame, file: str, order: Sequence[str]) -> DataFrame:
    """Row count and five-row preview of every file in a table of many files.

    The preview is cut by ``row_number`` before the shuffle; only five rows of a file are gathered.
    """
    record = F.to_json(
        F.struct(*[F.col(c) for c in df.columns if c != file]), {"ignoreNullFields": "false"}
    )
    counts = df.groupBy(file).agg(F.count(F.lit(1)).alias("row_count"))
    first = Window.partitionBy(file).orderBy(*order)
    shown = (
        df.withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= PREVIEW)
        .groupBy(file)
        .agg(F.sort_array(F.collect_list(F.struct("_place", record.alias("row")))).alias("_rows"))
    )
    return counts.join(shown, file).select(
        file, "row_count", F.transform("_rows", lambda r: r["row"]).alias("preview")
    )


def profile_uploads(headers: DataFrame, rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """A row about each file of a folder: ``(file, columns_found, suggested_mapping, row_count,
    preview)``.

    ``headers`` is (file, col_pos, column), ``rows`` (file, row, cells), ``mapping`` (file, field,
    source_column). The gathered lists are as long as a header or five rows.
    """
    columns = headers.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("col_pos", "column"))).alias("_columns")
    )
    fields = mapping.groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "source_column"))).alias(
            "suggested_mapping"
        )
    )
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("row_count"))
    first = Window.partitionBy("file").orderBy("row")
    shown = (
        rows.withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= PREVIEW)
        .groupBy("file")
        .agg(F.sort_array(F.collect_list(F.struct("_place", "cells"))).alias("_rows"))
    )
    joined = columns.join(fields, "file", "left").join(counts, "file", "left")
    return joined.join(shown, "file", "left").select(
        "file",
        F.transform("_columns", lambda c: c["column"]).alias("columns_found"),
        "suggested_mapping",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.transform("_rows", lambda r: r["cells"]).alias("preview"),
    )


def latest_upload(
    uploads: DataFrame, by: Sequence[str] = ("tenant",), at: str = "uploaded_at",
    upload_id: str = "upload_id",
) -> DataFrame:
    """The newest upload of each tenant; of equal times the higher id."""
    newest = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(upload_id))
    return (
        uploads.withColumn("_place", F.row_number().over(newest))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def latest_data(
    rows: DataFrame, uploads: DataFrame, by: Sequence[str] = ("tenant",), at: str = "uploaded_at",
    upload_id: str = "upload_id",
) -> DataFrame:
    """The rows that belong to the newest upload of their tenant."""
    newest = latest_upload(uploads, by, at, upload_id).select(*by, upload_id)
    return rows.join(newest, [*by, upload_id], "left_semi")
