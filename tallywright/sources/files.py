"""CSV uploads in, report tables out."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.operators.coerce import drop_na_tokens
from tallywright.operators.infer import with_types
from tallywright.operators.settle import settle
from tallywright.sources.spanning import parsed, spanning_records


def check_format(path: str) -> str:
    """``csv`` for a CSV file or a folder of them; other formats raise ``ValueError``."""
    name = os.path.basename(path.rstrip("/"))
    suffix = os.path.splitext(name)[1]
    if suffix == ".csv" or suffix == "":
        return "csv"
    if suffix in (".xlsx", ".xls"):
        raise ValueError("convert Excel files to CSV or parquet first")
    raise ValueError("only CSV or Excel files are supported")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``(file, header, open_quotes)``.

    ``header`` is the first line that is not blank, ``open_quotes`` tells whether a line has an odd
    number of quotes, so that a cell may go on in the next one. The place of the header is the least
    line number of the file's first block, a BIGINT, so the lines are combined by hash and never
    sorted; the text is then looked up by it.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"),
    )
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    first = (F.col("block") == 0) & (F.trim("value") != "")
    about = lines.groupBy("file").agg(
        F.min(F.when(first, F.col("number"))).alias("number"),
        F.bool_or(quotes % 2 == 1).alias("open_quotes"),
    )
    headers = lines.where(first).select("file", "number", F.col("value").alias("header"))
    return about.join(headers, ["file", "number"], "left").select("file", "header", "open_quotes")


def _split_paths(spark: SparkSession, path: str, open_files: list[str]) -> tuple[list[str], list[str]]:
    """The files whose cells end in their line, and those whose cells may go on in the next one.

    Which way a file is read depends on its own content alone, not on its size or its neighbours.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    paths = sorted(unquote(r.path) for r in listed.select("path").collect())
    return [p for p in paths if p not in set(open_files)], sorted(open_files)


def _reader(spark: SparkSession, **options):
    return spark.read.options(header=True, escape='"', pathGlobFilter="*.csv", **options)


def _open_files(lines: DataFrame) -> list[str]:
    return [unquote(r.file) for r in lines.where("open_quotes").select("file").collect()]


def read_upload(
    spark: SparkSession, path: str, na_tokens: tuple[str, ...] = schema.NA_TOKENS
) -> DataFrame:
    """Read an uploaded CSV file, or a folder of files with the same header, all cells as text.

    Cells may hold line breaks. The lines of every file are searched for open quotes first; files
    that have some are read by :mod:`spanning <tallywright.sources.spanning>`, and all files by byte
    ranges. Files whose header differs from the first one's raise an error.
    """
    check_format(path)
    plain, spanning = _split_paths(spark, path, _open_files(scan_lines(spark, path)))
    if not plain and not spanning:
        raise ValueError(f"no CSV file at {path}")
    first = (plain or spanning)[0]
    header = _reader(spark, multiLine=not plain).csv(first).schema
    rows = []
    if plain:
        rows.append(_reader(spark, enforceSchema=False).schema(header).csv(plain))
    if spanning:
        records = spanning_records(spark, spanning)
        wide = parsed(records, [*header.names, "_more"])
        cells = F.array(*[F.lower(F.trim(F.coalesce(F.col(f"`{n}`"), F.lit("")))) for n in header.names])
        want = F.array(*[F.lit(n.strip().lower()) for n in header.names])
        other = (cells != want) | F.col("_more").isNotNull()
        if not _generated(header.names) and (odd := wide.where("first").where(other).select("file").head(1)):
            raise ValueError(f"the header of {odd[0].file} is not that of {first}")
        ordered = wide.where("not first").orderBy("file", "start")  # as the lines of a file stand
        rows.append(ordered.select(*[F.col(f"`{n}`") for n in header.names]))
    return drop_na_tokens(reduce(DataFrame.unionByName, rows), na_tokens)


def read_typed(
    spark: SparkSession, path: str, na_tokens: tuple[str, ...] = schema.NA_TOKENS
) -> DataFrame:
    """Read an upload as :func:`read_upload` does, each column with the type of all its cells."""
    return with_types(read_upload(spark, path, na_tokens), None, na_tokens)


def _generated(names: list[str]) -> bool:
    """Whether the reader made up names, for empty or equal headers."""
    return any(n.startswith("_c") and n[2:].isdigit() or n[-1:].isdigit() for n in names)


def read_uploads(
    spark: SparkSession, path: str, na_tokens: tuple[str, ...] = schema.NA_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """Read a folder of CSV files, each with a header of its own.

    Gives ``(file, col_pos, column)`` for the headers and ``(file, row, cells)`` for the rows, as
    wide as the widest header; ``row`` rises within a file. One pass over the lines finds the headers
    and the files with cells that span lines; all are split between tasks whatever their size.
    """
    check_format(path)
    found = settle(scan_lines(spark, path))
    width = found.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))))
    names = [f"c{i}" for i in range((width.first()[0] or 0) + 1)]
    wide = ", ".join(f"{n} STRING" for n in names)
    header = F.from_csv(F.col("header"), F.lit(wide), {"escape": '"'})
    headers = found.select("file", header.alias("h")).select(
        "file", F.posexplode(F.array(*[f"h.{n}" for n in names])).alias("col_pos", "column")
    )
    plain, spanning = _split_paths(spark, path, _open_files(found))
    rows = []
    if plain:
        rows.append(
            _reader(spark).schema(wide).csv(plain).select(
                "*",
                F.col("_metadata.file_path").alias("_file"),
                F.monotonically_increasing_id().alias("_row"),
            )
        )
    if spanning:
        cells = parsed(spanning_records(spark, spanning).where("not first"), names)
        rows.append(cells.select(*names, F.col("file").alias("_file"), F.col("start.number").alias("_row")))
    nothing = spark.createDataFrame([], f"{wide}, _file STRING, _row BIGINT")
    cells = drop_na_tokens(reduce(DataFrame.unionByName, rows, nothing), na_tokens)
    return (
        headers.where(F.col("column").isNotNull()),
        cells.select(
            F.col("_file").alias("file"), F.col("_row").alias("row"), F.array(*names).alias("cells")
        ),
    )


def read_users(
    spark: SparkSession, url: str, lowest_id: int, highest_id: int, partitions: int = 16,
    **options: str,
) -> DataFrame:
    """The account table through JDBC, without the password hashes, in ranges of the id."""
    ranges = {"partitionColumn": "id", "lowerBound": lowest_id, "upperBound": highest_id}
    reader = spark.read.format("jdbc").options(url=url, dbtable="users", **ranges)
    reader = reader.option("numPartitions", partitions)
    return reader.options(**options).load().drop("hashed_password")


def write_reports(reports: DataFrame, path: str, format: str = "json", mode: str = "errorifexists"):
    """Write report documents or any other result as JSON lines or parquet."""
    if format not in ("json", "parquet"):
        raise ValueError(f"unknown report format {format!r}")
    writer = reports.write.mode(mode).format(format)
    if format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)
