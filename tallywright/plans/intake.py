"""From a folder of CSV uploads to one report per file."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import schema
from tallywright.operators import coerce
from tallywright.operators import mapping as mapper
from tallywright.plans.reports import report, report_json
from tallywright.operators.settle import settle
from tallywright.sources.files import read_uploads


def store_uploads(
    spark: SparkSession, path: str, out: str, domain: str = "sales", mode: str = "errorifexists",
    corrections: DataFrame | None = None, domains: DataFrame | None = None,
) -> DataFrame:
    """Read every CSV file at ``path``, map its columns and store its rows as parquet in ``out``.

    ``corrections`` (file, field, source_column) override the suggested mapping; with ``domains``
    (file, domain) only the files of ``domain`` are taken. The table is partitioned by ``layout``,
    the fields a file has, so a report that differs with the fields reads its own files only.
    Returns the mapping; files without a required field are in it but not in the table (see
    ``mapping.unusable_files``).
    """
    headers, rows = read_uploads(spark, path)
    if domains is not None:
        mine = domains.where(F.col("domain") == domain).select("file")
        headers = headers.join(mine, "file", "left_semi")
    mapping = mapper.map_columns(headers, domain)
    if corrections is not None:
        mapping = mapper.correct_mapping(mapping, headers, corrections)
    mapping = settle(mapping)
    facts = mapper.standard_columns(rows, mapping, domain)
    facts.write.mode(mode).partitionBy("layout").parquet(out)
    return mapping


def reports_of_uploads(
    spark: SparkSession, stored: str, domain: str = "sales", formats: Sequence[str] = (),
    stamp: bool = True,
) -> DataFrame:
    """JSON reports ``(file, part, position, text)`` of the stored uploads.

    Without ``formats``, a file's dates are read in the style of its first one. A report has the
    sections of the fields its file has. There are at most as many layouts as subsets of the
    optional fields, and each is one partition of the table.
    """
    fields = ", ".join(f"{f} STRING" for f in schema.ALIASES[schema.domain_of(domain)])
    table = spark.read.schema(f"file STRING, row BIGINT, {fields}, layout STRING").parquet(stored)
    layouts = sorted(r.layout for r in table.select("layout").distinct().collect())
    reports = []
    for layout in layouts:
        rows = table.where(F.col("layout") == layout).select("file", "row", *layout.split(","))
        if not formats:
            rows = coerce.with_inferred_dates(rows, ("file",), "row")
        made = report(rows.drop("row"), domain, ("file",), formats=formats, stamp=stamp)
        reports.append(report_json(made, ("file",)))
    nothing = spark.createDataFrame([], "file STRING, part INT, position BIGINT, text STRING")
    return reduce(DataFrame.unionByName, reports, nothing)
